"""Exact repeats of long word runs across all documents, found by fixed-block anchors.

Every document is a row of non-overlapping blocks of half a window. Any window that repeats elsewhere covers a whole
block of its other place, so it holds a run equal to that block. Blocks are the index and all rolling runs of
their length are the probes; both are hashed and meet in partitions of their hashes. A run that meets a block
elsewhere is a hit, and hits are extended: the windows around them are compared whole, with the first of equal ones kept.
Windows that follow one another merge into maximal repeats.

Between tasks, hashes and places travel packed: a row for each slice of documents and partition, not for each word.
Within a slice only the first of equal runs travels, so no partition gets more of a common passage than one of it a slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as w
from .runtime import checkpoint, prepare, slices, text_buffer

U = np.uint64
_KEY = ["none", "id", "hash"]
_PACKED = "part int, slice long, low binary, high binary, at binary, docs binary"
_BACK = "slice long, at binary, docs binary"


def encode(values: np.ndarray) -> bytes:
    """Ascending numbers as their differences, byte by byte: all lowest bytes first, as many as the largest needs."""
    d = np.diff(values.astype(U), prepend=U(0))
    k = max((int(d.max()).bit_length() + 7) // 8, 1) if len(d) else 0
    return bytes([k]) + d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes()


def decode(data: bytes) -> np.ndarray:
    """The numbers that `encode` packed."""
    if data[0] == 0:
        return np.zeros(0, U)
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    d = np.zeros((planes.shape[1], 8), np.uint8)
    d[:, : data[0]] = planes.T
    return np.cumsum(d.view("<u8").ravel(), dtype=U)


def _longs(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, np.int64).reshape(columns, -1)


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(0, np.int64)
    return list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))


def _dealt(number: int, parts: int, value: np.ndarray, low: np.ndarray, high: np.ndarray | None, at: np.ndarray, known: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    """A slice's packed rows: one for each partition of `value`, and one with what it knows itself and its documents."""
    part = (value % U(parts)).astype(np.int64)
    order = np.lexsort((at, part))
    part, low, at = part[order], low[order], at[order]
    high = None if high is None else high[order]
    runs = _runs(part)
    cols = [
        pa.array(np.append(part[[a for a, _ in runs]], number % parts).astype(np.int32)), pa.array(np.full(len(runs) + 1, number)),
        pa.array([low[a:b].tobytes() for a, b in runs] + [None], pa.binary()), pa.array([None if high is None else high[a:b].tobytes() for a, b in runs] + [None], pa.binary()),
        pa.array([encode(at[a:b]) for a, b in runs] + [encode(known)], pa.binary()), pa.array([None] * len(runs) + [docs.astype(np.int64).tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in _PACKED.split(", ")])


def _gathered(table: pa.Table):
    """A partition's packed rows: (low, high, places, slice of each), and the rows of slices themselves."""
    rows = table.select(["slice", "low", "high", "at", "docs"]).to_pylist()
    own = [r for r in rows if r["docs"] is None]
    at = [decode(r["at"]) for r in own]
    low = np.frombuffer(b"".join(r["low"] for r in own), np.uint32)
    high = np.frombuffer(b"".join(r["high"] or b"" for r in own), U)
    of = np.repeat(np.array([r["slice"] for r in own], np.int64), [len(x) for x in at])
    return low, high, np.concatenate(at) if at else np.zeros(0, U), of, [r for r in rows if r["docs"] is not None]


def _returned(of: np.ndarray, at: np.ndarray, own: list[dict]) -> pa.Table:
    """Places sent back to their slices, and the slices' own rows."""
    order = np.lexsort((at, of))
    of, at = of[order], at[order]
    rows = [(int(of[a]), encode(at[a:b]), None) for a, b in _runs(of)] + [(r["slice"], r["at"], r["docs"]) for r in own]
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["slice", "at", "docs"])


def _equal(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by these keys, the last first; where runs equal in all but the first begin)."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys[1:]:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.flatnonzero(new)


def _numbers(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], np.int64)


def _probes(docs: DataFrame, block: int, parts: int, slice_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, part in enumerate(slices(batches, "text", slice_bytes)):
            data, ends = text_buffer(part.column("text"))
            _, _, first, word = w.hashed_words(data, ends, w.SPACED, lower=False)
            place, value = w.rolling(word, first, block)
            aligned = (place - first[np.searchsorted(first, place, side="right") - 1]) % block == 0
            order, new = _equal(place, value)
            many = np.diff(np.append(new, len(order))) > 1
            some = np.maximum.reduceat(aligned[order].astype(np.int64), new) if len(new) else np.zeros(0, np.int64)
            known = np.sort(place[order[np.repeat(many, np.diff(np.append(new, len(order))))]])
            own = order[new]  # the first of equal runs
            code = place[own] * 4 + some + 2 * many
            listed = np.vstack([_numbers(part, _KEY), first[:-1], np.diff(first)])
            yield _dealt(TaskContext.get().partitionId() << 24 | k, parts, value[own], (value[own] >> U(32)).astype(np.uint32), None, code.astype(U), known.astype(U), listed)

    return docs.mapInArrow(run, _PACKED)


def _meet(table: pa.Table) -> pa.Table:
    """Runs that meet a block of another slice (those that do so in their own are known)."""
    low, _, code, of, own = _gathered(table)
    order, new = _equal(code, low)
    if len(new):
        size = np.diff(np.append(new, len(order)))
        hit = np.repeat((size > 1) & (np.bitwise_or.reduceat(code[order], new) & U(1) == 1), size)
        order = order[hit & (code[order] & U(2) == 0)]
    return _returned(of[order], code[order] >> U(2), own)


def _hits(table: pa.Table) -> pa.Table:
    """A slice's hits by document: (key, n_words, places in the document)."""
    rows = table.to_pylist()
    none, ids, hashes, first, size = _longs(next(r["docs"] for r in rows if r["docs"] is not None), 5)
    at = np.unique(np.concatenate([decode(r["at"]) for r in rows])).astype(np.int64)
    doc = np.searchsorted(first, at, side="right") - 1
    own, cut = np.unique(doc, return_index=True)
    packed = [encode(x - first[d]) for d, x in zip(own, np.split(at, cut[1:]), strict=True)] if len(own) else []
    return pa.table([pa.array(none[own]), pa.array(ids[own]), pa.array(hashes[own]), pa.array(size[own]), pa.array(packed, pa.binary())], names=[*_KEY, "n_words", "at"])


def _windows(docs: DataFrame, window: int, block: int, parts: int, slice_bytes: int) -> DataFrame:
    """The windows around hits, by two hashes of their words and their place in all documents' words (base + place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, part in enumerate(slices(batches, "text", slice_bytes)):
            data, ends = text_buffer(part.column("text"))
            _, _, first, word = w.hashed_words(data, ends, w.SPACED, lower=False)
            change = np.zeros(len(word) + 1, np.int64)
            for r, at in enumerate(part.column("at").to_pylist()):
                hit = decode(at).astype(np.int64)
                np.add.at(change, first[r] + np.maximum(hit - (window - block), 0), 1)
                np.add.at(change, first[r] + hit + 1, -1)
            around = np.cumsum(change[:-1]) > 0
            place, value = w.rolling(word, first, window)
            _, second = w.rolling(word, first, window, 0xC2B2AE3D27D4EB4F)
            keep = around[place]
            place, value, second = place[keep], value[keep], second[keep].astype(np.uint32)
            row = np.searchsorted(first, place, side="right") - 1
            listed = np.vstack([_numbers(part, [*_KEY, "base"]), np.diff(first)])
            at = (listed[3][row] + place - first[row]).astype(U)
            order, new = _equal(at, second, value)
            own = order[new]
            later = at[order] > np.repeat(at[own], np.diff(np.append(new, len(order))))
            listed = listed[:, np.unique(listed[3], return_index=True)[1]]
            yield _dealt(TaskContext.get().partitionId() << 24 | k, parts, value[own], second[own], value[own], at[own], np.unique(at[order][later]), listed)

    return docs.mapInArrow(run, _PACKED)


def _later(table: pa.Table) -> pa.Table:
    """Windows that are equal to an earlier one of another slice."""
    low, high, at, of, own = _gathered(table)
    order, new = _equal(at, low, high)
    if len(new):
        order = order[at[order] > np.repeat(at[order[new]], np.diff(np.append(new, len(order))))]
    return _returned(of[order], at[order], own)


def _repeated(table: pa.Table) -> pa.Table:
    """A slice's repeated windows by document: (key, places in the document)."""
    rows = table.to_pylist()
    none, ids, hashes, base, _ = _longs(next(r["docs"] for r in rows if r["docs"] is not None), 5)
    at = np.unique(np.concatenate([decode(r["at"]) for r in rows])).astype(np.int64)
    own, cut = np.unique(np.searchsorted(base, at, side="right") - 1, return_index=True)
    packed = [encode(x - base[d]) for d, x in zip(own, np.split(at, cut[1:]), strict=True)] if len(own) else []
    return pa.table([pa.array(none[own]), pa.array(ids[own]), pa.array(hashes[own]), pa.array(packed, pa.binary())], names=[*_KEY, "at"])


def _placed(hits: DataFrame, slots: int) -> DataFrame:
    """The documents with hits and `base`, the words of all documents before them in order."""
    ranged = checkpoint(hits.repartitionByRange(slots, *_KEY).withColumn("slot", F.spark_partition_id()))
    sums, total = [], 0
    for slot, n in sorted((r["slot"], r["n"]) for r in ranged.groupBy("slot").agg(F.sum("n_words").alias("n")).collect()):
        sums.append((slot, total))
        total += n
    offsets = hits.sparkSession.createDataFrame(sums, "slot int, offset long")
    before = Window.partitionBy("slot").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("before", F.coalesce(F.sum("n_words").over(before), F.lit(0))).join(F.broadcast(offsets), "slot").select(*_KEY, (F.col("offset") + F.col("before")).alias("base"), "at")


def repeats(docs: DataFrame, *, window: int = 20, part_bytes: int = 1 << 26, slice_bytes: int = 1 << 23) -> DataFrame:
    """What of docs(doc_id, text) repeats an earlier run of `window` words.

    Returns for each row: doc_id, n_words, n_removed (words that lie in a window which also starts earlier: in a
    smaller doc_id, or before in the same document), removed (maximal runs of such words, as start and end in words)
    and kept (the other words, joined by single blanks). Words are what white space (0x20, 0x09-0x0D) parts, unchanged.

    Blocks have half a window, so each window covers one. Hits are found by 32 bits of a hash within a partition, which can
    only bring more windows to compare; windows are equal by 96 bits of two hashes of their words' 64-bit hashes, never
    by their bytes. A slice of about `slice_bytes` of text is held as numbers by one task (a longer text is a slice of
    its own, hashed in strips); a partition gets what `part_bytes` of text have. Texts are shuffled once, by document;
    rows are sorted within tasks, so that a task that runs again makes the same slices.

    Defined results: null and empty texts have no words; fewer words than a window repeat nothing; a null doc_id comes
    after all others; different texts of one doc_id are ordered by their hash; rows with the same doc_id and the same text
    are one document, each with its result; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    block = window // 2
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.col("doc_id").isNull()
    docs = docs.select(none.cast("long").alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    parts = max(512, size // part_bytes)
    probes = _probes(docs.sortWithinPartitions(*_KEY), block, parts, slice_bytes)
    hits = probes.groupBy("part").applyInArrow(_meet, _BACK).groupBy("slice").applyInArrow(_hits, "none long, id long, hash long, n_words long, at binary")
    hits = hits.filter(F.col("n_words") >= window).groupBy(*_KEY).agg(F.max("n_words").alias("n_words"), F.max("at").alias("at"))
    placed = checkpoint(_placed(hits, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    around = docs.join(placed, _KEY).sortWithinPartitions(*_KEY)
    later = _windows(around, window, block, parts, slice_bytes).groupBy("part").applyInArrow(_later, _BACK)
    found = later.groupBy("slice").applyInArrow(_repeated, "none long, id long, hash long, at binary").groupBy(*_KEY).agg(F.max("at").alias("at"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 21):
            data, ends = text_buffer(part.column("text"))
            start, stop, first, _ = w.hashed_words(data, ends, w.SPACED, lower=False)
            gone, removed, kept = [], [], []
            for r, at in enumerate(part.column("at").to_pylist()):
                a, b = first[r], first[r + 1]
                change = np.zeros(b - a + 1, np.int64)
                if at is not None:
                    place = decode(at).astype(np.int64)
                    change[place] += 1
                    np.add.at(change, place + window, -1)
                out = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]])))
                gone.append(int(out.sum()))
                removed.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
                stay = a + np.flatnonzero(~out)
                kept.append(" ".join(data[x:y].tobytes().decode() for x, y in zip(start[stay].tolist(), stop[stay].tolist(), strict=True)))
            cols = [part.column("none"), part.column("id"), pa.array(np.diff(first)), pa.array(gone, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["none", "id", "n_words", "n_removed", "removed", "kept"])

    schema = "none long, id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string"
    out = docs.join(found, _KEY, "left").select("none", "id", "text", "at").mapInArrow(cut, schema)
    return out.select(F.when(F.col("none") == 0, F.col("id")).alias("doc_id"), "n_words", "n_removed", "removed", "kept")


def digest(found: DataFrame) -> DataFrame:
    """The counts of `repeats`, with a digest of the words that stay."""
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
