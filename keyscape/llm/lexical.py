"""Ranked lexical search over bit-sliced Bloom signatures.

Documents are gathered into blocks of like numbers of terms. A block's signature is a bit matrix: a row for each
signature bit, a column for each document. A term stands in as many levels as its occurrences reach, each level
by a few bits of its own; the rows of these bits, intersected, overestimate which documents hold the term how often.
Sums of slices, weighted by what a term can score at most at that level, bound each document's score, and every
document that the bounds don't exclude is scored exactly from its text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from keyscape.sources.shared import remove, scratch_path

from . import words as w
from .runtime import checkpoint, passes, prepare, slices, text_buffer

U = np.uint64
#: Occurrences from which a term stands in a further level.
LEVELS = np.array([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128])
#: Bits that a level of a term sets, and signature bits for each of them that a document may have (rounded up to a power of two).
BITS, WIDTH = 4, 8
#: Signature bits and documents of a block at most (eight documents at least).
BLOCK_BITS, BLOCK_DOCS = 1 << 22, 1024
_LEVEL_KEYS = w.mix(np.arange(1, len(LEVELS) + 1, dtype=U) * U(0x9FB21C651E98DF25))
_INDEX = "width int, docs long, terms long, ids array<long>, sizes array<long>, slices binary, words binary, df binary"


def _bits(words: np.ndarray, level: int, width: int) -> np.ndarray:
    """(words, BITS) places of a level of these terms in signatures of `width` bits, a power of two."""
    with np.errstate(over="ignore"):
        key = w.mix(words ^ _LEVEL_KEYS[level])
        step = w.mix(key ^ U(0xA0761D6478BD642F)) | U(1)
        return ((key[:, None] + np.arange(BITS, dtype=U) * step[:, None]) & U(width - 1)).astype(np.int64)


def _terms(batch: pa.RecordBatch):
    """(row, term hash, occurrences) of a batch's distinct terms by row, and each row's number of terms."""
    data, ends = text_buffer(batch.column("text"))
    _, _, first, value = w.hashed_words(data, ends, w.ALNUM)
    size = np.diff(first)
    row = np.repeat(np.arange(batch.num_rows), size)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[new], value[new], np.diff(np.append(new, len(row))), size


class _Block:
    """Documents of one signature width that wait to be written."""

    def __init__(self, width: int):
        self.width, self.most = width, max(8, min(BLOCK_DOCS, BLOCK_BITS // width))
        self.ids, self.sizes, self.words, self.counts = [], [], [], []

    def batch(self) -> pa.RecordBatch:
        docs = len(self.ids)
        columns = -(-docs // 8) * 8
        words, counts = (np.concatenate(x) for x in (self.words, self.counts))
        doc = np.repeat(np.arange(docs), [len(x) for x in self.words])
        matrix = np.zeros(self.width * columns, bool)
        for level, least in enumerate(LEVELS):
            has = counts >= least
            if not has.any():
                break
            matrix[(_bits(words[has], level, self.width) * columns + doc[has][:, None]).ravel()] = True
        own, df = np.unique(words, return_counts=True)
        cols = [[self.width], [docs], [sum(self.sizes)], [self.ids], [self.sizes], [np.packbits(matrix).tobytes()], [own.tobytes()], [df.astype(np.int64).tobytes()]]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _INDEX.split(", ")])


def build_index(docs: DataFrame) -> DataFrame:
    """The index of docs(doc_id, text): a row for each block of documents.

    width, ids and sizes (terms with repeats) of the documents, slices (the bit matrix, row by row), words and df
    (the block's distinct terms by hash, and how many of its documents hold each); docs and terms count what the
    block holds. Documents without a term are left out. Each task builds blocks from what it reads; nothing is shuffled.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, _Block] = {}
        for part in slices(batches, "text", 1 << 22):
            row, value, count, size = _terms(part)
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
            levels = np.searchsorted(LEVELS, count, side="right")
            keys = np.bincount(row, levels, part.num_rows).astype(np.int64)
            for r, doc_id in enumerate(part.column("doc_id").to_pylist()):
                if not size[r]:
                    continue
                width = WIDTH << max(int(keys[r] - 1).bit_length(), 3)
                block = blocks.setdefault(width, _Block(width))
                block.ids.append(doc_id)
                block.sizes.append(int(size[r]))
                block.words.append(value[cuts[r] : cuts[r + 1]])
                block.counts.append(count[cuts[r] : cuts[r + 1]])
                if len(block.ids) >= block.most:
                    yield blocks.pop(width).batch()
        for block in blocks.values():
            yield block.batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _INDEX)


class _Items:
    """Items of one pass: their distinct terms, each item's places among them, and what a term weighs."""

    def __init__(self, pairs: list[tuple[int | None, int]]):
        self.ids = sorted({i for i, _ in pairs}, key=lambda x: (x is None, x or 0))
        number = {x: k for k, x in enumerate(self.ids)}
        item = np.array([number[i] for i, _ in pairs], np.int64)
        self.words, term = np.unique(np.array([h % (1 << 64) for _, h in pairs], U), return_inverse=True)
        order = np.lexsort((term, item))
        self.term, self.cut = term[order], np.searchsorted(item[order], np.arange(len(self.ids) + 1))
        by_term = np.lexsort((item, term))
        self.item_of, self.term_cut = item[by_term], np.searchsorted(term[by_term], np.arange(len(self.words) + 1))
        self.weight = np.zeros(len(self.words), np.int64)
        self.docs = self.total = 0

    def weigh(self, df: dict[int, int], docs: int, total: int) -> None:
        self.docs, self.total = docs, total
        self.weight = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1))) if df.get(t) else 0 for t in range(len(self.words))], np.int64)

    def damping(self, sizes: np.ndarray) -> np.ndarray:
        """m of documents of these numbers of terms."""
        own, at = np.unique(sizes, return_inverse=True)
        return np.array([10 + 90 * int(n) * self.docs // self.total for n in own], np.int64)[at]

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of these hashes are terms of some item, the number of each such term)."""
        if not len(self.words):
            return np.zeros(len(words), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        known = self.words[at] == words
        return known, at[known]


def _gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1_000 * tf + 8 * m)


def _bounds(items: _Items, block: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(item, bounds of the block's documents for it) for the items that may match in it."""
    docs, width = len(block["ids"]), block["width"]
    columns = -(-docs // 8)
    matrix = np.frombuffer(block["slices"], np.uint8).reshape(width, columns)
    reach = np.zeros((len(items.words), docs), np.uint8)  # levels that a term reaches in a document, at most
    live = np.flatnonzero(items.weight)
    for level in range(len(LEVELS)):
        at = _bits(items.words[live], level, width)
        rows = matrix[at[:, 0]]
        for k in range(1, BITS):
            rows &= matrix[at[:, k]]
        has = np.unpackbits(rows, axis=1)[:, :docs]
        has &= reach[live] == level
        reach[live] += has
        live = live[has.any(axis=1)]
        if not len(live):
            break
    sizes = np.array(block["sizes"], np.int64)
    m = items.damping(sizes)
    most = np.minimum(np.concatenate([[0], LEVELS[1:] - 1, [np.iinfo(np.int64).max // 2_000_000_000]])[:, None], sizes[None, :])
    gain = _gain(most, m[None, :])
    everywhere = np.arange(docs)
    for i in range(len(items.ids)):
        own = items.term[items.cut[i] : items.cut[i + 1]]
        own = own[reach[own].any(axis=1)]
        if len(own):
            bound = np.zeros(docs, np.int64)
            for t in own:
                bound += items.weight[t] * gain[reach[t], everywhere]
            yield i, bound


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in ("width", "ids", "sizes", "slices")}


def _highest(index: DataFrame, items: _Items, top: int) -> DataFrame:
    """(doc_id) of the documents with the `top` highest bounds of each item, found in each task, then in all."""
    model = index.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, best = model.value, {}
        for block in _blocks(batches):
            ids = block["ids"]
            for i, bound in _bounds(items, block):
                k = min(top, len(bound))
                at = np.argpartition(-bound, k - 1)[:k]
                held = best.get(i, []) + [(-int(bound[a]), ids[a] is None, ids[a] or 0) for a in at]
                best[i] = sorted(held)[:top]
        rows = [(i, -b, None if none else d) for i, held in best.items() for b, none, d in held]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "bound", "doc_id"])

    found = index.select("width", "ids", "sizes", "slices").mapInArrow(run, "item int, bound long, doc_id long")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), F.asc_nulls_last("doc_id"))
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).select("doc_id").distinct()


def _not_excluded(index: DataFrame, items: _Items, least: list[tuple]) -> DataFrame:
    """(doc_id) of all documents whose bound for some item isn't below what its last place needs."""
    model = index.sparkSession.sparkContext.broadcast((items, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, least = model.value
        for block in _blocks(batches):
            ids = np.array([np.iinfo(np.int64).max if x is None else x for x in block["ids"]], np.int64)
            keep = np.zeros(len(ids), bool)
            for i, bound in _bounds(items, block):
                score, last = least[i]
                keep |= (bound > 0) & ((bound > score) | ((bound == score) & (ids <= last)))
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array([x for x, k in zip(block["ids"], keep, strict=True) if k], pa.int64())], ["doc_id"])

    return index.select("width", "ids", "sizes", "slices").mapInArrow(run, "doc_id long").distinct()


def _exact(docs: DataFrame, ids: DataFrame, items: _Items, least: list[tuple], most_ids: int) -> DataFrame:
    """(item, doc_id, score) of the documents of these ids, from their texts: scores above 0 that reach what the last place needs."""
    model = docs.sparkSession.sparkContext.broadcast((items, least))
    ids = checkpoint(ids)
    few = F.broadcast(ids) if ids.count() <= most_ids else ids
    few = few.withColumnRenamed("doc_id", "id")
    texts = docs.join(few, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, least = model.value
        need = np.array([x for x, _ in least], np.int64)
        for part in slices(batches, "text", 1 << 21):
            row, value, count, size = _terms(part)
            known, term = items.places(value)
            row, count = row[known], count[known]
            if not len(row):
                continue
            got = items.weight[term] * _gain(count, items.damping(np.maximum(size, 1))[row])
            ids = part.column("doc_id")
            for lo in range(0, part.num_rows, 256):  # scores of 256 documents for all items at a time
                a, b = np.searchsorted(row, (lo, lo + 256))
                wide = items.term_cut[term[a:b] + 1] - items.term_cut[term[a:b]]
                at = np.repeat(items.term_cut[term[a:b]] - np.concatenate([[0], np.cumsum(wide)[:-1]]), wide) + np.arange(wide.sum())
                pair = np.repeat(row[a:b] - lo, wide) * len(items.ids) + items.item_of[at]
                own, where = np.unique(pair, return_inverse=True)
                score = np.zeros(len(own), np.int64)
                np.add.at(score, where, np.repeat(got[a:b], wide))
                item = own % len(items.ids)
                keep = (score > 0) & (score >= need[item])
                if keep.any():
                    doc = ids.take(pa.array(own[keep] // len(items.ids) + lo))
                    yield pa.RecordBatch.from_arrays([pa.array(item[keep].astype(np.int32)), doc, pa.array(score[keep])], ["item", "doc_id", "score"])

    return texts.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, *, top: int = 10, part_terms: int = 1 << 18, most_ids: int = 200_000) -> DataFrame:
    """The `top` highest-scoring documents of docs(doc_id, text) for each of items(item_id, text).

    Returns item_id, rank (from 1), doc_id and score. Terms are runs of letters, digits and non-ASCII characters, A-Z
    lower-cased, compared by 64-bit hashes. With N documents that have terms, L terms in all, n those of a
    document, df the documents with a term and tf its occurrences in one, a term weighs
    w = floor(1000 * ln((2N + 2) / (2df + 1))) and a document scores the sum of w * (10**9 * tf div (1000 * tf + 8 * m))
    over the item's distinct terms, m = 10 + 90 * n * N div L. Scores above 0 count; equal ones rank by doc_id.

    `build_index` writes the signatures to the shared folder. Items take passes of `part_terms` distinct terms (or
    one larger item), the bound of what is known to all tasks and the driver. A pass reads the index twice: first the
    documents of the `top` highest bounds are scored, and then all others whose bound isn't below the last place
    so found. Ids of candidates are broadcast up to `most_ids`, and joined by a shuffle beyond. No cap: where bounds
    exclude little (a term in few documents, many equal scores), more texts are scored.

    Defined results: null texts and items have no terms; an item without terms, or with none that a document
    holds, has no rows; rows of one item_id are one item with the terms of all (null ids one item too); repeated
    documents each count and rank for themselves, those of equal score and doc_id in any order (null ids last);
    empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 22):
            row, value, _, _ = _terms(part)
            yield pa.RecordBatch.from_arrays([part.column("item_id").take(pa.array(row)), pa.array(value.view(np.int64))], ["item_id", "h"])

    path = scratch_path(spark, "signatures")
    build_index(docs).write.parquet(path)
    index = spark.read.parquet(path)
    size = index.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("terms"), F.lit(0)).alias("l")).first()
    terms = checkpoint(items.mapInArrow(terms_of, "item_id long, h long").distinct())
    out = None
    for here in passes(terms.withColumn("n", F.lit(1)), ["item_id"], "n", part_terms):
        part = _Items([tuple(r) for r in here.select("item_id", "h").collect()])
        model = spark.sparkContext.broadcast(part)

        def count_in(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            items = model.value
            df = np.zeros(len(items.words), np.int64)
            for batch in batches:
                for words, counts in zip(batch.column("words").to_pylist(), batch.column("df").to_pylist(), strict=True):
                    known, at = items.places(np.frombuffer(words, U))
                    df[at] += np.frombuffer(counts, np.int64)[known]
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], ["t", "df"])

        df = index.select("words", "df").mapInArrow(count_in, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).collect()
        part.weigh({r["t"]: r["df"] for r in df}, size["n"], size["l"])
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        none = [(0, np.iinfo(np.int64).max)] * len(part.ids)
        first = _exact(docs, _highest(index, part, top), part, none, most_ids)
        last = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") == top).collect()
        least = list(none)
        for r in last:
            least[r["item"]] = (r["score"], np.iinfo(np.int64).max if r["doc_id"] is None else r["doc_id"])
        ranked = _exact(docs, _not_excluded(index, part, least), part, least, most_ids).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(part.ids)), "item int, item_id long")
        found = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    remove(spark, path)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
