"""Benchmark passages in documents, found by an FM-index of each training shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as w
from .fm_index import FMIndex
from .runtime import checkpoint, passes, prepare, slices, text_buffer

U = np.uint64
#: Bytes of carried documents that wait for an index or to be handed on, in a task.
HELD_BYTES = 1 << 25
_OUT = "row long, doc_id long, n_words long, first_word array<long>, end_word array<long>, first_char array<long>, end_char array<long>, items array<long>"


class Phrases:
    """Test phrases: all runs of `window` words of each benchmark item (an item of fewer words is one phrase).

    items: (item_id, text) pairs; null texts have no words, null ids name no item but have phrases.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        text = pa.array([t for _, t in items], pa.string())
        data, ends = text_buffer(text)
        start, stop, first = w.words(data, ends, w.ALNUM)
        word = w.hashes(data, start, stop)
        self.vocab = np.unique(word)
        ids = np.searchsorted(self.vocab, word) + 2  # 0 ends the text, 1 parts runs
        found: dict[tuple, set[int]] = {}
        for k, (item, _) in enumerate(items):
            own = ids[first[k] : first[k + 1]]
            size = min(window, len(own))
            for i in range(len(own) - size + 1 if size else 0):
                found.setdefault(tuple(own[i : i + size].tolist()), set()).update(() if item is None else (item,))
        self.lengths = np.array([len(p) for p in found], np.int64)
        width = int(self.lengths.max(initial=1))
        self.patterns = np.zeros((len(found), width), np.int64)
        for k, p in enumerate(found):
            self.patterns[k, width - len(p) :] = p
        self.items = [sorted(v) for v in found.values()]
        self.least = int(self.lengths.min(initial=window))
        pairs = {(a, b) for p in found for a, b in zip(p, p[1:], strict=False)}
        self.pairs = np.array(sorted(a * (len(self.vocab) + 2) + b for a, b in pairs), np.int64)

    def ids(self, word: np.ndarray) -> np.ndarray:
        """The number of each word hash; 0 for words of no phrase."""
        if not len(self.vocab):
            return np.zeros(len(word), np.int64)
        at = np.minimum(np.searchsorted(self.vocab, word), len(self.vocab) - 1)
        return np.where(self.vocab[at] == word, at + 2, 0)

    def runs(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[lo, hi) of the word runs that can hold a phrase: known words, neighbours of some phrase, long enough."""
        known = ids > 0
        join = np.zeros(len(ids), bool)  # word k belongs to the run of word k - 1
        if len(ids) > 1 and len(self.pairs):
            both = np.flatnonzero(known[1:] & known[:-1]) + 1
            code = ids[both - 1] * (len(self.vocab) + 2) + ids[both]
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            join[both] = self.pairs[at] == code
        join[first[first < len(ids)]] = False
        lo = np.flatnonzero(known & ~join)
        hi = np.flatnonzero(known & ~np.append(join[1:], False)) + 1
        keep = hi - lo >= self.least
        return lo[keep], hi[keep]


class _Shard:
    """Rows waiting for an index: their run words, and where each stands in its document."""

    def __init__(self):
        self.rows, self.size, self.held = [], 0, 0

    def flush(self, phrases: Phrases, rate: int) -> list[tuple]:
        seqs = [np.append(r[3], 1) for r in self.rows]
        out = []
        covered: dict[int, np.ndarray] = {}
        hits: dict[int, set[int]] = {}
        if self.size and len(phrases.lengths):
            owner = np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
            base = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
            index = FMIndex(np.concatenate(seqs), len(phrases.vocab) + 2, rate)
            lo, hi = index.search(phrases.patterns, phrases.lengths)
            some = np.flatnonzero(hi > lo)
            count = hi[some] - lo[some]
            rows = np.repeat(lo[some] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            phrase = np.repeat(some, count)
            place = index.locate(rows)
            change = np.zeros(len(owner) + 1, np.int64)
            np.add.at(change, place, 1)
            np.add.at(change, place + phrases.lengths[phrase], -1)
            inside = np.cumsum(change[:-1]) > 0
            for d in np.unique(owner[place]):
                covered[d] = inside[base[d] : base[d + 1]][:-1]
            for d, p in {*zip(owner[place].tolist(), phrase.tolist(), strict=True)}:
                hits.setdefault(d, set()).update(phrases.items[p])
        for d, (row, doc_id, n_words, _, word_no, begin, end, doc) in enumerate(self.rows):
            spans = ([], [], [], [])
            if d in covered:
                at = np.flatnonzero(covered[d])
                if len(at):
                    new = np.concatenate([[True], word_no[at][1:] != word_no[at][:-1] + 1])
                    last = np.append(new[1:], True)
                    spans = (word_no[at][new], word_no[at][last] + 1, begin[at][new], end[at][last])
            out.append((row, doc_id, n_words, *(list(map(int, s)) for s in spans), sorted(hits.get(d, ())), doc))
        self.rows, self.size, self.held = [], 0, 0
        return out


def _batch(rows: list[tuple], doc: pa.DataType | None) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 5 + ([] if doc is None else [doc])
    names = [x.split()[0] for x in _OUT.split(", ")] + ([] if doc is None else ["doc"])
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=False)], names)


def _scan(docs: DataFrame, phrases: Phrases, shard_words: int, rate: int) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(phrases)
    carried = "doc" in docs.columns
    schema = _OUT + (f", doc {docs.schema['doc'].dataType.simpleString()}" if carried else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, shard, ready, kind, waiting = model.value, _Shard(), [], None, 0
        for part in slices(batches, "text"):
            kind = part.schema.field("doc").type if carried else None
            held = part.column("doc").to_pylist() if carried else [None] * part.num_rows
            data, ends = text_buffer(part.column("text"))
            start, stop, first = w.words(data, ends, w.ALNUM)
            word = w.hashes(data, start, stop)
            ids = phrases.ids(word)
            lo, hi = phrases.runs(ids, first)
            size = np.diff(ends) if carried else np.zeros(part.num_rows, np.int64)
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)]) if len(lo) else None
            of = np.searchsorted(first, lo, side="right") - 1
            cut = np.searchsorted(of, np.arange(part.num_rows + 1))
            for r, (row, doc_id) in enumerate(zip(part.column("row").to_pylist(), part.column("doc_id").to_pylist(), strict=True)):
                runs = range(cut[r], cut[r + 1])
                at = [np.arange(lo[k], hi[k]) for k in runs]
                seq = [x for k, a in enumerate(at) for x in ((ids[a],) if k == 0 else ([1], ids[a]))]
                pad = np.array([-2])  # stands where a 1 parts two runs, so that spans end there
                no = [x for k, a in enumerate(at) for x in ((a - first[r],) if k == 0 else (pad, a - first[r]))]
                begin = [x for k, a in enumerate(at) for x in ((chars[start[a]] - chars[ends[r]],) if k == 0 else (pad, chars[start[a]] - chars[ends[r]]))]
                end = [x for k, a in enumerate(at) for x in ((chars[stop[a]] - chars[ends[r]],) if k == 0 else (pad, chars[stop[a]] - chars[ends[r]]))]
                none = np.zeros(0, np.int64)
                cat = [np.concatenate(x) if x else none for x in (seq, no, begin, end)]
                if not len(cat[0]):
                    ready.append((row, doc_id, int(first[r + 1] - first[r]), [], [], [], [], [], held[r]))
                    waiting += int(size[r])
                    continue
                shard.rows.append((row, doc_id, int(first[r + 1] - first[r]), *cat, held[r]))
                shard.size += len(cat[0])
                shard.held += int(size[r])
                if shard.size >= shard_words or shard.held >= HELD_BYTES:
                    waiting += shard.held
                    ready += shard.flush(phrases, rate)
            if len(ready) >= 5_000 or waiting >= HELD_BYTES:
                yield _batch(ready, kind)
                ready, waiting = [], 0
        if ready or shard.rows:
            yield _batch(ready + shard.flush(phrases, rate), kind)

    return docs.mapInArrow(run, schema)


def _pieces(items: DataFrame, window: int, most: int) -> DataFrame:
    """(item_id, text, size) of runs of `most` words of each item, all of whose windows lie in one of them; size is their words, or a 16th of their bytes if that is more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, ends = text_buffer(part.column("text"))
            start, stop, first, _ = w.hashed_words(data, ends, w.ALNUM)
            rows = []
            for r, item in enumerate(part.column("item_id").to_pylist()):
                a, b = int(first[r]), int(first[r + 1])
                for lo in range(a, max(b - window + 1, a + 1), most - window + 1) if b > a else ():
                    hi = min(lo + most, b)
                    text = data[start[lo] : stop[hi - 1]].tobytes().decode()
                    rows.append((item, text, max(hi - lo, int(stop[hi - 1] - start[lo]) // 16)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64()), strict=True)], ["item_id", "text", "size"])

    return items.mapInArrow(run, "item_id long, text string, size long")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose spans of several passes are put in order and joined where their words meet; items once."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            lo, hi, begin, end = (np.array(r[c], np.int64) for c in ("first_word", "end_word", "first_char", "end_char"))
            order = np.argsort(lo, kind="stable")
            lo, begin, hi, end = lo[order], begin[order], np.maximum.accumulate(hi[order]), np.maximum.accumulate(end[order])
            new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]])) if len(lo) else np.zeros(0, np.int64)
            last = np.append(new[1:] - 1, len(lo) - 1)[: len(new)]
            spans = [x.tolist() for x in (lo[new], hi[last], begin[new], end[last])]
            out.append((r["row"], r["doc_id"], r["n_words"], *spans, sorted(set(r["items"]))))
        columns = list(zip(*out, strict=True)) if out else [[]] * 8
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _OUT.split(", ")])


def removal_spans(
    docs: DataFrame, benchmark: DataFrame, *, window: int = 13, shard_words: int = 1 << 18, part_words: int = 1 << 20, rate: int = 8, carry: list[str] | None = None
) -> DataFrame:
    """Where passages of benchmark(item_id, text) stand in docs(doc_id, text).

    Returns, for each row of docs: doc_id, n_words, n_hit (words inside an occurrence
    of a phrase), items (sorted item_ids with occurring phrases), words and chars
    (merged removal spans as arrays of start/end, in words and in code points) and
    contaminated (n_hit > 0 and 20 * n_hit >= n_words); with `carry`, also the row's
    columns of these names, as the struct doc.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; a
    phrase is `window` consecutive words of an item, or all words of a shorter one. Words
    are compared by 64-bit hashes, never by their bytes: two pass for equal with a chance of 5e-20.
    A task indexes its documents in shards of about `shard_words` words. What can't lie
    in a phrase (words of no phrase, neighbours that are neighbours in none) is left
    out of the index and parts its text, which loses no occurrence.

    The phrases reach the tasks in parts of `part_words` benchmark words, the bound of
    what is collected and broadcast; a larger benchmark takes a pass for each part. Equal items are taken once, and
    an item of more than a quarter of a part in runs that overlap by all but one of a window's words; no pass is empty.

    Defined results: null and empty texts have no words and no hits; null item texts
    have no phrases; those of a null item_id count for n_hit, and are in no items (so not
    in n_items); repeated documents and items count each for itself (an item_id
    once); a null doc_id is kept; an empty benchmark hits nothing; other columns are
    ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    doc = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc")] if carry else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *doc)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    parts = passes(checkpoint(_pieces(items, window, max(window, part_words // 4))), ["item_id", "text"], "size", part_words)
    # all passes read the same numbers: a number is given once, and written
    many = len(parts) > 1
    rows = checkpoint(docs.withColumn("row", F.monotonically_increasing_id())) if many else docs.withColumn("row", F.lit(0).cast("long"))
    found = None
    kept = ["doc"] if carry else []
    if not parts:
        found = _scan(rows, Phrases([], window), shard_words, rate)
    for own in parts:
        here = _scan(rows.drop("doc") if many else rows, Phrases([tuple(r) for r in own.select("item_id", "text").collect()], window), shard_words, rate)
        found = here if found is None else found.unionByName(here)
    if many:
        flat = lambda c: F.flatten(F.collect_list(c)).alias(c)  # noqa: E731  at most all words of a document for each pass
        found = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *map(flat, ("first_word", "end_word", "first_char", "end_char", "items")))
        found = found.mapInArrow(_merged, _OUT)
        if carry:
            found = found.join(rows.select("row", "doc"), "row")
    out = found.select(
        *kept, "doc_id", "n_words", "items",
        F.arrays_zip(F.col("first_word").alias("a"), F.col("end_word").alias("b")).alias("words"),
        F.arrays_zip(F.col("first_char").alias("a"), F.col("end_char").alias("b")).alias("chars"),
    )
    n_hit = F.aggregate("words", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return out.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def digest(found: DataFrame) -> DataFrame:
    """The counts of `removal_spans` with a digest of the item ids, as strings in order, and spans: start:end in words, comma-joined."""
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated",
        F.array_join(F.transform("words", lambda s: F.concat_ws(":", s["a"].cast("string"), s["b"].cast("string"))), ",").alias("spans"),
    )
