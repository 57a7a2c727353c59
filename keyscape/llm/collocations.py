"""Collocations: phrases of two and three words that stand together more often than their parts do.

Phrases are counted in a HAT-trie for each task: a shallow trie of word ids over hash containers that burst
when they grow. When a task holds too many phrases, whole subtrees leave it as sorted runs, and the runs of
each prefix partition are merged into the counts of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import words as w
from .runtime import checkpoint, prepare, slices, text_buffer

U = np.uint64
#: Bits of a word id in a packed phrase; id 0 stands where a piece has ended.
_ID = 21
#: Bytes that part pieces: . , ; : ! ? and 0x0A-0x0D; blanks and tabs part words.
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


class _Container:
    """Counts of the packed phrases of one subtree; additions wait until they outnumber what is counted."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts, self.waiting, self.more = keys, counts, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.more += len(keys)
        if self.more > max(4_096, len(self.keys)):
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            parts = [(self.keys, self.counts), *self.waiting]
            self.keys, self.counts = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            self.waiting, self.more = [], 0


class HatTrie:
    """Counts of phrases of three word ids, packed into one number each.

    A leaf is a container of the phrases from its lowest one to the next leaf's. Beyond `burst` phrases it bursts
    at a word boundary: between two first words, or, if all of its half share the first word, between two second
    (third) words below it.
    """

    def __init__(self, burst: int = 1 << 16):
        self.burst, self.low, self.leaves = burst, [0], [_Container(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def __len__(self) -> int:
        return sum(len(x.keys) + x.more for x in self.leaves)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds counts of distinct packed phrases in ascending order."""
        cuts = np.append(np.searchsorted(keys, self.low), len(keys))
        for k in range(len(self.leaves) - 1, -1, -1):
            if cuts[k] < cuts[k + 1]:
                self.leaves[k].add(keys[cuts[k] : cuts[k + 1]], counts[cuts[k] : cuts[k + 1]])
                self._burst(k)

    def _burst(self, k: int) -> None:
        if len(self.leaves[k].keys) + self.leaves[k].more <= 2 * self.burst:
            return
        leaf = self.leaves[k]
        leaf.settle()
        if len(leaf.keys) <= self.burst:
            return
        middle = int(leaf.keys[len(leaf.keys) // 2])
        cut = next(c for c in ((middle >> s) << s for s in (2 * _ID, _ID, 0)) if c > self.low[k])
        at = int(np.searchsorted(leaf.keys, cut))
        self.leaves[k : k + 1] = [_Container(leaf.keys[:at], leaf.counts[:at]), _Container(leaf.keys[at:], leaf.counts[at:])]
        self.low.insert(k + 1, cut)

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Takes the largest subtrees out until `keep` phrases are left: their phrases in order, and counts."""
        for leaf in self.leaves:
            leaf.settle()
        taken, left = [], len(self)
        for leaf in sorted(self.leaves, key=lambda x: -len(x.keys)):
            if left <= keep:
                break
            taken.append((leaf.keys, leaf.counts))
            left -= len(leaf.keys)
            leaf.keys, leaf.counts = leaf.keys[:0], leaf.counts[:0]
        if not taken:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts = (np.concatenate(x) for x in zip(*taken, strict=True))
        order = np.argsort(keys)
        return keys[order], counts[order]


def _words_of(batch: pa.RecordBatch):
    """(bytes, start, stop, row, hash, whether the next word follows in the same piece) of a batch's words; hashes differ by language."""
    data, ends = text_buffer(batch.column("text"))
    start, stop, first, value = w.hashed_words(data, ends, _WORD)
    row = np.repeat(np.arange(batch.num_rows), np.diff(first))
    lang = batch.column("lang_hash").to_numpy(zero_copy_only=False).view(U)
    value = np.maximum(w.mix(value ^ w.mix(lang)[row]), U(1))
    breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
    follows = np.zeros(len(start), bool)
    follows[:-1] = (row[1:] == row[:-1]) & (breaks[start[1:]] == breaks[stop[:-1]])
    return data, start, stop, row, value, follows


def _count_words(docs: DataFrame, most: int) -> DataFrame:
    """(lang, word, h, f) of each task's words, at most about `most` words held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, text, langs = np.zeros(0, U), np.zeros(0, np.int64), [], []

        def out() -> pa.RecordBatch:
            order = np.argsort(np.concatenate([x for x, _ in text])) if text else []
            words = pa.concat_arrays([x for _, x in text]).take(pa.array(order)) if text else pa.array([], pa.large_string())
            lang = pa.concat_arrays(langs).take(pa.array(order)) if text else pa.array([], pa.string())
            return pa.RecordBatch.from_arrays([lang.cast(pa.string()), words.cast(pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "word", "h", "f"])

        for part in slices(batches, "text", 1 << 22):
            data, start, stop, row, value, _ = _words_of(part)
            own, at, n = np.unique(value, return_index=True, return_counts=True)
            place = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
            old = keys[place] == own if len(keys) else np.zeros(len(own), bool)
            counts[place[old]] += n[old]
            new = at[~old]
            if len(new):
                text.append((own[~old], w.strings(w.LOWER[data], start[new], stop[new])))
                langs.append(part.column("lang").take(pa.array(row[new])))
                keys, counts = np.concatenate([keys, own[~old]]), np.concatenate([counts, n[~old]])
                order = np.argsort(keys)
                keys, counts = keys[order], counts[order]
            if len(keys) >= most:
                yield out()
                keys, counts, text, langs = np.zeros(0, U), np.zeros(0, np.int64), [], []
        if len(keys):
            yield out()

    return docs.mapInArrow(run, "lang string, word string, h long, f long")


def _runs(docs: DataFrame, parts: int, hot: np.ndarray, held: int) -> DataFrame:
    """Sorted runs (part, w1, w2, w3, n) of phrase counts: word hashes and counts as packed columns."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    limit = (1 << _ID) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        trie, known, code, by_id = HatTrie(), np.zeros(0, U), np.zeros(0, np.int64), [np.zeros(1, U)]

        def out(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(keys):
                return
            names = np.concatenate(by_id)
            w1, w2, w3 = (names[(keys >> s) & limit] for s in (2 * _ID, _ID, 0))
            at = np.minimum(np.searchsorted(hot, w1), max(len(hot) - 1, 0))
            deep = hot[at] == w1 if len(hot) else np.zeros(len(w1), bool)
            with np.errstate(over="ignore"):
                deal = w.mix(np.where(deep, w1 + w.mix(w2 + w.mix(w3)), w1))
            part = (deal % U(parts)).astype(np.int64)
            order = np.lexsort((w3, w2, w1, part))
            part = part[order]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            stops = np.append(cuts[1:], len(part))
            cols = [x[order] for x in (w1, w2, w3)] + [counts[order]]
            packed = [pa.array([x[a:b].tobytes() for a, b in zip(cuts, stops, strict=True)], pa.binary()) for x in cols]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), *packed], ["part", "w1", "w2", "w3", "n"])

        for batch in slices(batches, "text", 1 << 22):
            _, _, _, _, value, follows = _words_of(batch)
            own, inverse = np.unique(value, return_inverse=True)
            if len(known) + len(own) > limit:
                yield from out(*trie.spill(0))
                trie, known, code, by_id = HatTrie(), np.zeros(0, U), np.zeros(0, np.int64), [np.zeros(1, U)]
            place = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
            old = known[place] == own if len(known) else np.zeros(len(own), bool)
            ids = np.zeros(len(own), np.int64)
            ids[old] = code[place[old]]
            ids[~old] = np.arange((~old).sum()) + len(known) + 1
            if not old.all():
                by_id.append(own[~old])
                known, code = np.concatenate([known, own[~old]]), np.concatenate([code, ids[~old]])
                order = np.argsort(known)
                known, code = known[order], code[order]
            one = ids[inverse]
            two, three = np.zeros_like(one), np.zeros_like(one)
            two[:-1] = np.where(follows[:-1], one[1:], 0)
            three[:-1] = np.where(follows[:-1], two[1:], 0)
            trie.add(*np.unique(one << (2 * _ID) | two << _ID | three, return_counts=True))
            if len(trie) > held:
                yield from out(*trie.spill(held // 2))
        yield from out(*trie.spill(0))

    return docs.mapInArrow(run, "part int, w1 binary, w2 binary, w3 binary, n binary")


def _merge(runs: DataFrame, hot: np.ndarray, least: int) -> DataFrame:
    """(w1, w2, w3, f) of each prefix partition: phrases of three words, and of two (w3 = 0), with f >= least.

    Of a hot first word, whose phrases lie in several partitions, all two-word counts are given, each a part of its sum.
    """
    shared = runs.sparkSession.sparkContext.broadcast(hot)

    def merge(table: pa.Table) -> pa.Table:
        w1, w2, w3, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), U if c != "n" else np.int64) for c in ("w1", "w2", "w3", "n"))
        order = np.lexsort((w3, w2, w1))
        w1, w2, w3, n = w1[order], w2[order], w3[order], n[order]
        pair = np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
        new = np.flatnonzero(pair | np.concatenate([[True], w3[1:] != w3[:-1]]))
        both = np.flatnonzero(pair)
        three, two = np.add.reduceat(n, new), np.add.reduceat(n, both)
        keep3 = new[(three >= least) & (w3[new] != 0)]
        f3 = three[(three >= least) & (w3[new] != 0)]
        hot = shared.value
        at = np.minimum(np.searchsorted(hot, w1[both]), max(len(hot) - 1, 0))
        deep = hot[at] == w1[both] if len(hot) else np.zeros(len(both), bool)
        ok = ((two >= least) | deep) & (w2[both] != 0)
        keep2, f2 = both[ok], two[ok]
        cols = [np.concatenate([x[keep3], x[keep2]]).view(np.int64) for x in (w1, w2)]
        third = np.concatenate([w3[keep3], np.zeros(len(keep2), U)]).view(np.int64)
        return pa.table([*map(pa.array, (*cols, third, np.concatenate([f3, f2])))], names=["w1", "w2", "w3", "f"])

    return runs.groupBy("part").applyInArrow(merge, "w1 long, w2 long, w3 long, f long")


def _score(a: Column, left: Column, right: Column) -> Column:
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)).cast("decimal(31,0)"), wide(left) * wide(right))


def collocations(
    docs: DataFrame, *, least: int = 10, top: int = 2_000, part_words: int = 20_000_000, held: int = 2_000_000
) -> DataFrame:
    """The best collocations of docs(text, lang), by language.

    Returns lang, rank (from 1), phrase (its words, joined by blanks), a (occurrences of the phrase), l and r (those
    of the two parts of its lowest-scoring cut, ties to the first), n (all words of the language) and score
    (a * a / (l * r) in millionths, rounded down): each language's `top` phrases of two or three words with
    a >= least, by score, then a (both descending), then phrase (by bytes). A phrase whose words lie in one of three
    words that makes up half of its occurrences or more isn't returned.

    Texts are lower-cased (A-Z), parted into pieces at . , ; : ! ? and line ends, and these into words at blanks and
    tabs. Words are compared by 64-bit hashes of their bytes and language; a hash that two words share is noticed
    when words are counted, and ends the job (a chance of 3e-8 for a million distinct words).

    A task holds about `held` phrases; a prefix partition gets `part_words` words of text or what one first word has.
    First words with more than half a partition's share, at most 2 * partitions of them (known to all tasks), are dealt
    by whole phrases instead. All joins that follow hold phrases with a >= least only, none larger than what SQL would join.

    Defined results: null texts are empty; a null lang is `und`; texts without words count nothing; repeated rows
    each count; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    docs = docs.withColumn("lang_hash", F.xxhash64("lang"))
    unigrams = checkpoint(_count_words(docs, 500_000).groupBy("lang", "word").agg(F.sum("f").alias("f"), F.min("h").alias("h"), F.max("h").alias("h2")))
    total = unigrams.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("n"), F.count("*").alias("words"), F.countDistinct("h").alias("hashes")).first()
    if total["words"] != total["hashes"]:
        raise ValueError("two words share a 64-bit hash")
    parts = max(256, -(-total["n"] // part_words))
    hot = np.array(sorted(r["h"] % (1 << 64) for r in unigrams.filter(F.col("f") > max(total["n"] // (2 * parts), least)).select("h").collect()), U)
    grams = checkpoint(_merge(_runs(docs, parts, hot, held), hot, least))
    two = grams.filter("w3 = 0").groupBy("w1", "w2").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    three = grams.filter("w3 <> 0")
    one = unigrams.filter(F.col("f") >= least).select("h", "lang", "word", "f")
    word = lambda k: one.select(F.col("h").alias(f"w{k}"), F.col("word").alias(f"t{k}"), F.col("f").alias(f"f{k}"), *([F.col("lang")] if k == 1 else []))
    pair = lambda x, y, name: two.select(F.col("w1").alias(x), F.col("w2").alias(y), F.col("f").alias(name))
    inside = three.select("w1", "w2", "f").unionByName(three.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "f")).groupBy("w1", "w2").agg(F.max("f").alias("longer"))
    pairs = (
        two.join(inside, ["w1", "w2"], "left").filter("longer is null or 100 * longer < 50 * f").join(word(1), "w1").join(word(2), "w2")
        .select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"), _score(F.col("f"), F.col("f1"), F.col("f2")).alias("score"))
    )
    triples = (
        three.join(pair("w1", "w2", "f12"), ["w1", "w2"]).join(pair("w2", "w3", "f23"), ["w2", "w3"]).join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
        .withColumn("s1", _score(F.col("f"), F.col("f1"), F.col("f23"))).withColumn("s2", _score(F.col("f"), F.col("f12"), F.col("f3")))
    )
    first = F.col("s1") <= F.col("s2")
    triples = triples.select(
        "lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), F.col("f").alias("a"), F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = pairs.unionByName(triples).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    size = unigrams.groupBy("lang").agg(F.sum("f").alias("n"))
    return best.join(size, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
