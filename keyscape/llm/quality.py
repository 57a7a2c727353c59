"""Document quality by hashed word n-grams and follow-the-regularised-leader logistic regression."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as w
from .runtime import below, prepare, slices, spare, text_buffer

U = np.uint64
#: Kinds of bytes: 0 parts words; 1 lower-case, 2 upper-case, 3 digits, 4 non-ASCII make words; 5 makes words of signs.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 5
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = 1, 2, 3, 4
_SIGN = _KIND == 5
_WORD = (_KIND > 0) & ~_SIGN


def features(text: pa.Array, bits: int = 18) -> tuple[np.ndarray, np.ndarray]:
    """(slot, first): the hashed n-grams of all rows, and where each row's begin.

    N-grams of words (runs of letters and digits, and runs of signs, each as written):
    single words, pairs, and triples of word shapes (case, kind, and whether the word
    repeats the one before it).
    """
    data, ends = text_buffer(text)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(ends), np.int64)
    begins, stops = [], []
    for is_word in (_WORD, _SIGN):
        start, stop, _ = w.words(data, ends, is_word, lower=False)
        begins.append(start)
        stops.append(stop)
    start, stop = np.concatenate(begins), np.concatenate(stops)
    order = np.argsort(start, kind="stable")
    start, stop = start[order], stop[order]
    word = w.hashes(data, start, stop, lower=False)
    first = np.searchsorted(start, ends)
    head, tail = _KIND[data[start]].astype(U) if len(start) else np.zeros(0, U), _KIND[data[stop - 1]].astype(U) if len(start) else np.zeros(0, U)
    size = np.minimum(stop - start, 3).astype(U)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(first))
    place = np.arange(len(word)) - first[row]
    again = np.zeros(len(word), U)
    again[1:] = (word[1:] == word[:-1]) & (place[1:] >= 1)
    # a word that comes back after signs repeats too
    again[2:] |= ((word[2:] == word[:-2]) & (place[2:] >= 2)).astype(U)
    shape = ((head * U(8) + tail) * U(4) + size) * U(2) + again
    with np.errstate(over="ignore"):
        pair, triple = np.zeros_like(word), np.zeros_like(word)
        pair[1:] = w.mix(word[:-1] * U(0x9E3779B97F4A7C15) + word[1:] + U(1))
        pair[1:][word[1:] == word[:-1]] = U(0x5851F42D4C957F2D)  # any word twice in a row
        triple[2:] = w.mix((shape[:-2] * U(1 << 12) + shape[1:-1]) * U(1 << 12) + shape[2:] + U(0x1234567))
    slots = np.concatenate([word, pair[place >= 1], triple[place >= 2]])
    rows = np.concatenate([row, row[place >= 1], row[place >= 2]])
    order = np.argsort(rows, kind="stable")
    return (slots[order] >> U(64 - bits)).astype(np.int64), np.searchsorted(rows[order], np.arange(len(ends)))


def train(
    rows: list[tuple[np.ndarray, int]], *, prior: float | None = None, bits: int = 18, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.05, bias_alpha: float = 0.02
) -> np.ndarray:
    """Weights (the last one is the bias) after FTRL-proximal updates over (distinct slots, label) rows, in turn.

    The bias starts at the log-odds of `prior` (label 1's share; else that of the rows), at
    most 2, so a text that says nothing goes with the larger class, and takes updates
    of its own; for the n-grams both classes weigh the same.
    """
    size = 1 << bits
    z, n = np.zeros(size), np.zeros(size)

    def weight(i):
        out = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        return np.where(np.abs(z[i]) <= l1, 0.0, out)

    share = float(np.mean([y for _, y in rows])) if rows else 0.5
    odds = share if prior is None else prior
    start = bias = float(np.clip(np.log((odds + 1e-9) / (1 - odds + 1e-9)), -2, 2))
    bias_z = bias_n = 0.0
    for _ in range(epochs):
        for i, y in rows:
            x = 1 / np.sqrt(max(1, len(i)))
            now = weight(i)
            p = 1 / (1 + np.exp(-np.clip(now.sum() * x + bias, -35, 35)))
            g = (p - y) * min(8.0, 0.5 / max(1e-3, share if y else 1 - share))
            step = g * x
            z[i] += step - (np.sqrt(n[i] + step * step) - np.sqrt(n[i])) / alpha * now
            n[i] += step * step
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / bias_alpha * (bias - start)
            bias_n += g * g
            bias = start - bias_z / ((beta + np.sqrt(bias_n)) / bias_alpha + l2)
    return np.append(weight(np.arange(size)), bias).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, *, per_label: int = 4000, most_bytes: int = 1 << 26, bits: int = 18, **options) -> np.ndarray:
    """Weights fitted to docs(doc_id, text) with labels(doc_id, quality).

    The sample's bound is `per_label` documents of each label, by a hash of the doc_id, and `most_bytes` of whole texts, half for
    each label: the number of documents gives way, and a text above that half isn't learnt from. So the driver
    holds a number for each distinct n-gram of them, at most three for two bytes.
    A document with contradicting labels counts by its smallest, and of rows that
    repeat a doc_id that of the smallest text hash is taken.
    """
    spark = docs.sparkSession
    prepare(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}  # two rows at most
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    h = F.xxhash64("doc_id")
    some = reduce(Column.__or__, [(F.col("quality") == k) & below(h, spare(per_label, n)) for k, n in counts.items()], F.lit(False))
    # some more than per_label ids of each label, with their hashes; the lowest are taken
    ids = known.filter(some).select("doc_id", "quality", h.alias("h")).toPandas().sort_values(["quality", "h", "doc_id"]).groupby("quality").head(per_label)
    sample = spark.createDataFrame([(int(i), int(q)) for i, q in zip(ids.doc_id, ids.quality, strict=True)], "doc_id long, quality int")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h")).join(F.broadcast(sample), "doc_id")
    sizes = picked.groupBy("doc_id", "quality").agg(F.min(F.struct("h", F.octet_length("text").alias("size"))).alias("s")).select("doc_id", "quality", "s.size").toPandas()
    sizes = sizes[sizes["size"] <= most_bytes // 2].merge(ids[["doc_id", "h"]], on="doc_id").sort_values(["quality", "h", "doc_id"])
    fits = sizes[sizes.groupby("quality")["size"].cumsum() <= most_bytes // 2]
    if len(fits) < len(ids):  # texts of those that don't fit aren't sent
        picked = picked.join(F.broadcast(spark.createDataFrame([(int(i),) for i in fits.doc_id], "doc_id long")), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            slots, first = features(part.column("text"), bits)
            lists = []
            for r in range(part.num_rows):
                lists.append(np.unique(slots[first[r] : first[r + 1]]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(lists, pa.list_(pa.int32())), part.column("quality")], ["doc_id", "h", "slots", "quality"])

    rows = picked.mapInArrow(run, "doc_id long, h long, slots array<int>, quality int")
    rows = rows.groupBy("doc_id", "quality").agg(F.min(F.struct("h", "slots")).alias("s")).select("doc_id", "quality", "s.slots").toArrow()
    order = np.argsort(w.mix(rows.column("doc_id").to_numpy().astype(U)), kind="stable") if rows.num_rows else []
    slots, label = rows.column("slots").combine_chunks(), rows.column("quality").to_numpy()
    return train([(slots[int(k)].values.to_numpy(), int(label[k])) for k in order], prior=prior, bits=bits, **options)


def score(docs: DataFrame, weights: np.ndarray, carry: list[str] | None = None) -> DataFrame:
    """docs' doc_id (and `carry` columns) with score, the chance of label 1, and predicted.

    The score is a sparse dot product of the text's distinct hashed n-grams, scaled by
    their number. Defined results: a null text is empty, and the empty text's score is
    that of the bias; without training rows all scores are 0.5; rows are scored one
    by one, whatever their ids; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(weights)
    keep = carry or ["doc_id"]
    held = docs.schema["text"].dataType.simpleString() == "string" and "text" in keep  # a carried text needn't move twice
    of = "text" if held else "_text"
    bits = int(len(weights) - 1).bit_length() - 1
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for part in slices(batches, of):
            slots, first = features(part.column(of), bits)
            row = np.repeat(np.arange(part.num_rows, dtype=np.int64), np.diff(first))
            code = np.sort((row << bits) | slots)
            code = code[np.append(True, code[1:] != code[:-1])] if len(code) else code
            row = code >> bits
            count = np.bincount(row, minlength=part.num_rows)
            dot = np.bincount(row, weights=weight[code & ((1 << bits) - 1)], minlength=part.num_rows)
            logit = dot / np.sqrt(np.maximum(1, count)) + float(weight[-1])
            value = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(value)], [*keep, "score"])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if held else [F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")]))
    return rows.mapInArrow(run, schema).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int"))
