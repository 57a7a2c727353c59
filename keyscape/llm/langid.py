"""Language of texts by a byte convolutional network, trained and applied in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import below, prepare, slices, spare, text_buffer

#: Bytes as the network sees them: a-z with A-Z folded, white space and other ASCII as one, non-ASCII bytes each for itself.
CLASS = np.zeros(256, np.uint8)
CLASS[0x61:0x7B] = CLASS[0x41:0x5B] = np.arange(1, 27)
CLASS[0x80:] = np.arange(27, 27 + 128)
CLASSES = 27 + 128
WIDTHS = (2, 3, 4)
UNKNOWN = "und"
#: Windows that are cut and scored at a time.
BLOCK = 256


@dataclass
class ByteCNN:
    """Filters of several widths over byte classes, max-pooled over a window, then a softmax of languages.

    taps[k] is (CLASSES, filters): what the byte k places on adds to each filter;
    narrow filters have zero rows for places beyond their width.
    """

    languages: list[str]
    taps: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    window: int

    def windows(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-probabilities, letters) of each row of byte classes, (n, window + 3) with zeros behind the end."""
        n, span = len(codes), self.window
        pair = codes[:, :-1].astype(np.int32) * CLASSES + codes[:, 1:]
        out = np.take(self._pairs(0), pair[:, :span].ravel(), axis=0)
        out += np.take(self._pairs(2), pair[:, 2 : span + 2].ravel(), axis=0)
        out = out.reshape(n, span, -1)
        while span > 1:  # pooled by halves, which numpy does in long strides
            half = span // 2
            out = np.maximum(out[:, :half], out[:, span - half : span])if span % 2 == 0 else np.maximum(out[:, : half + 1], out[:, half:span])
            span = out.shape[1]
        hidden = np.maximum(out[:, 0] + self.bias, 0)
        logit = hidden @ self.dense + self.dense_bias
        logit -= logit.max(1, keepdims=True)
        return logit - np.log(np.exp(logit).sum(1, keepdims=True)), (codes[:, : self.window] > 0).sum(1)

    def _pairs(self, k: int) -> np.ndarray:
        cache = self.__dict__.setdefault("_cache", {})
        if k not in cache:
            cache[k] = np.ascontiguousarray((self.taps[k][:, None] + self.taps[k + 1][None]).reshape(CLASSES * CLASSES, -1), np.float32)
        return cache[k]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_cache"}


def place_windows(ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, owner) of the pieces of `window` bytes that the texts with these offsets make."""
    count = -(-np.diff(ends) // window)
    owner = np.repeat(np.arange(len(count)), count)
    first = np.concatenate([[0], np.cumsum(count)])
    return ends[owner] + (np.arange(len(owner)) - first[owner]) * window, owner


def cut_windows(codes: np.ndarray, ends: np.ndarray, window: int, begin: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Rows of byte classes of the pieces that begin at `begin`, each with three bytes more; zeros stand behind a text's end."""
    at = begin[:, None] + np.arange(window + 3)
    inside = at < ends[owner + 1][:, None]
    return np.where(inside, codes[np.minimum(at, max(len(codes) - 1, 0))], 0) if len(codes) else np.zeros((0, window + 3), np.uint8)


def train(texts: list[str], languages: list[str], *, window: int = 256, filters: int = 8, steps: int = 900, batch: int = 128, seed: int = 7) -> ByteCNN:
    """A network fitted by Adam to windows of labelled texts; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    data, ends = text_buffer(pa.array(texts, pa.string()))
    begin, owner = place_windows(ends, window)
    rows = cut_windows(CLASS[data], ends, window, begin, owner)
    label = np.array([names.index(x) for x in languages], np.int64)[owner]
    total, far = filters * len(WIDTHS), max(WIDTHS)
    mask = np.array([[k < w for w in WIDTHS for _ in range(filters)] for k in range(far)], np.float32)
    p = {
        "taps": rng.normal(0, 0.3, (far, CLASSES, total)).astype(np.float32) * mask[:, None], "bias": np.zeros(total, np.float32),
        "dense": rng.normal(0, 0.3, (total, len(names))).astype(np.float32), "dense_bias": np.zeros(len(names), np.float32),
    }
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    by_class = [np.flatnonzero(label == c) for c in range(len(names))]
    by_class = [x for x in by_class if len(x)]
    for step in range(1, steps + 1 if len(rows) and len(names) > 1 else 1):
        pick = np.concatenate([rng.choice(x, max(1, batch // len(by_class))) for x in by_class])
        x, y = rows[pick], label[pick]
        # short windows too: a random share of what lies behind a cut is blanked
        x = np.where(np.arange(window + 3) < np.maximum(24, (window * rng.random(len(x)) * 2).astype(int))[:, None], x, 0)
        conv = sum(p["taps"][k][x[:, k : window + k]] for k in range(far)) + p["bias"]
        best = conv.argmax(1)
        top = np.take_along_axis(conv, best[:, None], 1)[:, 0]
        hidden = np.maximum(top, 0)
        logit = hidden @ p["dense"] + p["dense_bias"]
        prob = np.exp(logit - logit.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        err = prob.copy()
        err[np.arange(len(y)), y] -= 1
        err /= len(y)
        back = (err @ p["dense"].T) * (top > 0)
        g = {"dense": hidden.T @ err, "dense_bias": err.sum(0), "bias": back.sum(0), "taps": np.zeros_like(p["taps"])}
        col = np.broadcast_to(np.arange(total), best.shape)
        for k in range(far):
            np.add.at(g["taps"][k], (np.take_along_axis(x, best + k, 1), col), back * mask[k])
        for k in p:
            m1[k] = 0.9 * m1[k] + 0.1 * g[k]
            m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
            p[k] = (p[k] - 0.02 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return ByteCNN(names, p["taps"], p["bias"], p["dense"], p["dense_bias"], window)


def training_rows(docs: DataFrame, per_language: int, most: int, most_bytes: int) -> DataFrame:
    """(lang, text): whole labelled texts of each language, by a hash of the doc_id.

    Each language has `per_language` texts at most, fewer where all of them would be more than `most`, and its share of
    `most_bytes`: the number of texts gives way, and a text above that share isn't learnt from. A hash threshold
    from the language's number of ids and bytes takes little more than these before they are ordered, so no task sees a
    language's rows.
    """
    h = F.xxhash64("doc_id")
    known = docs.filter("lang is not null and text is not null").select("lang", "text", h.alias("h"))
    known = known.withColumn("size", F.octet_length("text").cast("long"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"), F.avg("size").alias("size")).collect()  # a row for each class of the model
    share = most_bytes // max(1, len(counts))
    per = max(1, min(per_language, most // max(1, len(counts))))
    shares = docs.sparkSession.createDataFrame([(r["lang"], spare(max(1, min(per, int(share / max(r["size"], 1.0)))), int(r["n"] * 1.1))) for r in counts], "lang string, share double")
    some = known.filter(F.col("size") <= share).join(F.broadcast(shares), "lang").filter(below(F.col("h"), F.col("share")))
    some = some.groupBy("lang", "h").agg(F.min(F.struct("text", "size")).alias("t")).select("lang", "h", "t.*")  # a doc_id that repeats gives one text
    order = W.partitionBy("lang").orderBy("h")
    some = some.withColumn("r", F.row_number().over(order)).withColumn("upto", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return some.filter((F.col("r") <= per) & (F.col("upto") <= share)).orderBy("lang", "r").select("lang", "text")


def fit(docs: DataFrame, *, per_language: int = 300, most: int = 60_000, most_bytes: int = 1 << 26, **options) -> ByteCNN:
    """A network fitted to docs(doc_id, text, lang), for every language in it.

    The bound of the sample is `most` whole texts (or one for each language, if these are more), `per_language` of each
    language, and `most_bytes` bytes of text, which the languages share alike.
    """
    rows = training_rows(docs, per_language, most, most_bytes).collect()
    return train([r["text"] for r in rows], [r["lang"] for r in rows], **options)


def predict(docs: DataFrame, model: ByteCNN) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of docs(doc_id, text).

    All windows of the whole text are scored; their probabilities are averaged by
    their letters. score is the predicted language's share.

    Defined results: a null text and one without a letter give `und` with score 0; with
    no training rows every text is `und`; null and repeated doc_ids are predicted row by
    row; a text of any length takes memory of about twice its bytes; other columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches, "text", 1 << 19):
            column = part.column("text")
            data, ends = text_buffer(column)
            codes = CLASS[data]
            mass = np.zeros((part.num_rows, max(1, len(model.languages))))
            if model.languages:
                begin, owner = place_windows(ends, model.window)
                for k in range(0, len(begin), BLOCK):  # windows of a long text are cut and scored in turn
                    of = owner[k : k + BLOCK]
                    logp, letters = model.windows(cut_windows(codes, ends, model.window, begin[k : k + BLOCK], of))
                    np.add.at(mass, of, np.exp(logp) * letters[:, None])
            total = mass.sum(1)
            # windows without a letter have no say; letters beyond the bytes' classes are asked for by name
            lettered = np.array([t > 0 for t in total])
            for i in np.flatnonzero(lettered):
                if not ((codes[ends[i] : ends[i + 1]] > 0) & (codes[ends[i] : ends[i + 1]] < 27)).any():
                    lettered[i] = any(c.isalpha() for c in column[i].as_py())
            best = mass.argmax(1)
            names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
            score = np.where(lettered, mass[np.arange(len(best)), best] / np.maximum(total, 1e-12), 0.0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0))], ["doc_id", "lang_pred", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double")
