"""Token counts from flat token files: a vectorised search for end-of-document ids, stitched across blocks."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import checkpoint, prepare, slices

#: Fixed value: how the byte-level vocabularies split a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Setting of the session that names another vocabulary file.
SETTING = "spark.keyscape.vocabulary"
#: A text is encoded in parts of about so many characters, and a run of so many blanks by itself.
PART, BLANKS = 1 << 16, 10_000
#: Where a text may be cut without a change of its tokens: no token holds a blank behind another character.
_EDGE = re.compile(r"(?<=\S)[ \n]")
_BLANK_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % BLANKS)
#: Tokens of a block; documents reach over blocks as they fall.
BLOCK = 1 << 16
_BLOCKS = "file long, block long, tokens binary, ordinal long, doc_id long"
_SCAN = "file long, block long, kind int, a long, b long, c long"


def vocabulary_of(spark: SparkSession) -> str:
    """The session's vocabulary file (`spark.keyscape.vocabulary`, else VOCABULARY); FileNotFoundError where there is none."""
    path = spark.conf.get(SETTING, VOCABULARY)
    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary at {path}: name a file of `base64-token rank` lines in {SETTING}")
    return path


def parts(text: str) -> Iterator[tuple[bool, str]]:
    """(whole, part): the text in parts that are encoded by themselves; `whole` ones are one long run of blanks, which is one piece.

    Before another character the run's last blank belongs to what follows; it begins the next part.
    """
    at = 0
    while at < len(text):
        edge = _EDGE.search(text, at + PART) if len(text) - at > PART else None
        stop = edge.start() if edge else len(text)
        for run in _BLANK_RUN.finditer(text, at, stop):
            end = run.end() if run.end() == len(text) else run.end() - 1
            if run.start() > at:
                yield False, text[at : run.start()]
            yield True, text[run.start() : end]
            at = end
        if stop > at:
            yield False, text[at:stop]
        at = stop


class Encoder:
    """Token ids of texts of any length, by a byte-level vocabulary."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
        self.by_pattern = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.as_one = tiktoken.Encoding("one", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.end = len(ranks)

    def encode(self, text: str) -> list[int]:
        return [x for whole, part in parts(text) for x in (self.as_one if whole else self.by_pattern).encode_ordinary(part)]


def token_type(end: int) -> type:
    """The narrowest unsigned integers that hold all ids up to `end`."""
    return np.uint16 if end < 1 << 16 else np.uint32


def flat_blocks(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """Each input partition of docs(doc_id, text) as a flat file of tokens (`token_type`), cut in blocks of `block` tokens.

    Texts follow one another, each with the end-of-document id (one past the
    vocabulary's last) behind it, and nothing tells where they begin. Rows without tokens
    are the manifest: the file's documents in order (ordinal, doc_id). A null text has no tokens.
    """
    spark = docs.sparkSession
    prepare(spark)
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        end, kind = encoder.end, token_type(encoder.end)
        file, ordinal, number, held, size = TaskContext.get().partitionId(), 0, 0, [], 0
        names, kinds = zip(*((c.split()[0], {"long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in _BLOCKS.split(", ")), strict=True)

        def rows(values):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*values, strict=True), kinds, strict=True)], list(names))

        for part in slices(batches, "text", 1 << 19):
            out = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                held.append(np.array([*encoder.encode(text or ""), end], kind))
                size += len(held[-1])
                out.append((file, None, None, ordinal, doc_id))
                ordinal += 1
            if size >= block:
                flat = np.concatenate(held)
                for lo in range(0, size - block + 1, block):
                    out.append((file, number, flat[lo : lo + block].tobytes(), None, None))
                    number += 1
                held, size = [flat[size - size % block :]], size % block
            yield rows(out)
        if size:
            yield rows([(file, number, np.concatenate(held).tobytes(), None, None)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _BLOCKS)


def read_flat(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Blocks of the flat token files at `path`, of any size, `width` bytes to a token; each is read by its own range of bytes.

    Tasks open the files by their URI, so `path` must be in a store that pyarrow reads on the executors.
    """
    prepare(spark)
    step = width * block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for part in batches:
            for path, file, at, size in zip(*[part.column(c).to_pylist() for c in ("path", "file", "at", "size")], strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    tokens = f.read_at(size, at)
                none = pa.array([None], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([at // step]), pa.array([tokens], pa.binary()), none, none], [c.split()[0] for c in _BLOCKS.split(", ")])

    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")  # lengths alone: no content is read
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("at")
    uri = F.regexp_replace("path", r"\Afile:/+", "file:///")
    ranges = files.select(uri.alias("path"), F.xxhash64("path").alias("file"), "length", at).select("path", "file", "at", F.least(F.lit(step), F.col("length") - F.col("at")).cast("long").alias("size"))
    return ranges.repartition("file", "at").mapInArrow(run, _BLOCKS)


def scan_blocks(blocks: DataFrame, end: int, width: int = 2) -> DataFrame:
    """What each block says by itself, as rows of `kind`.

    0: an end-of-document id (a: its number in the block, b: its place, c: its document's
    tokens that lie in the block); 1: the block (a: tokens, b: ends, c: the place behind its
    last end, or null); 2: a manifest row (a: ordinal, b: doc_id).
    """
    dtype = {2: np.uint16, 4: np.uint32}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = [[] for _ in range(6)]

            def add(*columns, out=out):
                for o, c in zip(out, columns, strict=True):
                    o.append(c)

            for file, block, tokens, ordinal, doc_id in zip(*[part.column(c).to_pylist() for c in ("file", "block", "tokens", "ordinal", "doc_id")], strict=True):
                if tokens is None:
                    add([file], [0], [2], [ordinal], [doc_id], [None])
                    continue
                flat = np.frombuffer(tokens, dtype)
                at = np.flatnonzero(flat == end)
                n = len(at)
                add([file] * n, [block] * n, [0] * n, range(n), at.tolist(), np.diff(at, prepend=-1).__sub__(1).tolist())
                add([file], [block], [1], [len(flat)], [n], [int(at[-1]) + 1 if n else None])
            yield pa.RecordBatch.from_arrays([pa.array([x for c in o for x in c], pa.int32() if k == 2 else pa.int64()) for k, o in enumerate(out)], [c.split()[0] for c in _SCAN.split(", ")])

    return blocks.mapInArrow(run, _SCAN)


def stitch(scan: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens) of each file's documents, from what its blocks say.

    A prefix scan over a file's blocks (one small row for each) gives the number of
    documents that ended before a block and the tokens that lie open at its beginning.
    Tokens behind a file's last end are a document without an end.
    """
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    summary = scan.filter("kind = 1").select("file", "block", F.col("a").alias("size"), F.col("b").alias("ends"), F.col("c").alias("behind"))
    summary = summary.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0)))
    place = F.coalesce(F.max(F.col("base") + F.col("behind")).over(before), F.lit(0))
    summary = summary.withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0))).withColumn("open", F.col("base") - place)
    ends = scan.filter("kind = 0").select("file", "block", "a", "c")
    whole = ends.join(summary.select("file", "block", "first", "open"), ["file", "block"]).select(
        "file", (F.col("first") + F.col("a")).alias("ordinal"), (F.col("c") + F.when(F.col("a") == 0, F.col("open")).otherwise(0)).alias("n_tokens")
    )
    rest = summary.groupBy("file").agg(F.sum("size").alias("size"), F.sum("ends").alias("ordinal"), F.coalesce(F.max(F.col("base") + F.col("behind")), F.lit(0)).alias("behind"))
    rest = rest.filter("size > behind").select("file", "ordinal", (F.col("size") - F.col("behind")).alias("n_tokens"))
    return whole.unionByName(rest)


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens) of each row of docs(doc_id, text), counted in the flat token files that docs make.

    Defined results: null and empty texts have 0 tokens; null and repeated doc_ids are
    counted row by row; the end-of-document id isn't counted, and text that spells it
    out is ordinary text; texts of any length are encoded in parts, long runs of blanks by
    themselves; other columns are ignored; an empty table gives no rows.
    """
    with open(vocabulary, "rb") as f:
        end = sum(1 for x in f if x.strip())
    scan = checkpoint(scan_blocks(flat_blocks(docs, vocabulary, block), end, np.dtype(token_type(end)).itemsize))
    manifest = scan.filter("kind = 2").select("file", F.col("a").alias("ordinal"), F.col("b").alias("doc_id"))
    return manifest.join(stitch(scan), ["file", "ordinal"], "left").select("doc_id", "n_tokens")
