"""Large JSON documents read in parts: one file's arrays are cut into elements by many tasks.

A document is scanned as the pieces between its commas, which Spark reads by ranges of bytes. What a piece means depends on
whether it begins within a string and how deep. A range of pieces is summed up by the parity of its quotes and by how
far its brackets go up or down, for either beginning; these states run from range to range of a file, and then each range finds its
elements from the state that it begins with. Only elements that lie across two ranges are put together again. Short
files have one range and need no states: each is cut as it is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyscape.sources.shared import checkpoint, scratch_path, to_workers

_QUOTE, _BACKSLASH, _COMMA = 0x22, 0x5C, 0x2C
_STEP = np.zeros(256, np.int8)
_STEP[[0x7B, 0x5B]] = 1
_STEP[[0x7D, 0x5D]] = -1
#: Up to so many ranges their states are broadcast; more are joined by a shuffle that keeps ranges whole.
BROADCAST_RANGES = 100_000
#: Bytes of pieces that a task looks at together.
_BLOCK = 1 << 22
#: A file of more bytes than this, or a compressed one, is read by ranges; a shorter one is one value.
WHOLE_FILE = 1 << 23
_COMPRESSED = r"\.(gz|bz2|zst|lz4|snappy|deflate)\z"


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, long) of the files that aren't empty, and whether each is read by ranges; no content is read."""
    meta = F.col("_metadata")
    long = (F.col("length") > WHOLE_FILE) | meta["file_name"].rlike(_COMPRESSED)
    return spark.read.format("binaryFile").load(path).filter("length > 0").select(meta["file_path"].alias("file"), long.alias("long"))


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of the files that aren't long, each whole."""
    meta = F.col("_metadata")
    texts = spark.read.text(path, wholetext=True).filter((meta["file_size"] > 0) & (meta["file_size"] <= WHOLE_FILE) & ~meta["file_name"].rlike(_COMPRESSED))
    return texts.select(meta["file_path"].alias("file"), F.col("value").cast("binary").alias("value"))


def _pieces(spark: SparkSession, path: str, whole: int = 0) -> DataFrame:
    """(file, block, value) of the text between commas, each block in order within one task; of files of more than `whole` bytes and of compressed ones."""
    meta = F.col("_metadata")
    pieces = spark.read.option("lineSep", ",").text(path).filter((meta["file_size"] > whole) | meta["file_name"].rlike(_COMPRESSED))
    return pieces.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.col("value").cast("binary").alias("value"))


def _ranges(batches: Iterator[pa.RecordBatch], extra: list[str]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """(key, bytes, ends) of consecutive pieces of one (file, block): the pieces' bytes with a comma behind each, and where each ends."""
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = batch.column("value").to_pylist()
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        of_file, of_block = batch.column("file").dictionary_encode().indices.to_numpy(), batch.column("block").to_numpy()
        other = (np.diff(of_file) != 0) | (np.diff(of_block) != 0) | (np.diff((ends - 1) // _BLOCK) != 0)
        for lo, hi in pairwise([0, *(np.flatnonzero(other) + 1).tolist(), len(parts)]):
            data = np.frombuffer(b",".join([*parts[lo:hi], b""]), np.uint8)
            yield tuple(batch.column(c)[lo].as_py() for c in ["file", "block", *extra]), data, ends[lo:hi] - (ends[lo - 1] if lo else 0)


def _structure(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """(whether each byte lies in a string, steps of depth by brackets outside strings); a string's first quote lies in it, its last doesn't."""
    slash = data == _BACKSLASH
    quote = data == _QUOTE
    if slash.any():
        at = np.flatnonzero(slash)
        begin = np.concatenate([[True], np.diff(at) > 1])
        run = at - np.repeat(at[begin], np.diff(np.append(np.flatnonzero(begin), len(at))))  # backslashes in front in the same run
        escapes = at[run % 2 == 0] + 1
        quote[escapes[escapes < len(data)]] = False
    held = (np.cumsum(quote) + inside) % 2 == 1
    step = np.where(held | quote, 0, _STEP[data])
    return held, step


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, block, odd, out, within) of each range: whether it has an odd number of quotes, and its steps of depth if it begins outside a string, or within one."""
    sums: dict[tuple, list[int]] = {}
    for key, data, _ in _ranges(batches, []):
        own = sums.setdefault(key, [0, 0, 0])
        for k in (0, 1):
            held, step = _structure(data, bool(own[0]) ^ bool(k))
            own[1 + k] += int(step.sum())
            odd = held[-1] ^ bool(k)  # a comma is behind the last piece, so a quote isn't the last byte
        own[0] = int(odd)
    if sums:
        rows = [(*k, *v) for k, v in sums.items()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "block", "odd", "out", "within"])


def _states(sums: DataFrame) -> DataFrame:
    """(file, block, inside, depth) that each range begins with, and its file's end state; a row for each range."""
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    now = sums.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    now = now.withColumn("own", F.when(F.col("inside") == 1, F.col("within")).otherwise(F.col("out")))
    whole = W.partitionBy("file")
    return now.select(
        "file", "block", "inside", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("depth"), (F.sum("odd").over(whole) % 2).alias("open"), F.sum("own").over(whole).alias("end"), F.max("block").over(whole).alias("last"),
    )


def _cut(level: int):
    """Fragments (file, block, at, tail, begins, ends, value) of each range, cut at the commas of `level` or less; the last one is its tail, which goes on in the next range.

    begins and ends are the depths of the commas around a fragment; -1 where that comma is in another range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, list] = {}
        for (file, block, inside, depth), data, _ in _ranges(batches, ["inside", "depth"]):
            state = states.setdefault((file, block), [bool(inside), int(depth), b"", 0, -1])  # in a string, depth, what waits, number of the next fragment, depth where it begins
            held, step = _structure(data, state[0])
            deep = np.cumsum(step) + state[1]
            rows, lo, raw = [], 0, data.tobytes()
            for c in np.flatnonzero((data == _COMMA) & ~held & (deep <= level)).tolist():
                rows.append((file, block, state[3], False, state[4], int(deep[c]), state[2] + raw[lo:c]))
                state[2], lo, state[3], state[4] = b"", c + 1, state[3] + 1, int(deep[c])
            state[:3] = bool(held[-1]), int(deep[-1]), state[2] + raw[lo:]
            if rows:
                yield _rows(rows)
        tails = [(f, b, s[3], True, s[4], -1, s[2]) for (f, b), s in states.items()]
        if tails:
            yield _rows(tails)

    return run


def _cut_whole(level: int):
    """Fragments (file, block, at, tail, begins, ends, value) of whole files, as `_cut` makes them; without tails, as no range follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column("file"), batch.column("value"), strict=True):
                data = np.frombuffer(text.as_py() + b",", np.uint8)
                held, step = _structure(data, False)
                deep = np.cumsum(step, dtype=np.int64)
                if held[-1] or deep[-1] != 0:
                    raise ValueError(f"not a whole JSON document: {file.as_py()}")
                cuts = np.flatnonzero((data == _COMMA) & ~held & (deep <= level))
                at, ends = np.arange(len(cuts)), deep[cuts]
                offsets = np.concatenate([[0], cuts - at]).astype(np.int32)  # behind the commas that are taken out
                value = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(np.delete(data, cuts))])
                names = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(cuts), np.int32)), pa.array([file.as_py()])).cast(pa.string())
                columns = [names, pa.array(np.zeros(len(cuts), np.int64)), pa.array(at), pa.array(np.zeros(len(cuts), bool)), pa.array(np.concatenate([[-1], ends[:-1]])), pa.array(ends), value]
                yield pa.RecordBatch.from_arrays(columns, ["file", "block", "at", "tail", "begins", "ends", "value"])

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "block", "at", "tail", "begins", "ends", "value"])


def _fragments(spark: SparkSession, path: str, level: int) -> DataFrame:
    """(file, place, begins, ends, value) of what stands between commas of `level` or less, place in the order of the file; begins and ends are the depths of these commas.

    Where a range has a tail, it and the head of the next range (and ranges without a cut between them) are one
    fragment: only these are gathered. A file that ends within a string or a bracket, or closes more than it opens, fails the job.
    """
    to_workers(spark)
    kinds, kept = "file string, block long, at long, tail boolean, begins long, ends long, value binary", ("file", "place", "begins", "ends", "value")
    # once: readers ask for fragments many times
    written = scratch_path(spark, "fragments")
    _texts(spark, path).mapInArrow(_cut_whole(level), kinds).write.option("compression", "zstd").parquet(written)
    short = spark.read.schema(kinds).parquet(written).select("file", F.struct("block", "at").alias("place"), *kept[2:])
    if files_of(spark, path).filter("long").isEmpty():
        return short
    pieces = _pieces(spark, path, WHOLE_FILE)
    states = checkpoint(_states(pieces.mapInArrow(_summary, "file string, block long, odd long, out long, within long")))
    whole = (F.col("open") == 0) & (F.col("end") == 0)
    states = states.withColumn("inside", F.when(whole, F.col("inside")).otherwise(F.raise_error(F.concat(F.lit("not a whole JSON document: "), "file"))))
    begun = states.select("file", "block", "inside", "depth")
    if states.count() <= BROADCAST_RANGES:
        joined = pieces.join(F.broadcast(begun), ["file", "block"])
    else:
        joined = pieces.withColumn("order", F.monotonically_increasing_id()).join(begun, ["file", "block"]).sortWithinPartitions("file", "block", "order")
    written = scratch_path(spark, "fragments")
    joined.select("file", "block", "inside", "depth", "value").mapInArrow(_cut(level), kinds).write.option("compression", "zstd").parquet(written)
    cut = spark.read.schema(kinds).parquet(written)
    tails = checkpoint(cut.filter("tail").select("file", "block", F.col("at").alias("cuts")))  # a row for each range
    order = W.partitionBy("file").orderBy("block")
    # the range in which the fragment begins that a range's head ends: the last one before it that has a cut, or the file's first
    begins = F.coalesce(F.last(F.when(F.col("cuts") > 0, F.col("block")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)), F.first("block").over(order))
    file = W.partitionBy("file")
    ranges = tails.select("file", "block", "cuts", begins.alias("start"), F.min("block").over(file).alias("first"), F.max("block").over(file).alias("last"))
    ranges = ranges.join(tails.select("file", F.col("block").alias("start"), F.col("cuts").alias("start_at")), ["file", "start"])
    ranges = F.broadcast(ranges) if tails.count() <= BROADCAST_RANGES else ranges
    # behind the last piece of a file there is no comma: what would follow it is nothing
    rows = cut.join(ranges, ["file", "block"]).filter(~(F.col("tail") & (F.col("block") == F.col("last"))))
    head = (F.col("at") == 0) & (F.col("block") != F.col("first"))
    place = F.when(head, F.struct(F.col("start").alias("block"), F.col("start_at").alias("at"))).otherwise(F.struct("block", "at"))
    rows = rows.select("file", place.alias("place"), (head | F.col("tail")).alias("across"), "block", "begins", "ends", "value")
    parts = rows.filter("across").groupBy("file", "place").agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("p"), F.max("begins").alias("begins"), F.max("ends").alias("ends"))
    parts = parts.select("file", "place", "begins", "ends", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.value))").alias("value"))
    return short.unionByName(rows.filter("not across").select(*kept)).unionByName(parts)


def _text(value: Column) -> Column:
    return F.decode(value, "UTF-8")


_BLANKS, _BLANK = " \t\r\n", r"[\x20\t\r\n]*"


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, element) of files of one JSON array each: the text of each element, cut out by many tasks for one file.

    Files that aren't one array, or have an empty element, fail the job; what an element holds is for its parser to check.
    """
    rows = _fragments(spark, path, 1)
    ends = rows.groupBy("file").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    ends = F.broadcast(checkpoint(ends)) if files_of(spark, path).count() <= BROADCAST_RANGES else ends  # a row for each file
    rows = rows.join(ends, "file").select("file", "value", (F.col("place") == F.col("first")).alias("is_first"), (F.col("place") == F.col("last")).alias("is_last"))
    text = F.rtrim(_text(F.col("value")), F.lit(_BLANKS))
    bad = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), "file"))
    text = F.when(~F.col("is_first"), text).when(text.rlike(rf"\A{_BLANK}\["), F.regexp_replace(text, rf"\A{_BLANK}\[", "")).otherwise(bad("not a JSON array"))
    text = F.when(~F.col("is_last"), text).when(text.endswith("]"), F.left(text, F.length(text) - 1)).otherwise(bad("not a JSON array"))
    rows = rows.withColumn("element", text)
    empty = F.ltrim("element", F.lit(_BLANKS)) == ""
    rows = rows.filter(~(empty & F.col("is_first") & F.col("is_last")))
    return rows.select("file", F.when(empty, bad("an empty element")).otherwise(F.col("element")).alias("element"))


def object_members(spark: SparkSession, path: str) -> DataFrame:
    """(file, field, is_array, value) of files of one JSON object each: a row for each element of an array member, and for any other member its value as it stands.

    An empty array has no row. A file's members are looked up by where they begin, a row for each of them; what is within
    a member that isn't an array stays one value. Files that aren't one object fail the job.
    """
    rows = _fragments(spark, path, 2).withColumn("text", F.btrim(_text(F.col("value")), F.lit(_BLANKS)))
    begins, ends, text = F.col("begins"), F.col("ends"), F.col("text")
    # a file's first fragment has no comma in front, its last one none behind
    whole = ((begins >= 0) | text.startswith("{")) & ((ends > 0) | text.endswith("}"))
    rows = rows.withColumn("whole", whole)
    rows = rows.withColumn("text", F.when(begins >= 0, text).otherwise(F.regexp_replace(text, rf"\A\{{{_BLANK}", "")))
    rows = rows.withColumn("text", F.when(ends > 0, text).otherwise(F.regexp_replace(text, rf"{_BLANK}\}}\z", "")))
    head = rf'\A("(?:[^"\\]++|\\.)*+"){_BLANK}:{_BLANK}(\[?)'
    top = begins < 2
    rows = rows.withColumn("name", F.when(top, F.regexp_extract("text", head, 1))).withColumn("array", F.when(top, F.regexp_extract("text", head, 2) == "["))
    rows = rows.filter(~(top & (text == "") & (ends <= 0) & (begins < 0) & F.col("whole")))  # an empty object
    field = F.get(F.from_json(F.concat(F.lit("["), F.col("name"), F.lit("]")), "array<string>"), F.lit(0)).alias("field")  # once for each member
    heads = rows.filter(top).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("place", "name", "array", field))).alias("heads"))
    heads = F.broadcast(checkpoint(heads)) if files_of(spark, path).count() <= BROADCAST_RANGES else heads  # a row for each file
    rows = rows.select("file", "place", "begins", "ends", "text", "whole").join(heads, "file").withColumn("own", F.expr("element_at(filter(heads, h -> h.place <= place), -1)"))
    body = F.when(top, F.regexp_replace("text", head, "")).otherwise(text)
    # the last element's text has the array's end behind it
    inner = F.when(F.col("own.array") & (ends < 2), F.regexp_replace(body, rf"{_BLANK}\]\z", "")).otherwise(body)
    field = F.col("own.field")
    problem = F.when(~F.col("whole"), "not a JSON object").when(F.col("own.name") == "", "a member without a name")
    found = rows.filter("own.array").select("file", field.alias("field"), F.lit(True).alias("is_array"), inner.alias("value"), problem.alias("problem"), (top & (ends < 2)).alias("only"))
    found = found.filter(~((F.col("value") == "") & F.col("only"))).withColumn("problem", F.coalesce("problem", F.when(F.col("value") == "", "an empty element"))).drop("only")
    other = rows.filter("not own.array").groupBy("file", "own.name").agg(F.array_sort(F.collect_list(F.struct("place", body.alias("text")))).alias("p"), F.first(field).alias("field"), F.max(problem).alias("problem"))
    out = found.unionByName(other.select("file", "field", F.lit(False).alias("is_array"), F.array_join(F.transform("p", lambda x: x["text"]), ",").alias("value"), "problem"))
    # refused here, behind all filters: a filter may be asked of fragments before they are joined
    return out.select("file", "field", "is_array", F.when(F.col("problem").isNull(), F.col("value")).otherwise(F.raise_error(F.concat_ws(": ", "problem", "file"))).alias("value"))
