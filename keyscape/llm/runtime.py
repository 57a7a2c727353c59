"""Small helpers shared by the corpus operators: tables, worker path, lineage cuts."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyscape.sources.shared import checkpoint as checkpoint  # cuts lineage in the shared folder

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch between executors and their Python workers, where the session doesn't say: texts are long rows.
BATCH_ROWS = 2_000


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package where they see the driver's folder (local mode, tests), and keep their batches small.

    The session's `spark.sql.execution.arrow.maxRecordsPerBatch` is lowered to BATCH_ROWS if it is Spark's own default.
    """
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(size) == "10000":
        spark.conf.set(size, BATCH_ROWS)
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), _ROOT) if x)


def below(h: Column, share: Column | float) -> Column:
    """Whether a 64-bit hash lies in the lowest `share` of its range: a sample that no sort or window has to take."""
    return h.cast("double") < share * F.lit(2.0**64) - F.lit(2.0**63)


def spare(wanted: int, of: int) -> float:
    """The share of `of` rows that holds `wanted` of them almost surely, and little more."""
    return 1.0 if of <= 2 * wanted else min(1.0, (1.2 * wanted + 200) / of)


def passes(rows: DataFrame, key: list[str], size: str, most: int) -> list[DataFrame]:
    """rows in parts whose `size` sums to `most` at the most (or one key of more); rows of one `key` stay together.

    rows must be written already: they are dealt by hashes of `key` into more and more buckets, until no bucket of
    several keys is over `most`, and buckets are packed into parts. A sum for each bucket reaches the driver.
    """
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    if total["n"] <= most:
        return [rows] if total["rows"] else []
    buckets = 16 * -(-total["n"] // most)
    while True:
        bucket = F.pmod(F.xxhash64(*key), F.lit(buckets))
        own = rows.groupBy(bucket.alias("b")).agg(F.sum(size).alias("n"), F.min(F.struct(*key)).eqNullSafe(F.max(F.struct(*key))).alias("one")).collect()
        if all(r["n"] <= most or r["one"] for r in own):
            break
        buckets *= 2
    parts, held = [], most
    for r in sorted(own, key=lambda r: r["b"]):
        if held + r["n"] > most:
            parts.append([])
            held = 0
        parts[-1].append(r["b"])
        held += r["n"]
    return [rows.filter(bucket.isin(p)) for p in parts]


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut by rows so that the text of each holds about `max_bytes` (or one longer row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = text_buffer(batch.column(column))
        row = 0
        while row < batch.num_rows:
            stop = row + 1
            begin = ends[row]
            # rows whose end lies within max_bytes of this slice's beginning
            stop = max(stop, int(ends.searchsorted(begin + max_bytes, side="right")) - 1)
            stop = min(stop, batch.num_rows)
            yield batch.slice(row, stop - row)
            row = stop


def text_buffer(column: pa.Array):
    """(bytes of all texts, row offsets) of a string column without a copy; a null has no bytes."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, ends - ends[0]


def sorted_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of each key, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            now = tuple(c[lo] for c in cols)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = now
    if held:
        yield pa.Table.from_batches(held)
