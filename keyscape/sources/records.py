"""Verify records: one for each attempt, replaced whole, with the long diff beside it.

A write puts its records and its diff into a generation of its own and then commits that by one empty file, which is there or
isn't. Readers take an attempt from the last committed generation that has it, so an attempt that is compared
again and no longer differs leaves no old rows, and a writer or executor that is lost leaves nothing to be seen.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyscape.operators.compare import counted_verdict, diff_counts
from keyscape.sources.shared import checkpoint

_DIFF = "attempt_id string, kind string, key string, field string, tool_value string, reference_value string"
_COUNTS = ("n_missing", "n_extra", "n_duplicate", "n_reference_duplicate", "n_mismatch", "n_mtime")
_RECORD = f"attempt_id string, {', '.join(f'{c} long' for c in _COUNTS)}, verdict string, digest string"
_NAME = "%012d.%s"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, generation) of the committed writes, the last one last; one name for each write."""
    fs, folder = _file_system(spark, f"{path}/commits")
    if not fs.exists(folder):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(folder)]
    return sorted((int(n.split(".")[0]), n.split(".")[1]) for n in names if n[0] not in "_.")


def _summed() -> Column:
    """The aggregate of an attempt's rows in any order: their number and the sums of two hashes of them."""
    row = [F.coalesce(F.col(c), F.lit("\0")) for c in ("kind", "key", "field", "tool_value", "reference_value")]
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), *row).cast("decimal(38,0)")).cast("string")
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), wide(1), wide(2)), 256)


def _digest(diff: DataFrame) -> DataFrame:
    """(attempt_id, digest) of the attempts that have rows in diff."""
    return diff.groupBy("attempt_id").agg(_summed().alias("digest"))


def write_verify(diff: DataFrame, attempts: DataFrame, path: str) -> None:
    """The records of attempts(attempt_id), all that were compared, with their rows of diff(attempt_id, kind, ...).

    An attempt without rows in diff gets a record too: PASS, counts of 0. All of an attempt's earlier records and rows are
    replaced at once; other attempts keep theirs. Rows of attempts that aren't in `attempts` are refused. Two
    writers that commit at the same time both count, in the order of their numbers, then of their names.
    """
    spark, path = diff.sparkSession, path.rstrip("/")
    generation = uuid.uuid4().hex
    attempts = checkpoint(attempts.select("attempt_id").distinct())
    diff = diff.select(*[F.col(c.split()[0]) for c in _DIFF.split(", ")])
    diff.repartitionByRange("attempt_id", "key").sortWithinPartitions("attempt_id", "key").write.parquet(f"{path}/diff/generation={generation}")
    diff = spark.read.schema(_DIFF).parquet(f"{path}/diff/generation={generation}")
    sums = checkpoint(diff.groupBy("attempt_id").agg(*diff_counts(), _summed().alias("digest")))  # a row for each attempt
    if not sums.join(attempts, "attempt_id", "left_anti").isEmpty():
        raise ValueError("the diff has rows of attempts that weren't compared")
    records = counted_verdict(attempts.join(sums, "attempt_id", "left")).withColumn("digest", F.coalesce("digest", F.sha2(F.lit("0::"), 256)))
    records.select(*[c.split()[0] for c in _RECORD.split(", ")]).write.parquet(f"{path}/record/generation={generation}")
    number = max((n for n, _ in _commits(spark, path)), default=0) + 1
    fs, marker = _file_system(spark, f"{path}/commits/{_NAME % (number, generation)}")
    if not fs.createNewFile(marker):
        raise RuntimeError(f"{marker} is there already")


def read_verify(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, diff) as last committed: a record for each attempt, and the rows of their generations."""
    path, commits = path.rstrip("/"), _commits(spark, path.rstrip("/"))
    if not commits:
        return spark.createDataFrame([], _RECORD), spark.createDataFrame([], _DIFF)
    order = spark.createDataFrame([(g, k) for k, (_, g) in enumerate(commits)], "generation string, at long")
    kept = [g for _, g in commits]
    records = spark.read.schema(f"{_RECORD}, generation string").parquet(f"{path}/record").filter(F.col("generation").isin(kept)).join(order, "generation")
    last = records.withColumn("r", F.row_number().over(W.partitionBy("attempt_id").orderBy(F.desc("at")))).filter("r = 1").drop("r", "at")  # a row for each write of an attempt
    diff = spark.read.schema(f"{_DIFF}, generation string").parquet(f"{path}/diff").filter(F.col("generation").isin(kept))
    diff = diff.join(last.select("attempt_id", "generation"), ["attempt_id", "generation"], "left_semi")
    return last.drop("generation"), diff.drop("generation")


def vacuum_verify(spark: SparkSession, path: str) -> None:
    """Writes the current records and rows as one generation, commits it, and removes what it replaces; nothing may write meanwhile."""
    path, old = path.rstrip("/"), _commits(spark, path.rstrip("/"))
    if not old:
        return
    records, diff = read_verify(spark, path)
    write_verify(diff, records, path)
    for number, generation in old:
        for name in (f"commits/{_NAME % (number, generation)}", f"record/generation={generation}", f"diff/generation={generation}"):
            fs, p = _file_system(spark, f"{path}/{name}")
            fs.delete(p, True)
