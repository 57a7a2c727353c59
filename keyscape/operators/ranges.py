"""Ordered work in ranges: rows are dealt by range once, each range is summed up, and states run from range to range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyscape.sources.shared import checkpoint


def ranged(df: DataFrame, *order: str, partitions: int | None = None, salted: bool = False) -> DataFrame:
    """df dealt by ranges of `order`, with the number of each row's in `_range`; written once, as a second exchange would draw other bounds.

    salted: rows that are equal in `order` may lie in several ranges, so that a key with very many rows is split.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = [F.xxhash64(F.monotonically_increasing_id())] if salted else []
    return checkpoint(df.repartitionByRange(n, *order, *salt).withColumn("_range", F.spark_partition_id()))
