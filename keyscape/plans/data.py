"""Listings derived from `lineitem`, in Spark and, for the oracles, in DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyscape.functions.listing import FIELDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of lineitem (key, size, etag, mtime, storage_class) with l_orderkey and shipped (a timestamp)."""
    return listed(table(spark, sf_dir, "lineitem"))


#: Rows of lineitem that one task makes texts of, about: bytes shuffled don't tell what it holds, as rows of a few numbers become long texts.
TASK_ROWS = 100_000


def dealt(li: DataFrame, *by) -> DataFrame:
    """Rows of lineitem dealt out by what will gather them, narrow as they are, before a listing is made of them."""
    return li.repartition(max(int(li.sparkSession.conf.get("spark.sql.shuffle.partitions")), li.count() // TASK_ROWS), *by)


def listed_key() -> Column:
    """The key of a row of lineitem."""
    return F.concat_ws("/", F.lit("li"), F.year("l_shipdate"), F.month("l_shipdate"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))


def listed(li: DataFrame, *more: Column) -> DataFrame:
    """The listing of rows of lineitem, with l_orderkey, shipped and further columns of these rows."""
    key = listed_key()
    return li.select(
        "l_orderkey", F.col("l_shipdate").alias("shipped"), key.alias("key"), F.col("l_quantity").cast("bigint").cast("string").alias("size"), F.md5(key).alias("etag"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("mtime"),
        F.when(F.col("l_returnflag") == "A", "STANDARD").when(F.col("l_returnflag") == "N", "STANDARD_IA").otherwise("GLACIER").alias("storage_class"), *more,
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_order(spark, sf_dir).select(*FIELDS)


def _twice(df: DataFrame, rest: int) -> DataFrame:
    """Each row, those of remainder `rest` twice."""
    return df.withColumn("_n", F.explode(F.when(F.col("l_orderkey") % 97 == rest, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_n")


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing with some keys repeated."""
    return _twice(with_order(spark, sf_dir), 7).select(*FIELDS)


def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing with rows dropped, renamed, repeated and changed, by the remainder of l_orderkey by 97."""
    r = F.col("l_orderkey") % 97
    df = _twice(with_order(spark, sf_dir), 2).filter(r != 0)
    return df.select(
        F.when(r == 1, F.concat("key", F.lit(".x"))).otherwise(F.col("key")).alias("key"),
        F.when(r == 4, (F.col("size").cast("bigint") + 1).cast("string")).otherwise(F.col("size")).alias("size"),
        F.when(r == 3, F.upper("etag")).when(r != 6, F.col("etag")).alias("etag"),
        F.when(r == 5, F.concat(F.substring("mtime", 1, 11), F.lit("23:59:59Z"))).otherwise(F.col("mtime")).alias("mtime"),
        "storage_class",
    )


#: DuckDB: l (with l_orderkey and shipped), ref and act as above.
LISTING = """
l AS (SELECT *, md5(key) AS etag FROM (SELECT l_orderkey, l_shipdate AS shipped,
  'li/' || year(l_shipdate) || '/' || month(l_shipdate) || '/' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS key,
  CAST(CAST(trunc(l_quantity) AS BIGINT) AS VARCHAR) AS size, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS mtime,
  CASE l_returnflag WHEN 'A' THEN 'STANDARD' WHEN 'N' THEN 'STANDARD_IA' ELSE 'GLACIER' END AS storage_class FROM lineitem)),
ref AS (SELECT key, size, etag, mtime, storage_class FROM l, range(CASE WHEN l_orderkey % 97 = 7 THEN 2 ELSE 1 END)),
act AS (SELECT CASE WHEN l_orderkey % 97 = 1 THEN key || '.x' ELSE key END AS key,
  CASE WHEN l_orderkey % 97 = 4 THEN CAST(CAST(size AS BIGINT) + 1 AS VARCHAR) ELSE size END AS size,
  CASE WHEN l_orderkey % 97 = 3 THEN upper(etag) WHEN l_orderkey % 97 <> 6 THEN etag END AS etag,
  CASE WHEN l_orderkey % 97 = 5 THEN mtime[1:11] || '23:59:59Z' ELSE mtime END AS mtime, storage_class
  FROM l, range(CASE WHEN l_orderkey % 97 = 2 THEN 2 ELSE 1 END) WHERE l_orderkey % 97 <> 0)"""
