"""Queries of the keyspace analytics (K1-K23) over listings derived from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyscape.operators import keyspace as k

from .data import LISTING, damaged, listing, table, with_order

CUTS = 12


def _cuts(spark, d, n=CUTS):
    return k.cut_points(k.key_distribution(listing(spark, d)), n)


def _key_cuts(spark, d):
    """Cut points at keys themselves: those of orders divisible by 1,009."""
    return with_order(spark, d).filter("l_orderkey % 1009 = 0").select(F.col("key").alias("cut")).distinct()


def _shards(spark, d):
    """Ten shards by order; one order in 83 is in two of them, and one in 79 in none."""
    li = with_order(spark, d)
    own = (F.col("l_orderkey") % 10).cast("long")
    both = F.when(F.col("l_orderkey") % 83 == 0, F.array(own, own + 1)).otherwise(F.array(own))
    return li.filter("l_orderkey % 79 <> 0").select(F.explode(both).alias("shard"), "key")


def _emitted(spark, d):
    """Listings as files by month, in line order by l_orderkey."""
    li = with_order(spark, d)
    return li.select(F.date_format("shipped", "yyyy-MM").alias("file"), (F.col("l_orderkey") * 4_000_000_000 + F.conv(F.substring("etag", 1, 7), 16, 10).cast("bigint")).alias("line_no"), "key")


def _multipart(spark, d):
    li = with_order(spark, d)
    return li.select("key", F.when(F.col("l_orderkey") % 3 == 0, F.concat("etag", F.lit("-"), (F.col("l_orderkey") % 50).cast("string"))).otherwise(F.col("etag")).alias("etag"))


def _encoded(spark, d):
    return table(spark, d, "part").select(F.concat(F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("+%2525"), F.col("p_partkey").cast("string")).alias("key"))


def _escapes(spark, d):
    """Keys with good escapes, cut off or wrong ones, and bytes that aren't UTF-8."""
    end = F.element_at(F.array(*map(F.lit, ("%41", "%zz", "%4", "%", "%FF", "%C3%A9", "%EF%BF%BD", "+"))), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, d, "part").select(F.concat("p_name", end).alias("key"))


def _registry(spark, d):
    """Prefixes of years and months with a number of keys that is that of their orders' rows, but for one month."""
    li = listing(spark, d)
    own = li.select(F.explode(F.array(F.substring_index("key", "/", 2), F.substring_index("key", "/", 3))).alias("p")).groupBy(F.concat("p", F.lit("/")).alias("prefix")).agg(F.count("*").alias("keys"))
    return own.withColumn("keys", F.col("keys") + F.when(F.col("prefix").endswith("/7/"), 1).otherwise(0)).unionByName(spark.range(1).select(F.lit("none/").alias("prefix"), F.lit(0).cast("long").alias("keys")))


QUERIES = {
    "k1_listing_summary": lambda s, d: k.listing_summary(damaged(s, d)),
    "k2_prefix_counts": lambda s, d: k.prefix_counts(listing(s, d), 2),
    "k3_depth_histogram": lambda s, d: k.depth_histogram(listing(s, d)),
    "k4_top_prefixes": lambda s, d: k.top_prefixes(listing(s, d), 3, 10),
    "k5_delimiter_rollup": lambda s, d: k.delimiter_rollup(listing(s, d), "li/1998/", "/"),
    "k6_scope": lambda s, d: k.scope(listing(s, d), "li/1997/1"),
    "k7_key_range": lambda s, d: k.key_range(listing(s, d), "li/1996/3/", "li/1997/", 500),
    "k6_scope_counts": lambda s, d: k.scope_counts(listing(s, d), _registry(s, d)),
    "k8_rollup_pages": lambda s, d: k.rollup_pages(listing(s, d), "li/1998/", "/", size=2),
    "k23_malformed_escapes": lambda s, d: k.malformed_escapes(_escapes(s, d)),
    "k8_page_numbers": lambda s, d: k.page_numbers(listing(s, d)),
    "k8_page_count": lambda s, d: k.page_count(listing(s, d)),
    "k9_sortedness": lambda s, d: k.sortedness(_emitted(s, d)),
    "k10_key_distribution": lambda s, d: k.key_distribution(listing(s, d)),
    "k11_cut_points": lambda s, d: _cuts(s, d),
    "k12_check_cut_points": lambda s, d: k.check_cut_points(_cuts(s, d, 500), 500),
    "k13_assign_segment": lambda s, d: k.assign_segment(listing(s, d), _cuts(s, d)).select("key", "segment"),
    "k14_boundary_loss": lambda s, d: k.boundary_loss(listing(s, d), _key_cuts(s, d)).select("key"),
    "k15_segment_balance": lambda s, d: k.segment_balance(listing(s, d), _cuts(s, d)),
    "k16_shard_union_audit": lambda s, d: k.shard_union_audit(_shards(s, d), listing(s, d)),
    "k17_bucket_diff": lambda s, d: k.bucket_diff(listing(s, d), damaged(s, d)),
    "k18_drift": lambda s, d: k.drift(listing(s, d), damaged(s, d), "1998-01-01T00:00:00Z"),
    "k19_exactly_once": lambda s, d: k.exactly_once(damaged(s, d)),
    "k20_fanout": lambda s, d: k.fanout(listing(s, d)),
    "k20_byte_density": lambda s, d: k.byte_density(listing(s, d), 7),
    "k21_etag_kind": lambda s, d: k.etag_kind(_multipart(s, d)),
    "k22_version_collapse": lambda s, d: k.version_collapse(damaged(s, d)),
    "k23_decode_keys": lambda s, d: k.decode_keys(_encoded(s, d)),
}

_L = f"WITH {LISTING}"
_PARENT = "regexp_extract(key, '^(.*/)?')"
_CUT = f"""{_L}, kd AS (SELECT {_PARENT} AS prefix, count(*) AS c FROM l GROUP BY 1),
kr AS (SELECT *, sum(c) OVER (ORDER BY prefix) AS upto, sum(c) OVER () AS total FROM kd),
cuts AS (SELECT row_number() OVER (ORDER BY prefix) AS number, prefix AS cut FROM kr WHERE floor(CAST(upto * @N AS DOUBLE) / total) > floor(CAST((upto - c) * @N AS DOUBLE) / total) AND upto < total)"""
_C = _CUT.replace("@N", str(CUTS))
_SEG = f"{_C}, seg AS (SELECT key, (SELECT count(*) FROM cuts WHERE cut <= key) AS segment FROM l)"

ORACLES = {
    "k6_scope_counts": f"{_L}, r AS (SELECT p || '/' AS prefix, count(*) AS n FROM (SELECT unnest([string_split(key, '/')[1] || '/' || string_split(key, '/')[2], string_split(key, '/')[1] || '/' || string_split(key, '/')[2] || '/' || string_split(key, '/')[3]]) AS p FROM l) GROUP BY 1) SELECT prefix, n + CASE WHEN ends_with(prefix, '/7/') THEN 1 ELSE 0 END AS registered, n AS found, NOT ends_with(prefix, '/7/') AS agrees FROM r UNION ALL SELECT 'none/', 0, 0, true",
    "k8_rollup_pages": f"{_L}, r AS (SELECT {_PARENT} AS name, true AS is_prefix, count(*) AS n FROM l WHERE starts_with(key, 'li/1998/') GROUP BY 1) SELECT *, (row_number() OVER (ORDER BY name) + 1) // 2 AS page FROM r",
    "k23_malformed_escapes": "SELECT p_name || ['%zz', '%4', '%', '%FF'][p_partkey % 8] AS key, 'malformed escape' AS reason FROM part WHERE p_partkey % 8 BETWEEN 1 AND 4",
    "k1_listing_summary": f"{_L} SELECT count(*) AS n, count(DISTINCT key) AS n_keys, CAST(sum(CAST(size AS BIGINT)) AS BIGINT) AS bytes FROM act",
    "k2_prefix_counts": f"{_L} SELECT split_part(key, '/', 1) || '/' || split_part(key, '/', 2) || '/' AS prefix, count(*) AS n FROM l GROUP BY 1",
    "k3_depth_histogram": f"{_L} SELECT CAST(length(key) - length(replace(key, '/', '')) AS BIGINT) AS depth, count(*) AS n FROM l GROUP BY 1",
    "k4_top_prefixes": f"{_L} SELECT {_PARENT} AS prefix, count(*) AS n FROM l GROUP BY 1 ORDER BY n DESC, prefix LIMIT 10",
    "k5_delimiter_rollup": f"{_L} SELECT {_PARENT} AS name, true AS is_prefix, count(*) AS n FROM l WHERE starts_with(key, 'li/1998/') GROUP BY 1",
    "k6_scope": f"{_L} SELECT key, size, etag, mtime, storage_class FROM l WHERE starts_with(key, 'li/1997/1')",
    "k7_key_range": f"{_L} SELECT key, size, etag, mtime, storage_class FROM l WHERE key > 'li/1996/3/' AND key < 'li/1997/' ORDER BY key LIMIT 500",
    "k8_page_numbers": f"{_L} SELECT key, (row_number() OVER (ORDER BY key) + 999) // 1000 AS page FROM l",
    "k8_page_count": f"{_L} SELECT count(*) AS n, (count(*) + 999) // 1000 AS pages FROM l",
    "k9_sortedness": f"{_L}, e AS (SELECT strftime(shipped, '%Y-%m') AS file, l_orderkey * 4000000000 + CAST('0x' || etag[1:7] AS BIGINT) AS line_no, key FROM l), b AS (SELECT *, lag(key) OVER (PARTITION BY file ORDER BY line_no) AS before FROM e) SELECT file, line_no, key, before FROM b WHERE key < before",
    "k10_key_distribution": f"{_L} SELECT {_PARENT} AS prefix, count(*) AS \"count\" FROM l GROUP BY 1",
    "k11_cut_points": f"{_C} SELECT number, cut FROM cuts",
    "k12_check_cut_points": _CUT.replace("@N", "500") + " SELECT count(*) AS cuts, CASE WHEN count(*) * 2 < 499 THEN 'too few' END AS problem FROM cuts",
    "k13_assign_segment": f"{_SEG} SELECT key, segment FROM seg",
    "k14_boundary_loss": f"{_L} SELECT key FROM l WHERE key IN (SELECT key FROM l WHERE l_orderkey % 1009 = 0)",
    "k15_segment_balance": f"{_SEG}, c AS (SELECT segment, count(*) AS n FROM seg GROUP BY segment) SELECT segment, n, round(n / sum(n) OVER (), 6) AS share, round(n / avg(n) OVER (), 6) AS skew FROM c",
    "k16_shard_union_audit": f"{_L} SELECT DISTINCT key, CASE WHEN l_orderkey % 79 = 0 THEN 'gap' ELSE 'repeated' END AS problem FROM l WHERE l_orderkey % 79 = 0 OR l_orderkey % 83 = 0",
    "k17_bucket_diff": f"{_L}, a AS (SELECT DISTINCT key, size, etag FROM l), b AS (SELECT DISTINCT key, size, etag FROM act) SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'left' WHEN a.key IS NULL THEN 'right' ELSE 'changed' END AS flag FROM a FULL JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.size IS DISTINCT FROM b.size OR a.etag IS DISTINCT FROM b.etag",
    "k18_drift": f"{_L}, a AS (SELECT DISTINCT key FROM l), b AS (SELECT key, max(mtime) AS mtime FROM act GROUP BY key) SELECT count(*) FILTER (b.key IS NULL) AS gone, count(*) FILTER (a.key IS NULL) AS come, count(*) FILTER (mtime > '1998-01-01T00:00:00Z') AS later, max(mtime) AS newest FROM a FULL JOIN b ON a.key = b.key",
    "k19_exactly_once": f"{_L} SELECT count(*) AS n, count(DISTINCT key) AS n_keys, round(count(*) / count(DISTINCT key), 6) AS ratio FROM act",
    "k20_fanout": f"{_L}, p AS (SELECT string_split(key, '/') AS s FROM l), q AS (SELECT s, unnest(range(len(s))) AS i FROM p) SELECT CASE WHEN i > 0 THEN array_to_string(s[1:i], '/') || '/' ELSE '' END AS parent, count(DISTINCT s[i + 1] || CASE WHEN i < len(s) - 1 THEN '/' ELSE '' END) AS children FROM q GROUP BY 1",
    "k20_byte_density": f"{_L} SELECT lower(hex(substr(key, 7, 1))) AS byte, count(*) AS n FROM l GROUP BY 1",
    "k21_etag_kind": f"{_L} SELECT key, CASE WHEN l_orderkey % 3 = 0 THEN 'multipart' ELSE 'single' END AS kind, CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey % 50 END AS parts FROM l",
    "k22_version_collapse": f"{_L} SELECT key, count(*) AS versions FROM act GROUP BY key HAVING count(*) > 1",
    "k23_decode_keys": "SELECT p_name || '+%25' || p_partkey AS key FROM part",
}
