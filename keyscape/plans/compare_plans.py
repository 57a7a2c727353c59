"""Queries of the set comparison (D1-D15) over two or more listings derived from lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyscape.operators import compare

from .data import LISTING, damaged, reference, table, with_order

MEMBERS = 6


def _sides(f):
    return lambda spark, d: f(reference(spark, d), damaged(spark, d))


def _subjects(spark, d) -> DataFrame:
    """Attempts of two buckets and three modes, of which two share a stratum."""
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % MEMBERS).alias("n")).distinct()
    modes = rows.select(F.concat(F.lit("m"), (F.col("n") % 3).cast("string")).alias("mode")).distinct().withColumn("product", F.when(F.col("mode") == "m2", "keys").otherwise("objects")).withColumn("fields", F.when(F.col("mode") == "m2", F.array(F.lit("key"))).otherwise(F.array(F.lit("key"), F.lit("size"))))
    subjects = rows.select(F.concat(F.lit("a"), F.col("n").cast("string")).alias("attempt_id"), F.when(F.col("n") == 5, "b1").otherwise("b0").alias("bucket"), F.concat(F.lit("m"), (F.col("n") % 3).cast("string")).alias("mode"))
    return compare.stratify(subjects, modes)


def _listings(spark, d) -> DataFrame:
    """A listing for each attempt: attempt n lacks the orders that leave remainder n by 89, and a4's times differ for those of 50."""
    li = with_order(spark, d)
    r = F.col("l_orderkey") % 89
    each = li.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(MEMBERS - 1)))).filter((r != F.col("n")) | F.col("n").isin(0, 4))
    moved = F.when((F.col("n") == 4) & (r == 50), F.concat(F.substring("mtime", 1, 11), F.lit("23:59:59Z"))).otherwise(F.col("mtime"))
    return each.select(F.concat(F.lit("a"), F.col("n").cast("string")).alias("attempt_id"), "key", "size", "etag", moved.alias("mtime"), "storage_class")


def _members(spark, d):
    return compare.compare_all(_listings(spark, d), _subjects(spark, d))


def _pairs(spark, d):
    chosen = compare.choose_reference(_subjects(spark, d))
    return compare.pair_verdict(_members(spark, d), chosen.filter("attempt_id <> reference").select(F.col("attempt_id").alias("pair")))


def _strata(spark, d):
    return compare.stratum_verdicts(_subjects(spark, d), _pairs(spark, d))


def _gaps(spark, d):
    return _subjects(spark, d).filter("attempt_id = 'a5'").select("bucket", F.lit("unsettled").alias("reason"))


def _slots(spark, d):
    return table(spark, d, "orders").select(F.when(F.col("o_orderkey") < 0, "blocked").otherwise("resolved").alias("state"))


QUERIES = {
    "d1_missing_keys": _sides(compare.missing_keys),
    "d2_extra_keys": _sides(compare.extra_keys),
    "d3_duplicate_keys": lambda s, d: compare.duplicate_keys(damaged(s, d)),
    "d4_reference_duplicates": lambda s, d: compare.duplicate_keys(reference(s, d)),
    "d5_first_per_key": lambda s, d: compare.first_per_key(damaged(s, d)),
    "d6_field_mismatches": _sides(compare.field_mismatches),
    "d7_listing_diff": _sides(compare.listing_diff),
    "d8_pair_verdict": _sides(lambda r, a: compare.pair_verdict(compare.listing_diff(r, a))),
    "d9_worst_verdict": lambda s, d: compare.worst_verdict(_strata(s, d), "bucket"),
    "d10_stratify": lambda s, d: _subjects(s, d),
    "d11_choose_reference": lambda s, d: compare.choose_reference(_subjects(s, d)),
    "d12_compare_all": _members,
    "d13_diff_samples": _sides(lambda r, a: compare.diff_samples(compare.listing_diff(r, a))),
    "d14_bucket_verdict": lambda s, d: compare.bucket_verdict(_strata(s, d), _gaps(s, d)),
    "d15_group_verdict": lambda s, d: compare.group_verdict(compare.bucket_verdict(_strata(s, d), _gaps(s, d)), _slots(s, d)),
}

_FIRST = "f AS (SELECT key, size, etag, mtime, storage_class FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY size NULLS FIRST, etag NULLS FIRST, mtime NULLS FIRST, storage_class NULLS FIRST) AS rn FROM act) WHERE rn = 1)"
_MISS = """m AS (
  SELECT r.key, 'size' AS field, f.size AS tool_value, r.size AS reference_value FROM ref r JOIN f ON r.key = f.key WHERE f.size <> r.size UNION ALL
  SELECT r.key, 'etag', f.etag, r.etag FROM ref r JOIN f ON r.key = f.key WHERE lower(f.etag) <> lower(r.etag) UNION ALL
  SELECT r.key, 'mtime', f.mtime, r.mtime FROM ref r JOIN f ON r.key = f.key WHERE f.mtime <> r.mtime UNION ALL
  SELECT r.key, 'storage_class', f.storage_class, r.storage_class FROM ref r JOIN f ON r.key = f.key WHERE f.storage_class <> r.storage_class)"""
_DIFF = """d AS (
  SELECT 'missing' AS kind, key, NULL AS field, NULL AS tool_value, NULL AS reference_value FROM ref WHERE NOT EXISTS (SELECT 1 FROM act WHERE act.key = ref.key) UNION ALL
  SELECT 'extra', key, NULL, NULL, NULL FROM act WHERE NOT EXISTS (SELECT 1 FROM ref WHERE act.key = ref.key) UNION ALL
  SELECT 'duplicate', key, NULL, NULL, NULL FROM act GROUP BY key HAVING count(*) > 1 UNION ALL
  SELECT 'reference_duplicate', key, NULL, NULL, NULL FROM ref GROUP BY key HAVING count(*) > 1 UNION ALL
  SELECT 'mismatch', key, field, tool_value, reference_value FROM m)"""
_D = f"WITH {LISTING}, {_FIRST}, {_MISS}, {_DIFF}"
_S = """s AS (SELECT 'a' || n AS attempt_id, CASE WHEN n = 5 THEN 'b1' ELSE 'b0' END AS bucket, 'm' || (n % 3) AS mode,
  CASE WHEN n % 3 = 2 THEN 'keys|key' ELSE 'objects|key,size' END AS stratum FROM (SELECT DISTINCT l_orderkey % 6 AS n FROM lineitem)),
c AS (SELECT *, min(attempt_id) OVER (PARTITION BY bucket, stratum) AS reference FROM s)"""
_M = f"""WITH {LISTING}, {_S},
x AS (SELECT 'a' || n AS attempt_id, key, size, etag, CASE WHEN n = 4 AND l_orderkey % 89 = 50 THEN mtime[1:11] || '23:59:59Z' ELSE mtime END AS mtime, storage_class
  FROM l, (SELECT unnest(range(6)) AS n) WHERE l_orderkey % 89 <> n OR n IN (0, 4)),
pr AS (SELECT attempt_id AS pair, reference FROM c WHERE attempt_id <> reference),
pa AS (SELECT pair, x.key, x.mtime FROM pr JOIN x ON x.attempt_id = pair), pf AS (SELECT pair, x.key, x.mtime FROM pr JOIN x ON x.attempt_id = reference),
dd AS (
  SELECT pair, 'missing' AS kind, key, NULL AS field, NULL AS tool_value, NULL AS reference_value FROM pf WHERE NOT EXISTS (SELECT 1 FROM pa WHERE pa.pair = pf.pair AND pa.key = pf.key) UNION ALL
  SELECT pair, 'extra', key, NULL, NULL, NULL FROM pa WHERE NOT EXISTS (SELECT 1 FROM pf WHERE pa.pair = pf.pair AND pa.key = pf.key) UNION ALL
  SELECT pair, 'mismatch', pa.key, 'mtime', pa.mtime, pf.mtime FROM pa JOIN pf USING (pair, key) WHERE pa.mtime <> pf.mtime),
v AS (SELECT pr.pair, CASE WHEN count(*) FILTER (kind IN ('missing', 'extra')) > 0 THEN 'FAIL' WHEN count(kind) > 0 THEN 'DRIFT' ELSE 'PASS' END AS verdict FROM pr LEFT JOIN dd ON dd.pair = pr.pair GROUP BY pr.pair),
st AS (SELECT bucket, stratum, count(*) AS members, coalesce(max(CASE verdict WHEN 'PASS' THEN 2 WHEN 'DRIFT' THEN 3 WHEN 'FAIL' THEN 4 END), 1) AS r FROM s LEFT JOIN v ON v.pair = s.attempt_id GROUP BY bucket, stratum),
bw AS (SELECT bucket, ['UNCOMPARED', 'PASS', 'DRIFT', 'FAIL'][max(r)] AS verdict FROM st GROUP BY bucket),
bv AS (SELECT bucket, CAST(CASE WHEN bucket = 'b1' THEN 1 ELSE 0 END AS BIGINT) AS gaps, CASE WHEN bucket = 'b1' THEN 'INCOMPLETE' ELSE verdict END AS verdict FROM bw)"""

ORACLES = {
    "d1_missing_keys": f"{_D} SELECT key FROM d WHERE kind = 'missing'",
    "d2_extra_keys": f"{_D} SELECT key FROM d WHERE kind = 'extra'",
    "d3_duplicate_keys": f"{_D} SELECT key, count(*) AS n FROM act GROUP BY key HAVING count(*) > 1",
    "d4_reference_duplicates": f"{_D} SELECT key, count(*) AS n FROM ref GROUP BY key HAVING count(*) > 1",
    "d5_first_per_key": f"{_D} SELECT key, size, etag, mtime, storage_class FROM f",
    "d6_field_mismatches": f"{_D} SELECT key, field, tool_value, reference_value FROM m",
    "d7_listing_diff": f"{_D} SELECT kind, key, field, tool_value, reference_value FROM d",
    "d8_pair_verdict": f"""{_D} SELECT *, CASE WHEN n_missing + n_extra + n_duplicate + n_reference_duplicate + n_mismatch > 0 THEN 'FAIL' WHEN n_mtime > 0 THEN 'DRIFT' ELSE 'PASS' END AS verdict FROM (
SELECT count(*) FILTER (kind = 'missing') AS n_missing, count(*) FILTER (kind = 'extra') AS n_extra, count(*) FILTER (kind = 'duplicate') AS n_duplicate,
count(*) FILTER (kind = 'reference_duplicate') AS n_reference_duplicate, count(*) FILTER (kind = 'mismatch' AND field <> 'mtime') AS n_mismatch,
count(*) FILTER (kind = 'mismatch' AND field = 'mtime') AS n_mtime FROM d)""",
    "d9_worst_verdict": f"{_M} SELECT bucket, verdict FROM bw",
    "d10_stratify": f"WITH {_S} SELECT mode, attempt_id, bucket, stratum FROM s",
    "d11_choose_reference": f"WITH {_S} SELECT mode, attempt_id, bucket, stratum, reference FROM c",
    "d12_compare_all": f"{_M} SELECT pair, kind, key, field, tool_value, reference_value FROM dd",
    "d13_diff_samples": f"""{_D}, k AS (SELECT DISTINCT kind, key FROM d), r AS (SELECT kind, key, row_number() OVER (PARTITION BY kind ORDER BY key) AS place, count(*) OVER (PARTITION BY kind) AS n FROM k)
SELECT kind, key, place, greatest(n - 5, 0) AS more FROM r WHERE place <= 5""",
    "d14_bucket_verdict": f"{_M} SELECT bucket, gaps, verdict FROM bv",
    "d15_group_verdict": f"{_M} SELECT count(*) AS buckets, CAST(0 AS BIGINT) AS owed, 'INCOMPLETE' AS verdict, CAST(9 AS INTEGER) AS exit_code FROM bv",
}
