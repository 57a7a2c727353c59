"""Queries of the sources and sinks (S1-S10, S13-S17): listings derived from the tables, written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyscape.functions.listing import FIELDS
from keyscape.operators.compare import diff_differing, differing, mirrored, missing_keys, tagged
from keyscape.operators.keyspace import scope
from keyscape.operators.normalize import normalize
from keyscape.sources import listings as s
from keyscape.sources.records import read_verify, write_verify
from keyscape.sources.shared import scratch_path

from .data import LISTING, damaged, dealt, listed, listed_key, listing, reference, table
from .normalize_plans import _EXPECTED, raw


def _files(df: DataFrame, by: str, value: str, path: str, suffix: str = "") -> None:
    """Texts grouped by a column, one to a folder, as whole files."""
    df.select(by, F.col(value).alias("value")).repartition(by).write.option("lineSep", suffix or "\n").partitionBy(by).text(path)


def _canonical(spark, d):
    path = scratch_path(spark, "s1")
    s.write_canonical(damaged(spark, d), path, "tsv")
    return s.read_canonical(spark, path)


def _lines(spark, d):
    path = scratch_path(spark, "s2")
    table(spark, d, "part").select(F.concat("p_name", F.lit("\r"), F.col("p_partkey").cast("string")).alias("value")).write.option("lineSep", "\n").text(path)
    return s.read_lines(spark, path).select("value")


def _ndjson(spark, d):
    path = scratch_path(spark, "s3")
    raw(spark, d, "url_json").write.option("lineSep", "\n").text(path)
    return normalize(s.read_ndjson(spark, path, "key string, type string, size bigint, etag string, last_modified string, storage_class string"), "url_json")


#: Records of a written JSON document.
PAGE_ROWS = 20_000


def _listed_pages(spark, d: str, element) -> DataFrame:
    """(page, items): the listing's rows gathered as `element`, dealt out by page as rows of lineitem; a page has about PAGE_ROWS records."""
    li = table(spark, d, "lineitem")
    page = F.pmod(F.xxhash64(listed_key()), F.lit(max(1, li.count() // PAGE_ROWS))).cast("string")
    return listed(dealt(li, page), page.alias("page")).groupBy("page").agg(F.collect_list(element).alias("items"))


def _page_files(pages: DataFrame, path: str) -> None:
    """A file for each row (page, j)."""
    pages.select("page", F.col("j").alias("value")).write.partitionBy("page").text(path)


def _pages(rows: DataFrame, by, element: str, *own: str) -> DataFrame:
    """rows with `element` gathered to pages, and the page's name; each page has about PAGE_ROWS records, however many rows there are."""
    n = max(1, rows.count() // PAGE_ROWS)
    page = F.concat_ws("-", *own, F.pmod(F.xxhash64(by), F.lit(n)).cast("string"))
    return rows.groupBy(page.alias("page"), *own).agg(F.collect_list(element).alias("items"))


def _array(spark, d):
    """An array for each page."""
    path = scratch_path(spark, "s4")
    item = F.struct(F.col("key").alias("Path"), F.col("size").cast("bigint").alias("Size"), F.col("mtime").alias("ModTime"), F.lit(False).alias("IsDir"), F.col("storage_class").alias("Tier"))
    _page_files(_listed_pages(spark, d, item).select("page", F.to_json("items").alias("j")), path)
    return normalize(s.read_json_array(spark, f"{path}/*", "Path string, Size bigint, ModTime string, IsDir boolean, Tier string"), "path_json", prefix="top/")


def _object(spark, d):
    path = scratch_path(spark, "s5")
    item = F.struct(F.col("key").alias("Key"), F.col("size").cast("bigint").alias("Size"), F.col("etag").alias("ETag"), F.col("mtime").alias("LastModified"), F.col("storage_class").alias("StorageClass"))
    _page_files(_listed_pages(spark, d, item).select("page", F.to_json(F.struct(F.col("items").alias("Contents"))).alias("j")), path)
    pages = s.read_json_object(spark, f"{path}/*")
    return normalize(pages, "contents").unionByName(normalize(pages, "common_prefixes"))


def _dataset(spark, d):
    path = scratch_path(spark, "s6")
    raw(spark, d, "sink_parquet").write.parquet(path)
    return normalize(s.read_dataset(spark, path), "sink_parquet")


def _epoch(spark, d):
    path = scratch_path(spark, "s7")
    raw(spark, d, "epoch_parquet").write.parquet(path)
    return normalize(s.read_epoch_parquet(spark, path), "epoch_parquet")


def _gzip(spark, d):
    path = scratch_path(spark, "s8")
    raw(spark, d, "ls").write.option("compression", "gzip").option("lineSep", "\n").text(path)
    return normalize(s.read_lines(spark, path), "ls")


def _tree(spark, d, name: str) -> str:
    """A folder for each nation: customers as JSON and as key=value lines, without a line feed at the end."""
    path = scratch_path(spark, name)
    n = F.col("c_nationkey").cast("string")
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.max("c_custkey").alias("last"))
    if name == "s10":
        rows = rows.select(F.col("c_nationkey").alias("nation"), F.concat(F.lit("n="), F.col("n").cast("string"), F.lit("\nurl=a=b\nn=0\nlast="), F.col("last").cast("string")).alias("v"))
    else:
        rows = rows.select(F.col("c_nationkey").alias("nation"), F.concat(F.lit('{"nation":'), n, F.lit(',"n":'), F.col("n").cast("string"), F.lit("}")).alias("v"))
    _files(rows, "nation", "v", path)
    return path


def _nation():
    return F.regexp_extract("p", r"nation=(\d+)", 1).cast("int")


def _evidence(spark, d):
    e = s.read_evidence(spark, _tree(spark, d, "s9"), "part-*")
    return e.withColumn("p", F.col("prefix")).select(_nation().alias("nation"), F.try_variant_get("doc", "$.n", "bigint").alias("n"), "sha256")


def _receipts(spark, d):
    r = s.read_receipts(spark, f"{_tree(spark, d, 's10')}/*")
    return r.withColumn("p", F.col("path")).select(_nation().alias("nation"), F.element_at("kv", "n").alias("n"), F.element_at("kv", "url").alias("url"), F.element_at("kv", "last").alias("last"))


def _claims(spark, d):
    path = scratch_path(spark, "s13")
    k = F.col("o_orderkey")
    evidence = F.array(F.struct(F.when(k % 2 == 0, "run").otherwise("source").alias("kind"), F.concat(F.lit("r"), k.cast("string")).alias("receipt")), F.struct(F.lit("none").alias("kind"), F.lit(None).cast("string").alias("receipt")))
    claim = F.struct(F.concat(F.lit("c"), k.cast("string")).alias("id"), F.lit("supported").alias("status"), evidence.alias("evidence"))
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("t"), (F.col("o_custkey") % 5).cast("string")).alias("tool"), claim.alias("e"))
    rows = _pages(rows, "o_orderkey", "e", "tool").select("page", F.to_json(F.struct("tool", F.col("items").alias("claims"))).alias("j"))
    _page_files(rows, path)
    claims, evidence = s.read_claims(spark, f"{path}/*")
    return evidence.join(claims.select("tool", F.col("id").alias("claim_id"), "status"), ["tool", "claim_id"]).select("tool", "claim_id", "status", "kind", "receipt")


def _inventory(spark, d):
    i = s.artifact_inventory(spark, _tree(spark, d, "s14")).filter("path like 'nation=%'")
    return i.withColumn("p", F.col("path")).select(_nation().alias("nation"), "sha256", "size")


def _sink(spark, d):
    path = scratch_path(spark, "s15")
    s.write_canonical(damaged(spark, d), path)
    return spark.read.parquet(path).groupBy("storage_class").agg(F.count("*").alias("n"), F.count("etag").alias("n_etag"))


#: Rows of a bucket of a stored listing, about.
BUCKET_ROWS = 500_000


def _stored(spark, d):
    """Keys that one stored listing lacks of another, below a prefix; both have as many buckets, by the rows that there are."""
    n = max(8, listing(spark, d).count() // BUCKET_ROWS)
    one, two = (s.store_listing(f(spark, d), f"stored_{uuid.uuid4().hex}", scratch_path(spark, "stored"), n) for f in (reference, damaged))
    return missing_keys(scope(one, "li/1997/"), two)


def _verify(spark, d):
    """Three attempts' diffs are written; then a2 is compared again without differences, and a3 the other way round.

    Both ways ask for the rows of the same keys, so the listings are compared once.
    """
    path = scratch_path(spark, "s16")
    odd = differing(tagged(reference(spark, d), damaged(spark, d)))
    columns = ("kind", "key", "field", "tool_value", "reference_value")
    attempts = lambda *names: spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("attempt_id"))
    one = diff_differing(odd).select(F.explode(F.array(F.lit("a1"), F.lit("a2"), F.lit("a3"))).alias("attempt_id"), *columns)
    write_verify(one, attempts("a1", "a2", "a3"), path)
    write_verify(diff_differing(mirrored(odd)).select(F.lit("a3").alias("attempt_id"), *columns), attempts("a2", "a3"), path)
    records, diff = read_verify(spark, path)
    rows = diff.groupBy("attempt_id").agg(F.count("*").alias("n_rows"))
    return records.drop("digest").join(rows, "attempt_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def _report(spark, d):
    """Orders as report rows of five buckets, with bars and line feeds in a column and two kinds of notes."""
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("bucket"), F.format_string("o%09d", "o_orderkey").alias("attempt_id"), F.concat(F.lit("a|b\n"), "o_orderstatus").alias("state"), F.lit(None).cast("string").alias("exit"))
    notes = rows.select("bucket", F.explode(F.array(F.lit("Comparison strata"), F.lit("Rate cases"))).alias("title")).distinct().withColumn("note", F.concat("title", F.lit(" of "), "bucket"))
    blocked = table(spark, d, "region").select(F.concat_ws(" ", F.lit("slot"), "r_name").alias("note"))
    return s.report_sections(rows, ["attempt_id", "state", "exit"], notes, blocked)


QUERIES = {
    "s1_read_canonical": _canonical, "s2_read_lines": _lines, "s3_read_ndjson": _ndjson, "s4_read_json_array": _array, "s5_read_json_object": _object, "s6_read_dataset": _dataset,
    "s7_read_epoch_parquet": _epoch, "s8_read_gzip": _gzip, "s9_read_evidence": _evidence, "s10_read_receipts": _receipts, "s13_read_claims": _claims, "s14_artifact_inventory": _inventory,
    "s15_stored_listing": _stored, "s15_write_canonical": _sink, "s16_write_verify": _verify,
    "s17_report_sections": _report,
    "s17_report_table": lambda spark, d: s.report_table(listing(spark, d).withColumn("etag", F.lit(None).cast("string")), list(FIELDS)),
}


def _listed(fmt: str) -> str:
    rows, *fields = _EXPECTED[fmt]
    return f"WITH {LISTING} SELECT {', '.join(f'CAST({e} AS VARCHAR) AS {n}' for e, n in zip(fields, FIELDS, strict=True))} FROM l WHERE {rows}"


_N = "WITH n AS (SELECT c_nationkey AS nation, count(*) AS n, max(c_custkey) AS last FROM customer GROUP BY 1)"
_J = "'{\"nation\":' || nation || ',\"n\":' || n || '}' || chr(10)"
_DASH = lambda c: f"coalesce({c}, '-') AS {c}"
_KINDS = """d AS (SELECT 'missing' AS kind, key FROM ref WHERE NOT EXISTS (SELECT 1 FROM act WHERE act.key = ref.key) UNION ALL
  SELECT 'extra', key FROM act WHERE NOT EXISTS (SELECT 1 FROM ref WHERE act.key = ref.key) UNION ALL
  SELECT 'duplicate', key FROM act GROUP BY key HAVING count(*) > 1 UNION ALL SELECT 'reference_duplicate', key FROM ref GROUP BY key HAVING count(*) > 1)"""
ORACLES = {
    "s1_read_canonical": f"WITH {LISTING} SELECT key, " + ", ".join(map(_DASH, FIELDS[1:])) + ", CAST(5 AS INTEGER) AS n_fields FROM act",
    "s2_read_lines": "SELECT p_name || chr(13) || p_partkey AS value FROM part",
    "s3_read_ndjson": _listed("url_json"),
    "s4_read_json_array": f"WITH {LISTING} SELECT 'top/' || key AS key, size, CAST(NULL AS VARCHAR) AS etag, mtime, storage_class FROM l",
    "s5_read_json_object": _listed("contents"), "s6_read_dataset": _listed("sink_parquet"), "s7_read_epoch_parquet": _listed("epoch_parquet"), "s8_read_gzip": _listed("ls"),
    "s9_read_evidence": f"{_N} SELECT nation, n, sha256({_J}) AS sha256 FROM n",
    "s10_read_receipts": f"{_N} SELECT nation, CAST(n AS VARCHAR) AS n, 'a=b' AS url, CAST(last AS VARCHAR) AS last FROM n",
    "s13_read_claims": "SELECT 't' || (o_custkey % 5) AS tool, 'c' || o_orderkey AS claim_id, 'supported' AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'run' ELSE 'source' END AS kind, 'r' || o_orderkey AS receipt FROM orders UNION ALL SELECT 't' || (o_custkey % 5), 'c' || o_orderkey, 'supported', 'none', NULL FROM orders",
    "s14_artifact_inventory": f"{_N} SELECT nation, sha256({_J}) AS sha256, CAST(length({_J}) AS BIGINT) AS size FROM n",
    "s15_write_canonical": f"WITH {LISTING} SELECT storage_class, count(*) AS n, count(etag) AS n_etag FROM act GROUP BY 1",
    "s15_stored_listing": f"WITH {LISTING} SELECT key FROM ref WHERE starts_with(key, 'li/1997/') AND NOT EXISTS (SELECT 1 FROM act WHERE act.key = ref.key)",
    "s16_write_verify": f"""WITH {LISTING}, {_KINDS}, f AS (SELECT DISTINCT ON (key) * FROM act), g AS (SELECT DISTINCT ON (key) * FROM ref),
n AS (SELECT count(*) FILTER (kind = 'missing') AS mi, count(*) FILTER (kind = 'extra') AS ex, count(*) FILTER (kind = 'duplicate') AS du, count(*) FILTER (kind = 'reference_duplicate') AS rd FROM d),
m AS (SELECT 'a1' AS attempt_id, r.size <> f.size AS a, lower(r.etag) <> lower(f.etag) AS b, r.mtime <> f.mtime AS c FROM ref r JOIN f USING (key) UNION ALL SELECT 'a3', g.size <> t.size, lower(g.etag) <> lower(t.etag), g.mtime <> t.mtime FROM act t JOIN g USING (key)),
h AS (SELECT attempt_id, count(*) FILTER (a) + count(*) FILTER (b) AS hard, count(*) FILTER (c) AS soft FROM m GROUP BY attempt_id)
SELECT attempt_id, n_missing, n_extra, n_duplicate, n_reference_duplicate, hard AS n_mismatch, soft AS n_mtime, verdict, mi + ex + du + rd + hard + soft AS n_rows FROM
(SELECT 'a1' AS attempt_id, mi AS n_missing, ex AS n_extra, du AS n_duplicate, rd AS n_reference_duplicate, 'FAIL' AS verdict, * FROM n UNION ALL SELECT 'a3', ex, mi, rd, du, 'FAIL', * FROM n) JOIN h USING (attempt_id)
UNION ALL SELECT 'a2', 0, 0, 0, 0, 0, 0, 'PASS', 0""",
    "s17_report_sections": """WITH o AS (SELECT o_orderpriority AS section, printf('o%09d', o_orderkey) AS attempt_id, o_orderstatus AS s FROM orders), b AS (SELECT DISTINCT section FROM o)
SELECT section, '' AS part, row_number() OVER (PARTITION BY section ORDER BY attempt_id) AS "at", '| ' || attempt_id || ' | a\\|b ' || s || ' | - |' AS line FROM o
UNION ALL SELECT section, '', "at", line FROM b, (VALUES (-3, ''), (-2, '| attempt_id | state | exit |'), (-1, '| --- | --- | --- |')) t("at", line) UNION ALL SELECT section, '', -4, '## ' || section FROM b
UNION ALL SELECT section, part, "at", CASE "at" WHEN 1 THEN '- ' || part || ' of ' || section WHEN -2 THEN '### ' || part ELSE '' END FROM b, (VALUES ('Comparison strata'), ('Rate cases')) p(part), (VALUES (-3), (-2), (-1), (1)) t("at")
UNION ALL SELECT '', '', row_number() OVER (ORDER BY r_name), '> **Blocked slot**: slot ' || r_name || ' -- this group is incomplete.' FROM region""",
    "s17_report_table": f"WITH {LISTING} SELECT '| ' || key || ' | ' || size || ' | - | ' || mtime || ' | ' || storage_class || ' |' AS line FROM l",
}
