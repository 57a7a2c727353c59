"""Queries of the contract gates (C1-C11) and the text audits (T1-T13) over derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyscape.functions.listing import FIELDS
from keyscape.operators import audits as a
from keyscape.operators import gates as g

from .data import LISTING, table, with_order


# --- gates -----------------------------------------------------------------

#: A listing whose rows break the contract by the remainder of l_orderkey by 23 (Spark and DuckDB alike).
_BROKEN = {
    "key": "CASE l_orderkey % 23 WHEN 1 THEN key || '\t' || 'x' WHEN 2 THEN '' WHEN 3 THEN '-' ELSE key END",
    "size": "CASE l_orderkey % 23 WHEN 4 THEN '12a' WHEN 5 THEN '' WHEN 6 THEN '-' ELSE size END",
    "etag": "CASE l_orderkey % 23 WHEN 7 THEN '\"' || etag || '\"' WHEN 8 THEN etag || ' ' WHEN 9 THEN '-' ELSE etag END",
    "mtime": "CASE l_orderkey % 23 WHEN 10 THEN replace(mtime, 'T', ' ') WHEN 11 THEN replace(mtime, 'Z', '+00:00') WHEN 12 THEN replace(mtime, 'Z', '.5Z') ELSE mtime END",
    "storage_class": "CASE l_orderkey % 23 WHEN 13 THEN 'two words' WHEN 14 THEN CAST(NULL AS STRING) ELSE storage_class END",
}


def _broken(spark, d) -> DataFrame:
    return with_order(spark, d).selectExpr(*[f"{e} AS {c}" for c, e in _BROKEN.items()], "l_orderkey")


def _gate(name: str, gate):
    return lambda s, d: _broken(s, d).select(F.col(name).alias("value"), gate(F.col(name)).alias("reason")).filter("reason is not null").groupBy("value", "reason").agg(F.count("*").alias("n"))


def _lines(spark, d) -> DataFrame:
    return _broken(spark, d).select(F.concat_ws("\t", F.col("key"), F.col("size"), F.when(F.col("l_orderkey") % 5 > 0, F.col("etag")), F.when(F.col("l_orderkey") % 5 > 0, F.col("mtime"))).alias("value"))


def _fixed(spark, d) -> DataFrame:
    return with_order(spark, d).select(F.when(F.col("l_orderkey") % 10 == 0, F.concat(F.lpad("size", 16, "9"), F.lit("  "), "mtime", F.lit("      "), "key")).when(F.col("l_orderkey") % 10 == 1, F.lit("short")).otherwise(F.concat(F.lpad("size", 14, " "), F.lit("  "), F.rpad("mtime", 24, " "), F.lit("  "), "key")).alias("value"))


def _split(spark, d) -> DataFrame:
    return g.reason_counts(g.fold_unexposed(_broken(spark, d).select(*FIELDS)))


def _quarantine(spark, d) -> DataFrame:
    _, bad = g.validate(g.fold_unexposed(_broken(spark, d).select(*FIELDS)), "split")
    return bad.select("key", F.array_join("reasons", ",").alias("reasons"))


_B = f"WITH {LISTING}, b AS (SELECT l_orderkey, " + ", ".join(f"{e} AS {c}" for c, e in _BROKEN.items()) + " FROM l)"
_BY = {
    "key": "key = '' OR contains(key, chr(9))", "size": "size IS NOT NULL AND NOT regexp_full_match(size, '[0-9]+')",
    "etag": "etag IS NOT NULL AND NOT regexp_full_match(etag, '[!#-~]+')",
    "mtime": r"mtime IS NOT NULL AND NOT regexp_full_match(mtime, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(Z|\+00:00|\+0000)')",
    "storage_class": "storage_class IS NOT NULL AND NOT regexp_full_match(storage_class, '[!-~]+')",
}
_FOLDED = "f AS (SELECT key, " + ", ".join(f"nullif({c}, '-') AS {c}" for c in FIELDS[1:]) + " FROM b)"

# --- text audits -------------------------------------------------------------

#: Seeded text of documents (Spark and DuckDB alike).
_SEEDED = (
    "text || CASE WHEN doc_id % 50 = 0 THEN ' AKIA' || upper(substr(md5(CAST(doc_id AS STRING)), 1, 16)) WHEN doc_id % 53 = 0 THEN ' -----BEGIN PRIVATE KEY-----' "
    "WHEN doc_id % 59 = 0 THEN ' aws_secret_access_key = ' || md5(CAST(doc_id AS STRING)) WHEN doc_id % 61 = 0 THEN ' Authorization: Bearer x' ELSE '' END"
)
_PAGE = (
    "'# Page *' || doc_id || '*' || chr(10) || '## Part A' || chr(10) || '[next](p' || (doc_id + 1) || '.md#part-a-1) and [far](https://x.example/)' || chr(10) || "
    "'## Part A' || chr(10) || '[top](#page-' || (doc_id - doc_id % 3) || ') [file](../data/f' || (doc_id % 7) || '.txt) [raw](../data/f1.txt#x)' || chr(10) || '<a id=\"own' || (doc_id % 5) || '\">' || chr(10) || "
    "'see [SRC src/f' || (doc_id % 9) || '.c:' || (doc_id % 4) || '-' || (doc_id % 30) || ',2; lib/g.c @ abcdef' || (doc_id % 5) || '] and' || chr(10) || '[SRC odd path:1] [SRC src/f1.c:40]'"
)


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").selectExpr("doc_id", f"{_SEEDED.replace('STRING', 'STRING')} AS text")


def _pages(spark, d) -> DataFrame:
    page = _PAGE.replace("chr(10)", "'\\n'")
    return table(spark, d, "documents").selectExpr("concat('docs/p', doc_id, '.md') AS page", f"{page} AS text")


def _cites(spark, d) -> DataFrame:
    return a.citations(_pages(spark, d))


def _files(spark, d) -> DataFrame:
    """A file of 25 lines for each (commit, path) but src/f8.c."""
    rows = table(spark, d, "documents").select((F.col("doc_id") % 5).alias("c"), (F.col("doc_id") % 9).alias("p")).distinct()
    return rows.filter("p < 8").select(F.concat(F.lit("abcdef"), F.col("c").cast("string")).alias("commit"), F.concat(F.lit("src/f"), F.col("p").cast("string"), F.lit(".c")).alias("path"), F.repeat(F.lit("x\n"), 25).alias("content"))


def _other_files(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.concat(F.lit("data/f"), (F.col("doc_id") % 6).cast("string"), F.lit(".txt")).alias("path")).distinct()


def _repo_cites(spark, d) -> DataFrame:
    return _cites(spark, d).filter("parsed").select(F.concat(F.lit("r"), F.length("path").cast("string")).alias("repository"), "commit", "path")


def _roots(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").select((F.col("doc_id") % 9).alias("n")).distinct().filter("n in (7, 8)")
    return rows.select(F.concat(F.lit("r"), F.col("n").cast("string")).alias("repository"), F.concat(F.lit("abcdef"), (F.col("n") - 4).cast("string"), F.lit("0000")).alias("revision"))


#: Claims, their evidence and origins from orders (Spark and DuckDB alike).
_CLAIM = {
    "tool": "'t' || (o_custkey % 5)", "id": "'c' || (o_orderkey % 4001)",
    "status": "CASE o_orderkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'supported' WHEN 2 THEN 'unverified' ELSE 'unverifiable' END",
    "kind": "CASE o_orderkey % 7 WHEN 0 THEN 'run' WHEN 1 THEN 'source' WHEN 2 THEN 'documentation' WHEN 3 THEN 'observation' ELSE 'none' END",
    "reason": "CASE WHEN o_orderkey % 5 > 0 THEN 'why' END",
    "kind2": "CASE WHEN o_orderkey % 3 = 0 THEN 'run' ELSE 'none' END",
}
_EVIDENCE = {
    "tool": "'t' || (o_custkey % 5)", "claim_id": "'c' || o_orderkey", "kind": _CLAIM["kind"],
    "subject": "CASE WHEN o_orderkey % 2 = 0 THEN 'tested-variant' ELSE 'upstream' END", "repository": "'repo' || (o_custkey % 6)", "\"commit\"": "substr(md5('x' || (o_custkey % 5)), 1, 7 + CAST(o_orderkey % 3 AS INT)) || CASE WHEN o_orderkey % 11 = 0 THEN 'z' ELSE '' END",
    "path": "'d' || (o_orderkey % 40)", "receipt": "CASE WHEN o_orderkey % 3 = 0 THEN 'r' || (o_orderkey % 50) ELSE '' END", "artifact": "CASE WHEN o_orderkey % 4 = 0 THEN 'f' || (o_orderkey % 30) END",
}


def _orders(spark, d, exprs: dict[str, str]) -> DataFrame:
    return table(spark, d, "orders").selectExpr(*[f"{e} AS {c}".replace('"commit"', "commit") for c, e in exprs.items()])


def _claims(spark, d) -> DataFrame:
    both = F.array(F.struct("kind", "reason"), F.struct(F.col("kind2").alias("kind"), F.lit("why").alias("reason")))
    return _orders(spark, d, _CLAIM).select("tool", "id", "status", both.alias("evidence"))


def _inventory(spark, d) -> DataFrame:
    n = F.explode(F.array(F.concat(F.lit("d"), (F.col("o_orderkey") % 37).cast("string")), F.concat(F.lit("r"), (F.col("o_orderkey") % 48).cast("string")), F.concat(F.lit("f"), (F.col("o_orderkey") % 30).cast("string"))))
    return table(spark, d, "orders").select(F.concat(F.lit("t"), (F.col("o_custkey") % 4).cast("string")).alias("tool"), n.alias("path")).distinct()


def _tools(spark, d) -> DataFrame:
    n = table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("n")).distinct()
    s = F.col("n").cast("string")
    return n.select(F.concat(F.lit("t"), s).alias("tool"), F.concat(F.lit("repo"), s).alias("tested_repository"), F.when(F.col("n") != 3, F.md5(F.concat(F.lit("x"), s))).alias("tested_revision"), F.concat(F.lit("repo"), (F.col("n") + 1).cast("string")).alias("upstream_repository"))


_ORIGIN = {
    "expected": "SELECT DISTINCT 't' || (o_custkey % 5) AS tool, 'O-' || (o_custkey % 300) AS origin FROM orders WHERE o_custkey % 300 % 17 <> 0",
    "claims": "SELECT 't' || (o_custkey % 5) AS tool, 'c' || (o_custkey % 300 % 7) AS id, 'O-' || (o_custkey % 300) AS origin FROM orders WHERE o_custkey % 300 % 19 <> 0",
    "mapping": "SELECT 't' || (o_custkey % 5) AS tool, 'O-' || (o_custkey % 300) AS origin, CASE WHEN o_custkey % 300 % 31 = 0 THEN o_orderkey % 2 ELSE 0 END AS entry, "
    "CASE WHEN o_custkey % 300 % 37 = 0 THEN 'other' WHEN o_custkey % 300 % 29 = 0 THEN 'c1' ELSE 'c' || (o_custkey % 300 % 7) END AS id FROM orders WHERE o_custkey % 300 % 23 <> 0",
}


def _origins(spark, d) -> DataFrame:
    orders = table(spark, d, "orders")
    e, c, m = (spark.sql(q.replace("FROM orders", "FROM {o}"), o=orders) for q in _ORIGIN.values())
    return a.origin_conservation(e, c, m)


def _joined(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, F.array_join(c, ","))


def _folder_links(spark, d):
    """Each page links to folders with and without a README.md, with and without fragments, and to one that isn't there."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("docs/p"), "doc_id", F.lit(".md")).alias("page"), (F.col("doc_id") % 5).cast("string").alias("n"))
    readme = F.concat(F.lit("tools/t"), "n", F.lit("/README.md"))
    pages = docs.select("page").unionByName(docs.select(readme.alias("page")).distinct())
    targets = [F.lit(x) for x in ("..", "../data", "../data/", "../data#top", "../none", "../tools#x")] + [F.concat(F.lit("../tools/t"), "n", F.lit(x)) for x in ("", "/#usage", "#nothing", "/../t0#usage")]
    ids = docs.select(readme.alias("page"), F.lit("usage").alias("id")).distinct()
    return a.link_integrity(docs.select("page", F.explode(F.array(*targets)).alias("target")), pages, ids, _other_files(spark, d))


QUERIES = {
    "c1_gate_fields": lambda s, d: _lines(s, d).select(g.gate_fields(F.col("value")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")),
    "c2_gate_key": _gate("key", g.gate_key), "c3_gate_size": _gate("size", g.gate_size), "c4_gate_etag": _gate("etag", g.gate_etag),
    "c5_gate_mtime": _gate("mtime", g.gate_mtime), "c6_gate_storage_class": _gate("storage_class", g.gate_storage_class),
    "c7_fold_unexposed": lambda s, d: g.fold_unexposed(_broken(s, d).select(*FIELDS)),
    "c8_canonical_mtime": lambda s, d: g.canonical_mtime(_broken(s, d).select("key", "mtime")),
    "c9_null_gate": lambda s, d: g.null_gate(_broken(s, d)),
    "c10_gate_escape": lambda s, d: _broken(s, d).select(F.concat("key", F.when(F.col("l_orderkey") % 31 == 0, F.lit("\\x0A")).otherwise("")).alias("key")).select("key", g.gate_escape(F.col("key")).alias("reason")).filter("reason is not null"),
    "c11_gate_table_line": lambda s, d: _fixed(s, d).select(g.gate_table_line(F.col("value")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")),
    "c_validate_split": _split,
    "c_quarantine": _quarantine,
    "t1_credential_scan": lambda s, d: _joined(a.credential_scan(_docs(s, d), "doc_id", "text"), "patterns"),
    "t2_citations": _cites,
    "t3_parse_ranges": lambda s, d: _cites(s, d).filter("lines is not null").select("page", "line", F.posexplode(a.parse_ranges(F.col("lines"))).alias("n", "r")).select("page", "line", F.col("n").cast("long").alias("n"), "r.first", "r.last"),
    "t4_check_citations": lambda s, d: a.check_citations(_cites(s, d).filter("parsed").select("page", "commit", "path", "lines"), _files(s, d)),
    "t5_citation_tally": lambda s, d: a.citation_tally(_repo_cites(s, d), _roots(s, d), _files(s, d).select(F.concat(F.lit("r"), F.length("path").cast("string")).alias("repository"), "path")),
    "t6_links": lambda s, d: a.links(_pages(s, d)),
    "t7_heading_ids": lambda s, d: a.heading_ids(_pages(s, d)),
    "t8_folder_links": _folder_links,
    "t8_link_integrity": lambda s, d: a.link_integrity(a.links(_pages(s, d)), _pages(s, d), a.heading_ids(_pages(s, d)), _other_files(s, d)),
    "t9_claim_rules": lambda s, d: a.claim_rules(_claims(s, d)),
    "t10_duplicate_claims": lambda s, d: a.duplicate_claims(_claims(s, d)),
    "t11_missing_evidence": lambda s, d: a.missing_evidence(_orders(s, d, _EVIDENCE), _inventory(s, d)),
    "t12_provenance": lambda s, d: a.provenance(_orders(s, d, _EVIDENCE), _tools(s, d)),
    "t13_origin_conservation": _origins,
}


def _gate_sql(name: str) -> str:
    return f"{_B} SELECT {name} AS value, '{name}' AS reason, count(*) AS n FROM b WHERE {_BY[name]} GROUP BY 1"


_REASONS = "concat_ws(',', " + ", ".join(f"CASE WHEN {_BY[c]} THEN '{c}' END" for c in FIELDS) + ")"
_P = f"WITH p AS (SELECT doc_id, 'docs/p' || doc_id || '.md' AS page, {_PAGE} AS text FROM documents)"
_X = f"""{_P}, x AS (
  SELECT doc_id, page, CAST(7 AS BIGINT) AS line, 'abcdef' || (doc_id % 5) AS "commit", 'src/f' || (doc_id % 9) || '.c' AS path, (doc_id % 4) || '-' || (doc_id % 30) || ',2' AS lines, true AS parsed FROM p UNION ALL
  SELECT doc_id, page, 7, 'abcdef' || (doc_id % 5), 'lib/g.c', NULL, true FROM p UNION ALL
  SELECT doc_id, page, 8, 'abcdef' || (doc_id % 5), NULL, NULL, false FROM p UNION ALL
  SELECT doc_id, page, 8, 'abcdef' || (doc_id % 5), 'src/f1.c', '40', true FROM p)"""
_PAT = [p.replace("'", "''") for p in a.CREDENTIAL_PATTERNS.values()]
_NAMES = list(a.CREDENTIAL_PATTERNS)
_CL = "WITH c AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _CLAIM.items()) + " FROM orders)"
_EV = "WITH e AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _EVIDENCE.items()) + " FROM orders)"
_OR = "WITH " + ", ".join(f"{n} AS ({q})" for n, q in _ORIGIN.items()) + """,
c AS (SELECT tool, origin, string_agg(DISTINCT id, ',' ORDER BY id) AS c FROM claims GROUP BY 1, 2),
m AS (SELECT tool, origin, string_agg(DISTINCT id, ',' ORDER BY id) AS m, count(DISTINCT entry) AS entries, bool_or(NOT EXISTS (SELECT 1 FROM claims WHERE claims.tool = mapping.tool AND claims.id = mapping.id)) AS stray FROM mapping GROUP BY 1, 2),
k AS (SELECT tool, origin FROM expected UNION SELECT tool, origin FROM c UNION SELECT tool, origin FROM m),
j AS (SELECT k.tool, k.origin, expected.tool IS NOT NULL AS e, c, m, entries, stray FROM k LEFT JOIN expected ON expected.tool = k.tool AND expected.origin = k.origin LEFT JOIN c ON c.tool = k.tool AND c.origin = k.origin LEFT JOIN m ON m.tool = k.tool AND m.origin = k.origin)
SELECT tool, origin, 'missing' AS problem FROM j WHERE e AND c IS NULL UNION ALL SELECT tool, origin, 'unexpected' FROM j WHERE NOT e AND c IS NOT NULL UNION ALL
SELECT tool, origin, 'unmapped' FROM j WHERE e AND m IS NULL UNION ALL SELECT tool, origin, 'mapped but unexpected' FROM j WHERE NOT e AND m IS NOT NULL UNION ALL
SELECT tool, origin, 'mapped twice' FROM j WHERE entries > 1 UNION ALL SELECT tool, origin, 'unknown claim' FROM j WHERE stray UNION ALL
SELECT tool, origin, 'mapping disagrees' FROM j WHERE m IS NOT NULL AND m <> coalesce(c, '')"""
_SETTLED = "('source', 'documentation', 'run', 'observation')"

ORACLES = {
    "c1_gate_fields": f"{_B} SELECT CASE WHEN n = 3 THEN 'three fields: an old format' WHEN n <> 5 THEN 'not five fields' END AS reason, count(*) AS n FROM (SELECT len(string_split(concat_ws(chr(9), key, size, CASE WHEN l_orderkey % 5 > 0 THEN etag END, CASE WHEN l_orderkey % 5 > 0 THEN mtime END), chr(9))) AS n FROM b) GROUP BY 1",
    **{f"c{k}_gate_{c}": _gate_sql(c) for k, c in enumerate(FIELDS, 2)},
    "c7_fold_unexposed": f"{_B}, {_FOLDED} SELECT * FROM f",
    "c8_canonical_mtime": rf"{_B} SELECT key, CASE WHEN {_BY['mtime']} THEN mtime ELSE regexp_replace(mtime, '(Z|\+00:00|\+0000)$', '') END AS mtime FROM b",
    "c9_null_gate": f"{_B} SELECT count(*) AS bad FROM b WHERE " + " OR ".join(f"nullif({c}, '') IS NULL" for c in FIELDS),
    "c10_gate_escape": f"{_B} SELECT key || '\\x0A' AS key, 'ambiguous escape' AS reason FROM b WHERE l_orderkey % 31 = 0",
    "c11_gate_table_line": f"WITH {LISTING} SELECT CASE l_orderkey % 10 WHEN 0 THEN 'overflowing column' WHEN 1 THEN 'short line' END AS reason, count(*) AS n FROM l GROUP BY 1",
    "c_validate_split": f"{_B}, {_FOLDED} SELECT {_REASONS} AS reasons, count(*) AS n FROM f GROUP BY 1",
    "c_quarantine": f"{_B}, {_FOLDED}, q AS (SELECT key, {_REASONS} AS reasons FROM f) SELECT key, reasons FROM q WHERE reasons <> ''",
    "t1_credential_scan": f"WITH d AS (SELECT doc_id, {_SEEDED} AS text FROM documents), p AS (SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '{_PAT[0]}') THEN '{_NAMES[0]}' END, CASE WHEN regexp_matches(text, '{_PAT[1]}') THEN '{_NAMES[1]}' END) AS patterns FROM d) SELECT doc_id, patterns FROM p WHERE patterns <> ''",
    "t2_citations": f"{_X} SELECT page, line, \"commit\", path, lines, parsed FROM x",
    "t3_parse_ranges": f"{_X}, r AS (SELECT page, line, unnest(range(len(string_split(lines, ',')))) AS n, lines FROM x WHERE lines IS NOT NULL), q AS (SELECT page, line, n, string_split(string_split(lines, ',')[n + 1], '-') AS ab FROM r) SELECT page, line, n, CAST(ab[1] AS BIGINT) AS \"first\", CAST(ab[-1] AS BIGINT) AS \"last\" FROM q",
    "t4_check_citations": f"{_X} SELECT page, \"commit\", path, lines, CASE WHEN path IN ('src/f8.c', 'lib/g.c') THEN 'missing file' WHEN lines = '40' THEN 'past end' WHEN doc_id % 4 < 1 THEN 'line 0' WHEN doc_id % 30 < doc_id % 4 THEN 'inverted' WHEN doc_id % 30 > 25 THEN 'past end' END AS problem FROM x WHERE parsed",
    "t5_citation_tally": f"{_X}, c AS (SELECT 'r' || length(path) AS repository, \"commit\", CASE WHEN path IN ('src/f8.c', 'lib/g.c') THEN 'unresolved' ELSE 'checked' END AS found FROM x WHERE parsed) SELECT repository, \"commit\", CASE repository WHEN 'r7' THEN CASE \"commit\" WHEN 'abcdef3' THEN found ELSE 'refused' END WHEN 'r8' THEN CASE \"commit\" WHEN 'abcdef4' THEN found ELSE 'refused' END ELSE 'skipped' END AS status, count(*) AS n FROM c GROUP BY 1, 2, 3",
    "t6_links": f"{_P} SELECT page, unnest(['p' || (doc_id + 1) || '.md#part-a-1', '#page-' || (doc_id - doc_id % 3), '../data/f' || (doc_id % 7) || '.txt', '../data/f1.txt#x']) AS target FROM p",
    "t7_heading_ids": f"{_P} SELECT page, unnest(['page-' || doc_id, 'part-a', 'part-a-1', 'own' || (doc_id % 5)]) AS id FROM p",
    "t8_folder_links": "SELECT 'docs/p' || doc_id || '.md' AS page, target, problem FROM documents, (VALUES ('../data#top', 'fragment target is not Markdown'), ('../none', 'missing target'), ('../tools#x', 'fragment target is not Markdown')) t(target, problem) UNION ALL SELECT 'docs/p' || doc_id || '.md', '../tools/t' || (doc_id % 5) || '#nothing', 'missing fragment' FROM documents",
    "t8_link_integrity": f"{_P} SELECT page, 'p' || (doc_id + 1) || '.md#part-a-1' AS target, 'missing target' AS problem FROM p WHERE doc_id + 1 NOT IN (SELECT doc_id FROM p) UNION ALL SELECT page, '#page-' || (doc_id - doc_id % 3), 'missing fragment' FROM p WHERE doc_id % 3 > 0 UNION ALL SELECT page, '../data/f6.txt', 'missing target' FROM p WHERE doc_id % 7 = 6 UNION ALL SELECT page, '../data/f1.txt#x', 'fragment target is not Markdown' FROM p",
    "t9_claim_rules": f"{_CL}, p AS (SELECT tool, id, CASE WHEN status IN ('confirmed', 'supported') AND NOT (kind IN {_SETTLED} AND kind2 IN {_SETTLED}) THEN 'kind' WHEN status = 'confirmed' AND NOT (kind = 'run' OR kind2 = 'run') THEN 'no run' WHEN status IN ('unverified', 'unverifiable') AND NOT (kind = 'none' AND reason IS NOT NULL AND kind2 = 'none') THEN 'evidence of an unverified claim' END AS problem FROM c) SELECT tool, id, problem FROM p WHERE problem IS NOT NULL",
    "t10_duplicate_claims": f"{_CL} SELECT tool, id, count(*) AS n FROM c GROUP BY 1, 2 HAVING count(*) > 1",
    "t11_missing_evidence": f"{_EV}, i AS (SELECT DISTINCT 't' || (o_custkey % 4) AS tool, unnest(['d' || (o_orderkey % 37), 'r' || (o_orderkey % 48), 'f' || (o_orderkey % 30)]) AS path FROM orders), n AS (SELECT tool, claim_id, 'receipt' AS field, receipt AS path FROM e UNION ALL SELECT tool, claim_id, 'artifact', artifact FROM e UNION ALL SELECT tool, claim_id, 'documentation', path FROM e WHERE kind = 'documentation') SELECT tool, claim_id, field, path FROM n WHERE path <> '' AND NOT EXISTS (SELECT 1 FROM i WHERE i.tool = n.tool AND i.path = n.path)",
    "t12_provenance": f"{_EV}, t AS (SELECT DISTINCT 't' || (o_custkey % 5) AS tool, 'repo' || (o_custkey % 5) AS tr, CASE WHEN o_custkey % 5 <> 3 THEN md5('x' || (o_custkey % 5)) END AS rev, 'repo' || (o_custkey % 5 + 1) AS up FROM orders), s AS (SELECT e.*, tr, rev, up FROM e JOIN t USING (tool) WHERE kind = 'source') SELECT tool, claim_id, 'tested repository' AS problem FROM s WHERE subject = 'tested-variant' AND repository <> tr UNION ALL SELECT tool, claim_id, 'tested commit' FROM s WHERE subject = 'tested-variant' AND rev IS NOT NULL AND NOT starts_with(rev, \"commit\") UNION ALL SELECT tool, claim_id, 'upstream repository' FROM s WHERE subject = 'upstream' AND repository <> up",
    "t13_origin_conservation": _OR,
}
