"""Queries of the evidence and ledger analytics (E1-E25, S11, S12) over tables derived from orders.

Two numbers worked out from o_orderkey give each attempt's evidence two defects at most, so the oracles
know the outcome, and which rule comes first, from these numbers alone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyscape.operators import evidence as e

from .data import table

#: The ledger (Spark and DuckDB alike).
_LEDGER = {
    "o": "o_orderkey", "case_id": "'t' || (o_custkey % 5) || '.c' || (o_custkey % 701)",
    "attempt": "CAST(row_number() OVER (PARTITION BY o_custkey % 5, o_custkey % 701 ORDER BY o_orderkey) AS INT)",
    "case_inputs": "'i' || (o_custkey % 701) || CASE WHEN o_orderkey % 997 = 0 THEN 'x' ELSE '' END",
    "group_id": "'g' || (o_custkey % 3)", "tool": "'t' || (o_custkey % 5)",
    "config": "'{\"mode\":\"m' || (o_custkey % 4) || '\"' || CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE ',\"concurrency\":' || (o_orderkey % 9) END || '}'",
    "purpose": "CASE o_orderkey % 6 WHEN 0 THEN 'preparation' WHEN 1 THEN 'canary' ELSE 'measurement' END",
    "statistic": "CASE WHEN o_custkey % 2 = 0 THEN 'timing' ELSE 'rate' END",
    "state": "CASE o_orderkey % 8 WHEN 4 THEN 'FAILED' WHEN 5 THEN 'RUNNING' WHEN 6 THEN 'CANCELLED' WHEN 7 THEN 'NOT_CREATED' ELSE 'SUCCEEDED' END",
    "target_bucket": "'b' || (o_custkey % 4)", "target_region": "'us'", "target_prefix": "''", "tool_slice_sha256": "md5('s' || (o_custkey % 5))", "platform_sha256": "md5('p')",
    "settled_at": "CASE WHEN o_orderkey % 8 <> 5 THEN lpad(CAST(o_orderkey % 1000 AS STRING), 10, '0') END",
    "wall_seconds": "CAST(o_orderkey % 1000 AS DOUBLE) / 8",
    "r": "CAST(o_orderkey % 40 AS INT)",
    "r2": "CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_orderkey / 40) AS INT) % 33 ELSE 0 END",
    "job_name": "'j' || (o_orderkey % 50)", "auth_role": "CASE WHEN o_orderkey % 3 > 0 THEN 'role' END", "image_uri": "'img' || (o_custkey % 5)", "image_set_sha256": "md5('i')",
    "machine_type": "'n4-' || (o_custkey % 3)", "vcpus": "CAST(o_custkey % 3 + 1 AS INT)", "memory_gb": "CAST(4 AS INT)", "container_memory_gb": "CASE WHEN o_custkey % 2 = 0 THEN CAST(3 AS INT) END",
}


def _has(sql: str) -> str:
    """sql with @n as: defect n is one of the two."""
    return re.sub(r"@(\d+)", r"(r = \1 OR r2 = \1)", sql)


_DERIVED = {
    "attempt_id": "case_id || '.s' || attempt",
    "result_prefix": _has("'gs://r/' || case_id || '.s' || attempt || CASE WHEN @23 THEN 'z' ELSE '' END || '/' || CASE WHEN o % 2 = 0 THEN '/' ELSE '' END"),
    "produced_by": "CASE WHEN o % 3 = 0 THEN CASE WHEN attempt > 1 THEN case_id || '.s' || (attempt - 1) WHEN o % 2 = 0 THEN 'else.s1' END END",
}
_SHA = "'" + "ab" * 32 + "'"


def _result() -> str:
    """The JSON of an attempt's evidence, with its defects."""
    q = {
        "attempt_id": "'\"' || case_id || '.s' || CASE WHEN @13 THEN 0 ELSE attempt END || '\"'", "case_id": "'\"' || case_id || '\"'", "group_id": "'\"' || group_id || '\"'",
        "tool": "'\"' || CASE WHEN @21 THEN 'other' ELSE tool END || '\"'", "mode": "'\"m' || substr(config, 11, 1) || '\"'", "bucket": "'\"' || target_bucket || '\"'", "region": "'\"us\"'", "prefix": "'\"\"'",
        "job_name": "'\"' || job_name || '\"'", "auth_role": "CASE WHEN @31 THEN '7' WHEN auth_role IS NULL THEN 'null' ELSE '\"' || auth_role || '\"' END", "image": "'\"' || image_uri || CASE WHEN @30 THEN ':old' ELSE '' END || '\"'",
        "image_set_sha256": "'\"' || image_set_sha256 || '\"'",
        "declared_resources": "'{\"vcpus\":' || CASE WHEN @32 THEN '\"2\"' ELSE CAST(vcpus AS STRING) END || ',\"memory_gb\":4,\"machine_type\":\"' || machine_type || '\",\"container_memory_gb\":' || coalesce(CAST(container_memory_gb AS STRING), 'null') || '}'",
        "config": "CASE WHEN @27 THEN '{\"mode\":\"mx\"}' ELSE config END",
        "exit_code": "CASE WHEN @2 THEN '3' WHEN @3 THEN 'true' ELSE '0' END", "timed_out": "CASE WHEN @1 THEN 'true' ELSE 'false' END",
        "row_count": "CASE WHEN @14 THEN '-5' WHEN @15 THEN 'null' ELSE CAST(o % 5000 AS STRING) END", "wall_seconds": "'1.5'", "max_rss_kb": "CASE WHEN @16 THEN '9' ELSE '2048' END",
        "execution": (
            "CASE WHEN @4 THEN 'null' ELSE '{\"elapsed_ns\":' || CASE WHEN @17 THEN '1600000000' ELSE '1500000000' END || ',\"timed_out\":' || CASE WHEN @5 THEN '\"x\"' ELSE 'false' END || "
            "',\"subreaper_enabled\":' || CASE WHEN @6 THEN 'false' ELSE 'true' END || ',\"process_tree_clean\":' || CASE WHEN @7 THEN 'false' ELSE 'true' END || "
            "',\"process_group_empty\":' || CASE WHEN @8 THEN 'false' ELSE 'true' END || ',\"descendants_empty\":' || CASE WHEN @9 THEN 'false' ELSE 'true' END || ',\"max_rss_kb\":2048,\"max_rss_floor_kb\":77' || "
            "CASE WHEN @10 THEN '' WHEN @11 THEN ',\"cgroup\":{\"oom_delta\":0,\"oom_kill_delta\":-1}' WHEN @12 THEN ',\"cgroup\":{\"oom_delta\":0,\"oom_kill_delta\":2}' ELSE ',\"cgroup\":{\"oom_delta\":0,\"oom_kill_delta\":0}' END || '}' END"
        ),
        "product": f"CASE WHEN @29 THEN '{{\"name\":\"p\",\"size_bytes\":5,\"channel\":\"dataset\"}}' ELSE 'null' END",
        "stdout": f"CASE WHEN @18 OR @29 THEN 'null' WHEN @19 THEN '{{\"name\":\"o\",\"size_bytes\":5,\"sha256\":\"zz\"}}' ELSE '{{\"name\":\"o\",\"size_bytes\":5,\"sha256\":\"' || {_SHA} || '\"}}' END",
        "stderr": f"CASE WHEN @20 THEN 'null' ELSE '{{\"name\":\"e\",\"size_bytes\":0,\"sha256\":\"' || {_SHA} || '\"}}' END",
    }
    body = " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in q.items())
    return _has(f"CASE WHEN @22 THEN CAST(NULL AS STRING) WHEN @28 THEN '{{broken' ELSE '{{' || {body} || '}}' END")


def _verify() -> str:
    """verify.json, whose diff is of mtimes alone for even orders."""
    q = {
        "attempt_id": "'\"' || case_id || '.s' || attempt || '\"'", "tool": "'\"' || tool || '\"'", "mode": "'\"m' || substr(config, 11, 1) || '\"'", "actual_result_sha256": "'\"' || sha || '\"'",
        "verdict": "CASE WHEN @25 THEN '\"FAIL\"' WHEN o % 2 = 0 THEN '\"DRIFT\"' ELSE '\"PASS\"' END",
        "actual_tsv_sha256": f"CASE WHEN @26 THEN '\"zz\"' ELSE '\"' || {_SHA} || '\"' END", "reference_tsv_sha256": f"'\"' || {_SHA} || '\"'", "reference_result_sha256": f"'\"' || {_SHA} || '\"'",
        "reference_attempt_id": "'\"a\"'", "reference_tool": "'\"t\"'", "reference_mode": "'\"m\"'", "product": "'\"objects\"'", "fields": "'[\"key\"]'",
        "diff": "'{\"missing\":[],\"extra\":[],\"duplicates\":[],\"reference_duplicates\":[],\"mismatches\":[' || CASE WHEN o % 2 = 0 THEN '{\"key\":\"k\",\"field\":\"mtime\"}' ELSE '' END || ']}'",
    }
    body = " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in q.items())
    return _has(f"CASE WHEN @24 THEN CAST(NULL AS STRING) ELSE '{{' || {body} || '}}' END")


#: Slots: one order in 20.
_SLOT = {
    "group_id": "'g' || (o_custkey % 3)", "slot": "o_orderkey", "tool": "'t' || (o_custkey % 5)", "purpose": "'measurement'",
    "producer": (
        "CASE WHEN o_orderkey % 60 = 0 THEN '{\"tool\":\"t' || (o_custkey % 5) || '\",\"mode\":\"m' || (o_custkey % 4) || '\",\"config\":\"{\\\\\"mode\\\\\":\\\\\"m' || (o_custkey % 4) || '\\\\\"}\",\"target_bucket\":\"b' || (o_custkey % 4) || "
        "'\",\"target_prefix\":\"\",\"target_region\":\"us\",\"tool_slice_sha256\":\"' || md5('s' || (o_custkey % 5)) || '\",\"platform_sha256\":\"' || md5('p') || '\"}' END"
    ),
    "awaiting": "CASE o_orderkey % 60 WHEN 20 THEN 't' || (o_custkey % 5) || '.c' || (o_custkey % 701) || '.s1' WHEN 40 THEN 'g' || (o_custkey % 3) || '/' || (o_orderkey - 20 - 80 * (o_orderkey % 2)) END",
    "disqualified": "CASE WHEN o_orderkey % 7 = 0 THEN '{\"t' || (o_custkey % 5) || '.c' || (o_custkey % 701) || '.s1\":\"gone\"}' END",
    "state": "CASE o_orderkey % 100 WHEN 0 THEN 'ABANDONED' WHEN 60 THEN 'RESOLVED' ELSE 'BLOCKED' END", "became": "CAST(NULL AS STRING)",
}


def _select(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{v} AS {k}" for k, v in exprs.items()])


def _attempts(spark, d) -> DataFrame:
    # ordinals first, over the two columns that all others come of: the rows that are sorted for them are narrow
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").selectExpr("*", f"{_LEDGER['attempt']} AS _attempt")
    rows = _select(orders, _LEDGER | {"attempt": "_attempt"})
    return e.load_attempts(rows.selectExpr("*", *[f"{v} AS {k}" for k, v in _DERIVED.items() if k != "attempt_id"]))


def _slots(spark, d) -> DataFrame:
    return e.load_pending(_select(table(spark, d, "orders").filter("o_orderkey % 20 = 0"), _SLOT))


def _bound(spark, d) -> DataFrame:
    a = _attempts(spark, d)
    files = a.selectExpr("*", f"{_result()} AS result").withColumn("sha", F.coalesce(F.sha2("result", 256), F.lit(""))).selectExpr("result_prefix AS prefix", "result", f"{_verify()} AS verify")
    return e.with_evidence(a, files)


def _modes(spark, d) -> DataFrame:
    n = table(spark, d, "orders").select((F.col("o_custkey") % 4).alias("n")).distinct().filter("n < 3")
    return n.select(F.concat(F.lit("m"), F.col("n").cast("string")).alias("mode"), F.when(F.col("n") == 2, "keys").otherwise("objects").alias("product"), F.when(F.col("n") == 2, "key").otherwise("key,size").alias("fields"))


def _report(spark, d) -> DataFrame:
    return e.report_rows(e.evidence_state(_bound(spark, d)), _modes(spark, d))


def _once(df: DataFrame, c, name: str) -> DataFrame:
    """(attempt_id, name) with c evaluated once: a filter on it isn't pushed below and doesn't repeat it."""
    return df.select("attempt_id", F.explode(F.array(c)).alias(name))


def _listed(errors):
    def query(spark, d):
        b = _bound(spark, d)  # a filter on result would be pushed below its parsing and parse each text twice
        return _once(b, F.when(F.col("result").isNotNull(), F.array_join(errors(b), ",")), "errors").filter("errors <> ''")

    return query


def _recorded(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.concat(F.lit("p"), (F.col("o_orderkey") % 500).cast("string")).alias("prefix"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"), F.md5(F.col("o_orderkey").cast("string")).alias("sha256"), (F.col("o_orderkey") % 90).alias("size"), (F.col("o_orderkey") % 17 == 0).alias("optional")).filter("cast(substring(path, 2) as bigint) % 13 <> 0")


def _tree(spark, d):
    o = table(spark, d, "orders").filter("o_orderkey % 11 <> 0 and o_orderkey % 17 <> 0")
    k = F.col("o_orderkey")
    return o.select(F.concat(F.lit("p"), (k % 500).cast("string")).alias("prefix"), F.concat(F.lit("f"), k.cast("string")).alias("path"), F.when(k % 19 == 0, F.lit("0")).otherwise(F.md5(k.cast("string"))).alias("sha256"), (k % 90 + F.when(k % 23 == 0, 1).otherwise(0)).alias("size"))


def _registry(spark, d, cond: str):
    return table(spark, d, "orders").selectExpr("concat('tool', o_custkey % 40) AS tool").distinct().filter(cond)


def _receipts(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.concat(F.lit("t"), (F.col("o_custkey") % 5).cast("string")).alias("tool"), F.when(k % 3 == 0, "none").otherwise("s1").alias("stdout_sha256"), F.when(k % 9 == 0, "none").otherwise("s2").alias("stderr_sha256"), F.lit("none").alias("empty"), F.concat(F.lit("m"), (k % 45).cast("string")).alias("mode"))


def _declared(spark, d):
    return table(spark, d, "orders").selectExpr("concat('t', o_custkey % 5) AS tool", "concat('m', o_orderkey % 50) AS mode").distinct()


def _pins(spark, d):
    own = table(spark, d, "orders").filter("o_orderkey % 9 <> 0").groupBy(F.concat(F.lit("t"), (F.col("o_custkey") % 5).cast("string")).alias("tool")).agg(F.count("*").alias("n"))
    return own.filter("tool <> 't4'").select("tool", (F.col("n") + F.when(F.col("tool") == "t2", 1).otherwise(0)).alias("pinned"))


_FINGER = ["environment", "config", "note"]


def _cases(spark, d):
    """Cases with a struct as environment, JSON text as config and a string beside them."""
    k = F.col("o_orderkey")
    environment = F.struct(F.lit(4).alias("vcpus"), F.col("o_orderpriority").alias("machine"), F.when(k % 2 == 0, "role").alias("auth_role"), F.lit(True).alias("zoned"))
    config = F.concat(F.lit('{"n": '), (k % 50).cast("string"), F.lit(', "mode": "é\\u0001/", "deep": {"z": [1.0, 2.50, 1e20, true, null], "a": {"B": -0.0, "b": 12345678.25}}}'))
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("t"), (k % 5).cast("string")).alias("tool"), environment.alias("environment"), config.alias("config"), F.when(k % 3 > 0, F.concat(F.lit("a\\b "), F.col("o_orderstatus"))).alias("note"))


def _tool_modes(spark, d, cond: str):
    return table(spark, d, "orders").selectExpr("concat('tool', o_custkey % 40) AS tool", "concat('m', o_custkey % 3) AS mode").distinct().filter(cond)


QUERIES = {
    "s11_load_attempts": lambda s, d: _attempts(s, d).select("case_id", "attempt", "attempt_id", "mode", "concurrency"),
    "s12_load_pending": lambda s, d: _slots(s, d).select("group_id", "slot", "state", "producer", "awaiting", "valid"),
    "e1_roster": lambda s, d: e.roster(_attempts(s, d), _slots(s, d), "g1"),
    "e2_identity_errors": _listed(e.identity_errors),
    "e3_failed_subject": lambda s, d: _once(_bound(s, d).filter("result is not null"), e.failed_subject(F.col("result")), "reason").filter("reason is not null"),
    "e4_artifact_binding": lambda s, d: e.artifact_binding(_recorded(s, d), _tree(s, d)),
    "e5_gap_table": lambda s, d: e.gap_table(_bound(s, d), _attempts(s, d).filter("o % 13 = 0")),
    "e6_rate_summary": lambda s, d: e.rate_summary(_attempts(s, d)),
    "e7_result_binding": _listed(e.result_binding),
    "e8_result_semantics": _listed(lambda b: e.result_semantics(F.col("result"))),
    "e9_capture_errors": _listed(lambda b: e.capture_errors(F.col("result"))),
    "e10_verify_binding": lambda s, d: (lambda b: _once(b, F.array_join(e.verify_binding(b), ","), "errors").filter("errors <> ''"))(_bound(s, d).filter("verification is not null and result is not null")),
    "e11_evidence_state": lambda s, d: e.evidence_state(_bound(s, d)).select("attempt_id", "evidence_state"),
    "e12_report_rows": lambda s, d: e.with_preparations(_report(s, d)),
    "e13_preparation_cost": lambda s, d: e.preparation_cost(_attempts(s, d).select("attempt_id", "produced_by", "wall_seconds")),
    "e14_stratum_summary": lambda s, d: e.stratum_summary(_report(s, d)),
    "e15_summary_counts": lambda s, d: e.summary_counts(_report(s, d)),
    "e16_report_final": lambda s, d: e.report_final(_report(s, d), _slots(s, d)),
    "e17_slot_candidates": lambda s, d: e.slot_candidates(_slots(s, d), _attempts(s, d)),
    "e18_owed_reason": lambda s, d: e.owed_reason(_slots(s, d), _attempts(s, d)),
    "e19_abandonment_closure": lambda s, d: e.abandonment_closure(_slots(s, d)),
    "e20_next_ordinal": lambda s, d: e.next_ordinal(_attempts(s, d)),
    "e21_case_fingerprint": lambda s, d: e.case_fingerprint(_cases(s, d), _FINGER, "case/v1:", nested=("environment", "config")).select("o_orderkey", "case_id"),
    "e22_status": lambda s, d: e.status(_attempts(s, d), _slots(s, d)),
    "e23_prunable": lambda s, d: e.prunable(_attempts(s, d)),
    "e24_roster_coverage": lambda s, d: e.roster_coverage(_registry(s, d, "substring(tool, 5) % 4 <> 1"), _registry(s, d, "substring(tool, 5) % 5 <> 2"), _registry(s, d, "substring(tool, 5) % 7 = 0")),
    "e24_mode_coverage": lambda s, d: e.mode_coverage(_tool_modes(s, d, "true"), _tool_modes(s, d, "substring(tool, 5) % 4 <> 1 and mode <> 'm2'")),
    "e25_corpus_pin": lambda s, d: e.corpus_pin(_receipts(s, d), _pins(s, d)),
    "e25_unexercised_modes": lambda s, d: e.unexercised_modes(_declared(s, d), _receipts(s, d)),
}

_A = (
    "WITH RECURSIVE a0 AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _LEDGER.items()) + " FROM orders), a AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in _DERIVED.items())
    + ", 'm' || substr(config, 11, 1) AS mode, CASE WHEN o % 10 > 0 THEN CAST(o % 9 AS INT) END AS concurrency FROM a0), "
    "sl AS (SELECT " + ", ".join(f"{v}".replace("\\\\", "\\") + f" AS {k}" for k, v in _SLOT.items()) + ", group_id || '/' || slot AS slot_id FROM orders WHERE o_orderkey % 20 = 0)"
)
def _list(errors: list[tuple[str, str]]) -> str:
    """A list of the names whose conditions hold, in order."""
    return _has("list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in errors) + "], lambda x: x IS NOT NULL)")


_NO_STDOUT, _ROWS, _COUNTED = "@18 AND NOT @29", "(@14 OR NOT @15)", "NOT (@1 OR @2 OR @3)"
_E9 = [("stdout", _NO_STDOUT), ("stdout.sha256", "@19 AND NOT @18 AND NOT @29"), ("stderr", "@20")]
_HEAD = [("exit_code", "@3 AND NOT @2"), ("row_count", "@14")]
_NEVER_RAN = [("setup", "true"), ("exit_code", "NOT @2 AND NOT @3"), ("wall_seconds", "true"), ("max_rss_kb", "true"), ("row_count", _ROWS), ("product", "@29")]
_RAN = [
    ("max_rss_kb", "@16"), ("wall_seconds/elapsed_ns", "@17"), ("execution.timed_out", "@5"), ("execution.timed_out", "@5 OR @1"), ("execution.cgroup", "@10"),
    ("execution.cgroup.oom_kill_delta", "@11 AND NOT @10"), *_E9, ("row_count", f"{_COUNTED} AND NOT {_ROWS}"), ("row_count", f"NOT {_COUNTED} AND {_ROWS}"),
]
_E8 = _has(f"CASE WHEN @4 THEN {_list(_HEAD + _NEVER_RAN)} ELSE {_list(_HEAD + _RAN)} END")
_E7 = _list([("attempt_id", "@13"), ("tool", "@21"), ("auth_role", "@31"), ("image", "@30"), ("config", "@27"), ("declared_resources", "@32")])
_E2 = _list([("attempt_id", "@13"), ("prefix", "@23")])
_E10 = _list([("actual_tsv_sha256", "@26"), ("verdict", "@25")])
_E3 = _has(
    "CASE WHEN @1 THEN 'subject timed out' WHEN @2 OR @3 THEN 'subject exited' WHEN @4 THEN 'no execution evidence' WHEN @5 THEN 'execution timeout invalid' WHEN @6 THEN 'no descendant supervision' "
    "WHEN @7 THEN 'live descendant' WHEN @8 THEN 'process group not empty' WHEN @9 THEN 'descendants not empty' WHEN @10 THEN 'no oom evidence' WHEN @11 THEN 'oom evidence invalid' WHEN @12 THEN 'oom kill' END"
)
_READABLE = _has("NOT @22 AND NOT @28")


def _errors(found: str, rows: str = _READABLE) -> str:
    return f"{_A} SELECT attempt_id, array_to_string({found}, ',') AS errors FROM a WHERE {rows} AND len({found}) > 0"


_STATE = _has(
    f"CASE WHEN @22 THEN 'MISSING_EVIDENCE' WHEN @28 THEN 'RESULT_UNAVAILABLE' WHEN @13 OR @23 THEN 'IDENTITY_MISMATCH' WHEN len({_E7}) + len({_E8}) > 0 THEN 'RESULT_MISMATCH' "
    "WHEN @24 THEN 'VERIFY_UNAVAILABLE' WHEN @25 OR @26 THEN 'VERIFY_MISMATCH' ELSE 'VERIFIED' END"
)
_R = f"""{_A}, rp AS (SELECT *, CASE WHEN mode < 'm2' THEN 'objects' WHEN mode = 'm2' THEN 'keys' ELSE '-' END AS product, CASE WHEN mode < 'm2' THEN 'key,size' WHEN mode = 'm2' THEN 'key' ELSE '-' END AS fields,
  {_STATE} AS evidence_state, CASE WHEN {_STATE} <> 'VERIFIED' THEN '-' WHEN o % 2 = 0 THEN 'DRIFT' ELSE 'PASS' END AS verdict FROM a),
k AS (SELECT *, evidence_state IN ('VERIFY_UNAVAILABLE', 'VERIFY_MISMATCH', 'VERIFIED') AS known FROM rp)"""
_C = f"""{_A}, ca AS (SELECT sl.group_id, slot, attempt_id, a.state, settled_at FROM sl JOIN a ON a.group_id = sl.group_id AND
  CASE WHEN producer IS NOT NULL THEN a.tool = sl.tool AND a.target_bucket = json_extract_string(producer, '$.target_bucket') AND a.config = json_extract_string(producer, '$.config')
       ELSE NOT contains(awaiting, '/') AND attempt_id = awaiting END),
cn AS (SELECT group_id, slot, attempt_id, state, row_number() OVER (PARTITION BY group_id, slot ORDER BY settled_at NULLS FIRST, attempt_id) AS place FROM ca),
lv AS (SELECT ca.group_id, ca.slot, bool_or(ca.state IN ('RUNNING', 'FAILED', 'NOT_CREATED') OR (ca.state = 'SUCCEEDED' AND NOT coalesce(contains(disqualified, '"' || attempt_id || '"'), false))) AS live FROM ca JOIN sl ON sl.group_id = ca.group_id AND sl.slot = ca.slot GROUP BY 1, 2),
ow AS (SELECT s.group_id, s.slot, s.slot_id, CASE WHEN contains(coalesce(s.awaiting, ''), '/') THEN CASE WHEN coalesce(u.state, 'ABANDONED') = 'ABANDONED' THEN 'the slot it waits on will not produce an attempt' END
  WHEN live IS NULL THEN 'no attempt in this group produces what it consumes' WHEN NOT live THEN 'every candidate is settled and none published a usable artifact' END AS reason
  FROM sl s LEFT JOIN lv ON lv.group_id = s.group_id AND lv.slot = s.slot LEFT JOIN sl u ON u.slot_id = s.awaiting WHERE s.state = 'BLOCKED')"""
_DASH = lambda x: f"CASE WHEN known THEN {x} ELSE '-' END"

ORACLES = {
    "s11_load_attempts": f"{_A} SELECT case_id, attempt, attempt_id, mode, concurrency FROM a",
    "s12_load_pending": f"{_A} SELECT group_id, slot, state, producer, awaiting, true AS valid FROM sl",
    "e1_roster": f"{_A} SELECT 'subject' AS kind, attempt_id AS label FROM a WHERE group_id = 'g1' AND purpose = 'measurement' UNION ALL SELECT lower(state), 'slot ' || slot || ' (' || tool || ') awaiting ' || coalesce(awaiting, 'any ' || tool || ' ' || json_extract_string(producer, '$.mode') || ' of this group') FROM sl WHERE group_id = 'g1' AND state IN ('BLOCKED', 'ABANDONED')",
    "e2_identity_errors": _errors(_E2),
    "e3_failed_subject": f"{_A} SELECT attempt_id, {_E3} AS reason FROM a WHERE {_READABLE} AND {_E3} IS NOT NULL",
    "e4_artifact_binding": "WITH r AS (SELECT 'p' || (o_orderkey % 500) AS prefix, 'f' || o_orderkey AS path, o_orderkey AS k FROM orders) SELECT prefix, path, CASE WHEN k % 13 = 0 THEN 'unrecorded' WHEN k % 11 = 0 THEN 'absent' WHEN k % 19 = 0 THEN 'digest' ELSE 'size' END AS problem FROM r WHERE k % 17 <> 0 AND ((k % 13 = 0 AND k % 11 <> 0) OR (k % 13 <> 0 AND (k % 11 = 0 OR k % 19 = 0 OR k % 23 = 0)))",
    "e5_gap_table": f"{_A}, g AS (SELECT attempt_id, CASE WHEN state = 'RUNNING' THEN 'unsettled' WHEN state <> 'SUCCEEDED' THEN 'absent' WHEN {_has('@22')} THEN 'missing-evidence' WHEN {_has('@28')} THEN 'malformed' WHEN {_has('@13 OR @23')} THEN 'identity' WHEN {_E3} IS NOT NULL THEN 'failed-subject' WHEN o % 13 = 0 THEN 'normalize' END AS reason FROM a) SELECT attempt_id, reason, CAST(CASE reason WHEN 'missing-evidence' THEN 4 WHEN 'malformed' THEN 8 WHEN 'identity' THEN 5 WHEN 'failed-subject' THEN 7 WHEN 'normalize' THEN 6 ELSE 9 END AS INTEGER) AS exit_code FROM g WHERE reason IS NOT NULL",
    "e6_rate_summary": f"{_A}, c AS (SELECT case_id, count(*) AS attempts, count(*) FILTER (state <> 'RUNNING') AS settled, count(*) FILTER (state = 'SUCCEEDED') AS successes FROM a WHERE purpose = 'measurement' AND statistic = 'rate' GROUP BY 1) SELECT *, CASE WHEN settled > 0 THEN round(successes / settled, 4) END AS rate FROM c",
    "e7_result_binding": _errors(_E7),
    "e8_result_semantics": _errors(_E8),
    "e9_capture_errors": _errors(_list(_E9)),
    "e10_verify_binding": _errors(_E10, _has("NOT @22 AND NOT @28 AND NOT @24")),
    "e11_evidence_state": f"{_A} SELECT attempt_id, {_STATE} AS evidence_state FROM a",
    "e12_report_rows": f"{_R}, ch AS (SELECT attempt_id, produced_by AS nxt, CAST(0 AS DOUBLE) AS total FROM k WHERE produced_by IS NOT NULL UNION ALL SELECT ch.attempt_id, k.produced_by, total + CASE WHEN known THEN 1.5 END FROM ch JOIN k ON k.attempt_id = ch.nxt), pc AS (SELECT attempt_id AS id, round(total, 6) AS prep_seconds FROM ch WHERE nxt IS NULL) SELECT attempt_id, tool, mode, product, fields, coalesce(CAST(concurrency AS VARCHAR), '-') AS concurrency, case_id, attempt, target_bucket AS bucket, machine_type, CAST(vcpus AS VARCHAR) AS vcpus, CAST(memory_gb AS VARCHAR) AS memory_gb, coalesce(CAST(container_memory_gb AS VARCHAR), '-') AS container_memory_gb, prep_seconds, purpose, statistic, state, evidence_state, {_DASH(chr(39) + '0' + chr(39))} AS exit, {_DASH('CAST(o % 5000 AS VARCHAR)')} AS row_count, CASE WHEN known THEN CAST(1.5 AS DOUBLE) END AS wall_seconds, {_DASH(chr(39) + '2048' + chr(39))} AS max_rss_kb, {_DASH(chr(39) + '77' + chr(39))} AS max_rss_floor_kb, verdict, produced_by FROM k LEFT JOIN pc ON pc.id = k.attempt_id",
    "e13_preparation_cost": f"""{_A}, ch AS (SELECT attempt_id, produced_by AS nxt, CAST(0 AS BIGINT) AS links, CAST(0 AS DOUBLE) AS total FROM a WHERE produced_by IS NOT NULL UNION ALL
  SELECT ch.attempt_id, a.produced_by, links + 1, total + a.wall_seconds FROM ch JOIN a ON a.attempt_id = ch.nxt)
SELECT attempt_id, links, CASE WHEN nxt IS NULL THEN round(total, 6) END AS prep_seconds FROM ch WHERE nxt IS NULL OR nxt = 'else.s1'""",
    "e14_stratum_summary": f"{_R} SELECT target_bucket AS bucket, product, fields, count(*) AS n, string_agg(DISTINCT tool || '/' || mode, ', ' ORDER BY tool || '/' || mode) AS subjects, string_agg(DISTINCT verdict, ', ' ORDER BY verdict) AS verdicts FROM k WHERE purpose = 'measurement' AND statistic = 'timing' AND product <> '-' GROUP BY 1, 2, 3",
    "e15_summary_counts": f"{_R} SELECT verdict, count(*) AS n, count(*) FILTER (purpose = 'measurement' AND statistic = 'timing' AND verdict <> '-') AS verified_timings FROM k GROUP BY 1",
    "e16_report_final": f"{_A} SELECT (SELECT count(*) FROM a) > 0 AND (SELECT count(*) FROM sl WHERE state = 'BLOCKED') = 0 AS \"final\"",
    "e17_slot_candidates": f"{_C} SELECT group_id, slot, attempt_id, state, place FROM cn",
    "e18_owed_reason": f"{_C} SELECT group_id, slot, reason FROM ow WHERE reason IS NOT NULL",
    "e19_abandonment_closure": f"{_A}, cl AS (SELECT slot_id, CAST(0 AS BIGINT) AS rounds FROM sl WHERE state = 'ABANDONED' UNION SELECT sl.slot_id, rounds + 1 FROM sl JOIN cl ON sl.awaiting = cl.slot_id WHERE sl.state = 'BLOCKED') SELECT slot_id, min(rounds) AS rounds FROM cl WHERE rounds > 0 GROUP BY 1",
    "e20_next_ordinal": f"{_A} SELECT case_id, CAST(max(attempt) + 1 AS BIGINT) AS next, bool_or(state = 'SUCCEEDED') AS succeeded, count(DISTINCT case_inputs) > 1 AS conflict FROM a GROUP BY 1",
    "e21_case_fingerprint": r"""SELECT o_orderkey, 't' || (o_orderkey % 5) || '.' || substr(sha256('case/v1:{"config":{"deep":{"a":{"B":-0.0,"b":12345678.25},"z":[1.0,2.5,1e+20,true,null]},"mode":"\u00e9\u0001/","n":' || (o_orderkey % 50) || '},"environment":{"auth_role":' || CASE WHEN o_orderkey % 2 = 0 THEN '"role"' ELSE 'null' END || ',"machine":"' || o_orderpriority || '","vcpus":4,"zoned":true},"note":' || CASE WHEN o_orderkey % 3 > 0 THEN '"a\\b ' || o_orderstatus || '"' ELSE 'null' END || '}'), 1, 12) AS case_id FROM orders""",
    "e22_status": f"{_C} SELECT 'attempt' AS kind, attempt_id AS name, state, NULL AS note FROM a UNION ALL SELECT 'slot', sl.slot_id, sl.state, reason FROM sl LEFT JOIN ow ON ow.slot_id = sl.slot_id",
    "e23_prunable": f"{_A} SELECT attempt_id, state FROM a WHERE state IN ('FAILED', 'CANCELLED', 'NOT_CREATED')",
    "e24_mode_coverage": "WITH t AS (SELECT DISTINCT o_custkey % 40 AS n, 'm' || (o_custkey % 3) AS mode FROM orders), k AS (SELECT DISTINCT n FROM t WHERE n % 4 <> 1 AND mode <> 'm2') SELECT 'tool' || n AS tool, mode, CASE WHEN n IN (SELECT n FROM k) THEN 'no such mode' ELSE 'modes unknown' END AS problem FROM t WHERE NOT (n % 4 <> 1 AND mode <> 'm2')",
    "e24_roster_coverage": "WITH t AS (SELECT DISTINCT o_custkey % 40 AS n FROM orders), f AS (SELECT 'tool' || n AS tool, n % 4 <> 1 AS r, n % 5 <> 2 AS u, n % 7 = 0 AS x FROM t) SELECT tool, 'absent' AS problem FROM f WHERE r AND NOT u AND NOT x UNION ALL SELECT tool, 'unknown' FROM f WHERE NOT r AND (u OR x) UNION ALL SELECT tool, 'run and excluded' FROM f WHERE u AND x",
    "e25_unexercised_modes": "SELECT DISTINCT 't' || (o_custkey % 5) AS tool, 'm' || (o_orderkey % 50) AS mode FROM orders EXCEPT SELECT 't' || (o_custkey % 5), 'm' || (o_orderkey % 45) FROM orders WHERE o_orderkey % 9 <> 0",
    "e25_corpus_pin": "WITH c AS (SELECT 't' || (o_custkey % 5) AS tool, count(*) AS found FROM orders WHERE o_orderkey % 9 <> 0 GROUP BY 1) SELECT tool, found, CASE tool WHEN 't4' THEN NULL WHEN 't2' THEN found + 1 ELSE found END AS pinned, CASE tool WHEN 't4' THEN 'unpinned' WHEN 't2' THEN 'count' END AS problem FROM c",
}
