"""Run evidence bound to a ledger of attempts: identity, meaning, verdicts, rates, costs, slots.

Evidence is a VARIANT column, so that the JSON type of a field is known: `true` isn't 1.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyscape.operators.ranges import ranged
from keyscape.sources.shared import checkpoint

#: States of the ledger.
RETRYABLE = ("FAILED", "NOT_CREATED")
TERMINAL = ("SUCCEEDED", "FAILED", "NOT_CREATED", "CANCELLED", "ACCEPTED")
FINAL = ("SUCCEEDED", "CANCELLED", "ACCEPTED")
BOUND = ("VERIFY_UNAVAILABLE", "VERIFIED")
#: Exit codes of the reasons for which a subject isn't compared.
GAP_EXIT_CODES = {"unsettled": 9, "absent": 9, "missing-evidence": 4, "identity": 5, "failed-subject": 7, "normalize": 6, "malformed": 8}
#: The columns that a slot's producer must equal.
PRODUCER_SPEC = ("tool", "mode", "config", "target_bucket", "target_prefix", "target_region", "tool_slice_sha256", "platform_sha256")


def load_attempts(df: DataFrame) -> DataFrame:
    """Ledger rows with attempt_id, mode and concurrency derived from their case, ordinal and config."""
    return df.withColumns({
        "attempt_id": F.concat("case_id", F.lit(".s"), F.col("attempt").cast("string")), "mode": F.get_json_object("config", "$.mode"),
        "concurrency": F.get_json_object("config", "$.concurrency").try_cast("int"),
    })


def load_pending(df: DataFrame) -> DataFrame:
    """Slots, with columns that an older table lacks as NULL, and whether exactly one of producer and awaiting is set."""
    wanted = ("group_id", "slot", "tool", "purpose", "producer", "awaiting", "disqualified", "state", "became")
    out = df.select(*[(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in wanted])
    return out.withColumn("valid", F.col("producer").isNull() != F.col("awaiting").isNull())


# --- one field of evidence -----------------------------------------------------


def _sub(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def _kind(x: Column) -> Column:
    return F.when(~F.is_variant_null(x), F.substring_index(F.substring_index(F.schema_of_variant(x), "(", 1), "<", 1))


def _text(x: Column) -> Column:
    # a cast of a variant to its own type is a plain read; to another one it builds an expression for each value
    return F.when(F.schema_of_variant(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("string")).otherwise(F.try_variant_get(x, "$", "string"))


#: What a rule may ask of a field x, a variant. The type of an object or array is asked by a cast, as its schema is long.
_ASKED = {
    "there": lambda x: x.isNotNull() & ~F.is_variant_null(x), "object": lambda x: F.try_variant_get(x, "$", "struct<_:boolean>").isNotNull(),
    "array": lambda x: F.try_variant_get(x, "$", "array<variant>").isNotNull(),
    "kind": _kind, "schema": lambda x: F.schema_of_variant(x), "text": _text, "boolean": lambda x: F.when(F.schema_of_variant(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean")), "absent": lambda x: x.isNull(),
    "number": lambda x: F.try_variant_get(x, "$", "bigint"), "double": lambda x: F.try_variant_get(x, "$", "double"),
    "size": lambda x: F.size(F.try_variant_get(x, "$", "array<variant>")), "keys": lambda x: F.map_keys(F.try_variant_get(x, "$", "map<string,variant>")),
    "json": lambda x: F.to_json(x), "fields": lambda x: F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda m: F.try_variant_get(m, "$.field", "string")),
}


class _Reader:
    """Fields of evidence that rules ask for: at first they are noted, then read from a struct that holds each once."""

    def __init__(self, held: Column | None = None):
        self.held, self.asked = held, {}

    def ask(self, what: str, path: str) -> Column:
        name = f"{what}_{path.replace('.', '_')}"
        self.asked[name] = (what, path)
        return F.lit(None).cast(_NOTED.get(what, "boolean")) if self.held is None else self.held[name]


#: The types of what is asked, for the pass in which it is noted; others are boolean.
_NOTED = {"kind": "string", "schema": "string", "text": "string", "number": "bigint", "double": "double", "size": "int", "keys": "array<string>", "json": "string", "fields": "array<string>"}


def _levels(asked: dict[str, tuple[str, str]]) -> list[dict[str, list[str]]]:
    """The objects to take apart, level by level: the path of each, "" for the whole, and the fields of it that are asked or lead to one."""
    levels: list[dict[str, list[str]]] = []
    for path in [p for _, p in asked.values() if p]:
        steps = path.split(".")
        for k, step in enumerate(steps):
            levels += [{}] if k == len(levels) else []
            fields = levels[k].setdefault(".".join(steps[:k]), [])
            if step not in fields:
                fields.append(step)
    return levels


def _at(v: Column, held: list[Column], path: str) -> Column:
    """The variant at a path, of v or of the objects that were taken apart."""
    if not path:
        return v
    parent, _, leaf = path.rpartition(".")
    return held[path.count(".")][f"at_{parent.replace('.', '_')}"][leaf]


def _apart(v: Column, held: list[Column], level: dict[str, list[str]]) -> Column:
    """The objects of one level as structs of variants; each is decoded once, whatever number of its fields is asked. One that isn't an object is NULL."""
    cast = lambda path, fields: F.try_variant_get(_at(v, held, path), "$", f"struct<{','.join(f'`{f}`:variant' for f in fields)}>")
    return F.struct(*[cast(path, fields).alias(f"at_{path.replace('.', '_')}") for path, fields in level.items()])


def _answers(v: Column, held: list[Column], asked: dict[str, tuple[str, str]]) -> Column:
    return F.struct(*[_ASKED[what](_at(v, held, path)).alias(n) for n, (what, path) in asked.items()])


def _let(c: Column, body) -> Column:
    """body(c), with c evaluated once."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def _bind(v: Column, rules) -> Column:
    """rules(reader), where each object of the variant is decoded once, and each field asked once, however often rules ask for it."""
    first = _Reader()
    rules(first)

    def below(held: list[Column], levels: list[dict[str, list[str]]]) -> Column:
        if levels:
            return _let(_apart(v, held, levels[0]), lambda h: below([*held, h], levels[1:]))
        return _let(_answers(v, held, first.asked), lambda h: rules(_Reader(h)))

    return below([], _levels(first.asked))


def _with_fields(df: DataFrame, name: str, v: Column, rules) -> tuple[DataFrame, _Reader]:
    """df with a column `name` that holds what the rules ask of v, and a reader of it: compiled, unlike the body of `_bind`."""
    first, columns, held = _Reader(), df.columns, []
    rules(first)
    for k, level in enumerate(_levels(first.asked)):
        df = df.withColumn(f"{name}_{k}", _apart(v, held, level))
        held.append(F.col(f"{name}_{k}"))
    return df.withColumn(name, _answers(v, held, first.asked)).select(*columns, name), _Reader(F.col(name))


def _ask(v: Column | _Reader, what: str, path: str) -> Column:
    return v.ask(what, path) if isinstance(v, _Reader) else _ASKED[what](_sub(v, path))


def kind(v: Column | _Reader, path: str) -> Column:
    """The JSON type of a field: BOOLEAN, BIGINT, STRING, ... ; NULL where absent or null."""
    return _ask(v, "kind", path)


def text(v: Column | _Reader, path: str) -> Column:
    return _ask(v, "text", path)


def _there(v: Column | _Reader, path: str) -> Column:
    """Whether a field is there and isn't null."""
    return _ask(v, "there", path)


def _is(v: Column, path: str, *kinds: str) -> Column:
    if kinds in (("OBJECT",), ("ARRAY",)):
        return _ask(v, kinds[0].lower(), path)
    schema = _ask(v, "schema", path)
    named = [schema == k for k in kinds if k != "DECIMAL"] + [schema.startswith("DECIMAL(")] * ("DECIMAL" in kinds)
    return F.coalesce(reduce(or_, named), F.lit(False))


def _is_int(v: Column, path: str) -> Column:
    return _is(v, path, "BIGINT")


def _long(v: Column, path: str) -> Column:
    return F.when(_ask(v, "schema", path) == "BIGINT", _ask(v, "number", path))


def _true(v: Column, path: str) -> Column:
    return F.coalesce(_ask(v, "boolean", path), F.lit(False))


def _false(v: Column, path: str) -> Column:
    return ~F.coalesce(_ask(v, "boolean", path), F.lit(True))


def _names(*errors: Column) -> Column:
    return F.array_compact(F.array(*errors))


@dataclass(frozen=True)
class _Found:
    """How rules give what they find: all names as an array, or only the first one, which is compiled and stops at it."""

    names: Callable[..., Column]
    both: Callable[..., Column]
    none: Callable[[], Column]


_ALL = _Found(_names, F.concat, lambda: F.array().cast("array<string>"))
_FIRST = _Found(F.coalesce, F.coalesce, lambda: F.lit(None).cast("string"))


# --- binding and meaning ---------------------------------------------------------


def roster(attempts: DataFrame, slots: DataFrame, group: str) -> DataFrame:
    """(kind, label): a group's measurement attempts, and its blocked and abandoned slots with what they wait for."""
    subjects = attempts.filter((F.col("group_id") == group) & (F.col("purpose") == "measurement")).select(F.lit("subject").alias("kind"), F.col("attempt_id").alias("label"))
    spec = F.concat(F.lit("any "), F.get_json_object("producer", "$.tool"), F.lit(" "), F.get_json_object("producer", "$.mode"), F.lit(" of this group"))
    label = F.concat(F.lit("slot "), F.col("slot").cast("string"), F.lit(" ("), "tool", F.lit(") awaiting "), F.coalesce("awaiting", spec))
    owed = slots.filter((F.col("group_id") == group) & F.col("state").isin("BLOCKED", "ABANDONED")).select(F.lower("state").alias("kind"), label.alias("label"))
    return subjects.unionByName(owed)


def with_evidence(attempts: DataFrame, evidence: DataFrame) -> DataFrame:
    """attempts with their evidence(prefix, result, verify), found by result_prefix; texts become variants.

    has_result tells a missing file from one that can't be read.
    """
    e = evidence.select(F.col("prefix").alias("result_prefix"), F.col("result").alias("result_text"), F.col("verify").alias("verify_text"))
    joined = attempts.join(e, "result_prefix", "left")
    return joined.withColumns({"has_result": F.col("result_text").isNotNull(), "result": F.try_parse_json("result_text"), "verification": F.try_parse_json("verify_text")})


def identity_errors(df: DataFrame) -> Column:
    """Names of the identities of `result` that aren't the row's: attempt_id, case_id, prefix."""
    return _bind(F.col("result"), _identity_errors)


def _identity_errors(v: _Reader, out: _Found = _ALL) -> Column:
    leaf = F.element_at(F.split(F.rtrim(F.col("result_prefix"), F.lit("/")), "/"), -1)
    return out.names(
        F.when(~text(v, "attempt_id").eqNullSafe(F.col("attempt_id")), "attempt_id"), F.when(~text(v, "case_id").eqNullSafe(F.col("case_id")), "case_id"),
        F.when(~leaf.eqNullSafe(F.col("attempt_id")), "prefix"),
    )


def failed_subject(v: Column) -> Column:
    """Why evidence says nothing about a listing: the first rule that applies, or NULL."""
    return _bind(v, _failed_subject)


def _failed_subject(v: _Reader) -> Column:
    e, oom = "execution", "execution.cgroup.oom_kill_delta"
    rules = (
        (~_false(v, "timed_out"), "subject timed out"), (~_long(v, "exit_code").eqNullSafe(F.lit(0)), "subject exited"), (~_is(v, e, "OBJECT"), "no execution evidence"),
        (~_false(v, f"{e}.timed_out"), "execution timeout invalid"), (~_true(v, f"{e}.subreaper_enabled"), "no descendant supervision"),
        (~_true(v, f"{e}.process_tree_clean"), "live descendant"), (~_true(v, f"{e}.process_group_empty"), "process group not empty"), (~_true(v, f"{e}.descendants_empty"), "descendants not empty"),
        (_ask(v, "absent", oom), "no oom evidence"), (_there(v, oom) & ~(_is_int(v, oom) & (_long(v, oom) >= 0)), "oom evidence invalid"), (_long(v, oom) > 0, "oom kill"),
    )
    out = F.lit(None).cast("string")
    for cond, name in reversed(rules):
        out = F.when(cond, F.lit(name)).otherwise(out)
    return out


def artifact_binding(recorded: DataFrame, inventory: DataFrame) -> DataFrame:
    """(prefix, path, problem) where recorded(prefix, path, sha256, size, optional) and inventory(prefix, path, sha256, size) disagree."""
    i = inventory.select("prefix", "path", F.col("sha256").alias("found"), F.col("size").alias("found_size"))
    both = recorded.withColumn("r", F.lit(True)).join(i.withColumn("i", F.lit(True)), ["prefix", "path"], "full_outer")
    problem = (
        F.when(F.col("r").isNull(), "unrecorded").when(F.col("i").isNull(), F.when(~F.coalesce("optional", F.lit(False)), "absent"))
        .when(F.col("sha256") != F.col("found"), "digest").when(F.col("size") != F.col("found_size"), "size")
    )
    return both.select("prefix", "path", problem.alias("problem")).filter("problem is not null")


#: Fields of evidence and the ledger's columns that they repeat.
BOUND_FIELDS = {
    "group_id": "group_id", "job_name": "job_name", "case_id": "case_id", "attempt_id": "attempt_id", "tool": "tool", "mode": "mode", "bucket": "target_bucket", "region": "target_region",
    "prefix": "target_prefix", "auth_role": "auth_role", "image": "image_uri", "image_set_sha256": "image_set_sha256",
}
#: The numbers of declared_resources, whose other field is the text machine_type.
RESOURCES = ("vcpus", "memory_gb", "container_memory_gb")


def result_binding(df: DataFrame) -> Column:
    """Names of the fields of `result` that aren't what the row launched; config and declared_resources as whole objects, key order aside."""
    return _bind(F.col("result"), _result_binding)


def _result_binding(v: _Reader, out: _Found = _ALL) -> Column:
    same = lambda f, c: text(v, f).eqNullSafe(F.col(c)) & (~_there(v, f) | _is(v, f, "STRING"))
    number = lambda f, c: _long(v, f).eqNullSafe(F.col(c).cast("bigint")) & (~_there(v, f) | _is_int(v, f))
    held = F.sort_array(_ask(v, "keys", "declared_resources")).eqNullSafe(F.array(*[F.lit(k) for k in sorted(("machine_type", *RESOURCES))])) & same("declared_resources.machine_type", "machine_type")
    for r in RESOURCES:
        held &= number(f"declared_resources.{r}", r)
    # a variant writes an object's fields in the order of their names
    config = F.coalesce(_ask(v, "json", "config") == F.to_json(F.try_parse_json("config")), F.lit(False))
    return out.names(*[F.when(~same(f, c), f) for f, c in BOUND_FIELDS.items()], F.when(~config, "config"), F.when(~F.coalesce(held, F.lit(False)), "declared_resources"))


_HEX64 = r"\A[0-9a-f]{64}\z"


def _artifact(v: Column, at: str, optional: bool = False) -> list[Column]:
    """Names of what a recorded artifact lacks; for one that isn't an object only `shape`."""
    ok = _is(v, at, "OBJECT")
    digest = f"{at}.sha256"
    absent = ~_there(v, digest)
    allowed = absent & text(v, f"{at}.channel").eqNullSafe(F.lit("dataset")) if optional else F.lit(False)
    bad = ~allowed & (absent | ~_is(v, digest, "STRING") | ~F.coalesce(text(v, digest).rlike(_HEX64), F.lit(False)))
    size = f"{at}.size_bytes"
    return [
        F.when(~ok, f"{at}.shape"), F.when(ok & ~(_is(v, f"{at}.name", "STRING") & (text(v, f"{at}.name") != "")), f"{at}.name"),
        F.when(ok & ~(_is_int(v, size) & (_long(v, size) >= 0)), size), F.when(ok & bad, digest),
    ]


def capture_errors(v: Column) -> Column:
    """What the evidence fails to say of its product, stdout and stderr; a product may replace stdout."""
    return _bind(v, _capture_errors)


def _capture_errors(v: _Reader, out: _Found = _ALL) -> Column:
    product, none = _there(v, "product"), out.none()
    errors = [F.when(product, out.names(*_artifact(v, "product", True))).otherwise(none), out.names(F.when(_there(v, "product_error") & ~_is(v, "product_error", "STRING"), "product_error"))]
    for stem in ("stdout", "stderr"):
        there = _there(v, stem)
        gone = F.lit(True) if stem == "stderr" else ~product
        errors.append(F.when(there, out.names(*_artifact(v, stem))).otherwise(out.names(F.when(gone, stem))))
    return out.both(*errors)


def result_semantics(v: Column) -> Column:
    """Names of the fields of evidence that break its types, ranges or agreement."""
    return _bind(v, _result_semantics)


def _result_semantics(v: _Reader, out: _Found = _ALL) -> Column:
    e = "execution"
    counted = _long(v, "exit_code").eqNullSafe(F.lit(0)) & _false(v, "timed_out") & ~_there(v, "product_error")
    rows = _there(v, "row_count")
    head = out.names(
        F.when(~_is_int(v, "exit_code"), "exit_code"), F.when(~_is(v, "timed_out", "BOOLEAN"), "timed_out"),
        F.when(rows & ~(_is_int(v, "row_count") & (_long(v, "row_count") >= 0)), "row_count"),
        F.when(_there(v, "row_count_error") & ~_is(v, "row_count_error", "STRING"), "row_count_error"),
    )
    never_ran = out.names(
        F.when(~_is(v, "setup", "OBJECT"), "setup"), F.when(_long(v, "exit_code").eqNullSafe(F.lit(0)), "exit_code"),
        *[F.when(_there(v, n), n) for n in ("wall_seconds", "max_rss_kb", "row_count", "row_count_error", "product", "product_error")],
    )
    rss, elapsed = _long(v, "max_rss_kb"), _long(v, f"{e}.elapsed_ns")
    number = _is(v, "wall_seconds", "BIGINT", "DOUBLE", "DECIMAL", "FLOAT")
    wall = _ask(v, "double", "wall_seconds")
    ran = out.names(
        F.when(~F.coalesce((rss >= 0) & rss.eqNullSafe(_long(v, f"{e}.max_rss_kb")), F.lit(False)), "max_rss_kb"),
        F.when(~F.coalesce(elapsed >= 0, F.lit(False)), f"{e}.elapsed_ns"), F.when(~number, "wall_seconds"),
        F.when(number & elapsed.isNotNull() & (wall != F.round(elapsed / 1e9, 6)), "wall_seconds/elapsed_ns"),
        *[F.when(~_is(v, f"{e}.{n}", "BOOLEAN"), f"{e}.{n}") for n in ("timed_out", "process_group_empty", "descendants_empty", "process_tree_clean", "subreaper_enabled")],
        F.when(~text(v, f"{e}.timed_out").eqNullSafe(text(v, "timed_out")), f"{e}.timed_out"), F.when(~_is(v, f"{e}.cgroup", "OBJECT"), f"{e}.cgroup"),
        *[F.when(_there(v, p) & ~(_is_int(v, p) & (_long(v, p) >= 0)), p) for p in (f"{e}.cgroup.oom_delta", f"{e}.cgroup.oom_kill_delta")],
    )
    tail = out.names(F.when(counted & ~_there(v, "row_count_error") & ~rows, "row_count"), F.when(~counted & rows, "row_count"))
    return F.when(~_there(v, e), out.both(head, never_ran)).when(~_is(v, e, "OBJECT"), out.both(head, out.names(F.lit(e)))).otherwise(out.both(head, ran, _capture_errors(v, out), tail))


def verify_binding(df: DataFrame) -> Column:
    """Names of what `verification` fails to bind; the verdict is worked out again from its diff."""
    return _bind(F.col("verification"), _verify_binding)


def _verify_binding(v: _Reader, out: _Found = _ALL) -> Column:
    lists = ("missing", "extra", "duplicates", "reference_duplicates", "mismatches")
    expected = {"attempt_id": F.col("attempt_id"), "tool": F.col("tool"), "mode": F.col("mode"), "actual_result_sha256": F.sha2("result_text", 256)}
    n = {x: _ask(v, "size", f"diff.{x}") for x in lists}
    fields = _ask(v, "fields", "diff.mismatches")
    hard = F.lit(False)
    for x in lists[:4]:
        hard |= n[x] > 0
    hard |= F.exists(fields, lambda f: f != "mtime")
    again = F.when(hard, "FAIL").when(n["mismatches"] > 0, "DRIFT").otherwise("PASS")
    whole = F.lit(True)
    for x in lists:
        whole &= _is(v, f"diff.{x}", "ARRAY")
    digests = ("actual_tsv_sha256", "reference_tsv_sha256", "reference_result_sha256")
    return out.names(
        *[F.when(~text(v, k).eqNullSafe(c), k) for k, c in expected.items()], F.when(~F.coalesce(text(v, "verdict").isin("PASS", "DRIFT", "FAIL"), F.lit(False)), "verdict"),
        *[F.when(~(_is(v, d, "STRING") & F.coalesce(text(v, d).rlike(_HEX64), F.lit(False))), d) for d in digests],
        *[F.when(~(_is(v, d, "STRING") & (text(v, d) != "")), d) for d in ("reference_attempt_id", "reference_tool", "reference_mode", "product")],
        F.when(~_is(v, "fields", "ARRAY"), "fields"), F.when(~whole, "diff"), F.when(whole & ~again.eqNullSafe(text(v, "verdict")), "verdict"),
    )


def evidence_state(df: DataFrame) -> DataFrame:
    """with_evidence rows with evidence_state, the first rung of the ladder that applies."""
    # a rung reads its fields only where the rungs before it found nothing; verify.json is parsed for those rows alone
    first = lambda v, rules: _bind(v, lambda r: rules(r, _FIRST))
    result = F.col("result")
    bound = _let(F.try_parse_json("verify_text"), lambda v: F.when(v.isNull(), "VERIFY_UNAVAILABLE").when(first(v, _verify_binding).isNotNull(), "VERIFY_MISMATCH").otherwise("VERIFIED"))
    state = (
        F.when(~F.col("has_result"), "MISSING_EVIDENCE").when(result.isNull(), "RESULT_UNAVAILABLE").when(first(result, _identity_errors).isNotNull(), "IDENTITY_MISMATCH")
        .when(first(result, _result_binding).isNotNull() | first(result, _result_semantics).isNotNull(), "RESULT_MISMATCH").otherwise(bound)
    )
    return df.withColumn("evidence_state", state)


def report_rows(df: DataFrame, modes: DataFrame) -> DataFrame:
    """A report line for each evidence_state row, `-` for what isn't known; modes: mode, product, fields (text)."""
    v = F.col("result")
    known = F.col("evidence_state").isin("VERIFY_UNAVAILABLE", "VERIFY_MISMATCH", "VERIFIED")
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    measured = lambda p: dash(F.when(known, text(v, p)))
    return df.join(F.broadcast(modes), "mode", "left").select(
        "attempt_id", "tool", "mode", dash(F.col("product")).alias("product"), dash(F.col("fields")).alias("fields"), dash(F.col("concurrency")).alias("concurrency"), "case_id", "attempt",
        F.col("target_bucket").alias("bucket"), dash(F.col("machine_type")).alias("machine_type"), dash(F.col("vcpus")).alias("vcpus"), dash(F.col("memory_gb")).alias("memory_gb"),
        dash(F.col("container_memory_gb")).alias("container_memory_gb"), "purpose", "statistic", "state", "evidence_state", measured("exit_code").alias("exit"), measured("row_count").alias("row_count"),
        F.when(known, F.try_variant_get(v, "$.wall_seconds", "double")).alias("wall_seconds"), measured("max_rss_kb").alias("max_rss_kb"), measured("execution.max_rss_floor_kb").alias("max_rss_floor_kb"),
        F.when(F.col("evidence_state") == "VERIFIED", dash(text(F.col("verification"), "verdict"))).otherwise("-").alias("verdict"), "produced_by",
    )


def with_preparations(rows: DataFrame) -> DataFrame:
    """Report rows with prep_seconds, the measured seconds of the runs behind each; NULL for none, or where one is unknown or outside the report."""
    rows = checkpoint(rows)
    return rows.join(preparation_cost(rows.select("attempt_id", "produced_by", "wall_seconds")).select("attempt_id", "prep_seconds"), "attempt_id", "left")


# --- ledger aggregates --------------------------------------------------------------


def gap_table(subjects: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """E5: (attempt_id, reason, exit_code) of with_evidence rows that can't be compared, the first reason of each.

    refused: attempt_ids whose captures don't match their records or whose listings a format or a gate refused.
    """
    subjects = subjects.withColumn("_refused", F.lit(False)) if refused is None else subjects.join(refused.select("attempt_id").distinct().withColumn("_refused", F.lit(True)), "attempt_id", "left")
    rules = lambda v: F.when(_identity_errors(v, _FIRST).isNotNull(), "identity").when(_failed_subject(v).isNotNull(), "failed-subject")
    subjects, v = _with_fields(subjects, "_result", F.col("result"), rules)
    of_result = rules(v)
    reason = (
        F.when(~F.col("state").isin(*TERMINAL), "unsettled").when(F.col("state") != "SUCCEEDED", "absent").when(~F.col("has_result"), "missing-evidence")
        .when(F.col("result").isNull(), "malformed").otherwise(F.coalesce(of_result, F.when(F.col("_refused"), F.lit("normalize"))))
    )
    codes = F.create_map(*[F.lit(x) for kv in GAP_EXIT_CODES.items() for x in kv])
    return subjects.select("attempt_id", F.explode(F.array_compact(F.array(reason))).alias("reason")).withColumn("exit_code", F.element_at(codes, F.col("reason")))


def rate_summary(attempts: DataFrame) -> DataFrame:
    """(case_id, attempts, settled, successes, rate) of measured rate cases; rate to 4 places, NULL without a settled attempt."""
    own = attempts.filter("purpose = 'measurement' and statistic = 'rate'")
    out = own.groupBy("case_id").agg(F.count("*").alias("attempts"), F.count(F.when(F.col("state").isin(*TERMINAL), 1)).alias("settled"), F.count(F.when(F.col("state") == "SUCCEEDED", 1)).alias("successes"))
    return out.withColumn("rate", F.when(F.col("settled") > 0, F.round(F.col("successes") / F.col("settled"), 4)))


def preparation_cost(rows: DataFrame) -> DataFrame:
    """(attempt_id, links, prep_seconds) of rows(attempt_id, produced_by, wall_seconds) that ran behind another.

    The chain of produced_by is followed until it ends, comes back to a link it has, or
    leaves the table; in the last case, and if a link has no time, the cost is NULL. Each round doubles
    the steps that a row's walk has taken, so a chain of n links takes log n rounds. Walks that are still under way then lead
    into cycles, and stand on one: each cycle is summed once and becomes the end of the walks that lead to it. Of
    a repeated attempt_id the smallest row is followed.
    """
    step = rows.groupBy(F.col("attempt_id").alias("at")).agg(F.min(F.struct(F.col("produced_by").alias("to"), F.col("wall_seconds").alias("cost"))).alias("s"))
    one = checkpoint(step.select("at", "s.to", F.lit(1).cast("long").alias("links"), F.col("s.cost").cast("double").alias("total"), F.lit(False).alias("outside"), F.col("at").alias("least")))
    walk = _doubled(one)
    under_way = walk.filter("to is not null and not outside")
    if not under_way.isEmpty():
        on_ring = under_way.select(F.col("to").alias("at")).distinct()
        ring = on_ring.join(under_way.select("at", "least"), "at").join(one.select("at", "total"), "at")
        whole = ring.groupBy("least").agg(F.count("*").alias("links"), F.when(F.count("total") == F.count("*"), F.sum("total")).alias("total"))
        ends = ring.select("at", "least").join(whole, "least").select("at", F.lit(None).cast("string").alias("to"), "links", "total", F.lit(False).alias("outside"), "least")
        tails = one.join(under_way.select("at"), "at", "left_semi").join(on_ring, "at", "left_anti")
        walk = walk.filter("to is null or outside").unionByName(_doubled(checkpoint(tails.unionByName(ends))))
    behind = rows.filter("produced_by is not null").select("attempt_id", F.col("produced_by").alias("at")).join(walk, "at", "left")
    cost = F.when(F.col("to").isNull(), F.round("total", 6))  # a walk that isn't at its end left the table
    return behind.select("attempt_id", F.coalesce("links", F.lit(0)).cast("long").alias("links"), cost.alias("prep_seconds"))


def _doubled(one: DataFrame) -> DataFrame:
    """Walks of one(at, to, links, total, outside, least), each as long as it goes: until `to` is NULL or not in the table, or over as many steps as there are rows."""
    most, steps, walk = one.count(), 1, one
    open_ = F.col("to").isNotNull() & ~F.col("outside")
    while not walk.filter(open_).isEmpty() and steps <= most:
        nxt = walk.select(F.col("at").alias("to"), *[F.col(c).alias(f"{c}2") for c in ("to", "links", "total", "outside", "least")], F.lit(True).alias("found"))
        both = walk.filter(open_).join(nxt, "to", "left")
        found = F.col("found").isNotNull()
        longer = both.select(
            "at", F.when(found, F.col("to2")).otherwise(F.col("to")).alias("to"), (F.col("links") + F.coalesce("links2", F.lit(0))).alias("links"),
            F.when(found, F.col("total") + F.col("total2")).otherwise(F.col("total")).alias("total"), F.coalesce("outside2", F.lit(True)).alias("outside"), F.least("least", "least2").alias("least"),
        )
        walk, steps = checkpoint(walk.filter(~open_).unionByName(longer)), 2 * steps
    return walk


def stratum_summary(rows: DataFrame) -> DataFrame:
    """(bucket, product, fields, n, subjects, verdicts) of measured timings with a known product."""
    own = rows.filter("purpose = 'measurement' and statistic = 'timing' and product <> '-'")
    subject = F.concat_ws("/", "tool", "mode")
    return own.groupBy("bucket", "product", "fields").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(subject)), ", ").alias("subjects"), F.array_join(F.array_sort(F.collect_set("verdict")), ", ").alias("verdicts"))


def summary_counts(rows: DataFrame) -> DataFrame:
    """(verdict, n, verified_timings) of report rows."""
    timing = (F.col("purpose") == "measurement") & (F.col("statistic") == "timing") & (F.col("exit") == "0") & F.col("verdict").isin("PASS", "DRIFT") & F.col("wall_seconds").isNotNull() & ~F.isnan("wall_seconds")
    return rows.groupBy("verdict").agg(F.count("*").alias("n"), F.count(F.when(timing, 1)).alias("verified_timings"))


def report_final(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """(final): whether a report is: not empty, nothing blocked, every state final, every success with bound evidence."""
    r = rows.agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.col("state").isin(*FINAL) & ((F.col("state") != "SUCCEEDED") | F.col("evidence_state").isin(*BOUND))), F.lit(True)).alias("ok"))
    s = slots.agg(F.count(F.when(F.col("state") == "BLOCKED", 1)).alias("blocked"))
    return r.crossJoin(F.broadcast(s)).select(((F.col("n") > 0) & (F.col("blocked") == 0) & F.col("ok")).alias("final"))  # one row each


#: Places of one spec's candidates that are joined together.
_PLACES = 4096
#: Up to so many specs are broadcast with their numbers.
_SPECS = 4096


def _claims(slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What slots ask for: (group_id, slot, spec columns) of those with a producer, and (group_id, slot, attempt_id) of those that await an attempt."""
    spec = [F.get_json_object("producer", f"$.{c}").alias(c) for c in PRODUCER_SPEC]
    by_spec = slots.filter("producer is not null").select("group_id", "slot", *spec)
    return by_spec, slots.filter("producer is null and not contains(awaiting, '/')").select("group_id", "slot", F.col("awaiting").alias("attempt_id"))


def _placed(attempts: DataFrame, *by: str) -> DataFrame:
    """attempts with `place`, from 1 in the order of settled_at and attempt_id for each value of `by`, however many share it.

    They are dealt to ranges once, each range counts its rows of a value, and a row's place is its number in its range behind the ranges before.
    """
    order = (F.col("settled_at").asc_nulls_first(), F.col("attempt_id").asc_nulls_first())
    parts = ranged(attempts, *by, "settled_at", "attempt_id")  # NULL first too
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    sums = parts.groupBy(*by, "_range").count().select(*by, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy(*by, "_range").orderBy(*order)).cast("long")
    return parts.withColumn("_own", own).join(sums, [*by, "_range"]).withColumn("place", F.col("_own") + F.col("_before")).drop("_own", "_before", "_range")


def slot_candidates(slots: DataFrame, attempts: DataFrame) -> DataFrame:
    """(group_id, slot, attempt_id, state, place): attempts of a slot's group that could pay it, earliest settled first.

    All slots of one spec have the same candidates, so specs are numbered, candidates are placed once for each spec, and slots meet them in
    blocks of places by a spec's number: the pairs, as many as the product, leave the join as they are, without a shuffle or a sort. A
    block is what is held in memory. Only a slot that is there more than once has its candidates placed by itself.
    """
    slot, spec, keep = ["group_id", "slot"], ["group_id", *PRODUCER_SPEC], ("group_id", "slot", "attempt_id", "state", "place")
    attempts = attempts.select("group_id", "attempt_id", "state", "settled_at", *PRODUCER_SPEC)
    repeated = checkpoint(slots.groupBy(*slot).count().filter("count > 1").select(*slot))
    some = not repeated.isEmpty()
    by_spec, named = _claims(slots)
    once = by_spec.join(repeated, slot, "left_anti") if some else by_spec
    specs = checkpoint(once.select(*spec).distinct().withColumn("spec", F.monotonically_increasing_id()))
    specs = F.broadcast(specs) if specs.count() <= _SPECS else specs
    placed = _placed(attempts.join(specs, spec).select("spec", "attempt_id", "state", "settled_at"), "spec").drop("settled_at")
    placed = checkpoint(placed.withColumn("_block", F.floor((F.col("place") - 1) / _PLACES)))
    n = int(slots.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # dealt by number, as bytes don't tell how many pairs come of them
    dealt = once.join(specs, spec).select("spec", *slot).join(placed.select("spec", "_block").distinct(), "spec").repartition(n, "spec", "_block")
    met = dealt.join(placed.repartition(n, "spec", "_block").hint("shuffle_hash"), ["spec", "_block"]).select(*keep)
    own = named.join(attempts, ["group_id", "attempt_id"]).select(*slot, "attempt_id", "state", "settled_at")
    if some:
        own = own.unionByName(by_spec.join(repeated, slot, "left_semi").join(attempts, spec).select(*own.columns))
    place = F.row_number().over(W.partitionBy(*slot).orderBy(F.col("settled_at").asc_nulls_first(), "attempt_id")).cast("long")
    return met.unionByName(own.withColumn("place", place).select(*keep))


def _liveness(slots: DataFrame, attempts: DataFrame) -> DataFrame:
    """(group_id, slot, live) of slots that have candidates: whether one of them may still pay the slot; NULL where no state is known.

    Attempts are summed up by spec, so no pair of a slot and a candidate is made but for those that a slot disqualifies.
    """
    slot, spec = ["group_id", "slot"], ["group_id", *PRODUCER_SPEC]
    by_spec, named = (x.distinct() for x in _claims(slots))
    state = F.col("state")
    sums = [F.count("state").alias("known"), F.count(F.when(~state.isin(*TERMINAL) | state.isin(*RETRYABLE), 1)).alias("open"), F.count(F.when(state == "SUCCEEDED", 1)).alias("good")]
    none = F.lit(0).cast("long").alias("bad")
    one = by_spec.join(attempts.groupBy(*spec).agg(*sums), spec).select(*slot, "known", "open", "good", none)
    two = named.join(attempts.groupBy("group_id", "attempt_id").agg(*sums), ["group_id", "attempt_id"]).select(*slot, "known", "open", "good", none)
    # an attempt is out where each row of the slot disqualifies it
    rows = slots.groupBy(*slot).agg(F.count("*").alias("rows"))
    out = slots.select(*slot, F.explode(F.array_distinct(F.map_keys(F.from_json("disqualified", "map<string,string>")))).alias("attempt_id"))
    out = out.groupBy(*slot, "attempt_id").agg(F.count("*").alias("n")).join(rows, slot).filter("n = rows").select(*slot, "attempt_id")
    out = out.join(attempts.filter("state = 'SUCCEEDED'").select("attempt_id", *spec), ["group_id", "attempt_id"])
    lost = lambda df: df.groupBy(*slot).agg(F.count("*").alias("bad")).select(*slot, *[F.lit(0).cast("long").alias(c) for c in ("known", "open", "good")], "bad")
    bad = lost(out.join(by_spec, [*spec, "slot"], "left_semi")).unionByName(lost(out.join(named, [*slot, "attempt_id"], "left_semi")))
    total = one.unionByName(two).unionByName(bad).groupBy(*slot).agg(*[F.sum(c).alias(c) for c in ("known", "open", "good", "bad")])
    return total.select(*slot, F.when(F.col("known") > 0, (F.col("open") > 0) | (F.col("good") > F.col("bad"))).alias("live"))


def owed_reason(slots: DataFrame, attempts: DataFrame) -> DataFrame:
    """(group_id, slot, reason) of blocked slots that nothing can pay any more."""
    waiting = slots.filter("state = 'BLOCKED'")
    blocked = waiting.select("group_id", "slot", "awaiting")
    c = _liveness(waiting, attempts)
    up = slots.select(F.concat_ws("/", "group_id", F.col("slot").cast("string")).alias("awaiting"), F.col("state").alias("up"))
    rows = blocked.join(c, ["group_id", "slot"], "left").join(up, "awaiting", "left")
    on_slot = F.coalesce(F.col("awaiting").contains("/"), F.lit(False))
    reason = (
        F.when(on_slot, F.when(F.coalesce(F.col("up") == "ABANDONED", F.lit(True)), "the slot it waits on will not produce an attempt"))
        .when(F.col("live").isNull(), "no attempt in this group produces what it consumes").when(~F.col("live"), "every candidate is settled and none published a usable artifact")
    )
    return rows.select("group_id", "slot", reason.alias("reason")).filter("reason is not null")


def abandonment_closure(slots: DataFrame) -> DataFrame:
    """(slot_id, rounds): blocked slots that wait on an abandoned slot, directly (1) or through others.

    Each round doubles how far a slot has looked along `awaiting`, so n slots in a row take log n rounds. Slots that wait on
    nothing abandoned, or in a circle, are left out. Of a repeated slot the smallest `awaiting` is followed.
    """
    name = F.concat_ws("/", "group_id", F.col("slot").cast("string"))
    waits = slots.filter("state = 'BLOCKED' and awaiting is not null").groupBy(name.alias("at")).agg(F.min("awaiting").alias("to"))
    gone = slots.filter("state = 'ABANDONED'").select(name.alias("to")).distinct().withColumn("hit", F.lit(True))
    walk = checkpoint(waits.join(gone, "to", "left").select("at", "to", F.lit(1).cast("long").alias("rounds"), F.coalesce("hit", F.lit(False)).alias("hit")))
    most, steps = walk.count(), 1
    while steps <= most and not walk.filter("not hit").isEmpty():
        nxt = walk.select(F.col("at").alias("to"), F.col("to").alias("to2"), F.col("rounds").alias("rounds2"), F.col("hit").alias("hit2"))
        further = walk.filter("not hit").join(nxt, "to").select("at", F.col("to2").alias("to"), (F.col("rounds") + F.col("rounds2")).alias("rounds"), F.col("hit2").alias("hit"))
        walk, steps = checkpoint(walk.filter("hit").unionByName(further)), 2 * steps
    return walk.filter("hit").select(F.col("at").alias("slot_id"), "rounds")


def next_ordinal(attempts: DataFrame) -> DataFrame:
    """(case_id, next, succeeded, conflict): a case's next ordinal, and what refuses it: a success, or several inputs."""
    return attempts.groupBy("case_id").agg((F.max("attempt") + 1).cast("long").alias("next"), F.bool_or(F.col("state") == "SUCCEEDED").alias("succeeded"), (F.count_distinct("case_inputs") > 1).alias("conflict"))


#: Pieces of JSON: a string, or what stands between strings.
_PIECES = r'"(?:[^"\\]++|\\.)*+"|[^"]++'
#: Begins strings that wait for the keys to be sorted: with N behind it a number, with S a string that itself begins so.
_NUMBER = r"\u0001"


def _with(value: Column, f) -> Column:
    """f(value), with the value worked out once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _python_float(text: Column) -> Column:
    """The shortest text of a JSON number with a fraction or an exponent, as Python writes a float; NULL beyond a double."""

    def parts(shown: Column) -> Column:
        mantissa, e = F.substring_index(shown, "E", 1), F.when(shown.contains("E"), F.substring_index(shown, "E", -1).cast("int")).otherwise(0)
        return F.struct(F.replace(mantissa, F.lit("."), F.lit("")).alias("every"), (F.length(F.substring_index(mantissa, ".", 1)) + e).alias("point"))

    def stripped(x: Column) -> Column:
        lead = F.length(x["every"]) - F.length(F.ltrim(x["every"], F.lit("0")))
        return F.struct(F.btrim(x["every"], F.lit("0")).alias("digits"), (x["point"] - lead).alias("point"))  # digits in front of the point

    def shorter(x: Column) -> Column:
        """One digit less where that is the same double: before Java 19 a double's text may have one too many."""
        n = F.length(x["digits"]) - 1
        low, same = F.left(x["digits"], n).cast("decimal(20,0)"), lambda v: F.concat(v.cast("string"), F.lit("e"), (x["point"] - n).cast("string")).cast("double") == F.abs(text.cast("double"))
        as_ = lambda v: F.struct(F.rtrim(v.cast("string"), F.lit("0")).alias("digits"), (x["point"] + F.length(v.cast("string")) - n).alias("point"))
        return F.when((n > 0) & same(low + 1), as_(low + 1)).when((n > 0) & same(low), as_(low)).otherwise(x)

    def written(x: Column) -> Column:
        digits, point, size, zeros = x["digits"], x["point"], F.length(x["digits"]), lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
        power = F.abs(point - 1).cast("string")
        exponent = F.concat(F.when(point > 0, "+").otherwise("-"), F.when(F.length(power) < 2, "0").otherwise(""), power)
        return (
            F.when(digits == "", "0.0")
            .when((point < -3) | (point > 16), F.concat(F.left(digits, F.lit(1)), F.when(size > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), size))).otherwise(""), F.lit("e"), exponent))
            .when(point <= 0, F.concat(F.lit("0."), zeros(-point), digits)).when(point >= size, F.concat(digits, zeros(point - size), F.lit(".0")))
            .otherwise(F.concat(F.left(digits, point), F.lit("."), F.substring(digits, point + 1, size)))
        )

    whole = lambda shown: F.when(shown != "Infinity", F.concat(F.when(text.startswith("-"), "-").otherwise(""), _with(_with(_with(parts(shown), stripped), shorter), written)))
    return _with(F.abs(text.cast("double")).cast("string"), whole)


def _ascii(text: Column) -> Column:
    """A JSON string with each UTF-16 unit of its non-ASCII characters, and control characters, as lower-case \\uXXXX."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    one = lambda u: F.when(u <= "007E", F.decode(F.unhex(F.substring(u, 3, 2)), "US-ASCII")).otherwise(F.concat(F.lit("\\u"), F.lower(u)))

    def lower(c: Column) -> Column:
        for u in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):  # their hex digits as Python writes them
            c = F.regexp_replace(c, rf"(?<!\\)((?:\\\\)*)\\u{u:04X}", rf"$1\\u{u:04x}")
        return c

    control = F.when(text.contains("\\u00"), _with(text, lower)).otherwise(text)
    return F.when(text.rlike(r"\A[\x00-\x7E]*+\z"), control).otherwise(_with(F.array_join(F.transform(units, one), ""), lower))


def canonical(json: Column) -> Column:
    """JSON text of any depth with sorted keys, no blanks and ASCII alone; NULL for text that isn't JSON, a key used twice, or a number beyond a double.

    It is what Python's json.dumps(sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False) writes of
    what json.loads reads: integers of any length and booleans as they are, 1.0 apart from 1, floats in their
    shortest form. A VARIANT sorts the keys; numbers wait as marked strings meanwhile, for it doesn't keep their form.
    Keys sort by code points.
    """
    ok = F.try_parse_json(json).isNotNull()
    held = lambda x: F.when(x.startswith(f'"{_NUMBER}'), F.concat(F.lit(f'"{_NUMBER}S'), F.substring(x, F.lit(8), F.length(x)))).otherwise(x)
    marked = F.transform(F.regexp_extract_all(json, F.lit(_PIECES), F.lit(0)), lambda x: F.when(x.startswith('"'), held(x)).otherwise(F.regexp_replace(x, r"-?[0-9][0-9.eE+-]*+", '"\\\\u0001N$0"')))
    pieces = F.regexp_extract_all(F.to_json(F.try_parse_json(F.array_join(marked, ""))), F.lit(_PIECES), F.lit(0))  # keys in order

    def written(x: Column) -> Column:
        number = F.substring(x, F.lit(9), F.length(x) - 9)
        text = F.when(number.rlike("[.eE]"), _python_float(number)).when(number == "-0", "0").otherwise(number)
        own = F.when(x.startswith(f'"{_NUMBER}S'), F.concat(F.lit(f'"{_NUMBER}'), F.substring(x, F.lit(9), F.length(x)))).otherwise(x)
        return F.when(x.startswith(f'"{_NUMBER}N'), text).when(x.startswith('"'), _with(own, _ascii)).otherwise(x)

    out = F.transform(pieces, written)
    return F.when(ok, _with(out, lambda a: F.when(~F.exists(a, lambda x: x.isNull()), F.array_join(a, ""))))


def canonical_json(fields: dict[str, Column]) -> Column:
    """Strings and NULLs as one object of canonical JSON."""
    return canonical(F.to_json(F.struct(*[c.cast("string").alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"}))


def case_fingerprint(df: DataFrame, columns: list[str], tag: str, nested: tuple[str, ...] = ()) -> DataFrame:
    """Df with case_id `tool.hash`, the first 12 hex digits of a tagged hash of the columns' canonical JSON.

    A column of `nested` is JSON text, or a struct, array or map, and goes in as the document it is; others go in as
    strings, NULL as null. What isn't JSON, or holds a number beyond a double, has no case_id.
    """
    plain = lambda c: df.schema[c].dataType.typeName() == "string"
    whole = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns if c not in nested]), {"ignoreNullFields": "false"})
    own = [F.concat(F.lit(f'"{c}":'), F.coalesce(F.col(c) if plain(c) else F.to_json(c, {"ignoreNullFields": "false"}), F.lit("null"))) for c in nested]
    inside = F.substring(whole, F.lit(2), F.length(whole) - 2)
    document = canonical(F.concat(F.lit("{"), F.concat_ws(",", F.nullif(inside, F.lit("")), *own), F.lit("}")))
    return df.withColumn("case_id", F.concat("tool", F.lit("."), F.substring(F.sha2(F.concat(F.lit(tag), document), 256), 1, 12)))


def status(attempts: DataFrame, slots: DataFrame) -> DataFrame:
    """(kind, name, state, note): all attempts, and all slots with why nothing can pay them."""
    reasons = owed_reason(slots, attempts).withColumnRenamed("reason", "note")
    a = attempts.select(F.lit("attempt").alias("kind"), F.col("attempt_id").alias("name"), "state", F.lit(None).cast("string").alias("note"))
    s = slots.join(reasons, ["group_id", "slot"], "left").select(F.lit("slot").alias("kind"), F.concat_ws("/", "group_id", F.col("slot").cast("string")).alias("name"), "state", "note")
    return a.unionByName(s)


def prunable(attempts: DataFrame) -> DataFrame:
    """Attempts that settled without success."""
    return attempts.filter(F.col("state").isin(*TERMINAL) & (F.col("state") != "SUCCEEDED")).select("attempt_id", "state")


def roster_coverage(registered: DataFrame, run: DataFrame, excluded: DataFrame) -> DataFrame:
    """(tool, problem): registered tools neither run nor excluded, unknown ones, and ones in both."""
    r, u, x = (d.select("tool").distinct().withColumn(n, F.lit(True)) for d, n in ((registered, "r"), (run, "u"), (excluded, "x")))
    both = r.join(u, "tool", "full_outer").join(x, "tool", "full_outer")
    wrong = _names(F.when(F.col("r").isNotNull() & F.col("u").isNull() & F.col("x").isNull(), "absent"), F.when(F.col("r").isNull(), "unknown"), F.when(F.col("u").isNotNull() & F.col("x").isNotNull(), "run and excluded"))
    return both.select("tool", F.explode(wrong).alias("problem"))


def mode_coverage(cases: DataFrame, modes: DataFrame) -> DataFrame:
    """(tool, mode, problem) of cases(tool, mode) that modes(tool, mode) doesn't declare: `modes unknown` for a tool without any, else `no such mode`."""
    declared = modes.select("tool", "mode").distinct()
    stray = cases.select("tool", "mode").distinct().join(declared, ["tool", "mode"], "left_anti")
    known = declared.select("tool").distinct().withColumn("_known", F.lit(True))
    return stray.join(known, "tool", "left").select("tool", "mode", F.when(F.col("_known").isNull(), "modes unknown").otherwise("no such mode").alias("problem"))


def corpus_pin(receipts: DataFrame, expected: DataFrame) -> DataFrame:
    """(tool, found, pinned, problem): receipts(tool, stdout_sha256, stderr_sha256, empty) with a non-empty stream, against expected(tool, pinned)."""
    n = _payloads(receipts).groupBy("tool").agg(F.count("*").alias("found"))
    both = n.join(expected, "tool", "full_outer").select("tool", F.coalesce("found", F.lit(0)).alias("found"), "pinned")
    return both.withColumn("problem", F.when(F.col("pinned").isNull(), "unpinned").when(F.col("found") != F.col("pinned"), "count"))


def _payloads(receipts: DataFrame) -> DataFrame:
    """Receipts whose stdout, or else stderr, isn't empty."""
    return receipts.filter(F.coalesce(*[F.when(F.col(c) != F.col("empty"), F.col(c)) for c in ("stdout_sha256", "stderr_sha256")]).isNotNull())


def unexercised_modes(declared: DataFrame, receipts: DataFrame) -> DataFrame:
    """declared(tool, mode) that no receipt with a payload reaches."""
    return declared.select("tool", "mode").distinct().join(_payloads(receipts).select("tool", "mode"), ["tool", "mode"], "left_anti")
