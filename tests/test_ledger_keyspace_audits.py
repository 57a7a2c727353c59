"""Chains, slots, canonical JSON, cut points, links and sources on small inputs."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from keyscape.operators import audits as a
from keyscape.operators import evidence as e
from keyscape.operators import keyspace as k
from keyscape.sources import listings as s


def test_preparation_chains(spark):
    rows = spark.createDataFrame(
        [("a", None, 1.0), ("b", "a", 2.0), ("c", "b", 4.0), ("x", "gone", 1.0), ("p", "q", 1.0), ("q", "p", 2.0), ("n", "m", 1.0), ("m", None, None)], "attempt_id string, produced_by string, wall_seconds double"
    )
    assert {r[0]: (r[1], r[2]) for r in e.preparation_cost(rows).collect()} == {"b": (1, 1.0), "c": (2, 3.0), "x": (0, None), "p": (2, 3.0), "q": (2, 3.0), "n": (1, None)}


def test_long_chains_and_cycles(spark):
    """Chains of many links take few rounds; a walk into a cycle counts each link once."""
    n = 70
    rows = [(f"c{i}", f"c{i - 1}" if i else None, 1.0) for i in range(n)] + [("x", "y", 1.0), ("y", "z", 2.0), ("z", "x", 4.0), ("in", "x", 8.0), ("self", "self", 3.0), ("dup", "c1", 9.0), ("dup", "c0", 9.0)]
    out = e.preparation_cost(spark.createDataFrame(rows, "attempt_id string, produced_by string, wall_seconds double")).collect()
    got = {r[0]: (r[1], r[2]) for r in out if r[0] != "dup"}
    assert all(got[f"c{i}"] == (i, float(i)) for i in range(1, n)) and "c0" not in got
    assert got["x"] == got["y"] == got["z"] == (3, 7.0) and got["in"] == (3, 7.0) and got["self"] == (1, 3.0)
    assert sorted((r[1], r[2]) for r in out if r[0] == "dup") == [(1, 1.0), (2, 2.0)]


def test_bound_fields_by_type(spark):
    """A number written as text, another key order, and a further resource."""
    row = {"group_id": "g", "job_name": "j", "case_id": "c", "attempt_id": "c.s1", "tool": "t", "mode": "m", "target_bucket": "b", "target_region": "r", "target_prefix": "", "auth_role": None, "image_uri": "i", "image_set_sha256": "s",
           "config": '{"mode":"m","n":1}', "machine_type": "n4", "vcpus": 2, "memory_gb": 8, "container_memory_gb": None}
    good = {"group_id": "g", "job_name": "j", "case_id": "c", "attempt_id": "c.s1", "tool": "t", "mode": "m", "bucket": "b", "region": "r", "prefix": "", "image": "i", "image_set_sha256": "s",
            "config": {"n": 1, "mode": "m"}, "declared_resources": {"vcpus": 2, "memory_gb": 8, "container_memory_gb": None, "machine_type": "n4"}}
    cases = [({}, []), ({"config": {"mode": "m", "n": "1"}}, ["config"]), ({"declared_resources": good["declared_resources"] | {"gpu": 1}}, ["declared_resources"]), ({"declared_resources": good["declared_resources"] | {"vcpus": "2"}}, ["declared_resources"]),
             ({"auth_role": "x", "job_name": 5}, ["job_name", "auth_role"]), ({"declared_resources": None, "tool": None}, ["tool", "declared_resources"])]
    schema = ", ".join(f"{k} {'int' if k in e.RESOURCES else 'string'}" for k in row)
    for change, errors in cases:
        df = spark.createDataFrame([tuple(row.values())], schema).withColumn("result", F.parse_json(F.lit(json.dumps(good | change))))
        assert df.select(e.result_binding(df)).first()[0] == errors


def test_gap_of_refused_listings(spark):
    ok = json.dumps({"attempt_id": "c.s1", "case_id": "c", "exit_code": 0, "timed_out": False, "execution": {"timed_out": False, "subreaper_enabled": True, "process_tree_clean": True, "process_group_empty": True, "descendants_empty": True, "cgroup": {"oom_kill_delta": 0}}})
    attempts = spark.createDataFrame([("c.s1", "c", "SUCCEEDED", "p/c.s1", ok), ("d.s1", "d", "SUCCEEDED", "p/d.s1", ok), ("e.s1", "e", "RUNNING", "p/e.s1", ok)], "attempt_id string, case_id string, state string, result_prefix string, text string")
    rows = attempts.withColumn("has_result", F.lit(True)).withColumn("result", F.try_parse_json("text"))
    assert {tuple(r) for r in e.gap_table(rows, attempts.select("attempt_id")).collect()} == {("c.s1", "normalize", 6), ("d.s1", "identity", 5), ("e.s1", "unsettled", 9)}
    assert {tuple(r) for r in e.gap_table(rows).collect()} == {("d.s1", "identity", 5), ("e.s1", "unsettled", 9)}


def test_segments_at_each_number_of_cuts(spark):
    keys = spark.createDataFrame([(f"k{i:04d}",) for i in range(0, 700, 3)], "key string")
    for n in (0, 1, 63, 64, 65, 128, 300):
        cuts = spark.createDataFrame([(j + 1, f"k{2 * j:04d}") for j in range(n)], "number long, cut string")
        out = {r.key: r.segment for r in k.assign_segment(keys, cuts).collect()}
        assert len(out) == 234 and all(v == min(n, int(x[1:]) // 2 + 1) for x, v in out.items())


def test_bucket_diff_of_repeated_keys(spark):
    left = spark.createDataFrame([("a", "2", "x"), ("a", "1", "y"), ("b", "1", None)], "key string, size string, etag string")
    right = spark.createDataFrame([("a", "1", "y"), ("a", "3", "z"), ("b", "1", "e")], "key string, size string, etag string")
    assert [tuple(r) for r in k.bucket_diff(left, right).collect()] == [("b", "changed")]


def test_citations_by_rule(spark):
    text = "x\n[SRC a/b.c:1-3, 9 @ abcdef1] [SRC p.c; q r.c:2; s.c:; t.c:4, @ 1234567]\n[SRC late.c:7] [SRCnone] [SRC open"
    got = [tuple(r) for r in a.citations(spark.createDataFrame([("p", text)], "page string, text string")).collect()]
    assert set(got) == {
        ("p", 2, "abcdef1", "a/b.c", "1-3,9", True), ("p", 2, "1234567", "p.c", None, True), ("p", 2, "1234567", None, None, False), ("p", 2, "1234567", "t.c", "4", True), ("p", 3, None, None, None, False),
    } and len(got) == 6
    targets = a.links(spark.createDataFrame([("p", "[a](x.md) [b](y.md 'T)') ![c](z.png) [d](mailto:q) (e](no) [f](g h) [i]() [j](k.md\t\"t\")")], "page string, text string"))
    assert sorted(r.target for r in targets.collect()) == ["k.md", "x.md", "y.md", "z.png"]
    ids = a.heading_ids(spark.createDataFrame([("p", "# A ~b~ #\r\n## A b\n####### no\n#no\n# # c\n<A NAME='n1'> <a id=x> <a  id=\"n2\">")], "page string, text string"))
    assert sorted(r.id for r in ids.collect()) == ["a-b", "a-b-1", "c", "n1", "n2"]


def test_abandonment(spark):
    slots = spark.createDataFrame([("g", 1, "ABANDONED", None), ("g", 2, "BLOCKED", "g/1"), ("g", 3, "BLOCKED", "g/2"), ("g", 4, "BLOCKED", "g/9"), ("g", 5, "RESOLVED", "g/1")], "group_id string, slot long, state string, awaiting string")
    assert {tuple(r) for r in e.abandonment_closure(slots).collect()} == {("g/2", 1), ("g/3", 2)}


def test_canonical_json(spark):
    values = ["plain", 'q"\\', "tab\tline\n", "é ∑ 😀", "\x01", "", None]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", e.canonical_json({"b": F.col("v"), "a": F.lit("x")}).alias("j"))
    for v, j in df.collect():
        assert j == json.dumps({"a": "x", "b": v}, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def test_boolean_is_not_an_integer(spark):
    v = F.parse_json(F.lit('{"exit_code": true, "timed_out": 0}'))
    errors = spark.range(1).select(e.result_semantics(v)).first()[0]
    assert errors[:2] == ["exit_code", "timed_out"]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_cut_points_and_segments(spark, n):
    keys = spark.createDataFrame([(f"d{i % 10}/f{i}",) for i in range(1000)], "key string")
    cuts = k.cut_points(k.key_distribution(keys), n)
    assert cuts.count() == n - 1
    sizes = {r.segment: r.n for r in k.segment_balance(keys, cuts).collect()}
    assert sum(sizes.values()) == 1000 and set(sizes) <= set(range(n))


def test_segments_by_range_and_by_array_agree(spark, monkeypatch):
    keys = spark.createDataFrame([(f"k{i:04d}",) for i in range(300)], "key string")
    cuts = spark.createDataFrame([(j, f"k{i:04d}") for j, i in enumerate(range(0, 300, 37), 1)], "number long, cut string")
    one = sorted(map(tuple, k.assign_segment(keys, cuts).collect()))
    monkeypatch.setattr(k, "ARRAY_CUTS", 0)
    assert sorted(map(tuple, k.assign_segment(keys, cuts).collect())) == one


def test_links_and_headings(spark):
    pages = spark.createDataFrame([("docs/a.md", "# A b!\n## A b!\n[x](b.md#t) [y](../z.txt) [h](https://x) [s](#a-b-1)"), ("docs/b.md", '<a id="t">')], "page string, text string")
    ids = a.heading_ids(pages)
    assert {tuple(r) for r in ids.collect()} == {("docs/a.md", "a-b"), ("docs/a.md", "a-b-1"), ("docs/b.md", "t")}
    assert [tuple(r) for r in a.link_integrity(a.links(pages), pages, ids).collect()] == [("docs/a.md", "../z.txt", "missing target")]


def test_sources(spark, tmp_path):
    (tmp_path / "l.tsv").write_bytes(b"a\rb\t1\t-\t-\t-\nc\t2")
    assert [tuple(r) for r in s.read_canonical(spark, str(tmp_path / "l.tsv")).collect()] == [("a\rb", "1", "-", "-", "-", 5), ("c", "2", None, None, None, 2)]
    with pytest.raises(ValueError):
        s.read_dataset(spark, str(tmp_path))
    (tmp_path / "set").mkdir()
    (tmp_path / "set" / "_SUCCESS").write_text("")
    with pytest.raises(ValueError, match="no part"):
        s.read_dataset(spark, str(tmp_path / "set"), "key string")
    spark.range(1).selectExpr("'k' AS Key", "CAST(5 AS DECIMAL(20,0)) AS Size", "CAST(7 AS DECIMAL(20,0)) AS LastModified", "'e' AS ETag").coalesce(1).write.parquet(str(tmp_path / "epoch"))
    (tmp_path / "epoch" / "empty.parquet").write_bytes(b"")
    assert [tuple(r) for r in s.read_epoch_parquet(spark, str(tmp_path / "epoch")).collect()] == [("k", 5, 7, "e")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty.parquet").write_bytes(b"")
    assert s.read_epoch_parquet(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "none" / "bad.parquet").write_bytes(b"\n")
    with pytest.raises(ValueError, match="not readable"):
        s.read_epoch_parquet(spark, str(tmp_path / "none"))
    good = next((tmp_path / "epoch").glob("part-*.parquet")).read_bytes()
    for name, content in (("z late.parquet", good[:-9]), ("y.parquet", b"PAR1 and more PAR1")):  # beside good files, and later than they
        (tmp_path / "epoch" / name).write_bytes(content)
        with pytest.raises(ValueError, match=name):
            s.read_epoch_parquet(spark, str(tmp_path / "epoch"))
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "result.json").write_text('{"n": 1}')
    row = s.read_evidence(spark, str(tmp_path)).first()
    assert row.prefix.endswith("/run") and row.sha256 == hashlib.sha256(b'{"n": 1}').hexdigest()
    assert s.artifact_inventory(spark, str(tmp_path)).filter("path = 'run/result.json'").first()["size"] == 8
    (tmp_path / "run.meta").write_text("a=1\nb=x=y\na=2\nnone")
    assert s.read_receipts(spark, str(tmp_path / "run.meta")).first()["kv"] == {"a": "1", "b": "x=y"}


def _slots_and_attempts(spark):
    spec = {c: "x" for c in e.PRODUCER_SPEC}
    producer = lambda **kw: json.dumps(spec | kw)
    slots = [
        ("g", 1, producer(), None, '{"a1":"gone","a2":"gone","a3":"gone"}', "BLOCKED"), ("g", 2, producer(), None, '{"a1":"gone"}', "BLOCKED"), ("g", 3, None, "b1", None, "BLOCKED"), ("g", 4, None, "b1", '{"b1":"gone"}', "BLOCKED"),
        ("g", 5, producer(tool="none"), None, None, "BLOCKED"), ("h", 1, producer(), None, None, "BLOCKED"), ("g", 6, producer(), None, '{"a1":"gone","a2":"gone"}', "BLOCKED"), ("g", 6, None, "b1", '{"a1":"gone","a3":"gone","b1":"gone"}', "BLOCKED"), ("g", 7, producer(), None, None, "RESOLVED"),
    ]
    attempts = [("g", f"a{i}", "SUCCEEDED", str(9 - i) if i < 3 else None, *spec.values()) for i in (1, 2, 3)] + [("g", "b1", "SUCCEEDED", "1", *(spec | {"tool": "y"}).values()), ("h", "c1", "CANCELLED", "1", *spec.values())]
    slots = e.load_pending(spark.createDataFrame(slots, "group_id string, slot long, producer string, awaiting string, disqualified string, state string").withColumns({"tool": F.lit("x"), "purpose": F.lit("m")}))
    return slots, spark.createDataFrame(attempts, f"group_id string, attempt_id string, state string, settled_at string, {', '.join(f'{c} string' for c in e.PRODUCER_SPEC)}")


def test_candidates_are_placed_once_for_all_slots_of_a_spec(spark, monkeypatch):
    """Slots meet blocks of places; only slots that are there twice have their candidates placed by slot."""
    monkeypatch.setattr(e, "_PLACES", 2)
    slots, attempts = _slots_and_attempts(spark)
    out = e.slot_candidates(slots, attempts)
    got = {}
    for r in out.collect():
        got.setdefault((r.group_id, r.slot), []).append((r.place, r.attempt_id))
    three = [(1, "a3"), (2, "a2"), (3, "a1")]
    assert {k: sorted(v) for k, v in got.items()} == {("g", 1): three, ("g", 2): three, ("g", 7): three, ("g", 3): [(1, "b1")], ("g", 4): [(1, "b1")], ("h", 1): [(1, "c1")], ("g", 6): [(1, "a3"), (2, "b1"), (3, "a2"), (4, "a1")]}
    assert "_block" in out._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_made_by_numbers_of_specs(spark):
    """The join that makes the pairs looks at a spec's number and hashes one block of places; a slot with a NULL in its spec has no candidate."""
    slots, attempts = _slots_and_attempts(spark)
    lost = slots.filter("group_id = 'g' and slot = 1").withColumns({"slot": F.lit(8).cast("long"), "producer": F.lit('{"tool":"x"}')})
    out = e.slot_candidates(slots.unionByName(lost), attempts)
    assert "ShuffledHashJoin [spec" in out._jdf.queryExecution().executedPlan().toString()
    assert out.filter("slot = 8").count() == 0 and out.count() == 16


def test_ordinals_are_counted_over_narrow_rows(spark):
    from keyscape.plans.evidence_plans import _attempts

    plan = _attempts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" in plan and "md5" not in plan[plan.index("row_number") :]


def test_owed_reasons_of_disqualified_candidates(spark):
    slots, attempts = _slots_and_attempts(spark)
    settled, none = "every candidate is settled and none published a usable artifact", "no attempt in this group produces what it consumes"
    # each of slot 6's candidates but a1 is good for one of its rows
    assert {(r.group_id, r.slot): r.reason for r in e.owed_reason(slots, attempts).collect()} == {("g", 1): settled, ("g", 4): settled, ("g", 5): none, ("h", 1): settled}
    assert "_block" not in (plan := e.owed_reason(slots, attempts)._jdf.queryExecution().optimizedPlan().toString()) and "row_number" not in plan


def test_evidence_is_decoded_once_for_all_rules(spark):
    df = spark.createDataFrame([('{"exit_code":0,"execution":{"timed_out":false}}',)], "t string").repartition(1).select(F.try_parse_json("t").alias("v"))
    plan = e.checkpoint(df).select(e.result_semantics(F.col("v")).alias("errors"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get(v#") == 1


def test_booleans_and_their_texts_stay_apart(spark):
    rows = [('{"timed_out":"false","exit_code":0}',), ('{"timed_out":false,"exit_code":0}',), ('{"timed_out":null,"exit_code":0}',), ('{"timed_out":0,"exit_code":0}',), ("[]",), ('"x"',), ("null",)]
    df = spark.createDataFrame(rows, "t string").select("t", e.failed_subject(F.try_parse_json("t")).alias("why"))
    assert {r["t"]: r["why"] for r in df.collect()} == {t: "no execution evidence" if t == rows[1][0] else "subject timed out" for (t,) in rows}
