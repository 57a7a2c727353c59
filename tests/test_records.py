"""Verify records, many members at once, states that run from range to range, and walks by doubling."""

import json
import random

import pytest
from pyspark.sql import functions as F

from keyscape.functions.listing import LISTING
from keyscape.operators import audits as a
from keyscape.operators import compare as c
from keyscape.operators import evidence as e
from keyscape.operators import keyspace as k
from keyscape.operators import normalize as n
from keyscape.sources import listings as s
from keyscape.sources import records as r


def diff(spark, *rows):
    return spark.createDataFrame(list(rows), "attempt_id string, kind string, key string, field string, tool_value string, reference_value string")


def attempts(spark, *names):
    return spark.createDataFrame([(x,) for x in names], "attempt_id string")


def test_records_are_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "verify")
    assert r.read_verify(spark, path)[0].isEmpty()
    r.write_verify(diff(spark, ("a1", "missing", "k", None, None, None), ("a2", "mismatch", "k", "size", "1", "2"), ("a2", "extra", "x", None, None, None)), attempts(spark, "a1", "a2"), path)
    records, rows = r.read_verify(spark, path)
    assert {x.attempt_id: x.verdict for x in records.collect()} == {"a1": "FAIL", "a2": "FAIL"} and rows.count() == 3
    r.write_verify(diff(spark), attempts(spark, "a2"), path)  # clean at last
    records, rows = r.read_verify(spark, path)
    assert {x.attempt_id: x.verdict for x in records.collect()} == {"a1": "FAIL", "a2": "PASS"} and [x.attempt_id for x in rows.collect()] == ["a1"]
    r.write_verify(diff(spark, ("a3", "mismatch", "k", "mtime", "1", "2")), attempts(spark, "a3", "a2"), path)
    before = sorted(map(str, r.read_verify(spark, path)[0].collect()))
    r.vacuum_verify(spark, path)
    records, rows = r.read_verify(spark, path)
    assert sorted(map(str, records.collect())) == before and rows.count() == 2 and len(r._commits(spark, path)) == 1
    assert {x.attempt_id: x.verdict for x in records.collect()} == {"a1": "FAIL", "a2": "PASS", "a3": "DRIFT"}


def test_a_write_that_is_not_committed_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "verify")
    r.write_verify(diff(spark), attempts(spark, "a1"), path)
    r._RECORD and diff(spark, ("a1", "missing", "k", None, None, None)).write.parquet(f"{path}/diff/generation=lost")
    assert r.read_verify(spark, path)[1].isEmpty()
    with pytest.raises(ValueError):
        r.write_verify(diff(spark, ("a9", "missing", "k", None, None, None)), attempts(spark, "a1"), path)
    assert [x.verdict for x in r.read_verify(spark, path)[0].collect()] == ["PASS"]


def test_digest_ignores_order_and_tells_rows_apart(spark):
    one = diff(spark, ("a", "missing", "k", None, None, None), ("a", "missing", "k", None, None, None), ("a", "extra", "k", None, None, None))
    seen = [r._digest(x).first()["digest"] for x in (one, one.orderBy("kind"), one.distinct(), one.withColumn("key", F.lit("l")))]
    assert seen[0] == seen[1] and len(set(seen)) == 3


@pytest.mark.parametrize("bound", [0, 1000])
def test_many_members_as_by_pairs(spark, monkeypatch, bound):
    monkeypatch.setattr(c, "BROADCAST_KEYS", bound)
    rng = random.Random(3)
    rows, members = [], 70
    for m in range(members):
        for key in range(25):
            for _ in range(rng.choice((0, 1, 1, 1, 1, 1, 2)) if m % 9 else 1):
                rows.append((f"a{m:02}", f"k{key:02}", str(rng.choice((1, 1, 1, 2))) if m % 7 == 1 else "1", rng.choice(("e", "E", None)), "t" if m % 11 else rng.choice(("t", "u")), None))
    listings = spark.createDataFrame(rows, "attempt_id string, key string, size string, etag string, mtime string, storage_class string").cache()
    subjects = attempts(spark, *[f"a{m:02}" for m in range(members)], "b0", "b1", "c0").withColumn("bucket", F.left("attempt_id", F.lit(1))).withColumn("stratum", F.lit("s"))
    rows = {}
    for x in c.compare_all(listings, subjects).collect():
        rows.setdefault(x.pair, []).append(tuple(x)[1:])
    own = lambda m: listings.filter(F.col("attempt_id") == m).select(*LISTING.names)
    for m in (1, 9, 63, 64, 69):
        assert sorted(map(str, rows.get(f"a{m:02}", []))) == sorted(str(tuple(x)) for x in c.listing_diff(own("a00"), own(f"a{m:02}")).collect())
    assert "a00" not in rows and "c0" not in rows and "b1" not in rows


def test_a_member_without_rows_lacks_all(spark):
    listings = spark.createDataFrame([("a0", "k", "1"), ("a0", "k", "1"), ("a2", "k", "1")], "attempt_id string, key string, size string").withColumns({x: F.lit(None).cast("string") for x in ("etag", "mtime", "storage_class")})
    subjects = attempts(spark, "a0", "a1", "a2").withColumns({"bucket": F.lit(None).cast("string"), "stratum": F.lit("s")})
    got = sorted((x.pair, x.kind) for x in c.compare_all(listings, subjects).collect())
    assert got == [("a1", "missing"), ("a1", "missing"), ("a1", "reference_duplicate"), ("a2", "reference_duplicate")]


def test_each_row_is_shuffled_once_for_all_members(spark):
    """The rows of a listing take part in one exchange, by group and key, before the keys that differ are known."""
    rows = spark.createDataFrame([("g", 0, 2, "k", "1", None, None, None)], "g string, m int, members int, key string, size string, etag string, mtime string, storage_class string")
    plan = rows.groupBy("g", "key").agg(F.bit_or("m"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(g") == 1


LINES = """- Contents:
  - ETag: '"e1"'
    Key: a
    Size: 1
  - Key: b: c
    LastModified: '2020-01-02T03:04:05.123+00:00'
  RequestCharged: null
---
- CommonPrefixes:
  - Prefix: p/
  Contents:
  - Key: 'd'
    StorageClass: S
  - Key: e
---
- Contents: []
  Name: x
  - Key: not one""".split("\n")


@pytest.mark.parametrize("parts", [1, 2, 5, 60])
def test_pages_cut_at_any_line(spark, parts):
    df = spark.createDataFrame([(f, i, v) for f in ("f", "g") for i, v in enumerate(LINES)], "file string, line_no int, value string")
    got = sorted((x.file, x.Key, x.Size, x.StorageClass) for x in n._yaml_pages(df, partitions=parts).collect())
    assert got == sorted((f, *x) for f in ("f", "g") for x in (("a", "1", None), ("b: c", None, None), ("d", None, "S"), ("e", None, None)))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_sortedness_cut_at_any_line(spark, parts):
    keys = ["b", "a", "a", "é", "z", None, "c", "b", "\U0001F600", "￿"]
    rows = [(f, i * 10, x) for f in ("f", None) for i, x in enumerate(keys)]
    got = sorted((str(x.file), x.line_no, x.key, x.before) for x in k.sortedness(spark.createDataFrame(rows, "file string, line_no int, key string"), partitions=parts).collect())
    assert got == sorted((str(f), i * 10, x, keys[i - 1]) for f in ("f", None) for i, x in enumerate(keys) if i and x is not None and keys[i - 1] is not None and x.encode() < keys[i - 1].encode())


def test_one_hot_key_is_split_and_ranked(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1000, "hot").otherwise(F.format_string("k%05d", "id")).alias("key"))
    out = k.global_rank(df, "key", partitions=12)
    assert sorted(x["rank"] for x in out.collect()) == list(range(1, 3001))
    assert [x["rank"] for x in out.filter("key = 'hot'").orderBy("rank").collect()] == list(range(1, 1001))
    from keyscape.operators.ranges import ranged

    assert ranged(df.filter("key = 'hot'"), "key", partitions=8, salted=True).select("_range").distinct().count() > 4


def test_long_chains_and_cycles(spark):
    size = 20_000
    ring = spark.range(size).selectExpr("concat('r', id) AS attempt_id", f"concat('r', (id + 1) % {size}) AS produced_by", "1.0D AS wall_seconds")
    tail = spark.range(5).selectExpr("concat('t', id) AS attempt_id", "if(id = 0, 'r7', concat('t', id - 1)) AS produced_by", "0.5D AS wall_seconds")
    short = spark.createDataFrame([("s", "s", 2.0), ("u", "v", 1.0), ("v", "u", None), ("w", "gone", 1.0), ("x", "w", 1.0)], "attempt_id string, produced_by string, wall_seconds double")
    got = {x.attempt_id: (x.links, x.prep_seconds) for x in e.preparation_cost(ring.unionByName(tail).unionByName(short)).collect()}
    assert got["r0"] == got["r123"] == (size, float(size)) and got["t0"] == (size, float(size)) and got["t4"] == (size + 4, size + 2.0)
    assert got["s"] == (1, 2.0) and got["u"][1] is None and got["w"] == (0, None) and got["x"] == (1, None)


def test_long_waits(spark):
    size = 20_000
    row = spark.range(1, size).selectExpr("'g' AS group_id", "id AS slot", "'BLOCKED' AS state", "concat('g/', id - 1) AS awaiting")
    more = spark.createDataFrame([("g", 0, "ABANDONED", None), ("h", 1, "BLOCKED", "h/2"), ("h", 2, "BLOCKED", "h/1"), ("h", 3, "BLOCKED", "h/9"), ("h", 4, "BLOCKED", None)], "group_id string, slot long, state string, awaiting string")
    got = e.abandonment_closure(row.unionByName(more)).collect()
    assert len(got) == size - 1 and all(x.slot_id == f"g/{x.rounds}" for x in got)
    assert e.abandonment_closure(more.filter("group_id = 'h'")).isEmpty()


def _value(rng, depth=0):
    kind = rng.randrange(10 if depth < 3 else 7)
    if kind == 0:
        return rng.choice([True, False, None])
    if kind == 1:
        return rng.randrange(-(10 ** rng.randrange(1, 25)), 10**25)
    if kind == 2:
        return rng.choice([0.0, -0.0, 1.0, 1e16, 1e17, 1e-4, 1e-5, 5e-324, 1.7e308, 12345678.25, 1e7, 1e22, 2.0, -6.88574351671531e18])
    if kind < 7:
        return "".join(rng.choice(["a", "é", "\x01", "S", "N1", "\U0001F600", "\x1f", "\x0b", "\\", '"', "/", "\n", "\x7f", "1.5", "\\u001F", " "]) for _ in range(rng.randrange(6)))
    if kind < 9:
        return {rng.choice("abABé") + str(rng.randrange(20)): _value(rng, depth + 1) for _ in range(rng.randrange(5))}
    return [_value(rng, depth + 1) for _ in range(rng.randrange(5))]


def test_canonical_json_as_python_writes_it(spark):
    rng = random.Random(1)
    texts = [json.dumps({"r": _value(rng), "q": _value(rng)}, ensure_ascii=rng.random() < 0.5, indent=rng.choice((None, 1))) for _ in range(150)] + ['{"a":-0,"b":1E5,"c":1.50e+3}', "[]", "1.0", '"x"']
    want = [json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=True) for t in texts]
    bad = ['{"a":NaN}', '{"a":1,"a":2}', "[1,", '{"a":1e999}', "", None]
    df = spark.createDataFrame(list(enumerate([*texts, *bad])), "i int, t string").repartition(4)
    assert [x.c for x in df.select("i", e.canonical(F.col("t")).alias("c")).orderBy("i").collect()] == want + [None] * len(bad)


def test_fingerprint_of_nested_documents(spark):
    import hashlib

    df = spark.createDataFrame([("t", '{"b": [1, {"z": 1.0, "a": null}]}', "x", None)], "tool string, config string, note string, other string").withColumn("environment", F.struct(F.lit(4).alias("vcpus"), F.lit(None).cast("string").alias("role")))
    document = {"config": {"b": [1, {"z": 1.0, "a": None}]}, "environment": {"vcpus": 4, "role": None}, "note": "x", "other": None}
    text = json.dumps(document, sort_keys=True, separators=(",", ":"))
    got = e.case_fingerprint(df, ["note", "other", "config", "environment"], "tag\0", nested=("config", "environment")).first()["case_id"]
    assert got == "t." + hashlib.sha256(b"tag\0" + text.encode()).hexdigest()[:12]


def test_links_to_folders(spark):
    pages = spark.createDataFrame([("docs/p.md",), ("tools/a/README.md",)], "page string")
    found = spark.createDataFrame([("docs/p.md", x) for x in ("../tools/a", "../tools/a/#use", "../tools/a#no", "../tools", "../tools#x", "..", "../b", "#here")], "page string, target string")
    ids = spark.createDataFrame([("tools/a/README.md", "use"), ("docs/p.md", "here")], "page string, id string")
    got = {(x.target, x.problem) for x in a.link_integrity(found, pages, ids).collect()}
    assert got == {("../tools/a#no", "missing fragment"), ("../tools#x", "fragment target is not Markdown"), ("../b", "missing target")}


def test_escapes(spark):
    keys = {"a%zzb": None, "%": None, "%4": None, "%FF": None, "a%2Fb": "a/b", "+": "+", "%EF%BF%BD": "�", "%25zz": "%zz", "é": "é", "": ""}
    df = spark.createDataFrame([(x,) for x in [*keys, None]], "key string")
    assert {x.key for x in k.malformed_escapes(df).collect()} == {x for x, y in keys.items() if y is None}
    assert sorted(map(str, (x.key for x in k.decode_keys(df).collect()))) == sorted(map(str, [x if y is None else y for x, y in keys.items()] + [None]))


def test_report_cells(spark):
    df = spark.createDataFrame([("b|1", "a1", "x|y\r\nz"), (None, "a0", None)], "bucket string, attempt_id string, state string")
    assert sorted(x.line for x in s.report_table(df, ["attempt_id", "state"]).collect()) == ["| a0 | - |", "| a1 | x\\|y z |"]
    lines = s.report_sections(df, ["attempt_id", "state"], blocked=spark.createDataFrame([("s1",)], "note string")).orderBy("section", "part", "at").collect()
    assert [x.line for x in lines][:2] == ["> **Blocked slot**: s1 -- this group is incomplete.", "## -"] and len(lines) == 11


def test_registered_counts_and_modes(spark):
    df = spark.createDataFrame([("a/b/c",), ("a/d",), ("e",)], "key string")
    reg = spark.createDataFrame([("a/", 2), ("a/b/", 2), ("", 3), ("zz/", 0), ("a/", None)], "prefix string, keys long")
    got = sorted((x.prefix, x.found, x.agrees) for x in k.scope_counts(df, reg).collect())
    assert got == [("", 3, True), ("a/", 2, False), ("a/", 2, True), ("a/b/", 1, False), ("zz/", 0, True)]
    cases = spark.createDataFrame([("t", "m"), ("t", "x"), ("u", "m"), ("t", "x")], "tool string, mode string")
    assert sorted(map(tuple, e.mode_coverage(cases, cases.limit(1)).collect())) == [("t", "x", "no such mode"), ("u", "m", "modes unknown")]


def test_yaml_files_are_moved_once_unless_they_are_long(spark, monkeypatch):
    lines = ["- Contents:", "  - Key: a", "    Size: 1", "  - Key: 'b: c'", "  RequestCharged: null", "---", "- CommonPrefixes:", "  - Prefix: p/", "- Contents:", "  - Key: d", "    Size: 2"]
    df = spark.createDataFrame([(f, k, x) for f in ("x", "y", None) for k, x in enumerate(lines[: 5 if f == "y" else None])], "file string, line_no int, value string")
    read = lambda: sorted((str(x.file), x.Key, x.Size) for x in n._yaml_pages(df).collect())
    of = lambda f: [(f, "a", "1"), (f, "b: c", None)] + [(f, "d", "2")] * (f != "y")
    assert read() == sorted(of("x") + of("y") + of("None"))
    assert n._yaml_pages(df)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(n, "LONG_FILE", 6)
    assert read() == sorted(of("x") + of("y") + of("None"))
