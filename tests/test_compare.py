"""Differences and verdicts of small listings."""

import pytest
from pyspark.sql import functions as F

from keyscape.functions.listing import LISTING
from keyscape.operators import compare as c
from keyscape.operators import gates as g

T1, T2 = "2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z"


def listing(spark, *rows):
    return spark.createDataFrame(list(rows), LISTING)


CASES = {
    "both empty": ([], [], "PASS"),
    "reference repeats a key": ([("k", "1", "e", T1, "S")] * 2, [("k", "1", "e", T1, "S")], "FAIL"),
    "etag unexposed": ([("k", "1", None, T1, "S")], [("k", "1", "e", T1, "S")], "PASS"),
    "etag case": ([("k", "1", "ABC", T1, "S")], [("k", "1", "abc", T1, "S")], "PASS"),
    "time alone": ([("k", "1", "e", T1, "S")], [("k", "1", "e", T2, "S")], "DRIFT"),
    "size": ([("k", "1", "e", T1, "S")], [("k", "2", "e", T1, "S")], "FAIL"),
    "leading zero": ([("k", "7", "e", T1, "S")], [("k", "007", "e", T1, "S")], "FAIL"),
    "key dash": ([("-", "1", "e", T1, "S")], [("-", "1", "e", T1, "S")], "PASS"),
    "missing and extra": ([("a", "1", "e", T1, "S"), ("b", "1", "e", T1, "S")], [("b", "1", "e", T1, "S"), ("c", "1", "e", T1, "S")], "FAIL"),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_verdict(spark, name):
    ref, act, verdict = CASES[name]
    diff = c.listing_diff(listing(spark, *ref), listing(spark, *act))
    assert c.pair_verdict(diff).first()["verdict"] == verdict


def test_diff_is_its_mirror(spark):
    a = listing(spark, ("a", "1", None, None, None), ("b", "1", None, None, None), ("b", "1", None, None, None))
    b = listing(spark, ("b", "2", None, None, None), ("c", "1", None, None, None))
    one, two = c.listing_diff(a, b).collect(), c.listing_diff(b, a).collect()
    assert sorted(r.key for r in one if r.kind == "missing") == sorted(r.key for r in two if r.kind == "extra") == ["a"]
    assert sum(r.kind == "mismatch" for r in one) == 2 and sum(r.kind == "mismatch" for r in two) == 1
    assert c.pair_verdict(c.listing_diff(a.distinct(), a.distinct())).first()["verdict"] == "PASS"


def test_same_as_by_joins(spark):
    a = listing(spark, *[(f"k{i % 7}", str(i % 3), None, T1, None) for i in range(20)])
    b = listing(spark, *[(f"k{i % 5 + 3}", str(i % 2), None, T2, None) for i in range(9)])
    diff = c.listing_diff(a, b)
    assert diff.filter("kind = 'missing'").count() == c.missing_keys(a, b).count()
    assert diff.filter("kind = 'extra'").count() == c.extra_keys(a, b).count()
    assert diff.filter("kind = 'duplicate'").count() == c.duplicate_keys(b).count()
    assert sorted(map(tuple, diff.filter("kind = 'mismatch'").drop("kind").collect())) == sorted(map(tuple, c.field_mismatches(a, b).collect()))


def test_group_verdict(spark):
    slots = spark.createDataFrame([("resolved",)], "state string")
    b = spark.createDataFrame([("b0", "PASS"), ("b1", "DRIFT")], "bucket string, verdict string")
    assert tuple(c.group_verdict(b, slots).first()) == (2, 0, "DRIFT", 2)
    assert c.group_verdict(b.limit(0), slots).first()["verdict"] == "INCOMPLETE"
    assert c.group_verdict(b, slots.selectExpr("'blocked' AS state")).first()["exit_code"] == 9


def test_gates(spark):
    good = ("k", "1", "e", "2020-01-02T03:04:05+0000", "S")
    assert g.validate(listing(spark, good))[0].count() == 1
    for i, bad in ((0, "a\tb"), (0, ""), (1, "1a"), (1, "12\n"), (2, 'a"'), (2, "a b"), (3, "2020-01-02 03:04:05"), (4, "a b")):
        row = list(good)
        row[i] = bad
        with pytest.raises(ValueError):
            g.validate(listing(spark, tuple(row)))
        assert g.validate(listing(spark, tuple(row)), "split")[1].count() == 1
    assert g.fold_unexposed(listing(spark, ("-", "-", "-", "-", "-"))).first()[:] == ("-", None, None, None, None)
    assert g.null_gate(listing(spark, good, ("k", "", "e", "m", "s"))).first()["bad"] == 1


def test_a_key_of_many_rows_stays_rows(spark, monkeypatch):
    """Counts of a repeated key are dealt over small arrays, and keys that differ are joined without a broadcast too."""
    monkeypatch.setattr(c, "_REPEATS", 7)
    ref = spark.range(100).select(F.lit("hot").alias("key"), F.col("id").cast("string").alias("size"), *[F.lit(None).cast("string").alias(x) for x in ("etag", "mtime", "storage_class")])
    act = ref.filter("size = '5'").withColumn("etag", F.lit("e"))
    other = ref.withColumn("key", F.lit("gone"))
    for bound in (0, 1000):
        monkeypatch.setattr(c, "BROADCAST_KEYS", bound)
        got = c.listing_diff(ref.unionByName(other), act.unionByName(ref.withColumn("key", F.lit("new")))).groupBy("kind", "key", "field").count().collect()
        assert {tuple(r) for r in got} == {
            ("mismatch", "hot", "size", 99), ("reference_duplicate", "hot", None, 1), ("missing", "gone", None, 100), ("reference_duplicate", "gone", None, 1), ("extra", "new", None, 100), ("duplicate", "new", None, 1),
        }


def test_rows_that_may_differ(spark):
    """Of the rows beyond a broadcast of keys only those that may differ are shuffled: every one that does, and few others."""
    rows = spark.range(20_000).select(F.lit("g").alias("g"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), "id")
    odd = rows.filter("id % 200 = 7")
    got = {r.id for r in c._may_differ(rows, odd, 100, ["g", "key"]).collect()}
    assert {i for i in range(20_000) if i % 200 == 7} <= got and len(got) < 1_000


def test_two_listings_are_shuffled_as_rows_with_hashes(spark, monkeypatch):
    plans, checkpoint = [], c.checkpoint
    monkeypatch.setattr(c, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or checkpoint(df))
    schema = "key string, size string, etag string, mtime string, storage_class string"
    ref = spark.createDataFrame([("a", "1", "AB", "t", None), ("b", "1", "e", "t", "S"), ("b", "1", "e", "t", "S"), ("c", "1", None, None, None)], schema)
    act = spark.createDataFrame([("a", "1", "ab", "t", "S"), ("b", "2", None, "u", "S"), ("d", None, None, None, None), ("d", None, None, None, None)], schema)
    found = sorted((r.kind, r.key, r.field or "") for r in c.listing_diff(ref, act).collect())
    assert found == [("duplicate", "d", ""), ("extra", "d", ""), ("extra", "d", ""), *[("mismatch", "b", f) for f in ("mtime", "mtime", "size", "size")], ("missing", "c", ""), ("reference_duplicate", "b", "")]
    assert "HashAggregate" not in plans[0][plans[0].index("Exchange") :]


def test_both_ways_from_one_comparison(spark):
    """Each row of two listings is made once, and the rows of keys that differ hold the diff of either way."""
    import random

    draw, made = random.Random(7), spark.sparkContext.accumulator(0)
    some = lambda *xs: draw.choice(xs)
    sides = [[(f"p{draw.randrange(2)}", k, f"k{draw.randrange(60)}", some("1", "1", "2", None), some("a", "A", "b", None), some("T1", "T1", "T2"), some("S", None)) for _ in range(120)] for k in (0, 1)]
    sides[1] += [(p, 1, *rest) for p, _, *rest in sides[0]] + [("only", 1, "k1", "1", None, None, None)]
    sides[0] += [("alike", 0, "k1", "1", "E", None, "S"), ("few", 0, "k2", "1", "E", None, "S")]
    sides[1] += [("alike", 1, "k1", "1", "e", "T", "S"), ("few", 1, "k2", None, None, None, None)]
    rows = spark.createDataFrame(sides[0] + sides[1], "pair string, side int, key string, size string, etag string, mtime string, storage_class string")
    again = F.udf(lambda x: (made.add(1), x)[1], "string").asNondeterministic()
    odd = c.differing(rows.withColumn("key", again("key")))
    assert made.value == rows.count()
    assert {r.pair for r in odd.select("pair").distinct().collect()} == {"p0", "p1", "only"}

    def plain(pair: str, way: int) -> list:
        out, ref, act = [], {}, {}
        for p, side, key, *values in sides[0] + sides[1]:
            if p == pair:
                (ref if side == way else act).setdefault(key, []).append(values)
        for key in {*ref, *act}:
            r, a = ref.get(key, []), act.get(key, [])
            out += [(pair, "missing", key, None, None, None) for _ in r if not a] + [(pair, "extra", key, None, None, None) for _ in a if not r]
            out += [(pair, "duplicate", key, None, None, None)] * (len(a) > 1) + [(pair, "reference_duplicate", key, None, None, None)] * (len(r) > 1)
            first = min(a, key=lambda v: [(x is not None, x or "") for x in v], default=None)
            fold = lambda f, x: x.lower() if f == "etag" else x
            out += [(pair, "mismatch", key, f, t, x) for v in r if first for f, t, x in zip(("size", "etag", "mtime", "storage_class"), first, v) if None not in (t, x) and fold(f, t) != fold(f, x)]
        return out

    order = lambda found: sorted(map(str, found))
    for way, kept in ((0, odd), (1, c.mirrored(odd))):
        found = c.diff_differing(kept).select("pair", "kind", "key", "field", "tool_value", "reference_value").collect()
        assert order(map(tuple, found)) == order(x for p in ("p0", "p1", "only", "alike", "few") for x in plain(p, way))
