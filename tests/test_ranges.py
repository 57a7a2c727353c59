"""Operators that number ranges: the same result however the ranges are drawn and coalesced."""

import pytest

from keyscape.operators import keyspace as k


@pytest.fixture
def small_ranges(spark):
    new = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.execution.rangeExchange.sampleSizePerPartition": "2", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    old = {c: spark.conf.get(c, None) for c in new}
    for c, v in new.items():
        spark.conf.set(c, v)
    yield
    for c, v in old.items():
        spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def keys(spark, n=20_000):
    return spark.range(n).selectExpr("format_string('%06d', (id * 7919) % 20000) as key", "sha2(cast(id as string), 512) as wide", "id as size")


def test_segments_by_range_on_many_partitions(spark, small_ranges, monkeypatch):
    monkeypatch.setattr(k, "ARRAY_CUTS", 1)
    cuts = spark.range(0, 20_000, 37).selectExpr("format_string('%06d', id) as cut")
    out = k.assign_segment(keys(spark), cuts).collect()
    assert len(out) == 20_000 and all(r.segment == int(r.key) // 37 + 1 for r in out)
    assert sum(r.n for r in k.segment_balance(keys(spark), cuts).collect()) == 20_000


def test_global_rank_of_wide_rows(spark, small_ranges):
    out = k.global_rank(keys(spark), "key").collect()
    assert len(out) == 20_000 and all(r["rank"] == int(r.key) + 1 for r in out)


def test_segments_of_one_hot_key(spark, small_ranges, monkeypatch):
    monkeypatch.setattr(k, "ARRAY_CUTS", 1)
    df = spark.range(6_000).selectExpr("if(id % 2 = 0, 'm', format_string('%05d', id)) as key", "id")
    cuts = spark.createDataFrame([("00010",), ("m",), ("m",), ("z",)], "cut string")
    out = k.assign_segment(df, cuts).groupBy("key", "segment").count().collect()
    assert sum(r["count"] for r in out) == 6_000 and {r.segment for r in out if r.key == "m"} == {3}
    assert all(r.segment == (r.key >= "00010") for r in out if r.key != "m")


def test_yaml_items_are_counted_as_they_are_read(spark):
    import random

    from pyspark.sql import functions as F

    from keyscape.operators import normalize as n

    words = ["- Contents:", "Contents:", "  Contents:", "  Prefix: null", "---", "- Contents: []", "  - Key: a", "    Size: 1", "  - ETag: 'e'", "    - Key: b", "", "  Key:", None, "  note"]
    draw = random.Random(5)
    rows = [(f, k, draw.choice(words)) for f, size in [("a", 3000), ("b", 33), ("c", 64), (None, 90), *[(f"s{i}", i % 40) for i in range(120)]] for k in range(size)]
    rows += [("far", (1 << 20) * k + j, draw.choice(words[k % 5:])) for k in range(4) for j in range(40)]
    rows += [("late", k, "    Size: 1" if k % 70 else "  - Key: a") for k in range(400)] + [("head", k, w) for k, w in enumerate(["- Contents:", *["    Size: 1"] * 70, "  - Key: a"])]
    rows += [("below", k - 50, draw.choice(words)) for k in range(100)]
    df = spark.createDataFrame(rows, "file string, line_no long, value string").repartition(3)
    for part in (df, df.filter("file = 'head'"), df.filter("file = 'late'"), df.limit(0), *[df.filter(F.col("file") == f"s{i}") for i in (1, 7, 39)]):
        assert n.count_native(part, "yaml_pages").first()["count"] == n.normalize(part, "yaml_pages").count()
    assert n.count_native(df.filter("file = 'head'"), "yaml_pages").first()["count"] == 2  # the first begins at a line that isn't marked


def test_a_count_prints_each_line_once(spark):
    """Filters were pushed below what makes a line, which was then made once for each place that names it."""
    from pyspark.sql import functions as F

    from keyscape.operators.normalize import count_native

    made = spark.range(10).select(F.concat(F.lit("2020-01-02 03:04:05         12  s3://bucket/k"), F.md5(F.col("id").cast("string"))).alias("value"))
    for fmt in ("url_lines", "aligned", "table", "ls_level"):
        assert count_native(made, fmt)._jdf.queryExecution().optimizedPlan().toString().count("md5") == 1


def test_yaml_lines_are_not_shuffled_behind_their_files():
    """n6: rows of lineitem are dealt out by file, narrow, once; lines, windows and items follow where they lie, and a count of lines makes no page."""
    from pyspark.sql import SparkSession

    from keyscape.plans.normalize_plans import QUERIES, raw

    spark, d = SparkSession.getActiveSession(), "/root/testdata/sf0.001"
    plan = QUERIES["n6_yaml_pages"](spark, d)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "md5" not in plan[plan.index("Exchange ") :]
    assert "md5" not in raw(spark, d, "yaml_pages").groupBy("file").count()._jdf.queryExecution().optimizedPlan().toString()


def test_yaml_fields_with_odd_blanks_and_quotes(spark):
    from keyscape.operators import normalize as n

    lines = ["- Contents:", "  - \tKey: 'a'b'  ", "\t  Size:7\r", "    ETag: \"", "    LastModified: 'x\"", "  - StorageClass: ''", "    Key: a\rb: c", "  - Other: x", None, "    Key", "    Keys: z", "- Contents:", "    Key: d"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, value string")
    want = [("'a'b'"[1:-1], "7", '"', "'x\"", None), ("a\rb: c", None, None, None, ""), ("d", None, None, None, None)]
    names = ("Key", "Size", "ETag", "LastModified", "StorageClass")
    for partitions in (None, 3):
        out = n._yaml_pages(df, partitions).orderBy("item").collect()
        assert [tuple(r[c] for c in names) for r in out] == want


def test_formats_are_counted_together(spark):
    """n34: lines of several formats are made from one listing, and each count is that of the format by itself."""
    from keyscape.operators import normalize as n
    from keyscape.plans import normalize_plans as p

    d, some = "/root/testdata/sf0.001", ["tsv6", "found_json", "found", "totals", "path_size"]
    made = p.with_order(spark, d).selectExpr(f"inline(array({', '.join(f'struct({i} as n, {p._line(f)} as value)' for i, f in enumerate(some))}))")
    out = n.count_lines(made, some)
    assert {r["format"]: r["count"] for r in out.collect()} == {f: n.count_native(p.raw(spark, d, f), f).first()["count"] for f in some}
    assert {r["count"] for r in n.count_lines(made.limit(0), some).collect()} == {0}
    plan = p.QUERIES["n34_count_native"](spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] parquet") == 11 and not n.counted_together("yaml_pages") and not n.counted_together("url_json")
