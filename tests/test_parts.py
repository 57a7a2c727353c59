"""Files of any size: JSON arrays cut by many tasks, digests of streams."""

import hashlib
import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from keyscape.sources import json_parts
from keyscape.sources import listings as s


@pytest.fixture
def small_ranges(spark):
    """Ranges of 300 bytes."""
    new = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "20"}
    for c, v in new.items():
        spark.conf.set(c, v)
    yield
    for c in new:
        spark.conf.unset(c)


def element(rng):
    text = "".join(rng.choice(['"', "\\", ",", "[", "]", "{", "}", "é", "x", "\n", "\U0001F600", " "]) for _ in range(rng.randrange(30)))
    return {"k": text, "n": rng.randrange(1000), "a": [{"z": text[:3], "y": [1, 2, {"w": ","}]}] * rng.randrange(3)}


@pytest.mark.parametrize("seed", range(2))
def test_array_cut_anywhere(spark, small_ranges, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(json_parts, "BROADCAST_RANGES", 0 if seed % 2 else 100_000)
    rng, want = random.Random(seed), []
    for k, count in enumerate((0, 1, 25)):
        rows = [element(rng) for _ in range(count)]
        if k == 2:
            rows[7]["k"] = "," * 700 + "\\" * 300 + '"'  # ranges without a cut
        want += rows
        (tmp_path / f"f{k}.json").write_text(" " * k + json.dumps(rows, ensure_ascii=seed % 3 == 0, indent=seed % 2 or None) + "\n" * k)
    found = json_parts.array_elements(spark, str(tmp_path))
    assert json_parts._pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 8
    assert sorted(json.dumps(json.loads(r.element)) for r in found.collect()) == sorted(map(json.dumps, want))
    read = s.read_json_array(spark, str(tmp_path), "k string, n bigint, a array<struct<z:string>>").collect()
    assert sorted((r.k, r.n, len(r.a)) for r in read) == sorted((w["k"], w["n"], len(w["a"])) for w in want)


@pytest.mark.parametrize("indent", [None, 1])
def test_object_cut_anywhere(spark, small_ranges, tmp_path, indent):
    rng, want = random.Random(5), []
    documents = [
        {"t": "x", "rows": [], "more": {"a": 1, "b": [1, 2], "c": {"d": 1, "e": 2}}, "none": None}, {}, {"rows": None, "t": None}, {"z": [[1, 2], [3]], "rows": [{"k": "]}", "n": 1}]},
        {"other": [1, 2, 3], "rows": [element(rng) for _ in range(20)], "t": 'q",[{', "names": ["a,b", "]", "c"], "end": 1},
    ]
    for k, d in enumerate(documents):
        (tmp_path / f"f{k}.json").write_text(json.dumps(d, ensure_ascii=False, indent=indent) + "\n" * k)
        want += [(d.get("t"), "r", r["k"], r["n"]) for r in d.get("rows") or []] + [(d.get("t"), "n", x, None) for x in d.get("names") or []]
    found = s.read_json_object(spark, str(tmp_path), "t string, rows array<struct<k:string,n:bigint>>, names array<string>").collect()
    got = [(r.t, "r", r.rows[0].k, r.rows[0].n) for r in found if r.rows] + [(r.t, "n", r.names[0], None) for r in found if r.names]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(not r.rows and not r.names for r in found) == 3


@pytest.mark.parametrize("text", ["[1]", '{"a": [1, 2}', '{"a": [1,, 2]}', '{"a": [{"b": ]}', '{"a" [1]}', '{"a": [1]} x', "{,}"])
def test_malformed_objects_are_refused(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises((PySparkException, Py4JJavaError)):
        s.read_json_object(spark, str(tmp_path), "a array<bigint>").collect()


@pytest.mark.parametrize("text", ["[1, 2", '["a]', "[{]", '{"k": 1}', "[{}, ]", "[{},, {}]", "[{}]]", "x", '[{"k": }]', "[{}] {}", "[{}}, {]"])
def test_malformed_arrays_are_refused(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises((PySparkException, Py4JJavaError)):
        s.read_json_array(spark, str(tmp_path), "k string").collect()


def test_digests_of_streams(spark, tmp_path):
    big = tmp_path / "run" / "big file,%41é.bin"
    big.parent.mkdir()
    with big.open("wb") as f:
        f.truncate(2_300_000_000)  # sparse: more than a row can hold
        f.seek(0)
        f.write(b"head")
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "a.gz").write_bytes(b"not packed")
    want = hashlib.sha256(b"head")
    for _ in range(2_300_000_000 // (1 << 20)):
        want.update(bytes(1 << 20))
    want.update(bytes(2_300_000_000 % (1 << 20) - 4))
    got = {r.path: (r.sha256, r["size"]) for r in s.artifact_inventory(spark, str(tmp_path)).collect()}
    assert got == {
        "run/big file,%41é.bin": (want.hexdigest(), 2_300_000_000), "empty": (hashlib.sha256(b"").hexdigest(), 0), "a.gz": (hashlib.sha256(b"not packed").hexdigest(), 10),
    }


def test_stored_listings_are_joined_where_they_lie(spark, tmp_path):
    import pyarrow.parquet as pq

    from keyscape.operators.compare import missing_keys
    from keyscape.operators.keyspace import key_range, scope

    rows = spark.range(20_000).selectExpr("format_string('d%d/%06d', id % 10, id) as key", "cast(id as string) as size", "sha2(cast(id as string), 512) as etag", "cast(null as string) as mtime", "'S' as storage_class")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = s.store_listing(rows, "stored_one", str(tmp_path / "one"), 4, row_group=1 << 16)
        two = s.store_listing(rows.filter("size % 100 <> 7"), "stored_two", str(tmp_path / "two"), 4, row_group=1 << 16)
        lost = missing_keys(one, two)
        assert lost.count() == 200 and "Exchange" not in lost._jdf.queryExecution().executedPlan().toString()
        files = list((tmp_path / "one").glob("*.parquet"))
        groups = [pq.ParquetFile(f).metadata for f in files]
        assert len(files) == 4 and min(g.num_row_groups for g in groups) > 2
        for df, n in ((scope(one, "d3/"), 2000), (key_range(one, "d3/", "d4/"), 2000)):
            assert df.count() == n and "PushedFilters: [IsNotNull(key)" in df._jdf.queryExecution().executedPlan().toString()
        hit = sum(1 for g in groups for k in range(g.num_row_groups) if g.row_group(k).column(0).statistics.max >= "d3/" and g.row_group(k).column(0).statistics.min < "d30")
        assert hit < sum(g.num_row_groups for g in groups) / 2  # the others are skipped by their bounds
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for t in ("stored_one", "stored_two"):
            spark.sql(f"drop table if exists {t}")


def test_fragments_are_cut_once(spark, tmp_path):
    """What reads a document's members asks for its fragments many times; they are cut by one pass over the text and written."""
    (tmp_path / "f.json").write_text(json.dumps({"t": "x", "rows": [{"k": str(i)} for i in range(50)]}))
    found = s.read_json_object(spark, str(tmp_path), "t string, rows array<struct<k:string>>")
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 50


@pytest.mark.parametrize("whole", [0, 400, 1 << 23])
def test_short_files_are_cut_as_they_are_read(spark, small_ranges, tmp_path, monkeypatch, whole):
    """Short files, long ones and compressed ones together give the same elements, however many bytes a short one may have."""
    import gzip

    monkeypatch.setattr(json_parts, "WHOLE_FILE", whole)
    rng, arrays, objects = random.Random(3), [], []
    for k, count in enumerate((0, 1, 2, 12)):
        rows = [element(rng) for _ in range(count)]
        arrays, objects = arrays + rows, objects + [(f"t{k}", r["k"], r["n"]) for r in rows] + [(f"t{k}", None, None)] * (not rows)
        for kind, doc in (("a", rows), ("o", {"t": f"t{k}", "rows": rows, "odd": [[1, {"x": ","}]]})):
            (tmp_path / kind).mkdir(exist_ok=True)
            text = (json.dumps(doc, ensure_ascii=False, indent=k % 2 or None) + "\n" * k).encode()
            (tmp_path / kind / f"f{k}.json{'.gz' if k == 2 else ''}").write_bytes(gzip.compress(text) if k == 2 else text)
    (tmp_path / "a" / "empty.json").write_text("")
    assert sorted(json.dumps(json.loads(r.element)) for r in json_parts.array_elements(spark, str(tmp_path / "a")).collect()) == sorted(map(json.dumps, arrays))
    found = s.read_json_object(spark, str(tmp_path / "o"), "t string, rows array<struct<k:string,n:bigint>>").collect()
    assert sorted(((r.t, r.rows[0].k, r.rows[0].n) if r.rows else (r.t, None, None) for r in found), key=str) == sorted(objects, key=str)


def test_elements_of_objects_are_not_shuffled(spark, tmp_path):
    """s5: members of files are broadcast, so elements stay where they are read; and each text is parsed once, not by a filter too."""
    for k in range(3):
        (tmp_path / f"f{k}.json").write_text(json.dumps({"t": str(k), "rows": [{"k": str(i)} for i in range(20)]}))
    found = s.read_json_object(spark, str(tmp_path), "t string, rows array<struct<k:string>>")
    plan = found.selectExpr("explode(rows)")._jdf.queryExecution()
    assert "Exchange hashpartitioning" not in plan.executedPlan().toString() and plan.optimizedPlan().toString().count("from_json") == 1


def test_short_broken_files_are_refused(spark, tmp_path):
    (tmp_path / "f.json").write_text('[{"k": "a]}')
    with pytest.raises((Py4JJavaError, PySparkException)):
        json_parts.array_elements(spark, str(tmp_path)).collect()


def test_pages_are_dealt_out_as_narrow_rows(spark):
    from keyscape.plans import source_plans

    plan = source_plans._listed_pages(spark, "/root/testdata/sf0.001", json_parts.F.col("key"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "md5" not in plan[plan.index("Exchange ") :]
