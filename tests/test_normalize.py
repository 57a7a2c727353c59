"""Edge rows of the native formats."""

import pytest
from py4j.protocol import Py4JJavaError

from keyscape.operators.normalize import FORMATS, count_native, delimiter_pages, normalize


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def rows(df):
    return [tuple(r) for r in df.collect()]


CASES = {
    "tsv5": (["a b\t1\t\"e\"\t2020-01-02T03:04:05+0000\tGLACIER"], [("a b", "1", "e", "2020-01-02T03:04:05Z", "GLACIER")]),
    "ls": (["2020-01-02 03:04:05       42 a  b/c", "noise", ""], [("a  b/c", "42", None, "2020-01-02T03:04:05Z", None)]),
    "tsv6": (["key\tsize\tlast_modified\tetag\tstorage_class\trow_type", "k\t1\t2020-01-02T03:04:05.250Z\t\t\t"], [("k", "1", None, "2020-01-02T03:04:05Z", None)]),
    "table": ([f"{'12':>14}  {'2020-01-02T03:04:05Z':<24}  {' k'}", f"{'PRE':>14}{'':28}p/"], [(" k", "12", None, "2020-01-02T03:04:05Z", None)]),
    "tsv_last": (["\tPRE\t\t\tp/", "T\tDELETE\t\t\tv\tk", "T\t3\tSC\te\tv9\tk"], [("p/", None, None, None, None), ("k", None, None, "T", None), ("k", "3", "e", "T", "SC")]),
    "object_lines": (["Object: 2020-05-01 12:00:00 +0000 UTC\t 42\t  k\tz", "other"], [(" k\tz", "42", None, "2020-05-01T12:00:00Z", None)]),
    "path_size": (["a;b;12", "none"], [("a;b", "12", None, None, None)]),
    "url_lines": (["2020-01-02 03:04   12   s3://b/a b", "            DIR  s3://b/p/", "x s3://b/", "none"], [("a b", "12", None, None, None), ("p/", None, None, None, None)]),
    "spaced": (["2020/01/02 03:04:05  STANDARD \"e\"  7 a  b", "     DIR p/", "", "\tx"], [("a b", "7", "e", "2020-01-02T03:04:05Z", "STANDARD"), ("", None, None, "xT", None)]),
    "spaced_versions": (["2020/01/02 03:04:05 STANDARD e 7 a null"], [("a", "7", "e", "2020-01-02T03:04:05Z", "STANDARD")]),
    "bracketed": (
        ["[2020-01-02 03:04:05 UTC]1006KiB STANDARD  k", "[2020-01-02 03:04:05 UTC]  0B p/", "[2020-01-02 03:04:05 UTC]  1B WORD k", "x"],
        [(" k", None, None, "2020-01-02T03:04:05Z", "STANDARD"), ("p/", None, None, None, None), ("WORD k", None, None, "2020-01-02T03:04:05Z", None)],
    ),
    "version_key": (["v1 a b", "none"], [("a b", None, None, None, None)]),
    "long": (["d t 1K a  b", "a b c"], [("a b", None, None, None, None)]),
    "found": (["al/bu/k/x", "  ", ""], [("k/x", None, None, None, None)]),
    "url_json": (['{"key":"s3://b/k","size":1}', '{"key":"s3://b/p/","type":"dir"}'], [("k", "1", None, None, None)]),
    "key_json": (['{"Prefix":"p/"}', '{"Key":"k","Size":3,"ETag":"\\"e\\""}'], [("p/", None, None, None, None), ("k", "3", "e", None, None)]),
    "path_level": (['{"Path":"d","IsDir":true,"Size":-1}', '{"Path":"f","IsDir":false,"Size":2,"ModTime":"2020"}'], [("d/", None, None, None, None), ("f", "2", None, None, None)]),
    "totals": (["12 objects"], []),
}


@pytest.mark.parametrize("fmt", sorted(CASES))
def test_edges(spark, fmt):
    given, expected = CASES[fmt]
    raw = lines(spark, *given)
    if fmt == "spaced":
        expected = [e for e in expected if e[0]] + [(None if e[0] == "" else e[0], *e[1:]) for e in expected if not e[0]]
        found = rows(normalize(raw, fmt))
        assert found[0] == expected[0] and len(found) == 2
    else:
        assert rows(normalize(raw, fmt)) == expected
    assert count_native(raw, fmt).first()["count"] == normalize(raw, fmt).count()


@pytest.mark.parametrize("fmt", sorted(f for f, x in FORMATS.items() if x.raw != "rows" and f != "yaml_pages"))
def test_empty_input(spark, fmt):
    assert rows(normalize(lines(spark).limit(0), fmt)) == []


@pytest.mark.parametrize("line", ["a/b.csv\t12\t\"e\"\t2026-03-16T14:41:50+00:00", "a\t1\te\tT\tS\tmore", "alone"])
def test_ragged_lines_are_refused(spark, line):
    raw = lines(spark, "k\t1\te\tT\tS", "", line)
    for df in (normalize(raw, "tsv5"), count_native(raw, "tsv5")):
        with pytest.raises(Exception, match="without five fields"):
            df.collect()


def test_prefixes(spark):
    ls = lines(spark, "          PRE foobar/", "2020-01-02 03:04:05 1 foo.txt")
    assert [r.key for r in normalize(ls, "ls_level", prefix="a/fo").collect()] == ["a/foobar/", "a/foo.txt"]
    assert normalize(lines(spark, '{"key":"k","type":"folder","size":1}'), "folder_json", prefix="/p/").first()["key"] == "p/k"


def test_pages(spark):
    schema = "Contents array<struct<Key:string,Size:bigint,ETag:string,LastModified:string,StorageClass:string>>, CommonPrefixes array<struct<Prefix:string>>"
    pages = spark.createDataFrame([([("k", 1, '"e"', "2020-01-02T03:04:05+00:00", None)], None), (None, [("p/",)])], schema)
    assert sorted(rows(delimiter_pages(pages)), key=str) == sorted([("p/", None, None, None, None), ("k", "1", "e", "2020-01-02T03:04:05Z", None)], key=str)


def test_refusals(spark):
    with pytest.raises(ValueError):
        normalize(lines(spark, "x"), "unheard-of")
    with pytest.raises((Py4JJavaError, Exception), match="MALFORMED|Malformed|broken|FAILFAST"):
        normalize(lines(spark, "{broken"), "url_json").collect()
