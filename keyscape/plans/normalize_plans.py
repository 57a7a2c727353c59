"""Queries of the native formats (N1-N34): listings of lineitem, printed in each format and read back.

The oracle of each is the listing itself, so it checks that printing lost what it should and
nothing else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyscape.operators.normalize import count_lines, count_native, counted_together, delimiter_pages, normalize

from .data import LISTING, dealt, listed, table, with_order

_DAY, _TIME = "substring(mtime, 1, 10)", "substring(mtime, 12, 8)"
_MILLIS = "replace(mtime, 'Z', '.250Z')"
#: Format -> how a listing row prints as a line (Spark SQL); noise lines that must be dropped come from orders divisible by 10.
_LINES = {
    "tsv5": "concat_ws('\\t', key, size, concat('\"', etag, '\"'), replace(mtime, 'Z', '+00:00'), storage_class)",
    "ls": f"CASE WHEN l_orderkey % 10 = 0 THEN 'Total Objects: 3' ELSE concat({_DAY}, ' ', {_TIME}, lpad(size, 12, ' '), ' ', key) END",
    "ls_level": f"CASE WHEN l_orderkey % 10 = 0 THEN concat(lpad('PRE', 30, ' '), ' ', key, '/') ELSE concat({_DAY}, ' ', {_TIME}, lpad(size, 12, ' '), ' ', key) END",
    "tsv6": f"concat_ws('\\t', key, size, {_MILLIS}, etag, storage_class, CASE l_orderkey % 10 WHEN 0 THEN 'COMMON_PREFIX' WHEN 1 THEN '' ELSE 'OBJECT' END)",
    "table": "CASE WHEN l_orderkey % 10 = 0 THEN concat(lpad('PRE', 14, ' '), rpad('', 28, ' '), key) ELSE concat(lpad(size, 14, ' '), '  ', rpad(mtime, 24, ' '), '  ', key) END",
    "tsv_last": "CASE l_orderkey % 10 WHEN 0 THEN concat_ws('\\t', '', 'PRE', '', '', key) WHEN 1 THEN concat_ws('\\t', mtime, 'DELETE', '', '', 'v1', key) ELSE concat_ws('\\t', mtime, size, storage_class, etag, key) END",
    "aligned": "CASE l_orderkey % 10 WHEN 0 THEN concat(rpad('', 27, ' '), lpad('PRE', 14, ' '), '  ', key) WHEN 1 THEN 'short' ELSE concat(rpad(mtime, 25, ' '), '  ', lpad(size, 14, ' '), '  ', key) END",
    "keys": "CASE WHEN l_orderkey % 10 = 0 THEN '' ELSE key END",
    "object_lines": f"CASE WHEN l_orderkey % 10 = 0 THEN 'listing ...' ELSE concat('Object: ', {_DAY}, ' ', {_TIME}, '.5 +0000 UTC\\t   ', size, '\\t ', key, '\\tx') END",
    "path_size": "CASE WHEN l_orderkey % 10 = 0 THEN key ELSE concat(key, ';y;', size) END",
    "url_lines": f"CASE l_orderkey % 10 WHEN 0 THEN 'no url' WHEN 1 THEN concat('   DIR  s3://bucket/', key, '/') ELSE concat({_DAY}, ' 10:00   ', size, '  s3://bucket/', key, ' z') END",
    "spaced": f"CASE WHEN l_orderkey % 10 = 0 THEN concat('      DIR ', key, '/') ELSE concat(replace({_DAY}, '-', '/'), ' ', {_TIME}, '  ', storage_class, ' \"', etag, '\"   ', size, '  ', key, ' z') END",
    "spaced_versions": f"concat(replace({_DAY}, '-', '/'), ' ', {_TIME}, '  ', storage_class, ' ', etag, '   ', size, '  ', key, ' null')",
    "spaced_level": f"CASE WHEN l_orderkey % 10 = 0 THEN concat('      DIR ', key, '/') ELSE concat(replace({_DAY}, '-', '/'), ' ', {_TIME}, '  ', storage_class, ' ', etag, '   ', size, '  ', key) END",
    "urls": "CASE WHEN l_orderkey % 10 = 0 THEN '' ELSE concat('s3://bucket/', key) END",
    "found": "CASE WHEN l_orderkey % 10 = 0 THEN '  ' ELSE concat('alias/bucket/', key) END",
    "bracketed": f"CASE l_orderkey % 10 WHEN 0 THEN 'not a row' WHEN 1 THEN concat('[', {_DAY}, ' ', {_TIME}, ' UTC]     0B ', key, '/') WHEN 2 THEN concat('[', {_DAY}, ' ', {_TIME}, ' UTC]1006KiB WORD ', key) ELSE concat('[', {_DAY}, ' ', {_TIME}, ' UTC]  12KiB ', storage_class, ' ', key) END",
    "version_key": "CASE WHEN l_orderkey % 10 = 0 THEN 'none' ELSE concat('v12 ', key, ' z') END",
    "long": "CASE WHEN l_orderkey % 10 = 0 THEN 'a b c' ELSE concat(mtime, ' x  12K ', key, '  z') END",
    "totals": "concat(size, ' bytes')",
}
_S = "storage_class"
_JSON = {
    "sink_json": f"named_struct('key', key, 'size', cast(size as bigint), 'last_modified', {_MILLIS}, 'etag', etag, 'storage_class', {_S}, 'row_type', CASE l_orderkey % 10 WHEN 0 THEN 'COMMON_PREFIX' WHEN 1 THEN NULL ELSE 'OBJECT' END)",
    "key_json": f"named_struct('Key', CASE WHEN l_orderkey % 10 > 0 THEN key END, 'Size', cast(size as bigint), 'ETag', concat('\"', etag, '\"'), 'LastModified', mtime, 'StorageClass', {_S}, 'Prefix', CASE WHEN l_orderkey % 10 = 0 THEN key END)",
    "path_json": f"named_struct('Path', key, 'Size', cast(size as bigint), 'ModTime', replace(mtime, 'Z', '.000000000Z'), 'IsDir', false, 'Tier', CASE WHEN l_orderkey % 10 = 0 THEN '' ELSE {_S} END)",
    "path_level": f"named_struct('Path', key, 'Size', cast(size as bigint), 'ModTime', CASE WHEN l_orderkey % 10 = 1 THEN 'short' ELSE mtime END, 'IsDir', l_orderkey % 10 = 0, 'Tier', {_S})",
    "url_json": f"named_struct('key', concat('s3://bucket/', key), 'type', CASE l_orderkey % 10 WHEN 0 THEN 'dir' WHEN 1 THEN NULL ELSE 'file' END, 'size', cast(size as bigint), 'etag', etag, 'last_modified', mtime, 'storage_class', {_S})",
    "folder_json": f"named_struct('key', key, 'type', CASE WHEN l_orderkey % 10 = 0 THEN 'folder' ELSE 'file' END, 'size', cast(size as bigint), 'etag', CASE WHEN l_orderkey % 10 = 1 THEN '' ELSE etag END, 'lastModified', mtime, 'storageClass', {_S})",
    "found_json": f"named_struct('key', concat('alias/bucket/', key), 'type', 'file', 'size', cast(size as bigint), 'etag', '', 'lastModified', mtime, 'storageClass', {_S})",
    "raw_json": f"named_struct('Key', key, 'LastModified', {_MILLIS}, 'ETag', concat('\"', etag, '\"'), 'Size', cast(size as bigint), 'StorageClass', {_S})",
}
_PREFIXED = {"ls_level": "top/li", "path_size": "top/", "path_json": "top/", "path_level": "top/", "spaced": "top/", "spaced_versions": "top/", "spaced_level": "top/", "folder_json": "/top/", "bracketed": "/top/"}

_ROLL, _ONE = "l_orderkey % 10 = 0", "l_orderkey % 10 = 1"


def _unless(cond: str, value: str) -> str:
    return f"CASE WHEN NOT ({cond}) THEN {value} END"


#: Format -> (which rows, key, size, etag, mtime, storage_class) in DuckDB.
_EXPECTED = {
    "tsv5": ("true", "key", "size", "etag", "mtime", _S),
    "ls": (f"NOT ({_ROLL})", "key", "size", "NULL", "mtime", "NULL"),
    "ls_level": ("true", f"'top/' || key || CASE WHEN {_ROLL} THEN '/' ELSE '' END", _unless(_ROLL, "size"), "NULL", _unless(_ROLL, "mtime"), "NULL"),
    "tsv6": (f"NOT ({_ROLL})", "key", "size", "etag", "mtime", _S),
    "table": (f"NOT ({_ROLL})", "key", "size", "NULL", "mtime", "NULL"),
    "tsv_last": ("true", "key", _unless("l_orderkey % 10 < 2", "size"), _unless("l_orderkey % 10 < 2", "etag"), _unless(_ROLL, "mtime"), _unless("l_orderkey % 10 < 2", _S)),
    "aligned": (f"NOT ({_ONE})", "key", _unless(_ROLL, "size"), "NULL", _unless(_ROLL, "mtime"), "NULL"),
    "keys": (f"NOT ({_ROLL})", "key", "NULL", "NULL", "NULL", "NULL"),
    "object_lines": (f"NOT ({_ROLL})", "key || chr(9) || 'x'", "size", "NULL", "mtime", "NULL"),
    "path_size": (f"NOT ({_ROLL})", "'top/' || key || ';y'", "size", "NULL", "NULL", "NULL"),
    "url_lines": (f"NOT ({_ROLL})", f"key || CASE WHEN {_ONE} THEN '/' ELSE ' z' END", _unless(_ONE, "size"), "NULL", "NULL", "NULL"),
    "spaced": (f"NOT ({_ROLL})", "'top/' || key || ' z'", "size", "etag", "mtime", _S),
    "spaced_versions": ("true", "'top/' || key", "size", "etag", "mtime", _S),
    "spaced_level": ("true", f"'top/' || key || CASE WHEN {_ROLL} THEN '/' ELSE '' END", *(_unless(_ROLL, c) for c in ("size", "etag", "mtime", _S))),
    "urls": (f"NOT ({_ROLL})", "key", "NULL", "NULL", "NULL", "NULL"),
    "found": (f"NOT ({_ROLL})", "key", "NULL", "NULL", "NULL", "NULL"),
    "bracketed": (f"NOT ({_ROLL})", "'top/' || CASE l_orderkey % 10 WHEN 1 THEN key || '/' WHEN 2 THEN 'WORD ' || key ELSE key END", "NULL", "NULL", _unless(_ONE, "mtime"), _unless("l_orderkey % 10 IN (1, 2)", _S)),
    "version_key": (f"NOT ({_ROLL})", "key || ' z'", "NULL", "NULL", "NULL", "NULL"),
    "long": (f"NOT ({_ROLL})", "key || ' z'", "NULL", "NULL", "NULL", "NULL"),
    "totals": ("false", "key", "NULL", "NULL", "NULL", "NULL"),
    "sink_json": (f"NOT ({_ROLL})", "key", "size", "etag", "mtime", _S),
    "key_json": ("true", "key", *(_unless(_ROLL, c) for c in ("size", "etag", "mtime", _S))),
    "path_json": ("true", "'top/' || key", "size", "NULL", "mtime", _unless(_ROLL, _S)),
    "path_level": ("true", f"'top/' || key || CASE WHEN {_ROLL} THEN '/' ELSE '' END", _unless(_ROLL, "size"), "NULL", _unless("l_orderkey % 10 < 2", "mtime"), _unless(_ROLL, _S)),
    "url_json": (f"NOT ({_ROLL})", "key", "size", "etag", "mtime", _S),
    "folder_json": ("true", "'top/' || key", _unless(_ROLL, "size"), _unless(_ONE, "etag"), _unless(_ROLL, "mtime"), _S),
    "found_json": ("true", "key", "size", "NULL", "mtime", _S),
    "raw_json": ("true", "key", "size", "etag", "mtime", _S),
    "contents": ("true", "key", "size", "etag", "mtime", _S),
    "common_prefixes": ("true", "key || '/'", "NULL", "NULL", "NULL", "NULL"),
    "yaml_pages": ("true", "key", "size", "etag", "mtime", _S),
    "sink_parquet": (f"NOT ({_ROLL})", "key", "size", "etag", "mtime", _S),
    "epoch_parquet": ("true", "key", "size", "etag", "mtime", "NULL"),
}


def _items(li: DataFrame, *by) -> DataFrame:
    """A page of nested objects and prefixes, and their number n, for each value of `by`."""
    item = F.struct(F.col("key").alias("Key"), F.col("size").cast("bigint").alias("Size"), F.concat(F.lit('"'), "etag", F.lit('"')).alias("ETag"), F.replace("mtime", F.lit("Z"), F.lit("+00:00")).alias("LastModified"), F.col("storage_class").alias("StorageClass"))
    return li.groupBy(*by).agg(F.collect_list(item).alias("Contents"), F.collect_list(F.struct(F.concat("key", F.lit("/")).alias("Prefix"))).alias("CommonPrefixes"), F.count("*").alias("n"))


def _pages(spark, d: str) -> DataFrame:
    """A page for each order and day."""
    return _items(listed(dealt(table(spark, d, "lineitem"), "l_orderkey", "l_shipdate")), "l_orderkey", "shipped").drop("n")


#: Lines of an item of a YAML page, and how their values are quoted.
_YAML_ITEM = {"ETag": "'", "Key": "", "LastModified": "'", "Size": "", "StorageClass": ""}


def _yaml(spark, d: str) -> DataFrame:
    """YAML lines (file, line_no, value): a file for each order and day, its page a list of objects.

    A file's lines lie together, as its rows were dealt out by its name. The number of lines comes of a count, so that who asks for no line's text doesn't have the page made.
    """
    file = F.concat_ws("@", "l_orderkey", "l_shipdate")
    pages = _items(listed(dealt(table(spark, d, "lineitem"), file), file.alias("file")), "file").select("file", "n", "Contents")
    lines = pages.select("*", F.explode(F.sequence(F.lit(0), (F.col("n") * len(_YAML_ITEM) + 3).cast("int"))).alias("line_no"))
    at, item = F.col("line_no") - 1, F.col("n") * len(_YAML_ITEM)
    c, k = F.get("Contents", F.floor(at / len(_YAML_ITEM)).cast("int")), at % len(_YAML_ITEM)
    value = F.when(at < 0, "- Contents:").when(at == item, "  RequestCharged: null").when(at == item + 1, "---").when(at == item + 2, "- Contents: []")
    for i, (name, quote) in enumerate(_YAML_ITEM.items()):
        value = value.when(k == i, F.concat(F.lit(("    " if i else "  - ") + f"{name}: {quote}"), c[name].cast("string"), F.lit(quote)))
    return lines.select("file", "line_no", value.alias("value"))


def raw(spark, d: str, fmt: str) -> DataFrame:
    li = with_order(spark, d)
    if fmt in _LINES:
        return li.selectExpr(f"{_LINES[fmt]} AS value")
    if fmt in _JSON:
        return li.selectExpr(f"to_json({_JSON[fmt]}) AS value")
    if fmt in ("contents", "common_prefixes"):
        return _pages(spark, d)
    if fmt == "yaml_pages":
        return _yaml(spark, d)
    if fmt == "sink_parquet":
        return li.select(F.encode("key", "UTF-8").alias("key"), F.col("size").cast("bigint").alias("size"), "etag", F.col("shipped").alias("last_modified"), "storage_class", F.when(F.col("l_orderkey") % 10 > 0, "OBJECT").otherwise("COMMON_PREFIX").alias("row_type"))
    return li.select(F.col("key").alias("Key"), F.col("size").cast("decimal(20,0)").alias("Size"), F.unix_seconds(F.col("shipped").cast("timestamp")).cast("decimal(20,0)").alias("LastModified"), F.col("etag").alias("ETag"))


def _query(fmt: str):
    return lambda spark, d: normalize(raw(spark, d, fmt), fmt, prefix=_PREFIXED.get(fmt, ""))


def _oracle(fmt: str) -> str:
    rows, *fields = _EXPECTED[fmt]
    names = ("key", "size", "etag", "mtime", "storage_class")
    return f"WITH {LISTING} SELECT {', '.join(f'CAST({e} AS VARCHAR) AS {n}' for e, n in zip(fields, names, strict=True))} FROM l WHERE {rows}"


_NUMBER = {
    "tsv5": 1, "contents": 2, "common_prefixes": 3, "ls": 4, "ls_level": 5, "yaml_pages": 6, "tsv6": 7, "sink_json": 8, "table": 9, "sink_parquet": 10, "tsv_last": 11,
    "aligned": 12, "key_json": 13, "keys": 14, "object_lines": 15, "path_json": 16, "path_level": 17, "path_size": 18, "url_lines": 19, "spaced": 20, "spaced_versions": 21,
    "spaced_level": 22, "urls": 23, "url_json": 24, "folder_json": 25, "found_json": 26, "found": 27, "bracketed": 28, "version_key": 29, "long": 30, "raw_json": 31, "epoch_parquet": 32, "totals": 33,
}
QUERIES = {f"n{_NUMBER[f]}_{f}": _query(f) for f in _NUMBER}
ORACLES = {f"n{_NUMBER[f]}_{f}": _oracle(f) for f in _NUMBER}


#: Formats whose lines are made and counted in one scan; with more of them, the code of a scan grows too long to be compiled well.
TOGETHER = 7


def _line(fmt: str) -> str:
    return _LINES[fmt] if fmt in _LINES else f"to_json({_JSON[fmt]})"


def _counts(spark, d) -> DataFrame:
    """The count of each format; lines of several formats are printed from one listing."""
    together = [f for f in _NUMBER if counted_together(f)]
    parts = [count_native(raw(spark, d, fmt), fmt).select(F.lit(fmt).alias("format"), "count") for fmt in _NUMBER if fmt not in together]
    for at in range(0, len(together), TOGETHER):
        some = together[at : at + TOGETHER]
        lines = with_order(spark, d).select(F.inline(F.array(*[F.struct(F.lit(i).alias("n"), F.expr(_line(fmt)).alias("value")) for i, fmt in enumerate(some)])))
        parts.append(count_lines(lines, some))
    return reduce(DataFrame.unionByName, parts)


QUERIES["n34_count_native"] = _counts
ORACLES["n34_count_native"] = f"WITH {LISTING} " + " UNION ALL ".join(f"SELECT '{f}' AS format, count(*) AS \"count\" FROM l WHERE {_EXPECTED[f][0]}" for f in _NUMBER)
QUERIES["n3_delimiter_pages"] = lambda s, d: delimiter_pages(raw(s, d, "contents"))
ORACLES["n3_delimiter_pages"] = f"{_oracle('contents')} UNION ALL SELECT key || '/', NULL, NULL, NULL, NULL FROM l"
