"""Native listings of many shapes to the five-field listing, one column strategy for each format."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyscape.functions.listing import FIELDS, awk_fields, field, rest, tabbed, unquoted, whole_seconds, zulu
from keyscape.operators.ranges import ranged
from keyscape.sources.shared import checkpoint


def _v() -> Column:
    return F.col("value")


@dataclass(frozen=True)
class Format:
    """One way of printing a listing.

    raw: `lines` (a column value), `json` (lines of JSON) or `rows` (declared columns).
    schema: the declared columns of JSON lines. pick: the rows that may be records. where: which of them are.
    fields: their key and exposed fields, given the run's prefix. number: the count of raw's records, where picking them does more than a count asks for.
    """

    id: str
    raw: str
    fields: Callable[[Column], dict[str, Column]]
    where: Callable[[], Column] | None = None
    schema: str | None = None
    pick: Callable[[DataFrame], DataFrame] = lambda df: df
    number: Callable[[DataFrame], DataFrame] | None = None


def _ls(value: Column) -> list[Column]:
    shape = r"(?d)^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}:\d{2}) +(\d+) (.*)\z"
    return [F.regexp_extract(value, shape, k) for k in range(1, 5)]


def _ls_fields(prefix: Column) -> dict[str, Column]:
    day, time, size, key = _ls(_v())
    return {"key": key, "size": size, "mtime": F.concat(day, F.lit("T"), time, F.lit("Z"))}


def _pre() -> Column:
    return F.regexp_extract(_v(), r"(?d)^ *PRE (.*)\z", 1)


def _directory(prefix: Column) -> Column:
    """The prefix up to its last slash: what a listing of one level leaves out of its names."""
    return F.regexp_extract(prefix, r"(?s)^(.*/)?", 0)


def _ls_level(prefix: Column) -> dict[str, Column]:
    day, time, size, key = _ls(_v())
    rolled = _pre() != ""
    return {
        "key": F.concat(_directory(prefix), F.when(rolled, _pre()).otherwise(key)), "size": F.when(~rolled, size),
        "mtime": F.when(~rolled, F.concat(day, F.lit("T"), time, F.lit("Z"))),
    }


def _five_tabbed(prefix: Column) -> dict[str, Column]:
    f = tabbed(_v())
    return {"key": field(f, 1), "size": field(f, 2), "etag": unquoted(field(f, 3)), "mtime": zulu(field(f, 4)), "storage_class": field(f, 5)}


def _six_tabbed(prefix: Column) -> dict[str, Column]:
    f = tabbed(_v())
    empty = lambda c: F.nullif(c, F.lit(""))
    return {"key": field(f, 1), "size": field(f, 2), "etag": empty(field(f, 4)), "mtime": whole_seconds(field(f, 3)), "storage_class": empty(field(f, 5))}


def _last_tabbed(prefix: Column) -> dict[str, Column]:
    f = tabbed(_v())
    mark = field(f, 2)
    stored = ~mark.isin("PRE", "DELETE")
    return {
        "key": F.element_at(f, -1), "size": F.when(stored, mark), "etag": F.when(stored, field(f, 4)),
        "mtime": F.when(mark != "PRE", field(f, 1)), "storage_class": F.when(stored, field(f, 3)),
    }


def _aligned_parts() -> tuple[Column, Column, Column]:
    return (F.trim(F.substring(_v(), 1, 25)), F.trim(F.substring(_v(), 28, 14)), F.expr("substring(value, 44)"))


def _aligned(prefix: Column) -> dict[str, Column]:
    date, mark, key = _aligned_parts()
    return {"key": key, "size": F.when(mark != "PRE", mark), "mtime": F.when(mark != "PRE", date)}


def _objects(prefix: Column) -> dict[str, Column]:
    f = tabbed(_v())
    at = F.split(F.trim(F.expr("substring(split(value, '\t', -1)[0], 9)")), "[ \t]+", -1)
    return {
        "key": F.regexp_replace(rest(f, 3, sep="\t"), r"\A ", ""), "size": F.replace(field(f, 2), F.lit(" "), F.lit("")),
        "mtime": F.concat(field(at, 1), F.lit("T"), F.regexp_replace(field(at, 2), r"\..*\z", ""), F.lit("Z")),
    }


def _stamp19(c: str) -> Column:
    return F.when(F.length(c) >= 19, F.concat(F.substring(c, 1, 19), F.lit("Z")))


def _path_tier(prefix: Column) -> dict[str, Column]:
    return {"key": F.concat(prefix, "Path"), "size": F.col("Size").cast("string"), "mtime": _stamp19("ModTime"), "storage_class": F.nullif("Tier", F.lit(""))}


def _path_level(prefix: Column) -> dict[str, Column]:
    file = ~F.col("IsDir")
    out = {k: F.when(file, c) for k, c in _path_tier(prefix).items()}
    return out | {"key": F.concat(prefix, "Path", F.when(F.col("IsDir"), F.lit("/")).otherwise(""))}


_URL = "substring(value, locate('s3://', value) + 5)"
def _url_key() -> Column:
    return F.expr(f"substring({_URL}, locate('/', {_URL}) + 1)")


def _url_lines(prefix: Column) -> dict[str, Column]:
    gutter = F.element_at(awk_fields(F.expr("substring(value, 1, locate('s3://', value) - 1)")), -1)
    return {"key": _url_key(), "size": F.when(gutter != "DIR", F.nullif(gutter, F.lit("")))}


_BUCKET = r"\As3://[^/]*/"
_ALIAS = r"\A[^/]*/[^/]*/"


def _spaced(last: Callable[[Column], Column] | None = None) -> Callable[[Column], dict[str, Column]]:
    def fields(prefix: Column) -> dict[str, Column]:
        f = awk_fields(_v())
        stop = last(f) if last else None
        return {
            "key": F.concat(prefix, rest(f, 6, stop)), "size": field(f, 5), "etag": unquoted(field(f, 4)),
            "mtime": F.concat(F.replace(field(f, 1), F.lit("/"), F.lit("-")), F.lit("T"), field(f, 2), F.lit("Z")), "storage_class": field(f, 3),
        }

    return fields


def _spaced_level(prefix: Column) -> dict[str, Column]:
    f = awk_fields(_v())
    stored = field(f, 1) != "DIR"
    out = {k: F.when(stored, c) for k, c in _spaced()(prefix).items()}
    return out | {"key": F.concat(prefix, F.when(stored, rest(f, 6)).otherwise(rest(f, 2)))}


def _not_dir() -> Column:
    return (F.trim(_v()) != "") & (field(awk_fields(_v()), 1) != "DIR")


def _folder_json(prefix: Column) -> dict[str, Column]:
    stored = ~F.col("type").eqNullSafe("folder")
    return {
        "key": F.concat(F.regexp_replace(prefix, r"\A/", ""), "key"), "size": F.when(stored, F.col("size").cast("string")), "etag": F.nullif("etag", F.lit("")),
        "mtime": F.when(stored, F.col("lastModified")), "storage_class": F.nullif("storageClass", F.lit("")),
    }


def _found_json(prefix: Column) -> dict[str, Column]:
    empty = lambda c: F.nullif(c, F.lit(""))
    return {"key": F.regexp_replace("key", _ALIAS, ""), "size": F.col("size").cast("string"), "etag": empty("etag"), "mtime": empty("lastModified"), "storage_class": empty("storageClass")}


#: The storage classes that a bracketed text row may name in front of its key.
STORAGE_CLASSES = (
    "STANDARD", "STANDARD_IA", "ONEZONE_IA", "INTELLIGENT_TIERING", "GLACIER", "DEEP_ARCHIVE", "REDUCED_REDUNDANCY",
    "GLACIER_IR", "OUTPOSTS", "SNOW", "EXPRESS_ONEZONE", "FSX_OPENZFS", "FSX_ONTAP",
)
_BRACKETED = r"(?d)^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) UTC\]\s*(\S+)(.*)\z"


def _bracketed(prefix: Column) -> dict[str, Column]:
    time = F.regexp_extract(_v(), _BRACKETED, 1)
    tail = F.regexp_replace(F.regexp_extract(_v(), _BRACKETED, 3), r"\A ", "")
    word = F.substring_index(tail, " ", 1)
    tagged = tail.contains(" ") & word.isin(*STORAGE_CLASSES)
    key = F.concat(F.regexp_replace(prefix, r"\A/", ""), F.when(tagged, F.regexp_replace(tail, r"(?s)\A[^ ]* ", "")).otherwise(tail))
    stored = ~key.endswith("/")
    return {"key": key, "mtime": F.when(stored, F.concat(F.replace(time, F.lit(" "), F.lit("T")), F.lit("Z"))), "storage_class": F.when(stored & tagged, word)}


def _contents(prefix: Column) -> dict[str, Column]:
    return {"key": F.col("c.Key"), "size": F.col("c.Size").cast("string"), "etag": unquoted(F.col("c.ETag")), "mtime": zulu(F.col("c.LastModified")), "storage_class": F.col("c.StorageClass")}


def _sink_rows(prefix: Column) -> dict[str, Column]:
    return {"key": F.col("key"), "size": F.col("size").cast("string"), "etag": F.col("etag"), "mtime": whole_seconds(F.col("last_modified")), "storage_class": F.col("storage_class")}


def _key_or_prefix(prefix: Column) -> dict[str, Column]:
    stored = F.col("Prefix").isNull()
    own = {"size": F.col("Size").cast("string"), "etag": unquoted(F.col("ETag")), "mtime": F.col("LastModified"), "storage_class": F.col("StorageClass")}
    return {"key": F.coalesce("Prefix", "Key")} | {k: F.when(stored, c) for k, c in own.items()}


#: A file of more lines than this is cut into ranges; a shorter one is read by one task.
LONG_FILE = 1 << 18


def _yaml_pages(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """A row for each item of the Contents lists of lines (file, line_no, value) of multi-document YAML pages.

    Items begin at `- Key-like` lines of the list's indentation. Files of up to LONG_FILE lines are dealt out whole, once; their items are
    gathered where they lie. Only longer ones, or all if a number of partitions is given, are cut into ranges.
    """
    if partitions:
        return _yaml_ranges(df, partitions)
    long = checkpoint(df.groupBy("file").agg(F.count("*").alias("n")).filter(F.col("n") > LONG_FILE).select(F.col("file").alias("long")))
    if long.isEmpty():
        return _yaml_files(df)
    of_long = F.col("file").eqNullSafe(F.col("long"))
    return _yaml_files(df.join(F.broadcast(long), of_long, "left_anti")).unionByName(_yaml_ranges(df.join(F.broadcast(long), of_long, "left_semi")))


#: Fixed value: what a regular expression's \\s matches.
_SPACE = " \t\n\x0b\f\r"


def _yaml_section() -> tuple[Column, Column]:
    """Whether a line opens a section or a document, and the name of that section, "" for a document; lines that are further indented are told by their first characters."""
    inner = _v().startswith("   ") | _v().startswith("  -")
    name = F.when(inner, "").otherwise(F.regexp_extract(_v(), r"\A(?:- |  )?([A-Za-z]+):", 1))
    opened = F.when(name != "", name).when(_v().startswith("---"), "")
    return opened.isNotNull(), opened


def _begins() -> Column:
    """Whether a line begins an item, in any section."""
    return F.ltrim(_v(), F.lit(_SPACE)).startswith("- ")


def _yaml_items(lines: DataFrame) -> DataFrame:
    """The fields of lines' items (file, item). A field's text is what is behind its colon, without blanks around it and then without quotes."""
    names = ("Key", "Size", "ETag", "LastModified", "StorageClass")
    body = F.ltrim(_v(), F.lit(_SPACE))
    pair = lines.select("file", "item", F.when(body.startswith("- "), F.ltrim(F.substring(body, 3, 1 << 30), F.lit(_SPACE))).otherwise(body).alias("_pair"))
    name = F.substring_index("_pair", ":", 1)
    text = F.when(F.col("_pair").contains(":"), F.btrim(F.substring("_pair", F.length(name) + 2, F.lit(1 << 30)), F.lit(_SPACE)))  # NULL: a line without a field
    pair = pair.select("file", "item", name.alias("_name"), text.alias("_text"))
    text, first = F.col("_text"), F.left("_text", F.lit(1))
    text = F.when(first.isin("'", '"') & (F.length(text) > 1) & text.endswith(first), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    pick = lambda k: F.max(F.when(F.col("_name") == k, F.col("_text"))).alias(k)
    return pair.select("file", "item", "_name", text.alias("_text")).groupBy("file", "item").agg(*map(pick, names))


def _yaml_files(df: DataFrame) -> DataFrame:
    order = W.partitionBy("file").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    top, opened = _yaml_section()
    now = df.filter(_v().isNotNull()).select("file", "line_no", "value", opened.alias("opened")).withColumn("own", F.last("opened", ignorenulls=True).over(order))
    now = now.filter((F.col("own") == "Contents") & F.col("opened").isNull())
    return _yaml_items(now.withColumn("item", F.count(F.when(_begins(), 1)).over(order)))


def _yaml_ranges(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Files are cut into ranges of lines, and a range is summed up by the last section that it opens and by how many items it
    begins, in front of its first section and behind; these states run from range to range, so that no task has to see a whole file.
    """
    top, opened = _yaml_section()
    parts = ranged(df.filter(_v().isNotNull()).select("file", "line_no", "value"), "file", "line_no", partitions=partitions)
    order = W.partitionBy("file", "_range").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    now = parts.withColumn("top", top).withColumn("own", F.last(opened, ignorenulls=True).over(order)).withColumn("begins", ~F.col("top") & _begins())
    count = lambda c: F.count(F.when(F.col("begins") & c, 1))
    sums = parts.withColumn("top", top).groupBy("file", "_range").agg(F.max_by(F.when(F.col("top"), opened), F.when(F.col("top"), F.col("line_no"))).alias("last"))
    inner = now.groupBy("file", "_range").agg(count(F.col("own").isNull()).alias("head"), count(F.col("own") == "Contents").alias("inside"))
    same = lambda a, b: F.col(f"{a}.file").eqNullSafe(F.col(f"{b}.file")) & (F.col(f"{a}._range") == F.col(f"{b}._range"))
    before = W.partitionBy("file").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    state = sums.alias("s").join(inner.alias("i"), same("s", "i")).select("s.file", "s._range", "s.last", "i.head", "i.inside")
    state = state.withColumn("came", F.last("last", ignorenulls=True).over(before))
    n = F.col("inside") + F.when(F.col("came") == "Contents", F.col("head")).otherwise(0)
    state = state.withColumn("n", n).select("file", "_range", "came", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("items"))
    now = now.alias("l").join(state.alias("s"), same("l", "s")).select("l.*", "s.came", "s.items").filter((F.coalesce("own", "came") == "Contents") & ~F.col("top"))
    now = now.withColumn("item", F.col("items") + F.count(F.when(F.col("begins"), 1)).over(order))
    return _yaml_items(now)


#: Lines that one bitmap holds, as a power of 2, and lines that are summed up together.
_MASK, _BLOCK = 5, 18


def _yaml_number(df: DataFrame) -> DataFrame:
    """(count) of the items that `_yaml_pages` returns, by bitmaps of 32 lines, as a count needs no line's text.

    A bitmap row is summed up by what lies in Contents in front of its first section (head, if Contents came before) and behind (inside):
    the number of beginning items, and its first line with whether that one begins none, which is an item too where it is a file's first one.
    These sums run from bitmap to bitmap in a block, then from block to block, so no task has to see a whole file.
    """
    opened, line = F.col("opened"), F.col("line_no").cast("long")
    kind = F.when(opened == "Contents", 3).when(opened.isNotNull(), 2).when(_begins(), 1).otherwise(0)
    lines = df.filter(_v().isNotNull()).select("file", "line_no", "value", _yaml_section()[1].alias("opened"))
    lines = lines.select("file", F.shiftright(line, _BLOCK).alias("block"), F.shiftright(line, _MASK).alias("mask"), F.expr(f"shiftleft(1L, cast(pmod(cast(line_no as bigint), {1 << _MASK}) as int))").alias("bit"), kind.alias("kind"))
    of = lambda c: F.bit_or(F.when(c, F.col("bit")).otherwise(F.lit(0).cast("long")))
    k = F.col("kind")
    masks = lines.groupBy("file", "block", "mask").agg(of(k >= 2).alias("tops"), of(k == 3).alias("opens"), of(k == 1).alias("begins"), of(k < 2).alias("plain"), F.count_if(k > 0).alias("n"))
    once = F.when(F.expr("n = bit_count(tops) + bit_count(begins) and tops & plain = 0"), F.col("mask")).otherwise(F.raise_error(F.concat(F.lit("a line number twice in file "), F.coalesce("file", F.lit("NULL")))).cast("long"))
    whole = (1 << (1 << _MASK)) - 1
    masks = masks.select(
        "file", "block", once.alias("mask"), "begins", "plain", F.expr("case when tops <> 0 then opens > tops ^ opens end").alias("last"),
        F.expr(f"case when tops <> 0 then (tops & -tops) - 1 else {whole}L end").alias("head"), F.expr(f"{whole}L & ~tops").alias("free"), F.expr(f"shiftleft(opens, 1) & {whole}L & ~tops").alias("starts"),
    ).withColumn("inside", F.expr("((free + starts) ^ free) & free"))  # adding a run's lowest bit carries through all of it

    def sums(part: str) -> list[Column]:
        first = F.expr(f"plain & {part} & -(plain & {part})")
        at = F.when(first != 0, (F.shiftleft("mask", _MASK) + F.bit_count(first - 1)) * 2 + F.when(F.col("begins").bitwiseAND(first) == 0, 1).otherwise(0))
        return [F.expr(f"cast(bit_count(begins & {part}) as bigint)").alias(f"n_{part}"), at.alias(f"first_{part}")]

    def run(rows: DataFrame, by: list[str], at: str) -> DataFrame:
        """Sums of rows in the order of `at`, with what came before taken in."""
        came = F.last("last", ignorenulls=True).over(W.partitionBy(*by).orderBy(at).rowsBetween(W.unboundedPreceding, -1))
        now, held, open_ = rows.withColumn("came", came), F.col("came"), F.col("came").isNull()
        return now.groupBy(*by).agg(
            F.max_by("last", F.when(F.col("last").isNotNull(), F.col(at))).alias("last"),
            F.sum(F.when(open_, F.col("n_head")).otherwise(0)).alias("n_head"), F.min(F.when(open_, F.col("first_head"))).alias("first_head"),
            F.sum(F.col("n_inside") + F.when(held, F.col("n_head")).otherwise(0)).alias("n_inside"), F.min(F.least("first_inside", F.when(held, F.col("first_head")))).alias("first_inside"),
        )

    blocks = run(masks.select("file", "block", "mask", "last", *sums("head"), *sums("inside")), ["file", "block"], "mask")
    files = run(blocks, ["file"], "block")
    return files.agg(F.coalesce(F.sum(F.col("n_inside") + F.coalesce(F.col("first_inside").bitwiseAND(1), F.lit(0))), F.lit(0)).alias("count"))


def _each(name: str) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """How records that are a column's elements are picked and counted."""
    return {
        "pick": lambda df: df.select(F.explode(name).alias("c")),
        "number": lambda df: df.agg(F.coalesce(F.sum(F.array_size(name)), F.lit(0)).alias("count")),
    }


def _yaml_fields(prefix: Column) -> dict[str, Column]:
    stamp = F.regexp_replace(F.regexp_replace(F.replace(F.col("LastModified"), F.lit(" "), F.lit("T")), r"\.\d+(?=(Z|\+00:?00)\z)", ""), r"\+00:?00\z", "Z")
    return {
        "key": F.coalesce("Key", F.lit("")), "size": F.col("Size"), "etag": F.nullif(unquoted(F.regexp_replace("ETag", r"\\\"", "\"")), F.lit("")),
        "mtime": stamp, "storage_class": F.nullif("StorageClass", F.lit("")),
    }


_nonempty = lambda: _v() != ""
_KEY_ONLY = lambda key: (lambda prefix: {"key": key()})
_UPPER_JSON = "Key string, Size bigint, ETag string, LastModified string, StorageClass string"
_LOWER_JSON = "key string, type string, size bigint, etag string, last_modified string, storage_class string"
_CAMEL_JSON = "key string, type string, size bigint, etag string, lastModified string, storageClass string"
_LSJSON = "Path string, Size bigint, ModTime string, IsDir boolean, Tier string"
PAGE_SCHEMA = "Contents array<struct<Key:string,Size:bigint,ETag:string,LastModified:string,StorageClass:string>>, CommonPrefixes array<struct<Prefix:string>>"

FORMATS: dict[str, Format] = {
    "tsv5": Format("N1", "lines", _five_tabbed, lambda: F.when(_v() != "", F.when(F.size(tabbed(_v())) == 5, True).otherwise(F.raise_error(F.concat(F.lit("a line without five fields: "), F.left(_v(), F.lit(200))))))),
    "contents": Format("N2", "rows", _contents, schema=PAGE_SCHEMA, **_each("Contents")),
    "common_prefixes": Format("N3", "rows", lambda p: {"key": F.col("c.Prefix")}, schema=PAGE_SCHEMA, **_each("CommonPrefixes")),
    "ls": Format("N4", "lines", _ls_fields, lambda: _ls(_v())[0] != ""),
    "ls_level": Format("N5", "lines", _ls_level, lambda: (_pre() != "") | (_ls(_v())[0] != "")),
    "yaml_pages": Format("N6", "lines", _yaml_fields, pick=_yaml_pages, number=_yaml_number),
    "tsv6": Format("N7", "lines", _six_tabbed, lambda: (_v() != "") & F.coalesce(field(tabbed(_v()), 6), F.lit("")).isin("", "OBJECT")),
    "sink_json": Format("N8", "json", _sink_rows, lambda: F.coalesce("row_type", F.lit("OBJECT")) == "OBJECT", "key string, size bigint, last_modified string, etag string, storage_class string, row_type string"),
    "table": Format(
        "N9", "lines", lambda p: {"key": F.expr("substring(value, 43)"), "size": F.trim(F.substring(_v(), 1, 14)), "mtime": F.trim(F.substring(_v(), 17, 24))},
        lambda: (F.expr("substring(value, 43)") != "") & ~F.trim(F.substring(_v(), 1, 14)).isin("", "-", "PRE"),
    ),
    "sink_parquet": Format(
        "N10", "rows",
        lambda p: {"key": F.decode("key", "UTF-8"), "size": F.col("size").cast("string"), "etag": F.col("etag"), "mtime": F.date_format("last_modified", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "storage_class": F.col("storage_class")},
        lambda: F.coalesce("row_type", F.lit("OBJECT")) == "OBJECT",
    ),
    "tsv_last": Format("N11", "lines", _last_tabbed, _nonempty),
    "aligned": Format("N12", "lines", _aligned, lambda: (F.length(_v()) >= 43) & (_aligned_parts()[2] != "") & ((_aligned_parts()[1] == "PRE") | ((_aligned_parts()[0] != "") & (_aligned_parts()[1] != "")))),
    "key_json": Format("N13", "json", _key_or_prefix, schema=f"{_UPPER_JSON}, Prefix string"),
    "keys": Format("N14", "lines", _KEY_ONLY(_v), _nonempty),
    "object_lines": Format("N15", "lines", _objects, lambda: _v().startswith("Object: ")),
    "path_json": Format("N16", "json", _path_tier, schema=_LSJSON),
    "path_level": Format("N17", "json", _path_level, schema=_LSJSON),
    "path_size": Format("N18", "lines", lambda p: {"key": F.concat(p, F.regexp_extract(_v(), r"(?s)\A(.*);", 1)), "size": F.regexp_extract(_v(), r"(?s);([^;]*)\z", 1)}, lambda: _v().contains(";")),
    "url_lines": Format("N19", "lines", _url_lines, lambda: (F.locate("s3://", _v()) > 0) & F.expr(f"locate('/', {_URL}) > 0") & (_url_key() != "")),
    "spaced": Format("N20", "lines", _spaced(), _not_dir),
    "spaced_versions": Format("N21", "lines", _spaced(lambda f: F.size(f) - 1), _not_dir),
    "spaced_level": Format("N22", "lines", _spaced_level, lambda: F.trim(_v()) != ""),
    "urls": Format("N23", "lines", _KEY_ONLY(lambda: F.regexp_replace(_v(), _BUCKET, "")), _nonempty),
    "url_json": Format(
        "N24", "json",
        lambda p: {"key": F.regexp_replace("key", _BUCKET, ""), "size": F.col("size").cast("string"), "etag": F.col("etag"), "mtime": F.col("last_modified"), "storage_class": F.col("storage_class")},
        lambda: ~F.col("type").eqNullSafe("dir"), _LOWER_JSON,
    ),
    "folder_json": Format("N25", "json", _folder_json, schema=_CAMEL_JSON),
    "found_json": Format("N26", "json", _found_json, schema=_CAMEL_JSON),
    "found": Format("N27", "lines", _KEY_ONLY(lambda: F.regexp_replace(_v(), _ALIAS, "")), lambda: ~_v().rlike(r"\A\s*\z")),
    "bracketed": Format("N28", "lines", _bracketed, lambda: _v().rlike(_BRACKETED)),
    "version_key": Format("N29", "lines", _KEY_ONLY(lambda: F.expr("substring(value, locate(' ', value) + 1)")), lambda: F.locate(" ", _v()) > 0),
    "long": Format("N30", "lines", lambda p: {"key": rest(awk_fields(_v()), 4)}, lambda: (F.trim(_v()) != "") & (F.size(awk_fields(_v())) >= 4)),
    "raw_json": Format("N31", "json", lambda p: {"key": F.col("Key"), "size": F.col("Size").cast("string"), "etag": unquoted(F.col("ETag")), "mtime": whole_seconds(F.col("LastModified")), "storage_class": F.col("StorageClass")}, schema=_UPPER_JSON),
    "epoch_parquet": Format("N32", "rows", lambda p: {"key": F.col("Key"), "size": F.col("Size").cast("string"), "etag": F.col("ETag"), "mtime": F.date_format(F.timestamp_seconds(F.col("LastModified").cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss'Z'")}),
    "totals": Format("N33", "lines", _KEY_ONLY(_v), lambda: F.lit(False)),
}


def _format(fmt: str) -> Format:
    if fmt not in FORMATS:
        raise ValueError(f"unknown listing format: {fmt}")
    return FORMATS[fmt]


def _parsed(form: Format) -> Column:
    return F.from_json("value", form.schema, {"mode": "FAILFAST"})


def normalize(raw: DataFrame, fmt: str, *, prefix: str | Column = "") -> DataFrame:
    """The five-field listing of `raw` in format `fmt`; an unknown format raises ValueError.

    raw: lines in a column value, or declared columns. prefix: the run's, as text or
    as a column of raw. Fields that a format doesn't expose are NULL.
    """
    form = _format(fmt)
    if form.raw == "json" and "value" in raw.columns:
        kept = [c for c in raw.columns if c != "value"]
        raw = raw.filter(_v() != "").select(*kept, _parsed(form).alias("j")).select(*kept, "j.*")
    rows = form.pick(raw)
    if form.where:
        rows = rows.filter(form.where())
    own = form.fields(F.lit(prefix) if isinstance(prefix, str) else prefix)
    return rows.select(*[own.get(f, F.lit(None)).cast("string").alias(f) for f in FIELDS])


def count_native(raw: DataFrame, fmt: str) -> DataFrame:
    """(count) of the records that `normalize` would return, without making their fields.

    Rows are judged by a column that is counted, not by a filter: a filter is pushed below the expression that makes `value`, which
    is then made anew for each place that names it.
    """
    form = _format(fmt)
    if form.number:
        return form.number(raw)
    some = F.lit(True)
    if form.raw == "json" and "value" in raw.columns:
        some = F.col("_some")
        raw = raw.select((_v() != "").alias("_some"), F.when(_v() != "", _parsed(form)).alias("j")).select("_some", "j.*")
    record = some & form.where() if form.where else some
    return raw.select(record.alias("_record")).agg(F.count_if("_record").alias("count"))


def counted_together(fmt: str) -> bool:
    """Whether `count_lines` counts a format: its records are told by a line alone."""
    form = _format(fmt)
    return form.number is None and (form.raw == "lines" or form.raw == "json" and form.where is None)


def count_lines(raw: DataFrame, formats: list[str]) -> DataFrame:
    """(format, count), as `count_native` of each of several formats, of lines (n, value), n being a line's format by its place in `formats`.

    So what the lines of several formats are made of is worked out once for a row.
    """
    def record(form: Format) -> Column:
        return form.where() if form.where and form.raw == "lines" else _v() != "" if form.raw == "json" else F.lit(True)

    sums = raw.agg(*[F.count_if(F.when(F.col("n") == i, record(_format(fmt)))).alias(f"c{i}") for i, fmt in enumerate(formats)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(fmt).alias("format"), F.col(f"c{i}").alias("count")) for i, fmt in enumerate(formats)])))


def delimiter_pages(raw: DataFrame) -> DataFrame:
    """A listing of one level from nested pages: common prefixes, then objects."""
    return normalize(raw, "common_prefixes").unionByName(normalize(raw, "contents"))
