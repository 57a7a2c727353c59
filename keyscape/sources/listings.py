"""Readers and writers of listings, evidence, receipts, claims and reports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyscape.functions.listing import FIELDS, UNEXPOSED
from keyscape.operators.normalize import PAGE_SCHEMA
from keyscape.sources.json_parts import BROADCAST_RANGES, array_elements, files_of, object_members
from keyscape.sources.shared import checkpoint, to_workers

#: Up to so many characters of files' members are broadcast.
BROADCAST_TEXT = 1 << 25


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of its own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file) of lines ended by LF alone; .gz is read as it is, one task for a file.

    Carriage returns and NUL are part of a line, and a last line without LF counts.
    """
    return spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """The five fields of a tab-separated listing as text, `-` and empty as they stand; `n_fields` tells ragged lines."""
    f = F.split("value", "\t", -1)
    return read_lines(spark, path).select(*[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(FIELDS)], F.size(f).alias("n_fields"))


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S3: a JSON object on each line, in declared columns; a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("lineSep", "\n").json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of one JSON array each; an element is a row. One file is read by as many tasks as it has ranges; malformed text fails the job."""
    return array_elements(spark, path).select(F.from_json("element", schema, {"mode": "FAILFAST"}).alias("e")).select("e.*")


def read_json_object(spark: SparkSession, path: str, schema: str = PAGE_SCHEMA) -> DataFrame:
    """Files of one JSON object each, with nested arrays, in rows that `explode` takes apart like the objects themselves.

    Each element of a declared array is a row, with that array of one element, the file's other declared members, and NULL for its other arrays; a
    file without elements is one row. So neither a file nor an array is ever one value, and one file is read by many tasks. Absent and null
    arrays are NULL; members that aren't declared are skipped; malformed text fails the job. Of a repeated member the elements of all
    count, and the largest text of other values.
    """
    kind = T._parse_datatype_string(schema)
    arrays = [f for f in kind.fields if isinstance(f.dataType, T.ArrayType)]
    plain = [f for f in kind.fields if not isinstance(f.dataType, T.ArrayType)]
    own = lambda f: T.StructType([T.StructField("v", f.dataType)])
    parsed = lambda f, value: F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), own(f), {"mode": "FAILFAST"})["v"]
    found = object_members(spark, path)
    element = F.col("is_array") & F.col("field").isin([f.name for f in arrays])
    # a row for each file; counting all values has each one refused that is malformed, declared or not
    held = found.groupBy("file").agg(*[F.max(F.when(~F.col("is_array") & (F.col("field") == f.name), F.col("value"))).alias(f.name) for f in plain], F.count("value").alias("_n"), F.count_if(element).alias("_elements"))
    held = checkpoint(files_of(spark, path).select("file").join(held, "file", "left").filter(F.coalesce("_n", F.lit(0)) >= 0))
    size = held.agg(F.count("*").alias("n"), *[F.sum(F.length(f.name)).alias(f.name) for f in plain]).first()
    members = held.select("file", *[f.name for f in plain])
    members = F.broadcast(members) if size["n"] <= BROADCAST_RANGES and sum(size[f.name] or 0 for f in plain) <= BROADCAST_TEXT else members
    value = F.concat(F.lit("["), "value", F.lit("]"))
    each = found.filter(element).join(members, "file") if plain else found.filter(element)
    # behind `inline`, as a filter on an array would be pushed below its parsing and parse each text twice
    if arrays:
        each = each.select(*[f.name for f in plain], F.inline(F.array(F.struct(*[F.when(F.col("field") == f.name, parsed(f, value)).alias(f.name) for f in arrays]))))
    else:
        each = each.select(*[f.name for f in plain])
    none = held.filter(F.coalesce("_elements", F.lit(0)) == 0).select(*[f.name for f in plain], *[F.lit(None).cast(f.dataType).alias(f.name) for f in arrays])
    return each.unionByName(none).select(*[parsed(f, F.col(f.name)).alias(f.name) if f in plain else F.col(f.name) for f in kind.fields])


def _has_part(spark: SparkSession, root: str) -> bool:
    """Whether any Parquet file lies below root; the folder is listed up to the first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True)
    while found.hasNext():
        name = found.next().getPath().getName()
        if name.endswith(".parquet") and name[0] not in "_.":
            return True
    return False


def read_dataset(spark: SparkSession, root: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A Parquet dataset that its writer finished; one without `_SUCCESS` or without a part raises ValueError."""
    if not _exists(spark, f"{root.rstrip('/')}/_SUCCESS"):
        raise ValueError(f"{root} is not complete: it has no _SUCCESS")
    if not _has_part(spark, root):
        raise ValueError(f"{root} is not complete: it has no part")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(root)


def _unreadable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, problem) of the files whose footer isn't that of a Parquet file."""
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            store, name = _store(path)
            with store.open_input_file(name) as file:
                try:
                    pq.read_metadata(file)
                except (pa.ArrowInvalid, OSError) as e:
                    found.append((path, str(e)[:200]))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], ["path", "problem"])


_EPOCH = "Key string, Size bigint, LastModified bigint, ETag string"


def read_epoch_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Key, Size, LastModified (epoch seconds) and ETag of Parquet files, wide unsigned integers as BIGINT.

    A file of 0 bytes has no rows; if any other file isn't Parquet, ValueError names the first by its path: tasks read the footers of all files. The
    paths of the files reach the driver, which plans their scan.
    """
    lengths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")  # lengths alone: no content is read
    held = [r["path"] for r in lengths.filter("length > 0").collect()]
    if not held:
        return spark.createDataFrame([], _EPOCH)
    to_workers(spark)
    bad = lengths.filter("length > 0").select("path").repartition(F.col("path")).mapInArrow(_unreadable, "path string, problem string").agg(F.min(F.struct("path", "problem")).alias("b")).first()["b"]
    if bad:
        raise ValueError(f"{bad['path']} is not readable Parquet: {bad['problem']}")
    try:
        df = spark.read.parquet(*held)
    except (AnalysisException, Py4JJavaError) as e:
        raise ValueError(f"{path} is not readable Parquet: {e}") from e
    return df.select("Key", F.col("Size").cast("bigint").alias("Size"), F.col("LastModified").cast("bigint").alias("LastModified"), "ETag")


def read_evidence(spark: SparkSession, path: str, name: str = "result.json") -> DataFrame:
    """(prefix, sha256, doc, content) of each `name` below path: the folder, the digest of its bytes, and JSON as a variant (NULL if bad)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(path)
    text = F.decode("content", "UTF-8")
    return files.select(F.regexp_replace("path", r"/[^/]*\z", "").alias("prefix"), F.sha2("content", 256).alias("sha256"), F.try_parse_json(text).alias("doc"), text.alias("content"))


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    """(path, kv) of files of `key=value` lines; a key's first line counts."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    rows = files.select("path", F.posexplode(F.split("value", "\n")).alias("at", "line")).filter(F.col("line").contains("="))
    key = F.substring_index("line", "=", 1)
    rows = rows.select("path", "at", key.alias("k"), F.substring("line", F.length(key) + 2, F.length("line")).alias("v"))
    first = rows.withColumn("n", F.row_number().over(W.partitionBy("path", "k").orderBy("at"))).filter("n = 1")
    return first.groupBy("path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("kv"))


_CLAIMS = (
    "tool string, claims array<struct<id:string,statement:string,scope:string,status:string,disposition:string,qualification:string,legacy_origins:array<string>,"
    "evidence:array<struct<kind:string,subject:string,repository:string,commit:string,path:string,lines:string,url:string,receipt:string,artifact:string,reason:string>>>>"
)


def read_claims(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(claims, evidence) of claim ledgers, one JSON object in a file."""
    c = read_json_object(spark, path, _CLAIMS).select("tool", F.explode("claims").alias("c")).select("tool", "c.*")
    e = c.select("tool", F.col("id").alias("claim_id"), F.explode("evidence").alias("e")).select("tool", "claim_id", "e.*")
    return c, e


#: Bytes of a file that are hashed at a time.
_HASHED = 1 << 22


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a qualified path, and its name there."""
    scheme, _, rest = path.partition(":")
    return (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(quote(path, safe=":/@"))


def _listed(root: str):
    """The files below root by their names, folder by folder; names that begin with . or _ are hidden, as they are to Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            store, top = _store(root)
            folders = [top.rstrip("/")] * batch.num_rows
            while folders:
                here = [x for x in store.get_file_info(fs.FileSelector(folders.pop())) if x.base_name[0] not in "._"]
                folders += [x.path for x in here if x.type == fs.FileType.Directory]
                names = [x.path[len(top.rstrip("/")) :].lstrip("/") for x in here if x.type == fs.FileType.File]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["path"])

    return run


def _digests(root: str):
    """(path, sha256, size) of files by their names below root, read as streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            store, top = _store(root)
            out = []
            for path in batch.column("path").to_pylist():
                digest, size = hashlib.sha256(), 0
                with store.open_input_stream(f"{top.rstrip('/')}/{path}", compression=None) as stream:
                    while block := stream.read(_HASHED):
                        digest.update(block)
                        size += len(block)
                out.append((digest.hexdigest(), size))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.int64())], ["path", "sha256", "size"])

    return run


def artifact_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256, size) of all files below root, by their relative path.

    One task lists the names, which are dealt out, and each file is streamed through its hash, so it may have any size; empty
    files count. root is in a store that pyarrow opens on the executors (local, HDFS, S3, GCS).
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    to_workers(spark)
    names = spark.range(1, numPartitions=1).mapInArrow(_listed(whole), "path string")
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return names.repartition(slots, "path").mapInArrow(_digests(whole), "path string, sha256 string, size long")


def canonical_line(columns: list[str] | None = None) -> Column:
    """A listing row as a tab-separated line, `-` for NULL."""
    return F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit(UNEXPOSED)) for c in columns or FIELDS])


def write_canonical(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A listing as Parquet, or as tab-separated text (`tsv`)."""
    if fmt == "parquet":
        df.select(*FIELDS).write.parquet(path)
    elif fmt == "tsv":
        df.select(canonical_line().alias("value")).write.option("lineSep", "\n").text(path)
    else:
        raise ValueError(f"unknown sink: {fmt}")


def store_listing(df: DataFrame, table: str, path: str, buckets: int | None = None, row_group: int = 1 << 24) -> DataFrame:
    """A listing stored for comparisons and range scans: a table of `buckets` by key, each sorted by key, its files below path.

    Two listings stored with as many buckets are joined by key without a shuffle, and a prefix or a range of keys reads only the
    row groups of `row_group` bytes that may hold it. Of an existing table of that name the old rows are replaced.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.select(*FIELDS).repartition(n, "key").write.bucketBy(n, "key").sortBy("key").format("parquet")
    writer.option("parquet.block.size", row_group).option("path", path).mode("overwrite").saveAsTable(table)
    return spark.table(table)


def _cell(c: Column) -> Column:
    """A value in a Markdown table: `-` for NULL, bars escaped, line ends as blanks."""
    text = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("-")), r"\r\n|[\r\n]", " ")
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def _row(columns: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *columns), F.lit(" |"))


def report_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line) of a Markdown table: a line for each row, `-` for NULL, bars escaped and line ends as blanks."""
    return rows.select(_row([_cell(F.col(c)) for c in columns]).alias("line"))


def report_sections(rows: DataFrame, columns: list[str], notes: DataFrame | None = None, blocked: DataFrame | None = None, by: str = "bucket", order: tuple[str, ...] = ("attempt_id",)) -> DataFrame:
    """(section, part, at, line) of a Markdown report, which stands in the order of the first three.

    In front, a line for each of blocked(note). Then a section for each `by`: title, header and rows in `order` as
    `report_table` has them, and a part for each title of notes(by, title, note), as `Comparison strata`,
    `Rate cases` and `Preparations`, in their order. Rows are numbered within their section alone;
    rows of a NULL section stand under `-`.
    """
    name, none = F.coalesce(F.col(by).cast("string"), F.lit("-")), F.lit("")
    at = F.row_number().over(W.partitionBy("section").orderBy(*order))
    heads = rows.select(name.alias("section")).distinct()
    fixed = lambda *lines: F.explode(F.array(*[F.struct(F.lit(k - len(lines)).alias("at"), x.alias("line")) for k, x in enumerate(lines)]))
    top = heads.select("section", F.lit("").alias("part"), fixed(F.concat(F.lit("## "), "section"), none, F.lit("| " + " | ".join(columns) + " |"), F.lit("| " + " | ".join("---" for _ in columns) + " |")).alias("l"))
    out = top.select("section", "part", F.col("l.at").cast("long").alias("at"), "l.line")
    body = rows.withColumn("section", name).select("section", none.alias("part"), at.cast("long").alias("at"), _row([_cell(F.col(c)) for c in columns]).alias("line"))
    out = out.unionByName(body)
    if notes is not None:
        own = notes.select(name.alias("section"), F.col("title").alias("part"), F.concat(F.lit("- "), F.regexp_replace("note", r"\r\n|[\r\n]", " ")).alias("line"))
        lines = own.withColumn("at", F.row_number().over(W.partitionBy("section", "part").orderBy("line")).cast("long"))
        titles = own.select("section", "part").distinct().select("section", "part", fixed(none, F.concat(F.lit("### "), "part"), none).alias("l")).select("section", "part", F.col("l.at").cast("long").alias("at"), "l.line")
        out = out.unionByName(titles).unionByName(lines.select("section", "part", "at", "line"))
    if blocked is not None:
        owed = blocked.select(none.alias("section"), none.alias("part"), F.row_number().over(W.orderBy("note")).cast("long").alias("at"), F.concat(F.lit("> **Blocked slot**: "), "note", F.lit(" -- this group is incomplete.")).alias("line"))  # few slots
        out = out.unionByName(owed)
    return out
