"""Keyspace analytics of a listing: prefixes, depth, pages, cut points, segments, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyscape.functions.listing import depth
from keyscape.operators.ranges import ranged

#: Fixed value: keys of a listing page.
PAGE = 1000
#: Cut points up to this number are held as one sorted array, searched by its every STRIDE-th entry first; more are joined by range.
ARRAY_CUTS, STRIDE = 4096, 64


def listing_summary(df: DataFrame) -> DataFrame:
    """K1: rows, distinct keys and bytes."""
    return df.agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_keys"), F.coalesce(F.sum(F.col("size").try_cast("bigint")), F.lit(0)).alias("bytes"))


def prefix(key: Column, level: int = 1) -> Column:
    """The key's first `level` segments with their slashes; NULL for a key of fewer."""
    return F.when(depth(key) >= level, F.concat(F.substring_index(key, "/", level), F.lit("/")))


def prefix_counts(df: DataFrame, level: int = 1) -> DataFrame:
    """K2: keys by their first segments; keys of fewer segments stand together under a NULL prefix."""
    return df.groupBy(prefix(F.col("key"), level).alias("prefix")).agg(F.count("*").alias("n"))


def depth_histogram(df: DataFrame) -> DataFrame:
    """K3: keys by their number of slashes."""
    return df.groupBy(depth(F.col("key")).alias("depth")).agg(F.count("*").alias("n"))


def top_prefixes(df: DataFrame, level: int, k: int) -> DataFrame:
    """K4: the k prefixes of a level with the most keys, ties by the prefix."""
    return prefix_counts(df, level).filter("prefix is not null").orderBy(F.desc("n"), "prefix").limit(k)


def delimiter_rollup(df: DataFrame, under: str = "", delimiter: str = "/") -> DataFrame:
    """K5: what a listing under a prefix with a delimiter shows: (name, is_prefix, n), one row for a common prefix."""
    tail = F.substring("key", F.lit(len(under) + 1), F.length("key"))
    at = F.locate(delimiter, tail)
    name = F.when(at > 0, F.concat(F.lit(under), F.substring(tail, F.lit(1), at + len(delimiter) - 1))).otherwise(F.col("key"))
    return df.filter(F.col("key").startswith(under)).groupBy(name.alias("name"), (at > 0).alias("is_prefix")).agg(F.count("*").alias("n"))


def scope(df: DataFrame, under: str) -> DataFrame:
    """K6: the keys under a prefix."""
    return df.filter(F.col("key").startswith(under))


def scope_counts(df: DataFrame, registry: DataFrame) -> DataFrame:
    """K6: (prefix, registered, found, agrees) of registry(prefix, keys): how many keys are under each prefix, and whether that is the registered number.

    A key counts for each prefix that it begins with. Only its beginnings of registered lengths are looked up, so a
    key takes a row for each length, not for each prefix; a prefix that is registered twice is compared twice.
    """
    lengths = F.broadcast(registry.agg(F.collect_set(F.length("prefix")).alias("_lengths")))  # one row
    starts = df.join(lengths).select(F.explode(F.filter("_lengths", lambda n: n <= F.length("key"))).alias("_n"), "key")
    n = starts.groupBy(F.substring("key", F.lit(1), F.col("_n")).alias("prefix")).agg(F.count("*").alias("found"))
    both = registry.select("prefix", F.col("keys").alias("registered")).join(n, "prefix", "left")
    return both.select("prefix", "registered", F.coalesce("found", F.lit(0)).alias("found"), F.col("registered").eqNullSafe(F.coalesce("found", F.lit(0))).alias("agrees"))


def key_range(df: DataFrame, after: str | None = None, before: str | None = None, n: int | None = None) -> DataFrame:
    """K7: keys after one and before another, both left out; the first n in key order."""
    if after is not None:
        df = df.filter(F.col("key") > after)
    if before is not None:
        df = df.filter(F.col("key") < before)
    return df if n is None else df.orderBy("key").limit(n)


def global_rank(df: DataFrame, *order: str, partitions: int | None = None) -> DataFrame:
    """df with `rank`, 1 for the first row: ranges are counted first, and each is numbered from its offset.

    No task sees more than its range, and rows of one key may lie in several; only one count for each range is gathered,
    by a window over them. Rows that are equal in `order` are numbered in any order.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = ranged(df, *order, partitions=n, salted=True)
    # the numbers of ranges follow their order
    sizes = parts.groupBy("_range").agg(F.count("*").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_range", offset.alias("_offset"))
    own = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return parts.join(F.broadcast(sizes), "_range").withColumn("rank", own + F.col("_offset")).drop("_range", "_offset")


def page_numbers(df: DataFrame, size: int = PAGE) -> DataFrame:
    """K8: (key, page) with pages of `size` keys in key order, from 1."""
    return global_rank(df.select("key"), "key").select("key", F.ceil(F.col("rank") / size).cast("long").alias("page"))


def rollup_pages(df: DataFrame, under: str = "", delimiter: str = "/", size: int = PAGE) -> DataFrame:
    """K8: (name, is_prefix, n, page) of a listing under a prefix with a delimiter: a common prefix is one entry of a page, however many keys it holds."""
    return global_rank(delimiter_rollup(df, under, delimiter), "name").select("name", "is_prefix", "n", F.ceil(F.col("rank") / size).cast("long").alias("page"))


def page_count(df: DataFrame, size: int = PAGE) -> DataFrame:
    """K8: rows and pages."""
    return df.agg(F.count("*").alias("n"), F.ceil(F.count("*") / size).cast("long").alias("pages"))


def sortedness(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """K9: rows of df(file, line_no, key) whose key is below that of the line before, in byte order.

    Files are cut into ranges of lines. A range is summed up by its last key, which the next range of its file begins
    with, so no window spans a file. Of several rows with one line_no of a file, all but the first of a range
    follow each other in any order.
    """
    parts = ranged(df.select("file", "line_no", "key"), "file", "line_no", partitions=partitions)
    ends = parts.groupBy("file", "_range").agg(F.max_by("key", "line_no").alias("_last"))
    ends = ends.select("file", "_range", F.lag("_last").over(W.partitionBy("file").orderBy("_range")).alias("_came"))  # a row for each range
    last = F.lag("key").over(W.partitionBy("file", "_range").orderBy("line_no"))
    first = F.row_number().over(W.partitionBy("file", "_range").orderBy("line_no")) == 1
    run = parts.select("file", "_range", "line_no", "key", last.alias("before"), first.alias("first")).filter("first or key < before")
    same = (F.col("r.file").eqNullSafe(F.col("e.file"))) & (F.col("r._range") == F.col("e._range"))
    heads = run.filter("first").alias("r").join(ends.alias("e"), same).select("r.file", "r.line_no", "r.key", F.col("e._came").alias("before"))
    return run.filter("not first").select("file", "line_no", "key", "before").unionByName(heads).filter("key < before")


def parent(key: Column) -> Column:
    """The key up to its last slash; empty for a key without one."""
    return F.regexp_extract(key, r"(?s)\A(.*/)?", 0)


def key_distribution(df: DataFrame) -> DataFrame:
    """(prefix, count) of the directories of keys; sorted by a sink, not here."""
    return df.groupBy(parent(F.col("key")).alias("prefix")).agg(F.count("*").alias("count"))


def cut_points(dist: DataFrame, n: int) -> DataFrame:
    """(number, cut): the prefixes at which the running count first reaches 1/n, 2/n ... of all, without the last.

    Ranges of prefixes are summed first and run on from their offsets, so no
    window spans the whole distribution.
    """
    parts = ranged(dist, "prefix")
    sums = parts.groupBy("_range").agg(F.sum("count").alias("_n"))
    order = W.orderBy("_range")
    sums = sums.select("_range", F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"), F.sum("_n").over(W.partitionBy()).alias("_total"))
    own = F.sum("count").over(W.partitionBy("_range").orderBy("prefix").rowsBetween(W.unboundedPreceding, W.currentRow))
    run = parts.join(F.broadcast(sums), "_range").withColumn("upto", own + F.col("_offset"))
    step = lambda c: F.floor(c * n / F.col("_total"))
    crossed = run.filter((step(F.col("upto")) > step(F.col("upto") - F.col("count"))) & (F.col("upto") < F.col("_total")))
    return crossed.select(F.row_number().over(W.orderBy("prefix")).cast("long").alias("number"), F.col("prefix").alias("cut"))  # fewer than n rows


def check_cut_points(cuts: DataFrame, n: int) -> DataFrame:
    """(cuts, problem): none, one empty, the first empty, far fewer than asked for, or NULL."""
    a = cuts.agg(F.count("*").alias("cuts"), F.min_by("cut", "number").alias("first"))
    problem = F.when(F.col("cuts") == 0, "none").when((F.col("cuts") == 1) & (F.col("first") == ""), "single empty").when(F.col("first") == "", "first empty").when(F.col("cuts") * 2 < n - 1, "too few")
    return a.select("cuts", problem.alias("problem"))


def assign_segment(df: DataFrame, cuts: DataFrame) -> DataFrame:
    """Df with `segment`, the number of cut points at or below the key.

    Up to ARRAY_CUTS cuts are one broadcast array, searched in each row; more are
    merged with the keys by range, and a running count numbers them; a key of very many rows is split.
    """
    n = cuts.count()
    if n <= ARRAY_CUTS:
        held = cuts.agg(F.array_sort(F.collect_list("cut")).alias("_cuts"))
        held = held.withColumn("_marks", F.filter("_cuts", lambda c, i: i % STRIDE == STRIDE - 1))
        upto = lambda a: F.size(F.filter(a, lambda c: c <= F.col("key")))
        marked = df.join(F.broadcast(held)).withColumn("_before", upto(F.col("_marks")) * STRIDE)  # one row
        own = upto(F.slice("_cuts", F.col("_before") + 1, F.lit(STRIDE)))
        return marked.withColumn("segment", (F.col("_before") + own).cast("long")).drop("_cuts", "_marks", "_before")
    marked = df.select("key", F.struct(*df.columns).alias("_row"), F.lit(1).alias("_kind")).unionByName(cuts.select(F.col("cut").alias("key"), F.lit(0).alias("_kind")), allowMissingColumns=True)
    parts = ranged(marked, "key", "_kind", salted=True)  # cuts stand in front of the rows of their key, which may lie in several ranges
    is_cut = (F.col("_kind") == 0).cast("long")
    sums = parts.groupBy("_range").agg(F.sum(is_cut).alias("_n"))
    sums = sums.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    own = F.sum(is_cut).over(W.partitionBy("_range").orderBy("key", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow))
    return parts.join(F.broadcast(sums), "_range").withColumn("segment", own + F.col("_offset")).filter("_kind = 1").select("_row.*", "segment")


def boundary_loss(df: DataFrame, cuts: DataFrame) -> DataFrame:
    """Keys equal to a cut point, which lie in neither of two open slices."""
    return df.join(cuts.select(F.col("cut").alias("key")), "key", "left_semi")


def segment_balance(df: DataFrame, cuts: DataFrame) -> DataFrame:
    """(segment, n, share, skew): keys by segment, their share of all and their ratio to the mean."""
    n = assign_segment(df, cuts).groupBy("segment").agg(F.count("*").alias("n"))
    whole = W.partitionBy()  # a row for each segment
    return n.select("segment", "n", F.round(F.col("n") / F.sum("n").over(whole), 6).alias("share"), F.round(F.col("n") / F.avg("n").over(whole), 6).alias("skew"))


def shard_union_audit(shards: DataFrame, whole: DataFrame) -> DataFrame:
    """(key, problem): `repeated` in several of shards(shard, key), `gap` for keys of no shard, `stray` for keys of the whole's none."""
    s = shards.groupBy("key").agg(F.count_distinct("shard").alias("n"))
    both = s.join(whole.select("key").distinct().withColumn("_in", F.lit(1)), "key", "full_outer")
    problem = F.when(F.col("n").isNull(), "gap").when(F.col("_in").isNull(), "stray").when(F.col("n") > 1, "repeated")
    return both.select("key", problem.alias("problem")).filter("problem is not null")


def bucket_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, flag): keys only `left`, only `right`, or `changed` in size or etag; of a repeated key the smallest (size, etag) counts."""
    a, b = (df.groupBy("key").agg(F.min(F.struct("size", "etag")).alias(n)) for df, n in ((left, "a"), (right, "b")))
    flag = F.when(F.col("b").isNull(), "left").when(F.col("a").isNull(), "right").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, "key", "full_outer").select("key", flag.alias("flag")).filter("flag is not null")


def drift(old: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """One row: keys gone and come, keys of `new` later than as_of (an ISO time), and the newest time."""
    both = old.select("key").distinct().withColumn("a", F.lit(1)).join(new.groupBy("key").agg(F.max("mtime").alias("mtime"), F.lit(1).alias("b")), "key", "full_outer")
    return both.agg(
        F.count(F.when(F.col("b").isNull(), 1)).alias("gone"), F.count(F.when(F.col("a").isNull(), 1)).alias("come"),
        F.count(F.when(F.col("mtime") > as_of, 1)).alias("later"), F.max("mtime").alias("newest"),
    )


def exactly_once(df: DataFrame) -> DataFrame:
    """Rows, distinct keys, and rows for each distinct key."""
    return df.agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_keys")).withColumn("ratio", F.round(F.col("n") / F.col("n_keys"), 6))


def fanout(df: DataFrame) -> DataFrame:
    """Distinct children of each directory: its own keys' names and its directories' names."""
    at = F.explode(F.sequence(F.lit(0), F.size("s") - 1)).alias("at")
    parts = df.select(F.split("key", "/", -1).alias("s")).select("s", at)
    child = F.concat(F.get("s", F.col("at")), F.when(F.col("at") < F.size("s") - 1, F.lit("/")).otherwise(""))
    above = F.concat(F.array_join(F.slice("s", F.lit(1), F.col("at")), "/"), F.when(F.col("at") > 0, F.lit("/")).otherwise(""))
    return parts.select(above.alias("parent"), child.alias("child")).groupBy("parent").agg(F.count_distinct("child").alias("children"))


def byte_density(df: DataFrame, place: int = 1) -> DataFrame:
    """Keys by their byte number `place`, as two hex digits."""
    return df.groupBy(F.lower(F.hex(F.substring(F.encode("key", "UTF-8"), place, 1))).alias("byte")).agg(F.count("*").alias("n"))


def etag_kind(df: DataFrame) -> DataFrame:
    """(key, kind, parts): `multipart` with the number of parts for an etag that ends in -N, else `single`."""
    parts = F.nullif(F.regexp_extract("etag", r"-(\d+)\z", 1), F.lit("")).cast("long")
    return df.select("key", F.when(parts.isNotNull(), "multipart").when(F.col("etag").isNotNull(), "single").alias("kind"), parts.alias("parts"))


def version_collapse(df: DataFrame) -> DataFrame:
    """Keys of several rows with their number, as a versions listing has them."""
    return df.groupBy("key").agg(F.count("*").alias("versions")).filter("versions > 1")


def decode_keys(df: DataFrame) -> DataFrame:
    """Keys percent-decoded once; a plus sign is itself. A key with a malformed escape stays as it is: see `malformed_escapes`."""
    return df.withColumn("key", F.coalesce(_decoded(), "key"))


def _decoded() -> Column:
    """The decoded key; NULL if a percent sign isn't followed by two hex digits, or the bytes aren't UTF-8."""
    shape = F.col("key").rlike(r"\A(?:[^%]|%[0-9A-Fa-f]{2})*+\z")
    text = F.try_url_decode(F.replace("key", F.lit("+"), F.lit("%2B")))
    return F.when(shape & ~F.contains(text, F.lit("\ufffd")), text).when(shape & F.upper("key").contains("%EF%BF%BD"), text)


def malformed_escapes(df: DataFrame) -> DataFrame:
    """Rows whose key isn't a percent-encoded one, with `reason`; the others are fit for `decode_keys`."""
    return df.filter(F.col("key").isNotNull() & _decoded().isNull()).withColumn("reason", F.lit("malformed escape"))
