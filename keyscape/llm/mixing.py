"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import checkpoint

#: Bins of the sampling keys, for each doubling of a key: a source's sums are gathered for each bin, and only the bin where
#: its budget ends is sorted. Whatever the weights, no bin draws more than about 0.37 * ln 2 / BINS of a source's distinct doc_ids,
#: as a weight only shifts the logarithm of a key; rows that repeat a doc_id (or have none) with like weights share a bin.
BINS = 1 << 12
#: Bins of a coarse bin.
COARSE = 1 << 8
#: Up to so many sources their totals are broadcast; more are joined by shuffles.
BROADCAST_SOURCES = 20_000


def n_words(text: Column) -> Column:
    """Runs of characters other than white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def text_weight(text: Column) -> Column:
    """A quality weight in 0.1 to 1.1: the share of letters among the characters, plus 0.1."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.coalesce(letters / F.greatest(F.length(text), F.lit(1)), F.lit(0.0)) + F.lit(0.1)


def bounded_weight(weight: Column) -> Column:
    """A caller's weight as a positive number: 0.1 for NULL and NaN, and at least 1e-6 and at most 1e6, for which zero, negative and infinite ones stand."""
    w = weight.cast("double")
    return F.when(w.isNull() | F.isnan(w), F.lit(0.1)).otherwise(F.least(F.greatest(w, F.lit(1e-6)), F.lit(1e6)))


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in order of code points, null last, take the weights in turn and share
    the total size by them. None gets more than `most` times its size; what is above
    goes to the others by weight until none is above. As the ones at their limit are those
    with the least size for their weight, running sums in that order find them.
    The windows span all sources in one task: a row for each source.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    s = sizes.withColumn("w", weight).withColumn("limit", F.col("source_size") * most)
    order = W.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(whole)).withColumn("spent", F.coalesce(F.sum("limit").over(before), F.lit(0)))
    s = s.withColumn("left", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("full", (F.col("total") - F.col("spent")).cast("decimal(38,0)") * F.col("w") > F.col("limit").cast("decimal(38,0)") * F.col("left"))
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(whole), F.lit(0))
    share = F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(whole), F.lit(1))
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise((rest * F.col("w")).cast("double") / share)
    return s.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", weight: Column | None = None, carry: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of each row of docs(doc_id, source, text), and its `carry` columns.

    A source takes complete epochs of all its documents while its target allows, then
    fills the rest by documents in order of their keys -ln(u) / weight (u from the
    doc_id; weight: a column of quality weights, made positive by `bounded_weight`, else that of the text); the
    document at which the budget ends gives only the words that are left. So taken is at most
    `most` times a size, and a source's taken words are its target, rounded down.

    Sums by coarse bins of the keys, then by the bins of one coarse bin, then by the keys of one bin find
    where a source's budget ends, so no window spans a source.

    Defined results: null source is a source of its own, last in order; a null text has
    size 0 and takes 0; weights of any value draw (`bounded_weight`); repeated rows count each for itself, ties of
    keys go by doc_id and text hash; an empty table gives no rows; other columns are ignored.
    """
    weight = text_weight(F.col("text")) if weight is None else bounded_weight(weight)
    sized = docs.select(
        F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"),
        (-F.log(uniform(F.col("doc_id"), seed)) / weight).alias("key"), F.xxhash64("text").alias("tie"), F.struct(*[F.col(f"`{c}`") for c in carry] or [F.lit(0)]).alias("doc"),
    ).withColumn("bin", F.floor(F.log2("key") * BINS).cast("long"))
    if not carry:
        sized = sized.drop("doc")
    sized = checkpoint(sized)
    bins = checkpoint(sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")))
    targets = checkpoint(source_targets(bins.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, most))
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))

    def edge(parts: DataFrame, name: str, known: DataFrame) -> DataFrame:
        """known(source, budget, before) with `name` and `before` of the first of parts(source, name, n) that goes over the budget; NULL if none does."""
        upto = F.sum("n").over(W.partitionBy("source").orderBy(name).rowsBetween(W.unboundedPreceding, W.currentRow))
        s = known.select(F.col("source").alias("s"), "budget", "before")
        run = parts.withColumn("upto", upto).join(s, F.col("source").eqNullSafe(F.col("s"))).withColumn("upto", F.col("upto") + F.col("before"))
        first = run.filter("upto > budget").groupBy("source").agg(F.min(F.struct(name, (F.col("upto") - F.col("n")).alias("before"))).alias("e"))
        return first.select("source", f"e.{name}", "e.before")

    start = targets.select("source", "budget", F.lit(0).cast("long").alias("before"))
    coarse = edge(bins.groupBy("source", F.floor(F.col("bin") / COARSE).alias("coarse")).agg(F.sum("bin_size").alias("n")), "coarse", start)
    coarse = checkpoint(coarse.withColumnRenamed("source", "of").join(targets.select("source", "budget"), F.col("of").eqNullSafe(F.col("source"))).drop("of"))
    inside = bins.join(coarse.select(F.col("source").alias("of"), "coarse"), F.col("source").eqNullSafe(F.col("of")) & (F.floor(F.col("bin") / COARSE) == F.col("coarse")))
    fine = edge(inside.select("source", "bin", F.col("bin_size").alias("n")), "bin", coarse)
    few = targets.join(fine.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("of"), "source_size", "target", "epochs", "budget", F.coalesce("bin", F.lit(2**62)).alias("edge"), F.coalesce("before", F.lit(0)).alias("before")
    )
    few = checkpoint(few)
    if few.count() <= BROADCAST_SOURCES:
        few = F.broadcast(few)
    out = sized.join(few, F.col("source").eqNullSafe(F.col("of")))
    order = W.partitionBy("source").orderBy("key", "doc_id", "tie", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    at_edge = out.filter("bin = edge").withColumn("left", F.col("budget") - F.col("before") - F.sum("size").over(order) + F.col("size"))
    at_edge = at_edge.withColumn("part", F.greatest(F.lit(0), F.least("left", "size"))).drop("left")
    others = out.filter("bin <> edge").withColumn("part", F.when(F.col("bin") < F.col("edge"), F.col("size")).otherwise(0))
    return others.unionByName(at_edge).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), *[F.col(f"doc.`{c}`") for c in carry]
    )
