"""Set comparison of listings: differences, verdicts, strata and groups.

Many listings are compared at once: rows carry their group and their number in it, 0 for the reference.
One aggregation by (group, key) holds which members have a key and tells, by hashes of the fields, which keys have
rows that aren't all alike; values are joined for these keys alone, and reference rows stay rows, so
a key of any number of rows never becomes one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyscape.functions.listing import FIELDS
from keyscape.sources.shared import checkpoint

#: Verdicts from mild to bad, and the exit codes of a group.
VERDICTS = ("UNCOMPARED", "PASS", "DRIFT", "FAIL")
EXIT_CODES = {"UNCOMPARED": 0, "PASS": 0, "DRIFT": 2, "FAIL": 1, "INCOMPLETE": 9}
_VALUES = FIELDS[1:]


def missing_keys(ref: DataFrame, act: DataFrame) -> DataFrame:
    """A row for each reference row whose key the actual listing lacks; duplicates stay."""
    return ref.select("key").join(act.select("key"), "key", "left_anti")


def extra_keys(ref: DataFrame, act: DataFrame) -> DataFrame:
    """A row for each actual row whose key the reference lacks."""
    return missing_keys(act, ref)


def duplicate_keys(df: DataFrame) -> DataFrame:
    """Keys of several rows, once, with their count."""
    return df.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")


def first_per_key(df: DataFrame) -> DataFrame:
    """One row for each key, the least by (size, etag, mtime, storage_class) with NULL first."""
    least = F.min(F.struct(*_VALUES)).alias("v")
    return df.groupBy("key").agg(least).select("key", "v.*")


def _differs(name: str, a: Column, b: Column) -> Column:
    return F.lower(a) != F.lower(b) if name == "etag" else a != b


def _mismatches(tool: Column, reference: Column) -> Column:
    """An array of (field, tool_value, reference_value) where both sides expose the field and differ."""
    each = [
        F.when(_differs(f, tool[f], reference[f]), F.struct(F.lit(f).alias("field"), tool[f].alias("tool_value"), reference[f].alias("reference_value")))
        for f in _VALUES
    ]
    return F.array_compact(F.array(*each))


def field_mismatches(ref: DataFrame, act: DataFrame) -> DataFrame:
    """(key, field, tool_value, reference_value); a key's repeated reference rows each count."""
    both = ref.select("key", F.struct(*_VALUES).alias("r")).join(first_per_key(act).select("key", F.struct(*_VALUES).alias("t")), "key")
    return both.select("key", F.explode(_mismatches(F.col("t"), F.col("r"))).alias("m")).select("key", "m.*")


def tagged(ref: DataFrame, act: DataFrame, pair: Column | None = None) -> DataFrame:
    """Both sides as one table (pair, side, key, ...), side 0 for the reference."""
    pair = F.lit("") if pair is None else pair
    return ref.select(pair.alias("pair"), F.lit(0).alias("side"), *FIELDS).unionByName(act.select(pair.alias("pair"), F.lit(1).alias("side"), *FIELDS))


#: Keys that differ are broadcast up to this number, as attempts are.
BROADCAST_KEYS = 100_000
#: Slots of the bitmap of keys that differ: for each key, and at most; 512 of them are one row, so 262,144 rows of 8 words.
_SLOTS, _MOST_SLOTS, _LINE = 64, 1 << 27, 8
#: Rows that one array repeats; a count beyond is dealt over several arrays.
_REPEATS = 4096


def _repeated(df: DataFrame, n: Column) -> DataFrame:
    """df with each row n times, by arrays that don't grow with n."""
    whole = df.withColumn("_left", n).withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_left") - 1, F.lit(_REPEATS).cast("long"))))
    return whole.withColumn("_one", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(_REPEATS).cast("long"), F.col("_left") - F.col("_at"))))).drop("_left", "_at", "_one")


#: Members that one word of a presence bitmap holds.
_WORD = 63


def _hashes() -> list[Column]:
    """Two hashes of each field's exposed value; two different values pass for equal where both are equal, with a chance of 2^-96."""
    shown = {f: F.lower(f) if f == "etag" else F.col(f) for f in _VALUES}
    return [F.when(c.isNotNull(), h).alias(f"hash{k}_{f}") for f, c in shown.items() for k, h in enumerate((F.xxhash64(c), F.hash(F.lit(1), c)))]


def _alike() -> list[Column]:
    """Aggregates by which a field's exposed values are told apart: the ends of their hashes."""
    return [g(f"hash{k}_{f}").alias(f"{n}{k}_{f}") for f in _VALUES for k in (0, 1) for n, g in (("low", F.min), ("high", F.max))]


def _may_differ(rows: DataFrame, odd: DataFrame, n: int, by: list[str]) -> DataFrame:
    """The rows whose columns `by` may be those of one of the n rows of odd: all that are, and few others.

    A bitmap of odd's hashes, bounded whatever n is, is broadcast in lines of 8 words; with n beyond its slots more rows pass.
    """
    slots = min(1 << max(9, (n * _SLOTS - 1).bit_length()), _MOST_SLOTS)
    slot = F.pmod(F.xxhash64(*by), F.lit(slots).cast("long"))
    at = lambda df: df.withColumn("_slot", slot).withColumn("_line", F.shiftright("_slot", 9)).withColumn("_in", F.shiftright("_slot", 6).bitwiseAND(F.lit(_LINE - 1)).cast("int"))
    word = F.expr("shiftleft(1L, cast(_slot % 64 as int))")
    lines = at(odd.select(*by)).groupBy("_line").agg(*[F.bit_or(F.when(F.col("_in") == k, word).otherwise(F.lit(0).cast("long"))).alias(f"_w{k}") for k in range(_LINE)])
    held = F.expr("getbit(case _in " + " ".join(f"when {k} then _w{k}" for k in range(_LINE)) + " end, cast(_slot % 64 as int)) = 1")
    return at(rows).join(F.broadcast(lines), "_line").filter(held).select(*rows.columns)


def _members_diff(rows: DataFrame, most: int) -> DataFrame:
    """(g, m, kind, key, field, tool_value, reference_value) of rows(g, m, members, key, ...): how member m > 0 of a group differs from member 0.

    One aggregation by (g, key) holds which members have the key, in bitmaps of `most` members, how many rows they have in all, and
    whether a field's exposed values are all alike. A key that every member has once, with like values, differs for
    none; all members' rows of the other keys are taken from a second scan, by a broadcast of up to BROADCAST_KEYS keys, and beyond by
    a join of the rows that a bitmap of these keys lets pass. So each row is shuffled once, however many members there are, and
    again only where its key differs; the rows of such keys are written once for all that asks for them.
    """
    at, value, none = ["g", "key"], F.struct(*_VALUES), F.lit(None).cast("string")
    bit = lambda k: F.when((F.col("m") >= k * _WORD) & (F.col("m") < (k + 1) * _WORD), F.expr("shiftleft(1L, cast(m % 63 as int))")).otherwise(F.lit(0).cast("long"))
    words = [f"has_{k}" for k in range(-(-most // _WORD))]
    of_key = rows.select(*at, "m", "members", *_hashes()).groupBy(*at).agg(
        F.max("members").alias("members"), F.count("*").alias("n"), F.count(F.when(F.col("m") == 0, 1)).alias("n_ref"), *[F.bit_or(bit(k)).alias(w) for k, w in enumerate(words)],
        *_alike(),
    )
    unlike = F.lit(False)
    for f in _VALUES:
        unlike |= F.coalesce((F.col(f"low0_{f}") != F.col(f"high0_{f}")) | (F.col(f"low1_{f}") != F.col(f"high1_{f}")), F.lit(False))
    present = sum((F.bit_count(w) for w in words), F.lit(0))
    odd = of_key.withColumn("unlike", unlike).filter((F.col("n") != F.col("members")) | (present != F.col("members")) | F.col("unlike"))
    odd = checkpoint(odd.select(*at, "members", "n_ref", "unlike", *words))
    keys, n_odd = odd.select(*at, "n_ref", "unlike"), odd.count()
    own = rows.join(F.broadcast(keys), at) if n_odd <= BROADCAST_KEYS else _may_differ(rows, odd, n_odd, at).join(keys, at)
    own = checkpoint(own.select(*at, "m", "n_ref", "unlike", *_VALUES))
    tool = own.filter("m > 0").groupBy(*at, "m").agg(F.count("*").alias("n"), F.min(value).alias("t"), F.first("n_ref").alias("n_ref"), F.first("unlike").alias("unlike"))
    some = tool.select(*at, "m", F.explode(F.array_compact(F.array(
        F.when(F.col("n_ref") == 0, F.struct(F.lit("extra").alias("kind"), F.col("n").alias("n"))), F.when(F.col("n") > 1, F.struct(F.lit("duplicate").alias("kind"), F.lit(1).cast("long").alias("n"))),
    ))).alias("e")).select(*at, "m", "e.*")
    held = lambda m: F.expr("case " + " ".join(f"when {m} < {(k + 1) * _WORD} then {w}" for k, w in enumerate(words)) + " end")
    each = odd.filter("n_ref > 0 and members > 1").withColumn("m", F.explode(F.sequence(F.lit(1), F.col("members") - 1)))
    absent = F.expr("getbit(_held, cast(m % 63 as int)) = 0")
    lacks = each.withColumn("_held", held("m")).select(*at, "m", F.explode(F.array_compact(F.array(
        F.when(absent, F.struct(F.lit("missing").alias("kind"), F.col("n_ref").alias("n"))), F.when(F.col("n_ref") > 1, F.struct(F.lit("reference_duplicate").alias("kind"), F.lit(1).cast("long").alias("n"))),
    ))).alias("e")).select(*at, "m", "e.*")
    pairs = tool.filter("unlike and n_ref > 0").select(*at, "m", "t")
    wrong = own.filter("m = 0 and unlike").select(*at, value.alias("r")).join(pairs, at).select(*at, "m", F.explode(_mismatches(F.col("t"), F.col("r"))).alias("d"))
    plain = _repeated(some.unionByName(lacks), F.col("n")).select("g", "m", "kind", "key", none.alias("field"), none.alias("tool_value"), none.alias("reference_value"))
    return plain.unionByName(wrong.select("g", "m", F.lit("mismatch").alias("kind"), "key", "d.*"))


def differing(both: DataFrame) -> DataFrame:
    """The rows of tagged(pair, side, key, ...) whose key differs between the sides, written once with what a diff asks of their key.

    That is the rows that the own and the other side have (n_own, n_other), whether this is the own side's first row (leads), and the other
    side's least values (least). Sides come from scans of their own, so a task hardly sees a key twice: rows go to their key's task once,
    whole, and are judged there, without sums of one row each and without a second scan for values.
    """
    placed = both.select("pair", "side", *FIELDS).repartition("pair", "key").withColumn("_hash", F.xxhash64("key"))  # sorted by a number, then by texts
    key, side = W.partitionBy("_hash", "pair", "key"), F.col("side")
    ends = {f"_{n}_{f}": g(f).over(key) for f in _VALUES for n, g in (("one", F.first), ("two", F.last))}  # of two rows, all that there are
    judged = placed.withColumns({"_n": F.count("*").over(key), "_n_ref": F.count(F.when(side == 0, 1)).over(key)} | ends)
    unlike = F.lit(False)
    for f in _VALUES:
        unlike |= F.coalesce(_differs(f, F.col(f"_one_{f}"), F.col(f"_two_{f}")), F.lit(False))
    odd = judged.filter((F.col("_n") != 2) | (F.col("_n_ref") != 1) | unlike)
    least = [F.min(F.when(side == k, F.struct(*_VALUES))).over(key) for k in (0, 1)]
    own = F.when(side == 0, F.col("_n_ref")).otherwise(F.col("_n") - F.col("_n_ref"))
    odd = odd.withColumns({"n_own": own, "n_other": F.col("_n") - own, "_least_0": least[0], "_least_1": least[1], "leads": F.row_number().over(W.partitionBy("_hash", "pair", "key", "side").orderBy("side")) == 1})
    return checkpoint(odd.select("pair", "side", *FIELDS, "n_own", "n_other", "leads", F.when(side == 0, F.col("_least_1")).otherwise(F.col("_least_0")).alias("least")))


def mirrored(odd: DataFrame) -> DataFrame:
    """The rows of `differing` with its sides exchanged."""
    return odd.withColumn("side", 1 - F.col("side"))


def diff_differing(odd: DataFrame) -> DataFrame:
    """(pair, kind, key, field, tool_value, reference_value) of the rows of `differing`, row by row."""
    none, ref = F.lit(None).cast("string"), F.col("side") == 0
    plain = lambda kind, rows: F.when(rows, F.struct(F.lit(kind).alias("kind"), none.alias("field"), none.alias("tool_value"), none.alias("reference_value")))
    alone, first = F.col("n_other") == 0, (F.col("n_own") > 1) & F.col("leads")
    wrong = F.transform(F.when(ref, _mismatches(F.col("least"), F.struct(*_VALUES))).otherwise(F.array()), lambda m: F.struct(F.lit("mismatch").alias("kind"), m["field"].alias("field"), m["tool_value"].alias("tool_value"), m["reference_value"].alias("reference_value")))
    kinds = F.array_compact(F.array(plain("missing", ref & alone), plain("extra", ~ref & alone), plain("duplicate", ~ref & first), plain("reference_duplicate", ref & first)))
    found = odd.select("pair", "key", F.explode(F.concat(kinds, wrong)).alias("d"))
    return found.select("pair", "d.kind", "key", "d.field", "d.tool_value", "d.reference_value")


def diff_tagged(both: DataFrame) -> DataFrame:
    """(pair, kind, key, field, tool_value, reference_value) of tagged(pair, side, key, ...): groups of two members."""
    return diff_differing(differing(both))


def listing_diff(ref: DataFrame, act: DataFrame) -> DataFrame:
    """(kind, key, field, tool_value, reference_value) of two listings."""
    return diff_tagged(tagged(ref, act)).drop("pair")


def _verdict(hard: Column, soft: Column) -> Column:
    return F.when(hard > 0, "FAIL").when(soft > 0, "DRIFT").otherwise("PASS")


_KINDS = ("missing", "extra", "duplicate", "reference_duplicate")
_COUNTS = (*(f"n_{k}" for k in _KINDS), "n_mismatch", "n_mtime")


def diff_counts() -> list[Column]:
    """The aggregates of a diff that a verdict asks for, by name."""
    soft = F.col("field") == "mtime"
    counts = [F.col("kind") == k for k in _KINDS] + [(F.col("kind") == "mismatch") & c for c in (~soft, soft)]
    return [F.count(F.when(c, 1)).alias(n) for n, c in zip(_COUNTS, counts, strict=True)]


def counted_verdict(df: DataFrame) -> DataFrame:
    """df with its counts, 0 where NULL, and their verdict."""
    df = df.withColumns({n: F.coalesce(n, F.lit(0)) for n in _COUNTS})
    return df.withColumn("verdict", _verdict(sum((F.col(n) for n in _COUNTS[1:5]), F.col(_COUNTS[0])), F.col("n_mtime")))


def pair_verdict(diff: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row of counts and the verdict, for each of `pairs`(pair) or over all of diff.

    FAIL for a missing, extra or repeated key or any mismatch but of mtime; DRIFT for
    mtime alone; PASS without differences.
    """
    if pairs is None:
        return counted_verdict(diff.agg(*diff_counts()))
    return counted_verdict(pairs.join(diff.groupBy("pair").agg(*diff_counts()), "pair", "left"))


def rank(verdict: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, VERDICTS)), verdict)


def worst(verdict: Column) -> Column:
    """The aggregate of D9: the worst verdict, UNCOMPARED of none."""
    return F.element_at(F.array(*map(F.lit, VERDICTS)), F.coalesce(F.max(rank(verdict)), F.lit(1)).cast("int"))


def worst_verdict(df: DataFrame, *by: str) -> DataFrame:
    """The worst `verdict` by some columns."""
    return df.groupBy(*by).agg(worst(F.col("verdict")).alias("verdict"))


def stratify(subjects: DataFrame, modes: DataFrame) -> DataFrame:
    """subjects(attempt_id, bucket, mode) with the stratum of modes(mode, product, fields array)."""
    stratum = F.concat_ws("|", "product", F.array_join("fields", ","))
    return subjects.join(modes.select("mode", stratum.alias("stratum")), "mode", "left")


def choose_reference(subjects: DataFrame) -> DataFrame:
    """Subjects with the lowest attempt_id of their bucket and stratum as `reference`."""
    return subjects.withColumn("reference", F.min("attempt_id").over(W.partitionBy("bucket", "stratum")))


def compare_all(listings: DataFrame, subjects: DataFrame) -> DataFrame:
    """The diff of every other member of a stratum against its reference, all members in one aggregation.

    listings: attempt_id and the listing's fields; subjects: attempt_id, bucket, stratum, each attempt once; one of a NULL
    bucket or stratum is in that of NULL. `pair` is the other member's attempt_id. A member without rows lacks all keys; a
    stratum of one member has no pairs.
    """
    own = W.partitionBy("bucket", "stratum")
    numbered = subjects.select(
        "attempt_id", F.min("attempt_id").over(own).alias("g"), (F.row_number().over(own.orderBy("attempt_id")) - 1).alias("m"), F.count("*").over(own).cast("int").alias("members"),
    ).filter("members > 1")
    numbered = checkpoint(numbered)  # attempts, not listing rows
    n, most = numbered.agg(F.count("*"), F.coalesce(F.max("members"), F.lit(2))).first()
    # a shuffle by attempt_id would move every row into a few tasks, and part the members' rows of a key, which the scan's own aggregation brings together
    few = F.broadcast(numbered) if n <= BROADCAST_KEYS else numbered
    found = _members_diff(listings.join(few, "attempt_id").select("g", "m", "members", *FIELDS), most)
    return found.join(numbered.select(F.col("attempt_id").alias("pair"), "g", "m"), ["g", "m"]).select("pair", "kind", "key", "field", "tool_value", "reference_value")


def diff_samples(diff: DataFrame, n: int = 5) -> DataFrame:
    """The first n distinct keys of each kind, with the kind's number of keys beyond them."""
    keys = diff.select("kind", "key").distinct()
    total = keys.groupBy("kind").agg(F.count("*").alias("total"))
    first = keys.withColumn("r", F.row_number().over(W.partitionBy("kind").orderBy("key"))).filter(F.col("r") <= n)
    return first.join(F.broadcast(total), "kind").select("kind", "key", F.col("r").cast("long").alias("place"), F.greatest(F.col("total") - n, F.lit(0)).alias("more"))


def stratum_verdicts(subjects: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(bucket, stratum, members, verdict): the worst of a stratum's pairs; a lone member is UNCOMPARED."""
    joined = subjects.select("bucket", "stratum", "attempt_id").join(verdicts.select(F.col("pair").alias("attempt_id"), "verdict"), "attempt_id", "left")
    return joined.groupBy("bucket", "stratum").agg(F.count("*").alias("members"), worst(F.col("verdict")).alias("verdict"))


def bucket_verdict(strata: DataFrame, gaps: DataFrame) -> DataFrame:
    """INCOMPLETE for a bucket with a gap, else the worst of its strata.

    gaps: bucket, reason.
    """
    n = gaps.groupBy("bucket").agg(F.count("*").alias("gaps"))
    both = strata.groupBy("bucket").agg(worst(F.col("verdict")).alias("v")).join(n, "bucket", "full_outer")
    return both.select("bucket", F.coalesce("gaps", F.lit(0)).alias("gaps"), F.when(F.coalesce("gaps", F.lit(0)) > 0, "INCOMPLETE").otherwise(F.col("v")).alias("verdict"))


def group_verdict(buckets: DataFrame, slots: DataFrame) -> DataFrame:
    """One row: the group's verdict and exit code.

    INCOMPLETE without buckets, with a blocked or abandoned slot of slots(state), or
    with an incomplete bucket; else the worst bucket.
    """
    b = buckets.agg(F.count("*").alias("n"), F.count(F.when(F.col("verdict") == "INCOMPLETE", 1)).alias("open"), worst(F.col("verdict")).alias("v"))
    s = slots.agg(F.count(F.when(F.col("state").isin("blocked", "abandoned"), 1)).alias("owed"))
    out = b.crossJoin(F.broadcast(s)).select("n", "open", "owed", F.when((F.col("n") == 0) | (F.col("open") > 0) | (F.col("owed") > 0), "INCOMPLETE").otherwise(F.col("v")).alias("verdict"))  # one row each
    codes = F.create_map(*[F.lit(x) for kv in EXIT_CODES.items() for x in kv])
    return out.select(F.col("n").alias("buckets"), "owed", "verdict", F.element_at(codes, F.col("verdict")).cast("int").alias("exit_code"))
