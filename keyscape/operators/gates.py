"""Contract gates: each adds a nullable reason, and `validate` splits or refuses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyscape.functions.listing import ETAG_SHAPE, FIELDS, KEY_BREAKS, MTIME_SHAPE, SIZE_SHAPE, TOKEN_SHAPE, bare_mtime, fold


def _unless(good: Column, reason: str) -> Column:
    return F.when(~F.coalesce(good, F.lit(False)), F.lit(reason))


def gate_fields(value: Column) -> Column:
    """A text line has exactly five fields between tabs."""
    n = F.size(F.split(value, "\t", -1))
    return F.when(n == 3, F.lit("three fields: an old format")).when(n != 5, F.lit("not five fields"))


def gate_key(key: Column) -> Column:
    """A key is not empty and holds no tab, line feed or carriage return; `-` is a key."""
    return _unless((F.length(key) > 0) & ~key.rlike(KEY_BREAKS), "key")


def gate_size(size: Column) -> Column:
    """Digits only; unexposed passes."""
    return F.when(size.isNotNull(), _unless(size.rlike(SIZE_SHAPE), "size"))


def gate_etag(etag: Column) -> Column:
    """C4: printable ASCII without space and quotes."""
    return F.when(etag.isNotNull(), _unless(etag.rlike(ETAG_SHAPE), "etag"))


def gate_mtime(mtime: Column) -> Column:
    """Whole seconds in one of the three zone spellings."""
    return F.when(mtime.isNotNull(), _unless(mtime.rlike(MTIME_SHAPE), "mtime"))


def gate_storage_class(value: Column) -> Column:
    """A printable ASCII token."""
    return F.when(value.isNotNull(), _unless(value.rlike(TOKEN_SHAPE), "storage_class"))


GATES = {"key": gate_key, "size": gate_size, "etag": gate_etag, "mtime": gate_mtime, "storage_class": gate_storage_class}


def fold_unexposed(df: DataFrame) -> DataFrame:
    """`-` becomes NULL in all fields but the key."""
    return df.withColumns({f: fold(F.col(f)) for f in FIELDS[1:]})


def canonical_mtime(df: DataFrame) -> DataFrame:
    """Times without their zone; those of another shape stay, for the gate to refuse."""
    return df.withColumn("mtime", F.when(F.col("mtime").rlike(MTIME_SHAPE), bare_mtime(F.col("mtime"))).otherwise(F.col("mtime")))


def null_gate(df: DataFrame) -> DataFrame:
    """(bad): rows of a text image with an empty or missing field; one row."""
    missing = reduce(lambda a, b: a | b, [F.nullif(F.col(f), F.lit("")).isNull() for f in FIELDS])
    return df.agg(F.count(F.when(missing, 1)).alias("bad"))


def gate_escape(key: Column) -> Column:
    """A text sink's key doesn't hold a backslash-x escape, which may be the key's own text."""
    return F.when(key.rlike(r"\\x[0-9a-fA-F]{2}"), F.lit("ambiguous escape"))


def gate_table_line(value: Column) -> Column:
    """C11: a fixed-width line reaches its key, and the gaps between columns are blank (counted in bytes)."""
    raw = F.encode(value, "UTF-8")
    gap = lambda at: F.substring(raw, at, 2) != F.lit("  ").cast("binary")
    return F.when(F.octet_length(value) < 43, F.lit("short line")).when(gap(15) | gap(41), F.lit("overflowing column"))


def with_reasons(df: DataFrame) -> DataFrame:
    """df with `reasons`, the names of the fields that break the contract, in order."""
    return df.withColumn("reasons", F.array_compact(F.array(*[gate(F.col(f)) for f, gate in GATES.items()])))


def validate(df: DataFrame, mode: str = "refuse") -> tuple[DataFrame, DataFrame]:
    """(good, quarantine): records that meet the contract, and the others with their reasons.

    mode `split` keeps both; `refuse` raises ValueError if any record is bad (which runs df once).
    A caller of `split` that reads both sides and needs no records uses `reason_counts`.
    """
    if mode not in ("refuse", "split"):
        raise ValueError(f"unknown mode: {mode}")
    marked = with_reasons(df)
    good, bad = marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)
    if mode == "refuse" and (first := bad.select("key", "reasons").first()) is not None:
        raise ValueError(f"listing breaks the contract: key {first['key']!r}: {', '.join(first['reasons'])}")
    return good, bad


def reason_counts(df: DataFrame) -> DataFrame:
    """(reasons, n): records by the fields that break the contract, comma-joined; empty for those that meet it. One pass over df."""
    return with_reasons(df).groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))
