"""The listing record and the column expressions that its jobs share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELDS = ("key", "size", "etag", "mtime", "storage_class")
#: Fixed value: what a text listing prints for a field that its mode doesn't expose.
UNEXPOSED = "-"
LISTING = T.StructType([T.StructField(f, T.StringType(), f != "key") for f in FIELDS])

#: Regular expressions of the contract, anchored so that a final line feed doesn't slip through.
SIZE_SHAPE = r"\A[0-9]+\z"
ETAG_SHAPE = r"\A[!-~&&[^\"]]+\z"
TOKEN_SHAPE = r"\A[!-~]+\z"
MTIME_SHAPE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(Z|\+00:00|\+0000)\z"
KEY_BREAKS = r"[\t\n\r]"


def fold(c: Column) -> Column:
    """An unexposed field as NULL."""
    return F.when(c != UNEXPOSED, c)


def whole_seconds(c: Column) -> Column:
    """A time without the fraction in front of its final Z."""
    return F.regexp_replace(c, r"\.[0-9]+Z\z", "Z")


def zulu(c: Column) -> Column:
    """A final +00:00 or +0000 as Z."""
    return F.regexp_replace(c, r"\+00:?00\z", "Z")


def bare_mtime(c: Column) -> Column:
    """The instant without its zone, for comparison after the shape is checked."""
    return F.regexp_replace(c, r"(Z|\+00:00|\+0000)\z", "")


def unquoted(c: Column) -> Column:
    return F.replace(c, F.lit('"'), F.lit(""))


def tabbed(value: Column) -> Column:
    return F.split(value, "\t", -1)


def awk_fields(value: Column) -> Column:
    """Fields between runs of blanks and tabs, after spaces at both ends are dropped."""
    return F.split(F.trim(value), "[ \t]+", -1)


def rest(fields: Column, start: int, stop: Column | None = None, sep: str = " ") -> Column:
    """Fields from number `start` on (the first is 1), up to number `stop` where given, joined again."""
    upto = F.size(fields) if stop is None else stop
    return F.array_join(F.slice(fields, F.lit(start), F.greatest(upto - (start - 1), F.lit(0))), sep)


def field(fields: Column, number: int) -> Column:
    """Field `number` (the first is 1), NULL beyond the end."""
    return F.get(fields, F.lit(number - 1))


def depth(key: Column) -> Column:
    return (F.length(key) - F.length(F.replace(key, F.lit("/"), F.lit("")))).cast("long")
