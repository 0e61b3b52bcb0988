"""Keys, dates and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: End of a version that is still open. Fixed value.
OPEN_END = "9999-12-31 00:00:00"


def surrogate(*columns: Column | str) -> Column:
    """A non-negative key: 64-bit hash without its sign bit, which unlike abs() can't overflow."""
    return F.xxhash64(*columns).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def date_key(day: Column) -> Column:
    """yyyyMMdd as an int; null of null."""
    return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)


def utc_timestamp(text: Column | str) -> Column:
    """yyyy-MM-ddTHH:mm:ssZ as a timestamp; anything else null, so that checks rather than casts report it."""
    return F.try_to_timestamp(F.col(text) if isinstance(text, str) else text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))


def hours_between(start: Column, end: Column) -> Column:
    """Hours from start to end, from whole seconds."""
    seconds = [F.unix_seconds(x.cast("timestamp")) for x in (start, end)]
    return (seconds[1] - seconds[0]) / F.lit(3600.0)


def attribute_hash(*columns: str) -> Column:
    """SHA-256 of the columns as text, joined by ||, null as the empty-set sign."""
    return F.sha2(F.concat_ws("||", *[F.coalesce(F.col(x).cast("string"), F.lit("∅")) for x in columns]).cast("binary"), 256)
