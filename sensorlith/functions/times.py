"""Time columns. Everything is naive UTC (timestamp without zone)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a naive UTC timestamp."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(a: Column, b: Column) -> Column:
    """b − a in seconds with fraction."""
    return F.timestamp_diff("MICROSECOND", a.cast("timestamp_ntz"), b.cast("timestamp_ntz")) / F.lit(1e6)


def boundaries_between(unit: str, a: Column, b: Column) -> Column:
    """How many starts of ``unit`` lie between a and b: 00:00:59 to 00:01:01 is one minute.

    Spark's own difference counts whole units passed, which is zero here.
    """
    width = _UNIT_SECONDS[unit] * 1_000_000
    return F.floor(micros(b) / F.lit(width)) - F.floor(micros(a) / F.lit(width))


def parse_iso(text: Column) -> Column:
    """ISO text, with Z, with an offset or with neither, to naive UTC."""
    return text.try_cast("timestamp").cast("timestamp_ntz")


def epoch_to_utc(value: Column) -> Column:
    """Epoch seconds; null, empty, zero and text that is no number give null."""
    whole = F.nullif(value.try_cast("long"), F.lit(0).cast("long"))
    return F.timestamp_seconds(whole).cast("timestamp_ntz")


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us.cast("long")).cast("timestamp_ntz")


def month_start(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1)).cast("timestamp_ntz")


def next_month_start(year: Column, month: Column) -> Column:
    """Exclusive end; December rolls into January."""
    return F.add_months(F.make_date(year, month, F.lit(1)), 1).cast("timestamp_ntz")


def sunday_zero_weekday(ts: Column) -> Column:
    return (F.dayofweek(ts) - 1).cast("int")


def slug(ts: Column) -> Column:
    """20240131T235959Z, the form used in snapshot file names."""
    return F.date_format(ts.cast("timestamp"), "yyyyMMdd'T'HHmmss'Z'")
