"""Rounding, clamping, casts and magnitudes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int) -> Column:
    """SQL ROUND on doubles: halves go away from zero, judged on the scaled double."""
    scale = F.lit(10.0**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def half_even(x: Column, digits: int) -> Column:
    """Array-library rounding: halves go to the even neighbour."""
    scale = F.lit(10.0**digits)
    return F.rint(x * scale) / scale


def clamp(x: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; null stays null (greatest/least alone would drop it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def safe_double(x: Column) -> Column:
    return x.try_cast("double")


def safe_int(x: Column) -> Column:
    """Text to int by way of double, cutting the fraction off."""
    return x.try_cast("double").try_cast("int")


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(x.cast("string")).isin("true", "1", "yes", "y"), F.lit(False))


def magnitude(*parts: Column) -> Column:
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def wrap_angle(a: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(a + F.pi(), 2 * F.pi()) - F.pi()


def rmse(diff: Column) -> Column:
    """Aggregate: root of the mean square, nulls left out."""
    return F.sqrt(F.avg(diff * diff))


def percent_text(x: Column) -> Column:
    return F.format_string("%.0f%%", 100.0 * x)


def number_text(x: Column, digits: int, absent: str = "—") -> Column:
    return F.when(x.isNull(), F.lit(absent)).otherwise(F.format_string(f"%.{digits}f", x))


def file_safe(x: Column) -> Column:
    """Names as used in report files: spaces and slashes become underscores, brackets go."""
    return F.translate(x, " /()", "__")


def settled(x: Column, digits: int) -> Column:
    """``half_up`` after wiping out noise in the last bits, so that a true half rounds the same way every time."""
    return half_up(half_up(x, digits + 4), digits)


def settled_even(x: Column, digits: int) -> Column:
    """``half_even`` after wiping out noise in the last bits."""
    return half_even(half_up(x, digits + 6), digits)


def stable_mean(total: Column, n: Column, digits: int = 4) -> Column:
    """Mean from a sum rounded first, so that the order of addition cannot tip the last digit."""
    return half_up(F.try_divide(half_up(total, 4), n), digits)
