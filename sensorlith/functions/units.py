"""Unit conversions and text quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MPH_PER_MPS = 2.2369362921
STANDARD_GRAVITY = 9.80665


def c_to_f(c: Column) -> Column:
    return c * 9.0 / 5.0 + 32.0


def mps_to_mph(v: Column) -> Column:
    return v * MPH_PER_MPS


def fahrenheit(value: Column, unit: Column) -> Column:
    return F.when(unit == "C", c_to_f(value)).otherwise(value)


def wind_text_mph(text: Column) -> Column:
    """Largest number in the text: "5 to 10 mph" is 10; no number is null."""
    numbers = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    return F.array_max(F.transform(numbers, lambda s: s.cast("double")))
