"""Range-scan columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Distances (m) and age (s) of the obstacle guard, and of the turn logic.
STOP_DISTANCE_M = 0.45
RESUME_DISTANCE_M = 0.55
SCAN_TIMEOUT_S = 0.5
TURN_TRIGGER_M = 0.80
TURN_CLEAR_M = 1.0
PATH_TIMEOUT_S = 2.5
LOOKAHEAD_M = 0.30


def nearest_in_sector(
    ranges: Column,
    angle_min: Column,
    angle_step: Column,
    range_min: Column,
    range_max: Column,
    centre: float,
    half_width: float,
) -> Column:
    """Smallest usable range within the sector. +inf counts as range_max; NaN and −inf do not count."""
    low, high = centre - half_width, centre + half_width

    def usable(x: Column, i: Column) -> Column:
        angle = angle_min + i * angle_step
        d = F.when(x == float("inf"), range_max).when(F.isnan(x), None).otherwise(x.cast("double"))
        return F.when((angle >= low) & (angle <= high) & (d >= range_min) & (d <= range_max), d)

    return F.array_min(F.transform(ranges, usable))
