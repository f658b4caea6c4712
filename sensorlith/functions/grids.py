"""Occupancy-grid cell arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def world_to_index(world: Column, origin: Column, resolution: Column) -> Column:
    """Cell index along one axis; values within 1e-9 of a cell edge count as on it."""
    at = (world - origin) / resolution
    return F.floor(F.when(F.abs(at - F.rint(at)) <= 1e-9, F.rint(at)).otherwise(at)).cast("int")


def cell_centre(index: Column, origin: Column, resolution: Column) -> Column:
    return origin + (index + 0.5) * resolution


def manhattan(row_a: Column, col_a: Column, row_b: Column, col_b: Column) -> Column:
    return F.abs(row_a - row_b) + F.abs(col_a - col_b)


def squared_distance(row_a: Column, col_a: Column, row_b: Column, col_b: Column) -> Column:
    return (row_a - row_b) * (row_a - row_b) + (col_a - col_b) * (col_a - col_b)


def inflation_radius(length_m: float, width_m: float, clearance_m: float, resolution: Column) -> Column:
    """Cells to grow obstacles by: half the robot's diagonal plus clearance, rounded up."""
    half_diagonal = ((length_m / 2.0) ** 2 + (width_m / 2.0) ** 2) ** 0.5
    return F.ceil(F.lit(half_diagonal + clearance_m) / resolution).cast("int")
