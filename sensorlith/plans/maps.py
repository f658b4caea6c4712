"""Exploration jobs over many maps: frontier, candidate, inflation, way and world coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlith.functions.grids import cell_centre, inflation_radius, world_to_index
from sensorlith.operators import grids as G
from sensorlith.session import cut

# Robot size and clearance (m).
LENGTH_M, WIDTH_M, CLEARANCE_M = 0.40, 0.30, 0.05


def robot_cells(maps: DataFrame) -> DataFrame:
    """The robot's cell on each map, null when it stands outside."""
    row = world_to_index(F.col("robot_y"), F.col("origin_y"), F.col("resolution"))
    col = world_to_index(F.col("robot_x"), F.col("origin_x"), F.col("resolution"))
    inside = row.between(0, F.col("height") - 1) & col.between(0, F.col("width") - 1)
    return maps.select("map_id", F.when(inside, row).alias("robot_row"), F.when(inside, col).alias("robot_col"))


def explore(maps: DataFrame, min_cluster: int = G.MIN_CLUSTER, clearance_m: float = CLEARANCE_M) -> DataFrame:
    """One row per map: robot cell, chosen frontier cell, steps of the way to it (null when there is none)."""
    grid = cut(G.cells(maps))
    robots = cut(robot_cells(maps))
    goals = cut(G.candidates(G.cluster_summary(G.clusters(G.frontier(grid), min_cluster)), robots))
    steps = way_distances(maps, grid, robots, clearance_m)
    to_goal = goals.join(
        steps.select("map_id", F.col("row").alias("goal_row"), F.col("col").alias("goal_col"), "steps"), ["map_id", "goal_row", "goal_col"], "left"
    )
    return maps.select("map_id").join(robots, "map_id", "left").join(to_goal, "map_id", "left")


def way_distances(maps: DataFrame, grid: DataFrame, robots: DataFrame, clearance_m: float = CLEARANCE_M) -> DataFrame:
    """Steps from the robot's cell over the grid with grown obstacles."""
    radius = maps.select("map_id", inflation_radius(LENGTH_M, WIDTH_M, clearance_m, F.col("resolution")).alias("_radius"))
    grown = G.inflated(grid.join(radius, "map_id"), F.col("_radius")).drop("_radius")
    starts = robots.filter("robot_row is not null").select("map_id", F.col("robot_row").alias("start_row"), F.col("robot_col").alias("start_col"))
    return G.hop_distances(grown, starts)


def world_path(path: DataFrame, maps: DataFrame) -> DataFrame:
    """Path cells as world points (cell centres)."""
    shape = maps.select("map_id", "resolution", "origin_x", "origin_y")
    return path.join(shape, "map_id").select(
        "map_id",
        "step",
        "row",
        "col",
        cell_centre(F.col("col"), F.col("origin_x"), F.col("resolution")).alias("x"),
        cell_centre(F.col("row"), F.col("origin_y"), F.col("resolution")).alias("y"),
    )
