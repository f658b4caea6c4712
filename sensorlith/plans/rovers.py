"""Rover scans and commands: obstacle state, staleness, guarded commands, turns and look-ahead points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlith.functions.scans import (
    LOOKAHEAD_M,
    PATH_TIMEOUT_S,
    RESUME_DISTANCE_M,
    SCAN_TIMEOUT_S,
    STOP_DISTANCE_M,
    TURN_CLEAR_M,
    TURN_TRIGGER_M,
    nearest_in_sector,
)
from sensorlith.operators.recursions import Scan, run_scan, table_compose, table_identity
from sensorlith.operators.series import arrange, fill, shift


def sector(centre: float, half_width: float) -> Column:
    c = F.col
    return nearest_in_sector(c("ranges"), c("angle_min"), c("angle_increment"), c("range_min"), c("range_max"), centre, half_width)


def sector_distances(scans: DataFrame, front_half: float, side_centre: float, side_half: float) -> DataFrame:
    return scans.withColumns(
        {
            "front": sector(0.0, front_half),
            "left": sector(side_centre, side_half),
            "right": sector(-side_centre, side_half),
        }
    )


def blocked_states(scans: DataFrame, stop_m: float = STOP_DISTANCE_M, resume_m: float = RESUME_DISTANCE_M) -> DataFrame:
    """Whether the way ahead is blocked after each scan (needs robot_id, ts, front), and where that changes to blocked.

    Blocked from a distance at or below ``stop_m`` or unknown, until one at or above
    ``resume_m``; in between the state stays. So the last scan outside the band decides.
    """
    decided = (
        F.when(F.col("front").isNull() | (F.col("front") <= stop_m), True).when(F.col("front") >= resume_m, False)
    )
    s = fill(arrange(scans, ["robot_id"], ["ts"]), {"blocked": decided})
    s = s.with_df(s.df.withColumn("blocked", F.coalesce("blocked", F.lit(True))))
    s = shift(s, {"_was": F.col("blocked"), "_before": F.struct("ts")})
    started = F.col("blocked") & ~F.coalesce("_was", F.lit(True))
    return s.result().withColumn("stop_sent", started).drop("_was", "_before")


def stale_periods(scans: DataFrame, timeout_s: float = SCAN_TIMEOUT_S) -> DataFrame:
    """From ``timeout_s`` after a scan until the next one, where the next is later than that; open at the end."""
    s = shift(arrange(scans.select("robot_id", "ts"), ["robot_id"], ["ts"]), {"stale_until": F.col("ts")}, by=-1)
    late = F.col("stale_until").isNull() | (F.col("stale_until") - F.col("ts") > timeout_s)
    return s.result().filter(late).select("robot_id", (F.col("ts") + timeout_s).alias("stale_from"), "stale_until")


def as_of(commands: DataFrame, states: DataFrame, values: list[str], key: str = "robot_id", time: str = "ts") -> DataFrame:
    """Newest state at or before each command, by one ordered pass over both."""
    state = F.struct(F.col(time).alias("t"), *values)
    own = [c for c in commands.columns if c not in (key, time)]
    no_state = F.lit(None).cast(states.select(state).schema[0].dataType)
    left = commands.select(key, time, F.lit(1).alias("_cmd"), F.struct(*own).alias("_own"), no_state.alias("_state"))
    own_type = left.schema["_own"].dataType
    right = states.select(
        key, time, F.lit(0).alias("_cmd"), F.lit(None).cast(own_type).alias("_own"), state.alias("_state")
    )
    s = fill(arrange(left.unionByName(right), [key], [time, "_cmd"]), {"_last": F.col("_state")})
    return s.result().filter("_cmd = 1").select(key, time, "_own.*", F.col("_last.t").alias("state_ts"), *[F.col(f"_last.{v}").alias(v) for v in values])


def guarded(commands: DataFrame, states: DataFrame, timeout_s: float = SCAN_TIMEOUT_S) -> DataFrame:
    """Commands (robot_id, ts, linear_x, angular_z) after the guard: no forward motion while blocked or without a fresh scan."""
    seen = as_of(commands, states, ["blocked"])
    stale = F.col("state_ts").isNull() | (F.col("ts") - F.col("state_ts") > timeout_s)
    unsafe = F.coalesce("blocked", F.lit(True)) | stale
    return seen.withColumns(
        {
            "scan_is_stale": stale,
            "front_blocked": F.coalesce("blocked", F.lit(True)),
            "safe_linear_x": F.when(unsafe & (F.col("linear_x") > 0), 0.0).otherwise(F.col("linear_x")),
            "safe_angular_z": F.col("angular_z"),
        }
    ).drop("blocked", "state_ts")


def path_gated(commands: DataFrame, paths: DataFrame, timeout_s: float = PATH_TIMEOUT_S) -> DataFrame:
    """Commands are zero without a path, with an empty one, or with one older than the timeout."""
    seen = as_of(commands, paths, ["n_points"])
    usable = F.coalesce((F.col("n_points") > 0) & (F.col("ts") - F.col("state_ts") <= timeout_s), F.lit(False))
    return seen.withColumns(
        {
            "path_is_usable": usable,
            "out_linear_x": F.when(usable, F.col("linear_x")).otherwise(0.0),
            "out_angular_z": F.when(usable, F.col("angular_z")).otherwise(0.0),
        }
    ).drop("n_points", "state_ts")


TURN = T.StructType([T.StructField("ts", T.DoubleType()), T.StructField("turn", T.DoubleType()), T.StructField("forward", T.BooleanType())])


#: directions by number: right, none, left
TURNS = np.array([-1.0, 0.0, 1.0])


def turn_table(front: np.ndarray, left: np.ndarray, right: np.ndarray, trigger: float, clear: float) -> tuple[np.ndarray, np.ndarray]:
    """For each tick what every direction becomes, by number, and whether to drive on in it; NaN is no distance."""
    n, blind = len(front), np.isnan(front)
    free_right = np.isnan(left) | (~np.isnan(right) & (right > left))
    start = np.where(np.isnan(left) & np.isnan(right), 1, np.where(free_right, 0, 2))
    becomes, forward = np.tile(np.arange(3.0), (n, 1)), np.zeros((n, 3), bool)
    with np.errstate(invalid="ignore"):
        turned, open_ = front > clear, front > trigger
    for state in (0, 2):
        becomes[:, state] = np.where(turned, 1, state)
        forward[:, state] = turned
    becomes[:, 1] = np.where(blind | open_, 1, start)
    forward[:, 1] = open_
    return becomes, forward


def turn_states(ticks: DataFrame, trigger_m: float = TURN_TRIGGER_M, clear_m: float = TURN_CLEAR_M) -> DataFrame:
    """Turn direction per tick (robot_id, ts, front, left, right): towards the freer side until the front is clear.

    A tick is a table of three directions; tables are composed, so a long drive runs in parts side by side."""

    def tables(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        values = (pd.to_numeric(pdf[c]).to_numpy(dtype=float) for c in ("front", "left", "right"))
        return turn_table(*values, trigger_m, clear_m)

    def elements(pdf: pd.DataFrame):
        becomes, _ = tables(pdf)
        first = pdf["is_first"].to_numpy(dtype=bool)
        return (np.where(first[:, None], becomes[:, 1:2], becomes),)

    def emit(composed, pdf: pd.DataFrame, entering) -> pd.DataFrame:
        after = composed[0][:, 1].astype(int)
        before = np.where(pdf["is_first"].to_numpy(dtype=bool), 1, np.append(int(entering[0][0, 1]), after[:-1]))
        _, forward = tables(pdf)
        return pd.DataFrame({"ts": pdf["ts"].to_numpy(), "turn": TURNS[after], "forward": forward[np.arange(len(after)), before]})

    s = arrange(ticks.select("robot_id", "ts", "front", "left", "right"), ["robot_id"], ["ts"])
    s = shift(s, {"_before": F.struct("ts")})
    s = s.with_df(s.df.withColumn("is_first", F.col("_before").isNull()).drop("_before"))
    return run_scan(s, Scan(elements, table_compose, table_identity(3), emit), TURN)


def lookahead(ticks: DataFrame, distance_m: float = LOOKAHEAD_M) -> DataFrame:
    """Per tick (x, y, path as array of points) the nearest path index and the first later point far enough along, else the last."""
    px, py = F.col("x"), F.col("y")
    away = F.transform(
        "path", lambda p, i: F.struct(((p["x"] - px) * (p["x"] - px) + (p["y"] - py) * (p["y"] - py)).alias("d"), i.alias("i"))
    )
    nearest = ticks.filter(F.size("path") > 0).withColumn("closest_index", F.array_min(away)["i"])
    start = F.get("path", F.col("closest_index"))
    later = F.slice("path", F.col("closest_index") + 2, F.size("path"))
    zero = F.struct(F.lit(0.0).alias("run"), start["x"].alias("x"), start["y"].alias("y"), F.lit(False).alias("done"))
    step = lambda acc, p: F.when(acc["done"], acc).otherwise(
        F.struct(
            (acc["run"] + F.hypot(p["x"] - acc["x"], p["y"] - acc["y"])).alias("run"),
            p["x"].alias("x"),
            p["y"].alias("y"),
            (acc["run"] + F.hypot(p["x"] - acc["x"], p["y"] - acc["y"]) >= distance_m).alias("done"),
        )
    )
    return nearest.withColumn("_ahead", F.aggregate(later, zero, step)).withColumns(
        {
            "ahead_x": F.when(F.col("_ahead.done"), F.col("_ahead.x")).otherwise(F.element_at("path", -1)["x"]),
            "ahead_y": F.when(F.col("_ahead.done"), F.col("_ahead.y")).otherwise(F.element_at("path", -1)["y"]),
        }
    ).drop("_ahead")
