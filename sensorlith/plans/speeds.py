"""Road speeds: baseline, newest reading and slowdown of each link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlith.functions.numbers import half_even, half_up, settled, stable_mean
from sensorlith.functions.scores import slowdown_ratio
from sensorlith.functions.times import boundaries_between
from sensorlith.operators.quantiles import join_on_keys, percentiles
from sensorlith.operators.series import latest

DESCRIBED = ("borough", "link_name", "owner")


def usable(speeds: DataFrame) -> DataFrame:
    """Readings with a positive speed."""
    return speeds.filter(F.col("speed_mph") > 0)


def described(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Fill the descriptive columns from the segment table and add its end points."""
    seg = segments.select("link_id", *[F.col(c).alias(f"_{c}") for c in DESCRIBED], "start_lat", "start_lon", "end_lat", "end_lon", "point_count")
    return (
        rows.join(seg, "link_id", "left")
        .withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in DESCRIBED})
        .drop(*[f"_{c}" for c in DESCRIBED])
    )


def baseline(speeds: DataFrame) -> DataFrame:
    base = speeds.groupBy("link_id").agg(
        F.count(F.lit(1)).alias("observations"),
        stable_mean(F.sum("speed_mph"), F.count(F.lit(1)), 2).alias("avg_speed_mph"),
        half_up(F.min("speed_mph"), 2).alias("min_speed_mph"),
        half_up(F.max("speed_mph"), 2).alias("max_speed_mph"),
    )
    wanted = {"median_speed_mph": 0.5, "p75_speed_mph": 0.75, "p90_speed_mph": 0.9}
    pct = percentiles(speeds, ["link_id"], {n: ("speed_mph", p) for n, p in wanted.items()})
    return join_on_keys(base, pct.withColumns({n: settled(F.col(n), 2) for n in wanted}), ["link_id"])


def current_segments(speeds: DataFrame, segments: DataFrame, fresh_min: int, tie_break: str) -> DataFrame:
    """Newest reading of each link against its baseline, worst first. The join sees one row per link."""
    good = usable(speeds)
    newest = latest(good, ["link_id"], [F.col("data_as_of"), F.col(tie_break)])
    clock = good.select(F.max("data_as_of")).scalar()
    scored = join_on_keys(described(newest, segments), baseline(good), ["link_id"]).withColumn("latest_data_as_of", clock)
    behind = boundaries_between("minute", F.col("data_as_of"), F.col("latest_data_as_of"))
    ratio = slowdown_ratio(F.col("speed_mph"), F.col("p75_speed_mph"))
    return (
        scored.withColumns(
            {
                "minutes_behind_latest": behind,
                "is_fresh": F.coalesce(behind <= fresh_min, F.lit(False)),
                "slowdown_ratio": settled(ratio, 4),
                "traffic_stress_score": settled(100.0 * ratio, 1),
            }
        )
        .withColumnRenamed("speed_mph", "current_speed_mph")
        .orderBy(F.desc_nulls_last("traffic_stress_score"), F.asc_nulls_last("current_speed_mph"), "link_id")
    )


def borough_summary(segments: DataFrame) -> DataFrame:
    """Means over fresh links per borough (a missing borough is one too), and how many were stale."""
    fresh = F.col("is_fresh")
    mean = lambda c, n: half_even(
        stable_mean(F.sum(F.when(fresh, F.col(c))), F.count(F.when(fresh, F.col(c))), 7), 3
    ).alias(n)
    return (
        segments.groupBy("borough")
        .agg(
            F.count_if(fresh).alias("segment_count"),
            mean("current_speed_mph", "avg_current_speed_mph"),
            mean("p75_speed_mph", "avg_baseline_p75_mph"),
            mean("slowdown_ratio", "avg_slowdown_ratio"),
            mean("traffic_stress_score", "avg_traffic_stress_score"),
            F.count_if(~fresh).alias("stale_count"),
        )
        .filter(F.col("segment_count") > 0)
        .orderBy(F.desc_nulls_last("avg_traffic_stress_score"), F.asc_nulls_last("borough"))
    )


def most_stressed(segments: DataFrame, k: int = 30) -> DataFrame:
    return (
        segments.filter("is_fresh")
        .orderBy(F.desc_nulls_last("traffic_stress_score"), F.asc_nulls_last("current_speed_mph"), "link_id")
        .limit(k)
    )


def coverage_description(segments: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, quartiles of numeric columns, one row per column."""
    long = segments.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("r")).select("r.*")
    base = long.groupBy("column_name").agg(
        F.count("x").alias("n"),
        stable_mean(F.sum("x"), F.count("x")).alias("mean"),
        settled(F.stddev_samp("x"), 4).alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    pct = percentiles(long, ["column_name"], {"p25": ("x", 0.25), "p50": ("x", 0.5), "p75": ("x", 0.75)})
    return join_on_keys(base, pct.withColumns({p: settled(F.col(p), 4) for p in ("p25", "p50", "p75")}), ["column_name"])
