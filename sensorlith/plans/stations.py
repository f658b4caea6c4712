"""Bike-station status intervals and reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlith.functions.numbers import half_up
from sensorlith.functions.scores import LAYER_MINUTES, layer_minutes, minutes_radius, ratio_bucket, station_status
from sensorlith.functions.times import boundaries_between, micros
from sensorlith.operators.series import arrange, shift

COUNTERS = (
    "num_bikes_available",
    "num_ebikes_available",
    "num_bikes_disabled",
    "num_docks_available",
    "num_docks_disabled",
    "is_installed",
    "is_renting",
    "is_returning",
)


def classified(status: DataFrame) -> DataFrame:
    c = F.col
    return status.withColumn(
        "status_class",
        station_status(c("is_installed"), c("is_renting"), c("is_returning"), c("num_bikes_available"), c("num_docks_available")),
    )


def status_intervals(status: DataFrame, max_gap_min: float, tie_break: tuple[str, ...] = ()) -> DataFrame:
    """From each status to the next of the same station; open ends, empty and too long intervals fall out.

    A gap in collection longer than ``max_gap_min`` says nothing about the station.
    """
    s = arrange(status, ["station_id"], ["source_last_updated_utc", *tie_break])
    s = shift(s, {"interval_end_utc": F.col("source_last_updated_utc")}, by=-1)
    kept = [c for c in COUNTERS if c in status.columns]
    out = s.result().withColumnRenamed("source_last_updated_utc", "interval_start_utc")
    seconds = boundaries_between("second", F.col("interval_start_utc"), F.col("interval_end_utc"))
    out = out.withColumn("duration_sec", seconds).filter(
        (F.col("duration_sec") > 0) & (F.col("duration_sec") <= max_gap_min * 60)
    )
    return out.select(
        "station_id",
        "interval_start_utc",
        "interval_end_utc",
        "duration_sec",
        (F.col("duration_sec") / 60.0).alias("duration_min"),
        "status_class",
        *kept,
    )


def newest_end(intervals: DataFrame) -> DataFrame:
    return intervals.agg(F.count(F.lit(1)).alias("interval_count"), F.max("interval_end_utc").alias("latest_interval_end_utc"))


def looking_back(intervals: DataFrame, hours: float | None) -> DataFrame:
    """Only intervals that end within the last hours before the newest end; all, if not asked for."""
    if hours is None:
        return intervals
    newest = intervals.select(F.max(micros(F.col("interval_end_utc")))).scalar()
    return intervals.filter(micros(F.col("interval_end_utc")) >= newest - int(hours * 3_600_000_000))


def status_summary(intervals: DataFrame) -> DataFrame:
    minutes = F.sum("duration_sec") / 60.0
    return (
        intervals.groupBy("status_class")
        .agg(
            F.count(F.lit(1)).alias("interval_count"),
            half_up(minutes, 2).alias("total_minutes"),
            half_up(minutes / F.count(F.lit(1)), 2).alias("avg_minutes"),
        )
        .orderBy(F.desc("total_minutes"), "status_class")
    )


def _minutes(*states: str) -> Column:
    return F.sum(F.when(F.col("status_class").isin(*states), F.col("duration_sec")).otherwise(0)) / 60.0


def reliability(intervals: DataFrame, stations: DataFrame, min_observed_min: float) -> DataFrame:
    """Minutes per state and failure ratios of each station that is installed and has docks.

    Minutes are summed per station before the station table is joined.
    """
    observed = F.sum("duration_sec") / 60.0
    ratio = lambda *states: half_up(F.try_divide(_minutes(*states), F.nullif(observed, F.lit(0.0))), 4)
    per_station = (
        intervals.filter(F.col("status_class") != "not_installed")
        .groupBy("station_id")
        .agg(
            observed.alias("_observed"),
            half_up(observed, 2).alias("observed_minutes"),
            *[half_up(_minutes(s), 2).alias(f"{s}_minutes") for s in ("available", "empty", "full", "offline")],
            ratio("available").alias("availability_ratio"),
            ratio("empty", "offline").alias("rental_failure_ratio"),
            ratio("full", "offline").alias("return_failure_ratio"),
            ratio("empty", "full", "offline").alias("any_failure_ratio"),
        )
        .filter(F.col("_observed") >= min_observed_min)
        .drop("_observed")
    )
    named = stations.select(
        "station_id",
        F.coalesce("name", F.lit("Unknown")).alias("station_name"),
        F.coalesce("capacity", F.lit(0)).alias("capacity"),
        "lat",
        "lon",
    )
    return (
        per_station.join(named, "station_id")
        .filter(F.col("capacity") > 0)
        .orderBy(F.desc("any_failure_ratio"), F.desc("observed_minutes"), "station_id")
    )


def map_layer(reliable: DataFrame, layer: str, min_observed_min: float) -> DataFrame:
    """Rows and marker columns of one map layer."""
    metric = {"overall": "any_failure_ratio", "rent": "rental_failure_ratio", "dock": "return_failure_ratio"}[layer]
    assert layer in LAYER_MINUTES
    minutes = layer_minutes(layer)
    return (
        reliable.dropna(subset=["lat", "lon"])
        .filter(F.col("observed_minutes") >= min_observed_min)
        .select(
            F.lit(layer).alias("layer"),
            "station_id",
            F.col(metric).alias("metric"),
            minutes.alias("layer_minutes"),
            minutes_radius(minutes).alias("radius"),
            ratio_bucket(F.col(metric)).alias("bucket"),
        )
    )
