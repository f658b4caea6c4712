"""Weather context per location: the forecast that applies, newest observation, alerts, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlith.functions.numbers import clamp, half_even, stable_mean
from sensorlith.functions.scores import (
    precipitation_points,
    severity_points,
    temperature_points,
    weather_class,
    wind_points,
)
from sensorlith.functions.times import boundaries_between
from sensorlith.operators.series import latest


def newest_snapshots(forecasts: DataFrame) -> DataFrame:
    return forecasts.groupBy("location_id").agg(F.max("observed_at_utc").alias("latest_observed_at_utc"))


def period_priority() -> Column:
    """0 covers the snapshot, 1 lies ahead, 2 has passed."""
    seen, start, end = F.col("observed_at_utc"), F.col("forecast_start_utc"), F.col("forecast_end_utc")
    return F.when((start <= seen) & (end > seen), 0).when(start > seen, 1).otherwise(2)


def current_forecast(forecasts: DataFrame, tie_break: str) -> DataFrame:
    """One period per location: of the newest snapshot the best by priority, then nearest in minutes.

    One aggregate does both: the snapshot time is the first thing compared.
    """
    away = F.abs(boundaries_between("minute", F.col("observed_at_utc"), F.col("forecast_start_utc")))
    return latest(
        forecasts,
        ["location_id"],
        [F.col("observed_at_utc"), -period_priority(), -away, -F.col(tie_break)],
    )


def newest_observation(observations: DataFrame, tie_break: str) -> DataFrame:
    """By observation time (a missing one loses), then by snapshot."""
    return latest(observations, ["location_id"], [F.col("observation_time_utc"), F.col("observed_at_utc"), F.col(tie_break)])


def alert_summary(alerts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Alerts of the newest snapshot: how many, how severe, and which. Event names are made distinct before they are joined up."""
    now = alerts.join(
        snapshots, (alerts["location_id"] == snapshots["location_id"]) & (alerts["observed_at_utc"] == snapshots["latest_observed_at_utc"])
    ).select(alerts["location_id"], "severity", "event")
    per_event = now.groupBy("location_id", "event").agg(
        F.count(F.lit(1)).alias("n"), F.max(severity_points(F.col("severity"))).alias("points")
    )
    return per_event.groupBy("location_id").agg(
        F.sum("n").alias("active_alert_count"),
        F.max("points").alias("alert_component"),
        F.array_join(F.array_sort(F.collect_set("event")), "; ").alias("active_alert_events"),
    )


def context(forecasts: DataFrame, observations: DataFrame, alerts: DataFrame, tie_break: str) -> DataFrame:
    snapshots = newest_snapshots(forecasts)
    seen = newest_observation(observations, tie_break).select(
        "location_id",
        "station_id",
        "observation_time_utc",
        F.col("temperature_f").alias("observed_temperature_f"),
        F.col("wind_speed_mph").alias("observed_wind_speed_mph"),
        F.col("text_description").alias("observed_condition"),
    )
    joined = (
        current_forecast(forecasts, tie_break)
        .join(seen, "location_id", "left")
        .join(alert_summary(alerts, snapshots), "location_id", "left")
        .join(snapshots, "location_id", "left")
        .fillna({"active_alert_count": 0, "alert_component": 0.0, "active_alert_events": ""})
    )
    points = {
        "precip_component": precipitation_points(F.col("precipitation_probability_pct")),
        "wind_component": wind_points(F.col("wind_speed_mph_est")),
        "temperature_component": temperature_points(F.col("temperature_f")),
    }
    total = sum(points.values(), F.lit(0.0)) + F.col("alert_component")
    scored = joined.withColumns(
        {**{n: half_even(p, 2) for n, p in points.items()}, "weather_stress_score": half_even(clamp(total, 0.0, 100.0), 2)}
    )
    c = F.col
    return scored.withColumn(
        "weather_stress_class",
        weather_class(
            c("active_alert_count"), c("precipitation_probability_pct"), c("wind_speed_mph_est"), c("temperature_f"), c("weather_stress_score")
        ),
    )


def city_summary(ctx: DataFrame) -> DataFrame:
    """One row; among equally common classes the first by name is dominant."""
    classes = ctx.groupBy("weather_stress_class").agg(F.count(F.lit(1)).alias("n"))
    dominant = classes.select(F.min_by("weather_stress_class", F.struct(-F.col("n"), F.col("weather_stress_class")))).scalar()
    return ctx.agg(
        F.count(F.lit(1)).alias("location_count"),
        half_even(stable_mean(F.sum("weather_stress_score"), F.count("weather_stress_score"), 7), 2).alias("avg_weather_stress_score"),
        half_even(F.max("weather_stress_score"), 2).alias("max_weather_stress_score"),
        half_even(F.max(F.coalesce("precipitation_probability_pct", F.lit(0.0))), 2).alias("max_precip_probability_pct"),
        half_even(F.max(F.coalesce("wind_speed_mph_est", F.lit(0.0))), 2).alias("max_wind_speed_mph_est"),
        F.count_if(F.col("active_alert_count") > 0).alias("active_alert_locations"),
    ).withColumn("dominant_weather_class", dominant)
