"""Stations, traffic and weather brought together."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlith.functions.numbers import half_even, settled, settled_even, stable_mean
from sensorlith.functions.scores import (
    mobility_class,
    score_bucket,
    station_radius,
    weather_adjusted_class,
    weather_adjusted_score,
)
from sensorlith.operators.series import arrange, running_sum
from sensorlith.operators.spatial import lines_around, nearest_line, nearest_point, segments_of
from sensorlith.session import cut

# Map layers by stress class text.
CLASS_LAYERS = {
    "high bike + traffic": "high bike + high traffic",
    "bike stress only": "bike stress only",
    "traffic stress only": "traffic stress only",
}


def require_columns(df: DataFrame, needed: Iterable[str], what: str) -> DataFrame:
    """Raise a ValueError that names what is missing."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {missing}")
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def weights(bike: float, traffic: float) -> tuple[float, float]:
    if bike < 0 or traffic < 0:
        raise ValueError("weights must not be negative")
    if bike + traffic <= 0:
        raise ValueError("one weight must be positive")
    return bike / (bike + traffic), traffic / (bike + traffic)


def local_traffic(stations: DataFrame, links: DataFrame, radius_m: float) -> DataFrame:
    """Per station: links within the radius, their distance-weighted score, and the nearest link of all."""
    stations = stations.select("station_id", "lat", "lon")
    scored = cut(links.filter(F.col("traffic_stress_score").isNotNull() & (F.size("points") > 0)))
    segments = segments_of(scored, "link_id", "points")
    scores = scored.select("link_id", "traffic_stress_score", "link_name")
    near = lines_around(stations, segments, "link_id", radius_m).join(scores, "link_id")
    w = F.exp(-F.col("distance_m") / max(radius_m, 1.0))
    # sums per place: stations of one place share them, and pairs are not repeated for each station
    there = near.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("_n"), F.sum(w * F.col("traffic_stress_score")).alias("_scores"), F.sum(w).alias("_weights"))
    around = (
        stations.join(there, ["lat", "lon"])
        .groupBy("station_id")
        .agg(F.sum("_n").alias("nearby_traffic_segment_count"), (F.sum("_scores") / F.sum("_weights")).alias("local_score"))
    )
    closest = (
        nearest_line(stations, "station_id", segments, "link_id")
        .join(scores, "link_id")
        .select(
            "station_id",
            F.col("traffic_stress_score").alias("nearest_score"),
            F.col("distance_m").alias("nearest_m"),
            F.col("link_name").alias("nearest_traffic_link_name"),
        )
    )
    return stations.select("station_id").join(around, "station_id", "left").join(closest, "station_id", "left")


def fuse(stations: DataFrame, links: DataFrame, radius_m: float, bike_weight: float, traffic_weight: float) -> DataFrame:
    """One row per station with bike, traffic and mixed stress."""
    wb, wt = weights(bike_weight, traffic_weight)
    placed = stations.dropna(subset=["lat", "lon"])
    joined = placed.join(local_traffic(placed, links, radius_m), "station_id", "left")
    bike = 100.0 * F.col("any_failure_ratio")
    local = F.col("local_score")
    return joined.select(
        "station_id",
        "station_name",
        "capacity",
        F.col("lat").alias("station_lat"),
        F.col("lon").alias("station_lon"),
        "observed_minutes",
        "available_minutes",
        "empty_minutes",
        "full_minutes",
        "offline_minutes",
        settled_even(bike, 2).alias("bike_unusable_score"),
        settled_even(100.0 * F.col("rental_failure_ratio"), 2).alias("unable_to_rent_score"),
        settled_even(100.0 * F.col("return_failure_ratio"), 2).alias("unable_to_dock_score"),
        F.coalesce("nearby_traffic_segment_count", F.lit(0)).alias("nearby_traffic_segment_count"),
        settled_even(local, 2).alias("local_traffic_stress_score"),
        half_even(F.col("nearest_score"), 2).alias("nearest_traffic_stress_score"),
        settled_even(F.col("nearest_m"), 1).alias("nearest_traffic_distance_m"),
        "nearest_traffic_link_name",
        settled_even(wb * bike + wt * local, 2).alias("fusion_mobility_stress_score"),
        mobility_class(bike, local).alias("stress_class"),
    )


def top_stations(fused: DataFrame, k: int = 50) -> DataFrame:
    return fused.dropna(subset=["local_traffic_stress_score"]).orderBy(F.desc("fusion_mobility_stress_score"), "station_id").limit(k)


def class_summary(fused: DataFrame) -> DataFrame:
    mean = lambda c: half_even(stable_mean(F.sum(c), F.count(c), 7), 2).alias(f"avg_{c}")
    return fused.groupBy("stress_class").agg(
        F.count("station_id").alias("station_count"),
        mean("bike_unusable_score"),
        mean("local_traffic_stress_score"),
        mean("fusion_mobility_stress_score"),
    )


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """(value, mean rank of its ties): counts per value first, then a running sum over the values."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    one = counts.withColumn("_all", F.lit(0))
    s = running_sum(arrange(one, ["_all"], [column]), {"_upto": F.col("_n")})
    return s.result().select(F.col(column).alias(f"_{column}"), (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name))


def correlation(fused: DataFrame, radius_m: float) -> DataFrame:
    """Pearson and Spearman between bike and traffic stress; no row below three covered stations."""
    x, y = "bike_unusable_score", "local_traffic_stress_score"
    fused = cut(fused.select(x, y))
    covered = fused.dropna(subset=[y])
    for column, name in ((x, "_rx"), (y, "_ry")):
        ranks = average_ranks(covered, column, name)
        covered = covered.join(ranks, F.col(column) == F.col(f"_{column}"))
    stations = fused.select(F.count(F.lit(1))).scalar()
    return (
        covered.agg(
            F.count(F.lit(1)).alias("stations_with_nearby_traffic"),
            settled(F.corr(x, y), 6).alias("pearson_bike_vs_traffic"),
            settled(F.corr("_rx", "_ry"), 6).alias("spearman_bike_vs_traffic"),
        )
        .filter(F.col("stations_with_nearby_traffic") >= 3)
        .withColumns(
            {
                "radius_m": F.lit(float(radius_m)),
                "station_count": stations,
                "coverage_ratio": settled(F.col("stations_with_nearby_traffic") / stations, 6),
            }
        )
    )


FUSED_COLUMNS = ("station_id", "station_name", "station_lat", "station_lon", "bike_unusable_score", "fusion_mobility_stress_score", "stress_class")
WEATHER_COLUMNS = (
    "location_id",
    "temperature_f",
    "precipitation_probability_pct",
    "wind_speed_mph_est",
    "short_forecast",
    "active_alert_count",
    "weather_stress_score",
    "weather_stress_class",
)


def with_weather(fused: DataFrame, weather: DataFrame, places: DataFrame) -> DataFrame:
    """Nearest weather location with known coordinates, and the adjusted score and class."""
    require_columns(fused, FUSED_COLUMNS, "fusion table")
    require_columns(weather, WEATHER_COLUMNS, "weather table")
    known = weather.join(places.select("location_id", "lat", "lon").dropna(), "location_id")
    at = fused.select("station_id", F.col("station_lat").alias("lat"), F.col("station_lon").alias("lon"))
    nearest = nearest_point(at, "station_id", known, "location_id")
    attributes = known.select(
        "location_id",
        *[F.col(c).alias(f"weather_{c}") for c in ("temperature_f", "precipitation_probability_pct", "wind_speed_mph_est", "short_forecast")],
        F.coalesce("active_alert_count", F.lit(0)).alias("weather_active_alert_count"),
        "weather_stress_score",
        "weather_stress_class",
    )
    attached = nearest.join(attributes, "location_id").select(
        "station_id",
        F.col("location_id").alias("nearest_weather_location_id"),
        settled_even(F.col("distance_m") / 1000.0, 2).alias("nearest_weather_distance_km"),
        *attributes.columns[1:],
    )
    c = F.col
    return fused.join(attached, "station_id", "left").withColumns(
        {
            "weather_adjusted_mobility_stress_score": weather_adjusted_score(
                c("fusion_mobility_stress_score"), c("bike_unusable_score"), c("weather_stress_score")
            ),
            "weather_adjusted_stress_class": weather_adjusted_class(
                c("stress_class"), c("weather_stress_score"), c("weather_active_alert_count")
            ),
        }
    )


def weather_summary(adjusted: DataFrame) -> DataFrame:
    mean = lambda col: half_even(stable_mean(F.sum(col), F.count(col), 7), 2).alias(f"avg_{col}")
    return adjusted.groupBy("nearest_weather_location_id", "weather_stress_class").agg(
        F.count("station_id").alias("station_count"),
        mean("bike_unusable_score"),
        mean("local_traffic_stress_score"),
        mean("fusion_mobility_stress_score"),
        mean("weather_stress_score"),
        mean("weather_adjusted_mobility_stress_score"),
        F.max("weather_active_alert_count").alias("max_weather_active_alert_count"),
    )


def station_score() -> Column:
    """Best score at hand: weather-adjusted, else fused, else bike."""
    return F.coalesce("weather_adjusted_mobility_stress_score", "fusion_mobility_stress_score", "bike_unusable_score")


def station_markers(adjusted: DataFrame, min_score: float = 0.0, largest: float = 18.0) -> DataFrame:
    """Stations to draw: score at least ``min_score`` (a missing one counts 0), with size and bucket."""
    score = station_score()
    return adjusted.filter(F.coalesce(score, F.lit(0.0)) >= min_score).select(
        "station_id",
        score.alias("score"),
        score_bucket(score).alias("bucket"),
        settled(station_radius(score, largest), 4).alias("radius"),
        "stress_class",
    )


def class_layers(fused: DataFrame) -> DataFrame:
    """(layer, station): the class text is looked for literally, in any case."""
    hits = F.array_compact(
        F.array(*[F.when(F.contains(F.lower("stress_class"), F.lit(text)), F.lit(layer)) for layer, text in CLASS_LAYERS.items()])
    )
    return fused.select(F.explode(hits).alias("layer"), "station_id")
