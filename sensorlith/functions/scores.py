"""Status classes, stress scores and map buckets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorlith.functions.numbers import clamp, half_even, half_up

# Alert severity in points.
SEVERITY_POINTS = {"Extreme": 65.0, "Severe": 45.0, "Moderate": 25.0, "Minor": 10.0, "Unknown": 0.0}

# Class limits for scores (percent) and ratios.
SCORE_LIMITS = (10.0, 25.0, 50.0, 75.0)
RATIO_LIMITS = (0.10, 0.25, 0.50, 0.75)

# Which minutes count for each map layer.
LAYER_MINUTES = {
    "overall": ("empty_minutes", "full_minutes", "offline_minutes"),
    "rent": ("empty_minutes", "offline_minutes"),
    "dock": ("full_minutes", "offline_minutes"),
}


def station_status(installed: Column, renting: Column, returning: Column, bikes: Column, docks: Column) -> Column:
    return (
        F.when(installed == 0, "not_installed")
        .when((renting == 0) & (returning == 0), "offline")
        .when((bikes == 0) & (renting == 1), "empty")
        .when((docks == 0) & (returning == 1), "full")
        .otherwise("available")
    )


def slowdown_ratio(speed: Column, p75: Column) -> Column:
    """1 − current / p75 within [0, 1]; null without a positive p75."""
    return F.when(p75 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - speed / p75)))


def precipitation_points(percent: Column) -> Column:
    return F.coalesce(clamp(percent * 0.40, 0.0, 40.0), F.lit(0.0))


def wind_points(mph: Column) -> Column:
    return F.when(mph > 15.0, clamp((mph - 15.0) * 1.5, 0.0, 30.0)).otherwise(0.0)


def temperature_points(fahrenheit: Column) -> Column:
    return (
        F.when(fahrenheit >= 85.0, clamp((fahrenheit - 85.0) * 2.0, 0.0, 25.0))
        .when(fahrenheit <= 32.0, clamp((32.0 - fahrenheit) * 1.5, 0.0, 25.0))
        .otherwise(0.0)
    )


def severity_points(severity: Column) -> Column:
    out = F.when(severity == "Extreme", SEVERITY_POINTS["Extreme"])
    for name in ("Severe", "Moderate", "Minor"):
        out = out.when(severity == name, SEVERITY_POINTS[name])
    return out.otherwise(SEVERITY_POINTS["Unknown"])


def weather_class(alerts: Column, precip: Column, wind: Column, temp: Column, score: Column) -> Column:
    precip = F.coalesce(precip, F.lit(0.0))
    wind = F.coalesce(wind, F.lit(0.0))
    return (
        F.when((alerts > 0) & (score >= 50), "active alert / high weather stress")
        .when(alerts > 0, "active weather alert")
        .when((precip >= 50) & (wind >= 20), "wet and windy")
        .when(precip >= 50, "rain risk")
        .when(wind >= 25, "wind stress")
        .when(temp >= 90, "heat stress")
        .when(temp <= 32, "cold stress")
        .when(score >= 35, "moderate weather stress")
        .otherwise("low weather stress")
    )


def mobility_class(bike: Column, traffic: Column) -> Column:
    return (
        F.when(traffic.isNull() & (bike >= 50), "bike stress only / no nearby detector")
        .when(traffic.isNull(), "no nearby traffic detector")
        .when((bike >= 50) & (traffic >= 50), "high bike + high traffic stress")
        .when((bike >= 50) & (traffic < 25), "bike stress only")
        .when((bike < 25) & (traffic >= 50), "traffic stress only")
        .when((bike < 25) & (traffic < 25), "low local stress")
        .otherwise("mixed / moderate stress")
    )


def weather_adjusted_score(fused: Column, bike: Column, weather: Column) -> Column:
    base = F.coalesce(fused, bike)
    mixed = clamp(0.85 * base + 0.15 * weather, 0.0, 100.0)
    return half_even(F.when(weather.isNull(), base).otherwise(mixed), 2)


def weather_adjusted_class(base: Column, score: Column, alerts: Column) -> Column:
    suffix = (
        F.when(score.isNull(), "weather unknown")
        .when(alerts > 0, "weather alert")
        .when(score >= 50, "high weather stress")
        .when(score >= 25, "moderate weather stress")
        .otherwise("low weather stress")
    )
    return F.concat(F.coalesce(base, F.lit("unknown")), F.lit(" / "), suffix)


def bucket(x: Column, limits: tuple[float, ...], low: float, high: float) -> Column:
    """0 for the lowest class up to len(limits); null stays null."""
    x = clamp(x, low, high)
    out = F.when(x.isNull(), F.lit(None).cast("int"))
    for i, limit in enumerate(limits):
        out = out.when(x < limit, i)
    return out.otherwise(len(limits))


def score_bucket(x: Column) -> Column:
    return bucket(x, SCORE_LIMITS, 0.0, 100.0)


def ratio_bucket(x: Column) -> Column:
    return bucket(x, RATIO_LIMITS, 0.0, 1.0)


def layer_minutes(layer: str) -> Column:
    total = F.lit(0.0)
    for name in LAYER_MINUTES[layer]:
        total = total + F.coalesce(F.col(name), F.lit(0.0))
    return total


def minutes_radius(minutes: Column) -> Column:
    return clamp(4.0 + minutes / 7.0, 4.0, 18.0)


def station_radius(score: Column, largest: float = 18.0) -> Column:
    return F.coalesce(clamp(5.0 + score / 8.0, 5.0, largest), F.lit(5.0))


def traffic_weight(score: Column) -> Column:
    return F.coalesce(clamp(2.0 + score / 25.0, 2.0, 6.0), F.lit(2.0))


def rounded_score(ratio: Column) -> Column:
    return half_up(100.0 * ratio, 1)
