"""Weather context queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlith.plans import weather as W
from sensorlith.queries.city_tables import EVENTS, WEATHER, alerts, events, forecasts, observations
from sensorlith.queries.speeds import even, mean_sql, settle
from sensorlith.functions.numbers import settled
from sensorlith.functions.units import fahrenheit, mps_to_mph, wind_text_mph
from sensorlith.registry import query

SQL = f"WITH {EVENTS}, {WEATHER}"


def context(spark, sf):
    return W.context(forecasts(spark, sf), observations(spark, sf), alerts(spark, sf), "event_id")


@query("weather_newest_snapshots", f"{SQL} SELECT * FROM snap")
def weather_newest_snapshots(spark, sf):
    return W.newest_snapshots(forecasts(spark, sf))


@query("weather_current_forecast", f"{SQL} SELECT * FROM cur")
def weather_current_forecast(spark, sf):
    return W.current_forecast(forecasts(spark, sf), "event_id")


@query("weather_newest_observation", f"{SQL} SELECT location_id, station_id, observation_time_utc, observed_condition FROM obs")
def weather_newest_observation(spark, sf):
    return W.newest_observation(observations(spark, sf), "event_id").select(
        "location_id", "station_id", "observation_time_utc", F.col("text_description").alias("observed_condition")
    )


@query("weather_alert_summary", f"{SQL} SELECT location_id, active_alert_count, CAST(alert_component AS DOUBLE) AS alert_component, active_alert_events FROM al")
def weather_alert_summary(spark, sf):
    return W.alert_summary(alerts(spark, sf), W.newest_snapshots(forecasts(spark, sf)))


@query("weather_context", f"{SQL} SELECT * FROM weather")
def weather_context(spark, sf):
    return context(spark, sf)


@query(
    "weather_city_summary",
    f"""{SQL} SELECT count(*) AS location_count, {even(mean_sql('weather_stress_score', 7), 2)} AS avg_weather_stress_score,
        max(weather_stress_score) AS max_weather_stress_score, max(coalesce(precipitation_probability_pct, 0)) AS max_precip_probability_pct,
        max(coalesce(wind_speed_mph_est, 0)) AS max_wind_speed_mph_est, count(*) FILTER (WHERE active_alert_count > 0) AS active_alert_locations,
        (SELECT weather_stress_class FROM weather GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS dominant_weather_class FROM weather""",
)
def weather_city_summary(spark, sf):
    return W.city_summary(context(spark, sf))


@query(
    "weather_unit_conversions",
    f"""WITH {EVENTS} SELECT event_id, {settle("CASE WHEN event_type = 'view' THEN k * 9.0 / 5.0 + 32.0 ELSE k END", 4)} AS temperature_f,
        {settle('(value * CAST(2.2369362921 AS DOUBLE))', 4)} AS wind_mph,
        CAST(CASE WHEN k % 3 = 0 THEN greatest(k, k % 11 + 0.5) WHEN k % 3 = 1 THEN NULL ELSE k END AS DOUBLE) AS text_mph FROM ev""",
)
def weather_unit_conversions(spark, sf):
    k = F.col("k")
    text = (
        F.when(k % 3 == 0, F.format_string("%d.5 to %d mph", (k % 11).cast("int"), k))
        .when(k % 3 == 1, "calm")
        .otherwise(F.concat(k.cast("string"), F.lit("mph")))
    )
    return events(spark, sf).select(
        "event_id",
        settled(fahrenheit(k.cast("double"), F.when(F.col("event_type") == "view", "C").otherwise("F")), 4).alias("temperature_f"),
        settled(mps_to_mph(F.col("value")), 4).alias("wind_mph"),
        wind_text_mph(text).alias("text_mph"),
    )
