"""Station, road and weather tables derived from events, customers and suppliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlith.functions.geo import parse_points
from sensorlith.functions.units import wind_text_mph
from sensorlith.queries.trip_tables import table

c = F.col


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


EVENTS = "ev AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)"


def station_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    kind = c("event_type")
    return e.select(
        c("user_id").alias("station_id"),
        c("event_id").alias("snapshot_id"),
        c("ts").alias("source_last_updated_utc"),
        F.when((kind == "view") & (c("k") < 60), 0).otherwise(c("k") % 20).alias("num_bikes_available"),
        F.when((kind == "purchase") & (c("k") < 60), 0).otherwise(20 - c("k") % 20).alias("num_docks_available"),
        F.when((kind == "signup") & (c("k") % 10 == 9), 0).otherwise(1).alias("is_installed"),
        F.when(kind == "error", 0).otherwise(1).alias("is_renting"),
        F.when((kind == "error") & (c("k") < 80), 0).otherwise(1).alias("is_returning"),
    )


STATUS = (
    EVENTS
    + """,
status AS (
  SELECT user_id AS station_id, event_id AS snapshot_id, ts AS source_last_updated_utc,
    CASE WHEN event_type = 'view' AND k < 60 THEN 0 ELSE k % 20 END AS num_bikes_available,
    CASE WHEN event_type = 'purchase' AND k < 60 THEN 0 ELSE 20 - k % 20 END AS num_docks_available,
    CASE WHEN event_type = 'signup' AND k % 10 = 9 THEN 0 ELSE 1 END AS is_installed,
    CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS is_renting,
    CASE WHEN event_type = 'error' AND k < 80 THEN 0 ELSE 1 END AS is_returning
  FROM ev
),
classified AS (
  SELECT *, CASE WHEN is_installed = 0 THEN 'not_installed' WHEN is_renting = 0 AND is_returning = 0 THEN 'offline'
    WHEN num_bikes_available = 0 AND is_renting = 1 THEN 'empty' WHEN num_docks_available = 0 AND is_returning = 1 THEN 'full'
    ELSE 'available' END AS status_class FROM status
),
intervals AS (
  SELECT * FROM (
    SELECT station_id, source_last_updated_utc AS interval_start_utc,
      lead(source_last_updated_utc) OVER (PARTITION BY station_id ORDER BY source_last_updated_utc, snapshot_id) AS interval_end_utc,
      date_diff('second', interval_start_utc, interval_end_utc) AS duration_sec, status_class FROM classified)
  WHERE duration_sec > 0 AND duration_sec <= 86400
)"""
)

MAX_GAP_MIN = 24 * 60


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = c("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("station_id"),
        c("c_name").alias("name"),
        c("c_nationkey").alias("capacity"),
        (40.5 + (key * 7919 % 4000) / 10000.0).alias("lat"),
        (-74.2 + (key * 104729 % 5000) / 10000.0).alias("lon"),
    )


STATIONS = """
stations AS (SELECT c_custkey AS station_id, c_name AS name, c_nationkey AS capacity,
  40.5 + (c_custkey * 7919 % 4000) / 10000.0 AS lat, -74.2 + (c_custkey * 104729 % 5000) / 10000.0 AS lon FROM customer)"""


def link_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    kind = c("event_type")
    return e.select(
        c("user_id").alias("link_id"),
        c("event_id").alias("reading_id"),
        c("ts").alias("data_as_of"),
        F.when(kind == "error", 0.0).when((kind == "signup") & (c("k") < 10), None).otherwise(c("value")).alias("speed_mph"),
        c("k").alias("travel_time_sec"),
        kind.alias("status"),
        F.when(kind == "click", None).otherwise(F.concat(F.lit("B"), (c("user_id") % 5).cast("string"))).alias("borough"),
        F.lit(None).cast("string").alias("link_name"),
        F.lit(None).cast("string").alias("owner"),
    )


def points_text(key: Column) -> Column:
    lat, lon = 5000 + key * 7919 % 4000, 6500 + key * 104729 % 3300
    pair = lambda dy, dx: F.concat(F.lit("40."), (lat + dy).cast("string"), F.lit(",-73."), (lon + dx).cast("string"))
    text = F.concat_ws(" ", pair(0, 0), pair(40, 60), pair(90, 30))
    return F.when(key % 7 == 0, F.concat(text, F.lit(" 40.9,"))).otherwise(text)


def road_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One road link per supplier, with three points; every seventh text has a broken last token."""
    key = c("s_suppkey")
    df = table(spark, sf_dir, "supplier").select(
        key.alias("link_id"),
        c("s_name").alias("link_name"),
        F.concat(F.lit("N"), c("s_nationkey").cast("string")).alias("borough"),
        F.concat(F.lit("owner"), (c("s_nationkey") % 4).cast("string")).alias("owner"),
        points_text(key).alias("link_points"),
    )
    points = parse_points(c("link_points"))
    return df.withColumn("points", points).withColumns(
        {
            "start_lat": F.try_element_at("points", F.lit(1))["lat"],
            "start_lon": F.try_element_at("points", F.lit(1))["lon"],
            "end_lat": F.try_element_at("points", F.lit(-1))["lat"],
            "end_lon": F.try_element_at("points", F.lit(-1))["lon"],
            "point_count": F.size("points"),
        }
    )


SPEEDS = (
    EVENTS
    + """,
speeds AS (
  SELECT user_id AS link_id, event_id AS reading_id, ts AS data_as_of,
    CASE WHEN event_type = 'error' THEN 0.0 WHEN event_type = 'signup' AND k < 10 THEN NULL ELSE value END AS speed_mph,
    k AS travel_time_sec, event_type AS status,
    CASE WHEN event_type <> 'click' THEN 'B' || CAST(user_id % 5 AS VARCHAR) END AS borough FROM ev
),
usable AS (SELECT * FROM speeds WHERE speed_mph > 0),
link_geo AS (
  SELECT s_suppkey AS link_id, s_name AS link_name, 'N' || CAST(s_nationkey AS VARCHAR) AS borough,
    'owner' || CAST(s_nationkey % 4 AS VARCHAR) AS owner, 5000 + s_suppkey * 7919 % 4000 AS la, 6500 + s_suppkey * 104729 % 3300 AS lo
  FROM supplier
),
segments AS (
  SELECT link_id, link_name, borough, owner,
    CAST('40.' || la AS DOUBLE) AS lat0, CAST('-73.' || lo AS DOUBLE) AS lon0,
    CAST('40.' || (la + 40) AS DOUBLE) AS lat1, CAST('-73.' || (lo + 60) AS DOUBLE) AS lon1,
    CAST('40.' || (la + 90) AS DOUBLE) AS lat2, CAST('-73.' || (lo + 30) AS DOUBLE) AS lon2 FROM link_geo
)"""
)


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    day = F.date_trunc("day", c("ts")).cast("timestamp_ntz")
    k = c("k")
    text = (
        F.when(k % 4 == 0, "")
        .when(k % 4 == 1, F.concat((k % 30).cast("string"), F.lit(" mph")))
        .otherwise(F.concat((k % 20).cast("string"), F.lit(" to "), (k % 40).cast("string"), F.lit(" mph")))
    )
    start = day + F.make_dt_interval(hours=(c("event_id") % 7 - 3).cast("int"))
    return e.select(
        c("user_id").alias("location_id"),
        c("event_id"),
        day.alias("observed_at_utc"),
        start.alias("forecast_start_utc"),
        (start + F.make_dt_interval(hours=F.lit(1))).alias("forecast_end_utc"),
        (20.0 + k * 0.75).alias("temperature_f"),
        F.when(c("event_type") != "error", k.cast("double")).alias("precipitation_probability_pct"),
        wind_text_mph(text).alias("wind_speed_mph_est"),
        c("event_type").alias("short_forecast"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        c("user_id").alias("location_id"),
        c("event_id"),
        F.concat(F.lit("S"), (c("k") % 3).cast("string")).alias("station_id"),
        F.when(c("event_type") != "signup", c("ts")).alias("observation_time_utc"),
        F.date_trunc("day", c("ts")).cast("timestamp_ntz").alias("observed_at_utc"),
        c("k").cast("double").alias("temperature_f"),
        (c("k") / 4.0).alias("wind_speed_mph"),
        c("event_type").alias("text_description"),
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(s) for s in ("Extreme", "Severe", "Moderate", "Minor", "Unknown", "Other")])
    return (
        events(spark, sf_dir)
        .filter(c("event_type") == "error")
        .select(
            c("user_id").alias("location_id"),
            F.date_trunc("day", c("ts")).cast("timestamp_ntz").alias("observed_at_utc"),
            F.element_at(names, c("k") % 6 + 1).alias("severity"),
            F.concat(F.lit("Alert "), (c("k") % 3).cast("string")).alias("event"),
        )
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known coordinates of some weather locations."""
    key = c("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("location_id"), (40.5 + (key * 3571 % 4500) / 10000.0).alias("lat"), (-74.2 + (key * 6007 % 5500) / 10000.0).alias("lon")
    )


WEATHER = """
fc AS (
  SELECT user_id AS location_id, event_id, date_trunc('day', ts) AS observed_at_utc,
    date_trunc('day', ts) + to_hours(event_id % 7 - 3) AS forecast_start_utc,
    date_trunc('day', ts) + to_hours(event_id % 7 - 2) AS forecast_end_utc,
    20.0 + k * CAST(0.75 AS DOUBLE) AS temperature_f,
    CASE WHEN event_type <> 'error' THEN CAST(k AS DOUBLE) END AS precipitation_probability_pct,
    CAST(CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN k % 30 ELSE greatest(k % 20, k % 40) END AS DOUBLE) AS wind_speed_mph_est,
    event_type AS short_forecast FROM ev
),
snap AS (SELECT location_id, max(observed_at_utc) AS latest_observed_at_utc FROM fc GROUP BY location_id),
cur AS (
  SELECT fc.* FROM fc JOIN snap ON fc.location_id = snap.location_id AND observed_at_utc = latest_observed_at_utc
  QUALIFY row_number() OVER (PARTITION BY fc.location_id ORDER BY
    CASE WHEN forecast_start_utc <= observed_at_utc AND forecast_end_utc > observed_at_utc THEN 0
         WHEN forecast_start_utc > observed_at_utc THEN 1 ELSE 2 END,
    abs(date_diff('minute', observed_at_utc, forecast_start_utc)), event_id) = 1
),
obs AS (
  SELECT user_id AS location_id, 'S' || CAST(k % 3 AS VARCHAR) AS station_id, CASE WHEN event_type <> 'signup' THEN ts END AS observation_time_utc,
    CAST(k AS DOUBLE) AS observed_temperature_f, k / 4.0 AS observed_wind_speed_mph, event_type AS observed_condition FROM ev
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type <> 'signup' THEN ts END DESC NULLS LAST,
    date_trunc('day', ts) DESC, event_id DESC) = 1
),
al AS (
  SELECT user_id AS location_id, count(*) AS active_alert_count,
    max(CASE k % 6 WHEN 0 THEN 65.0 WHEN 1 THEN 45.0 WHEN 2 THEN 25.0 WHEN 3 THEN 10.0 ELSE 0.0 END) AS alert_component,
    string_agg(DISTINCT 'Alert ' || CAST(k % 3 AS VARCHAR), '; ' ORDER BY 'Alert ' || CAST(k % 3 AS VARCHAR)) AS active_alert_events
  FROM ev JOIN snap ON user_id = location_id AND date_trunc('day', ts) = latest_observed_at_utc
  WHERE event_type = 'error' GROUP BY user_id
),
parts AS (
  SELECT cur.*, station_id, observation_time_utc, observed_temperature_f, observed_wind_speed_mph, observed_condition,
    coalesce(active_alert_count, 0) AS active_alert_count, CAST(coalesce(alert_component, 0) AS DOUBLE) AS alert_component,
    coalesce(active_alert_events, '') AS active_alert_events, latest_observed_at_utc,
    CASE WHEN precipitation_probability_pct IS NULL THEN 0 ELSE least(40, precipitation_probability_pct * CAST(0.4 AS DOUBLE)) END AS p,
    CASE WHEN wind_speed_mph_est > 15 THEN least(30, (wind_speed_mph_est - 15) * 1.5) ELSE 0 END AS w,
    CASE WHEN temperature_f >= 85 THEN least(25, (temperature_f - 85) * 2) WHEN temperature_f <= 32 THEN least(25, (32 - temperature_f) * 1.5) ELSE 0 END AS t
  FROM cur LEFT JOIN obs USING (location_id) LEFT JOIN al USING (location_id) LEFT JOIN snap USING (location_id)
),
ctx AS (
  SELECT * EXCLUDE (p, w, t), CAST(round_even(p * 100, 0) / 100 AS DOUBLE) AS precip_component,
    CAST(round_even(w * 100, 0) / 100 AS DOUBLE) AS wind_component, CAST(round_even(t * 100, 0) / 100 AS DOUBLE) AS temperature_component,
    CAST(round_even(greatest(0, least(100, 0.0 + p + w + t + alert_component)) * 100, 0) / 100 AS DOUBLE) AS weather_stress_score FROM parts
),
weather AS (
  SELECT *, CASE WHEN active_alert_count > 0 AND weather_stress_score >= 50 THEN 'active alert / high weather stress'
    WHEN active_alert_count > 0 THEN 'active weather alert'
    WHEN coalesce(precipitation_probability_pct, 0) >= 50 AND coalesce(wind_speed_mph_est, 0) >= 20 THEN 'wet and windy'
    WHEN coalesce(precipitation_probability_pct, 0) >= 50 THEN 'rain risk' WHEN coalesce(wind_speed_mph_est, 0) >= 25 THEN 'wind stress'
    WHEN temperature_f >= 90 THEN 'heat stress' WHEN temperature_f <= 32 THEN 'cold stress'
    WHEN weather_stress_score >= 35 THEN 'moderate weather stress' ELSE 'low weather stress' END AS weather_stress_class FROM ctx
)"""
