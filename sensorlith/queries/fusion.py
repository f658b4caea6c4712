"""Station, traffic and weather fusion queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sensorlith.functions import geo
from sensorlith.functions.numbers import settled
from sensorlith.functions.scores import traffic_weight
from sensorlith.plans import fusion as M
from sensorlith.queries import speeds as SP
from sensorlith.queries import stations as ST
from sensorlith.queries import weather as WE
from sensorlith.queries.city_tables import EVENTS, WEATHER, places, road_segments
from sensorlith.queries.speeds import even, mean_sql, settle
from sensorlith.queries.trip_tables import rnd
from sensorlith.registry import query
from sensorlith.session import cut

RADIUS_M = 1500.0


def links(spark, sf):
    """Current stress of the links that have a geometry."""
    shape = road_segments(spark, sf).select("link_id", "points")
    return SP.current(spark, sf).join(shape, "link_id").select("link_id", "link_name", "traffic_stress_score", "points")


def fused(spark, sf):
    return M.fuse(cut(ST.reliability(spark, sf)), links(spark, sf), RADIUS_M, 0.5, 0.5)


def adjusted(spark, sf):
    return M.with_weather(cut(fused(spark, sf)), cut(WE.context(spark, sf)), places(spark, sf))


R = "CAST(6371000.0 AS DOUBLE)"


def seven(expr, digits):
    return even(rnd(expr, digits + 6), digits)


def _seg(a, b):
    """Distance from the station to segment a–b in local metres, as SQL."""
    x = lambda i: f"({R} * (radians(lon{i}) - radians(s.lon)) * cos(radians(s.lat)))"
    y = lambda i: f"({R} * (radians(lat{i}) - radians(s.lat)))"
    dx, dy = f"({x(b)} - {x(a)})", f"({y(b)} - {y(a)})"
    t = f"greatest(0.0, least(1.0, -({x(a)} * {dx} + {y(a)} * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    px, py = f"({x(a)} + {t} * {dx})", f"({y(a)} + {t} * {dy})"
    return f"sqrt({px} * {px} + {py} * {py})"


# The speed tables again, without the shared event table they start with.
PAIRS = ST.RELIABLE + "," + SP.SCORED.removeprefix(EVENTS + ",")
FUSED = (
    PAIRS
    + f""",
lk AS (SELECT scored.link_id, scored.link_name, traffic_stress_score, lat0, lon0, lat1, lon1, lat2, lon2 FROM scored JOIN segments USING (link_id)
       WHERE traffic_stress_score IS NOT NULL),
pairs AS (SELECT station_id, link_id, link_name, traffic_stress_score, least({_seg(0, 1)}, {_seg(1, 2)}) AS d FROM reliable s CROSS JOIN lk),
near AS (SELECT station_id, count(*) AS nearby_traffic_segment_count,
           sum(exp(-d / {RADIUS_M}) * traffic_stress_score) / sum(exp(-d / {RADIUS_M})) AS local FROM pairs WHERE d <= {RADIUS_M} GROUP BY station_id),
closest AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY d, link_id) = 1),
fused0 AS (
  SELECT s.*, coalesce(nearby_traffic_segment_count, 0) AS nearby_traffic_segment_count, local, c.traffic_stress_score AS ns, c.d AS nd,
    c.link_name AS nearest_traffic_link_name, 100.0 * any_failure_ratio AS bike
  FROM reliable s LEFT JOIN near USING (station_id) LEFT JOIN closest c USING (station_id)
),
fused AS (
  SELECT station_id, station_name, capacity, lat AS station_lat, lon AS station_lon, observed_minutes, available_minutes, empty_minutes, full_minutes,
    offline_minutes, {seven('bike', 2)} AS bike_unusable_score, {seven('(100.0 * rental_failure_ratio)', 2)} AS unable_to_rent_score,
    {seven('(100.0 * return_failure_ratio)', 2)} AS unable_to_dock_score, nearby_traffic_segment_count, {seven('local', 2)} AS local_traffic_stress_score,
    {even('ns', 2)} AS nearest_traffic_stress_score, {seven('nd', 1)} AS nearest_traffic_distance_m, nearest_traffic_link_name,
    {seven('(0.5 * bike + 0.5 * local)', 2)} AS fusion_mobility_stress_score,
    CASE WHEN local IS NULL AND bike >= 50 THEN 'bike stress only / no nearby detector' WHEN local IS NULL THEN 'no nearby traffic detector'
      WHEN bike >= 50 AND local >= 50 THEN 'high bike + high traffic stress' WHEN bike >= 50 AND local < 25 THEN 'bike stress only'
      WHEN bike < 25 AND local >= 50 THEN 'traffic stress only' WHEN bike < 25 AND local < 25 THEN 'low local stress'
      ELSE 'mixed / moderate stress' END AS stress_class FROM fused0
)"""
)
ADJUSTED = (
    FUSED
    + ","
    + WEATHER
    + f""",
places AS (SELECT s_suppkey AS location_id, 40.5 + (s_suppkey * 3571 % 4500) / 10000.0 AS lat, -74.2 + (s_suppkey * 6007 % 5500) / 10000.0 AS lon FROM supplier),
wd AS (
  SELECT station_id, location_id, 2.0 * {R} * asin(sqrt(pow(sin(radians(lat - station_lat) / 2.0), 2) +
    cos(radians(station_lat)) * cos(radians(lat)) * pow(sin(radians(lon - station_lon) / 2.0), 2))) AS d
  FROM fused CROSS JOIN (SELECT location_id, lat, lon FROM weather JOIN places USING (location_id))
),
wn AS (SELECT * FROM wd QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY d, location_id) = 1),
adjusted AS (
  SELECT fused.*, wn.location_id AS nearest_weather_location_id, {seven('(d / 1000.0)', 2)} AS nearest_weather_distance_km,
    temperature_f AS weather_temperature_f, precipitation_probability_pct AS weather_precipitation_probability_pct,
    wind_speed_mph_est AS weather_wind_speed_mph_est, short_forecast AS weather_short_forecast, active_alert_count AS weather_active_alert_count,
    weather_stress_score, weather_stress_class,
    {even('greatest(0.0, least(100.0, 0.85 * coalesce(fusion_mobility_stress_score, bike_unusable_score) + 0.15 * weather_stress_score))', 2)}
      AS weather_adjusted_mobility_stress_score,
    stress_class || ' / ' || CASE WHEN active_alert_count > 0 THEN 'weather alert' WHEN weather_stress_score >= 50 THEN 'high weather stress'
      WHEN weather_stress_score >= 25 THEN 'moderate weather stress' ELSE 'low weather stress' END AS weather_adjusted_stress_class
  FROM fused JOIN wn USING (station_id) JOIN weather ON weather.location_id = wn.location_id
)"""
)


@query("fusion_stations", f"WITH {FUSED} SELECT * FROM fused")
def fusion_stations(spark, sf):
    return fused(spark, sf)


@query("fusion_top_stations", f"WITH {FUSED} SELECT station_id, fusion_mobility_stress_score FROM fused WHERE local_traffic_stress_score IS NOT NULL ORDER BY fusion_mobility_stress_score DESC, station_id LIMIT 50")
def fusion_top_stations(spark, sf):
    return M.top_stations(fused(spark, sf)).select("station_id", "fusion_mobility_stress_score")


def _mean2(column):
    return f"{even(mean_sql(column, 7), 2)} AS avg_{column}"


THREE = "bike_unusable_score local_traffic_stress_score fusion_mobility_stress_score".split()


@query("fusion_class_summary", f"WITH {FUSED} SELECT stress_class, count(station_id) AS station_count, {', '.join(map(_mean2, THREE))} FROM fused GROUP BY stress_class")
def fusion_class_summary(spark, sf):
    return M.class_summary(fused(spark, sf))


@query(
    "fusion_correlation",
    f"""WITH {FUSED}, cov AS (SELECT bike_unusable_score AS x, local_traffic_stress_score AS y FROM fused WHERE local_traffic_stress_score IS NOT NULL),
        rk AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
          rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM cov)
        SELECT CAST({RADIUS_M} AS DOUBLE) AS radius_m, (SELECT count(*) FROM fused) AS station_count, count(*) AS stations_with_nearby_traffic,
        {settle('(count(*) / (SELECT count(*) FROM fused))', 6)} AS coverage_ratio, {settle('corr(x, y)', 6)} AS pearson_bike_vs_traffic,
        {settle('corr(rx, ry)', 6)} AS spearman_bike_vs_traffic FROM rk HAVING count(*) >= 3""",
)
def fusion_correlation(spark, sf):
    return M.correlation(fused(spark, sf), RADIUS_M)


@query("fusion_with_weather", f"WITH {ADJUSTED} SELECT * FROM adjusted")
def fusion_with_weather(spark, sf):
    return adjusted(spark, sf)


FIVE = THREE + ["weather_stress_score", "weather_adjusted_mobility_stress_score"]


@query(
    "fusion_weather_summary",
    f"""WITH {ADJUSTED} SELECT nearest_weather_location_id, weather_stress_class, count(station_id) AS station_count, {', '.join(map(_mean2, FIVE))},
        max(weather_active_alert_count) AS max_weather_active_alert_count FROM adjusted GROUP BY ALL""",
)
def fusion_weather_summary(spark, sf):
    return M.weather_summary(adjusted(spark, sf))


SCORE = "coalesce(weather_adjusted_mobility_stress_score, fusion_mobility_stress_score, bike_unusable_score)"


@query(
    "fusion_station_markers",
    f"""WITH {ADJUSTED} SELECT station_id, {SCORE} AS score, CASE WHEN {SCORE} < 10 THEN 0 WHEN {SCORE} < 25 THEN 1 WHEN {SCORE} < 50 THEN 2
        WHEN {SCORE} < 75 THEN 3 ELSE 4 END AS bucket, {settle(f'greatest(5.0, least(18.0, 5.0 + {SCORE} / 8.0))', 4)} AS radius, stress_class
        FROM adjusted WHERE coalesce({SCORE}, 0) >= 10""",
)
def fusion_station_markers(spark, sf):
    return M.station_markers(adjusted(spark, sf), 10.0)


@query(
    "fusion_class_layers",
    f"WITH {FUSED} " + " UNION ALL ".join(
        f"SELECT '{layer}' AS layer, station_id FROM fused WHERE contains(lower(stress_class), '{text}')" for layer, text in M.CLASS_LAYERS.items()
    ),
)
def fusion_class_layers(spark, sf):
    return M.class_layers(fused(spark, sf))


@query("traffic_line_weights", f"WITH {SP.SCORED} SELECT link_id, {settle('greatest(2.0, least(6.0, 2.0 + traffic_stress_score / 25.0))', 4)} AS weight FROM scored WHERE traffic_stress_score >= 25")
def traffic_line_weights(spark, sf):
    rows = SP.current(spark, sf).filter(F.col("traffic_stress_score") >= 25)
    return rows.select("link_id", settled(traffic_weight(F.col("traffic_stress_score")), 4).alias("weight"))


@F.pandas_udf(StringType())
def _encoded(points: pd.Series) -> pd.Series:
    """Stand-in data: encode points the way road feeds do."""

    def one(pairs):
        flat = np.rint(np.array([[p["lat"], p["lon"]] for p in pairs]) * 1e5).astype(np.int64)
        deltas = np.diff(flat, axis=0, prepend=np.zeros((1, 2), dtype=np.int64)).ravel()
        out = []
        for v in ((deltas << 1) ^ (deltas >> 63)).tolist():
            while v >= 0x20:
                out.append(chr((0x20 | (v & 0x1F)) + 63))
                v >>= 5
            out.append(chr(v + 63))
        return "".join(out)

    return points.map(one)


@query(
    "road_geometry_choice",
    f"""WITH {SP.SPEEDS} SELECT link_id, CASE WHEN link_id % 3 = 0 THEN 'encoded' WHEN link_id % 3 = 1 THEN 'points' ELSE 'ends' END AS source,
        CASE WHEN link_id % 3 = 2 THEN 2 ELSE 3 END AS point_count, lat0 AS first_lat, lon0 AS first_lon FROM segments""",
)
def road_geometry_choice(spark, sf):
    """Encoded line, else point text, else the two ends; each has to pass the wide and the strict check."""
    seg = road_segments(spark, sf)
    kind = F.col("link_id") % 3
    far = F.array(F.struct(F.lit(10.0).alias("lat"), F.lit(10.0).alias("lon")), F.struct(F.lit(60.0).alias("lat"), F.lit(10.0).alias("lon")))
    seg = seg.withColumns(
        {
            "encoded": F.when(kind == 0, _encoded("points")).otherwise(_encoded(far)),
            "text_points": F.when(kind == 1, F.col("points")).otherwise(far),
        }
    ).withColumn("decoded", geo.decode_polyline("encoded"))
    ends = F.array(F.struct(F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon")), F.struct(F.col("end_lat").alias("lat"), F.col("end_lon").alias("lon")))
    candidates = {"encoded": F.col("decoded"), "points": F.col("text_points"), "ends": ends}
    chosen = seg.select("link_id", geo.choose_polyline(candidates, geo.WIDE_BOX).alias("chosen"))
    chosen = chosen.select("link_id", "chosen.*").filter(geo.usable_polyline(F.col("points"), geo.STRICT_BOX))
    return chosen.select(
        "link_id",
        "source",
        F.size("points").alias("point_count"),
        F.col("points")[0]["lat"].alias("first_lat"),
        F.col("points")[0]["lon"].alias("first_lon"),
    )
