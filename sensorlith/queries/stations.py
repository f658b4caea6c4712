"""Station intervals and reliability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sensorlith.plans import stations as S
from sensorlith.queries.city_tables import MAX_GAP_MIN, STATIONS, STATUS, station_status, stations
from sensorlith.queries.trip_tables import rnd
from sensorlith.registry import query


def intervals(spark, sf):
    return S.status_intervals(S.classified(station_status(spark, sf)), MAX_GAP_MIN, ("snapshot_id",))


def reliability(spark, sf):
    return S.reliability(intervals(spark, sf), stations(spark, sf), 60)


def _min(states):
    return f"(sum(CASE WHEN status_class IN ({states}) THEN duration_sec ELSE 0 END) / 60.0)"


def _ratio(states, name):
    return rnd(f"({_min(states)} / nullif(sum(duration_sec) / 60.0, 0))") + f" AS {name}"


RELIABLE = (
    STATUS
    + ","
    + STATIONS
    + f""",
reliable AS (
  SELECT station_id, any_value(coalesce(name, 'Unknown')) AS station_name, any_value(coalesce(capacity, 0)) AS capacity,
    any_value(lat) AS lat, any_value(lon) AS lon, {rnd('(sum(duration_sec) / 60.0)', 2)} AS observed_minutes,
    {', '.join(f"{rnd(_min(repr(s)), 2)} AS {s}_minutes" for s in ('available', 'empty', 'full', 'offline'))},
    {_ratio("'available'", 'availability_ratio')}, {_ratio("'empty', 'offline'", 'rental_failure_ratio')},
    {_ratio("'full', 'offline'", 'return_failure_ratio')}, {_ratio("'empty', 'full', 'offline'", 'any_failure_ratio')}
  FROM intervals LEFT JOIN stations USING (station_id)
  WHERE status_class <> 'not_installed' AND coalesce(capacity, 0) > 0
  GROUP BY station_id HAVING sum(duration_sec) / 60.0 >= 60
)"""
)


@query("station_status_classes", f"WITH {STATUS} SELECT station_id, snapshot_id, status_class FROM classified")
def station_status_classes(spark, sf):
    return S.classified(station_status(spark, sf)).select("station_id", "snapshot_id", "status_class")


@query("station_intervals", f"WITH {STATUS} SELECT station_id, interval_start_utc, interval_end_utc, {rnd('(duration_sec / 60.0)', 6)} AS duration_min, status_class FROM intervals")
def station_intervals(spark, sf):
    return intervals(spark, sf).select(
        "station_id", "interval_start_utc", "interval_end_utc", S.half_up(F.col("duration_min"), 6).alias("duration_min"), "status_class"
    )


@query("station_interval_coverage", f"WITH {STATUS} SELECT count(*) AS interval_count, max(interval_end_utc) AS latest_interval_end_utc FROM intervals")
def station_interval_coverage(spark, sf):
    return S.newest_end(intervals(spark, sf))


@query(
    "station_status_summary",
    f"""WITH {STATUS} SELECT status_class, count(*) AS interval_count, {rnd('(sum(duration_sec) / 60.0)', 2)} AS total_minutes,
        {rnd('(sum(duration_sec) / 60.0 / count(*))', 2)} AS avg_minutes FROM intervals GROUP BY status_class""",
)
def station_status_summary(spark, sf):
    return S.status_summary(intervals(spark, sf))


@query("station_reliability", f"WITH {RELIABLE} SELECT * FROM reliable")
def station_reliability(spark, sf):
    return reliability(spark, sf)


@query(
    "station_reliability_lookback",
    f"""WITH {STATUS}, recent AS (SELECT * FROM intervals WHERE interval_end_utc >= (SELECT max(interval_end_utc) FROM intervals) - INTERVAL 72 HOUR)
        SELECT status_class, count(*) AS interval_count, {rnd('(sum(duration_sec) / 60.0)', 2)} AS total_minutes,
        {rnd('(sum(duration_sec) / 60.0 / count(*))', 2)} AS avg_minutes FROM recent GROUP BY status_class""",
)
def station_reliability_lookback(spark, sf):
    return S.status_summary(S.looking_back(intervals(spark, sf), 72))


@query("station_least_reliable", f"WITH {RELIABLE} SELECT station_id, any_failure_ratio, observed_minutes FROM reliable ORDER BY any_failure_ratio DESC, observed_minutes DESC, station_id LIMIT 20")
def station_least_reliable(spark, sf):
    return reliability(spark, sf).select("station_id", "any_failure_ratio", "observed_minutes").limit(20)


_LAYERS = {"overall": ("any_failure_ratio", "empty_minutes + full_minutes + offline_minutes"),
           "rent": ("rental_failure_ratio", "empty_minutes + offline_minutes"), "dock": ("return_failure_ratio", "full_minutes + offline_minutes")}


@query(
    "station_map_layers",
    f"WITH {RELIABLE} " + " UNION ALL ".join(
        f"""SELECT '{n}' AS layer, station_id, {m} AS metric, {rnd(f'({x})')} AS layer_minutes,
            {rnd(f'greatest(4.0, least(18.0, 4.0 + ({x}) / 7.0))')} AS radius,
            CASE WHEN {m} < 0.1 THEN 0 WHEN {m} < 0.25 THEN 1 WHEN {m} < 0.5 THEN 2 WHEN {m} < 0.75 THEN 3 ELSE 4 END AS bucket
            FROM reliable WHERE observed_minutes >= 120""" for n, (m, x) in _LAYERS.items()
    ),
)
def station_map_layers(spark, sf):
    reliable = reliability(spark, sf)
    layers = [S.map_layer(reliable, n, 120) for n in _LAYERS]
    out = reduce(lambda a, b: a.unionByName(b), layers)
    return out.withColumns({c: S.half_up(F.col(c), 4) for c in ("layer_minutes", "radius")})
