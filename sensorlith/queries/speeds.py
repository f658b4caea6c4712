"""Road speed queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlith.functions.numbers import settled
from sensorlith.plans import speeds as S
from sensorlith.queries.city_tables import SPEEDS, link_speeds, road_segments
from sensorlith.queries.trip_tables import rnd
from sensorlith.registry import query


def settle(expr, digits):
    return rnd(rnd(expr, digits + 4), digits)


def even(expr, digits):
    return f"(round_even({expr} * 1e{digits}, 0) / 1e{digits})"


def mean_sql(expr, digits=4, where=""):
    return rnd(f"({rnd(f'(sum({expr}) {where})')} / (count({expr}) {where}))", digits)


FRESH_MIN = 1440

SCORED = (
    SPEEDS
    + f""",
baseline AS (
  SELECT link_id, count(*) AS observations, {mean_sql('speed_mph', 2)} AS avg_speed_mph, {settle('median(speed_mph)', 2)} AS median_speed_mph,
    {settle('quantile_cont(speed_mph, 0.75)', 2)} AS p75_speed_mph, {settle('quantile_cont(speed_mph, 0.9)', 2)} AS p90_speed_mph,
    {rnd('min(speed_mph)', 2)} AS min_speed_mph, {rnd('max(speed_mph)', 2)} AS max_speed_mph FROM usable GROUP BY link_id
),
newest AS (SELECT * FROM usable QUALIFY row_number() OVER (PARTITION BY link_id ORDER BY data_as_of DESC, reading_id DESC) = 1),
joined AS (
  SELECT n.link_id, data_as_of, (SELECT max(data_as_of) FROM usable) AS latest_data_as_of, coalesce(n.borough, s.borough) AS borough,
    s.link_name, s.owner, status, speed_mph AS current_speed_mph, travel_time_sec, b.* EXCLUDE (link_id),
    CASE WHEN p75_speed_mph > 0 THEN greatest(0.0, least(1.0, 1.0 - speed_mph / p75_speed_mph)) END AS ratio
  FROM newest n JOIN baseline b USING (link_id) LEFT JOIN segments s USING (link_id)
),
scored AS (
  SELECT * EXCLUDE (ratio), date_diff('minute', data_as_of, latest_data_as_of) AS minutes_behind_latest,
    date_diff('minute', data_as_of, latest_data_as_of) <= {FRESH_MIN} AS is_fresh,
    {settle('ratio', 4)} AS slowdown_ratio, {settle('(100.0 * ratio)', 1)} AS traffic_stress_score FROM joined
)"""
)

COLUMNS = """link_id data_as_of latest_data_as_of minutes_behind_latest is_fresh borough link_name owner status current_speed_mph travel_time_sec
 observations avg_speed_mph median_speed_mph p75_speed_mph p90_speed_mph min_speed_mph max_speed_mph slowdown_ratio traffic_stress_score""".split()


def current(spark, sf):
    return S.current_segments(link_speeds(spark, sf), road_segments(spark, sf), FRESH_MIN, "reading_id")


@query("speed_baseline", f"WITH {SCORED} SELECT * FROM baseline")
def speed_baseline(spark, sf):
    return S.baseline(S.usable(link_speeds(spark, sf)))


@query("speed_cleaned", f"WITH {SPEEDS} SELECT reading_id, link_id, speed_mph, coalesce(u.borough, s.borough) AS borough, s.link_name, s.owner FROM usable u LEFT JOIN segments s USING (link_id)")
def speed_cleaned(spark, sf):
    return S.described(S.usable(link_speeds(spark, sf)), road_segments(spark, sf)).select(
        "reading_id", "link_id", "speed_mph", "borough", "link_name", "owner"
    )


@query("speed_current_segments", f"WITH {SCORED} SELECT {', '.join(COLUMNS)} FROM scored")
def speed_current_segments(spark, sf):
    return current(spark, sf).select(*COLUMNS)


def _fresh_mean(column, name):
    return even(mean_sql(column, 7, "FILTER (WHERE is_fresh)"), 3) + f" AS {name}"


@query(
    "speed_borough_summary",
    f"""WITH {SCORED} SELECT borough, count(*) FILTER (WHERE is_fresh) AS segment_count, {_fresh_mean('current_speed_mph', 'avg_current_speed_mph')},
        {_fresh_mean('p75_speed_mph', 'avg_baseline_p75_mph')}, {_fresh_mean('slowdown_ratio', 'avg_slowdown_ratio')},
        {_fresh_mean('traffic_stress_score', 'avg_traffic_stress_score')}, count(*) FILTER (WHERE NOT is_fresh) AS stale_count
        FROM scored GROUP BY borough HAVING count(*) FILTER (WHERE is_fresh) > 0""",
)
def speed_borough_summary(spark, sf):
    return S.borough_summary(current(spark, sf))


@query("speed_most_stressed", f"WITH {SCORED} SELECT link_id, traffic_stress_score, current_speed_mph FROM scored WHERE is_fresh ORDER BY traffic_stress_score DESC NULLS LAST, current_speed_mph, link_id LIMIT 30")
def speed_most_stressed(spark, sf):
    return S.most_stressed(current(spark, sf)).select("link_id", "traffic_stress_score", "current_speed_mph")


_DESC = ["minutes_behind_latest", "current_speed_mph", "p75_speed_mph", "traffic_stress_score"]


@query(
    "speed_coverage_description",
    f"WITH {SCORED} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS n, {mean_sql(c)} AS mean, {settle(f'stddev_samp({c})', 4)} AS std, CAST(min({c}) AS DOUBLE) AS min,
            CAST(max({c}) AS DOUBLE) AS max, {settle(f'quantile_cont({c}, 0.25)', 4)} AS p25, {settle(f'quantile_cont({c}, 0.5)', 4)} AS p50,
            {settle(f'quantile_cont({c}, 0.75)', 4)} AS p75 FROM scored""" for c in _DESC
    ),
)
def speed_coverage_description(spark, sf):
    return S.coverage_description(current(spark, sf), _DESC)


@query(
    "road_polyline_points",
    f"""WITH {SPEEDS} SELECT link_id, 3 AS point_count, lat0 AS start_lat, lon0 AS start_lon, lat2 AS end_lat, lon2 AS end_lon FROM segments""",
)
def road_polyline_points(spark, sf):
    return road_segments(spark, sf).select("link_id", "point_count", "start_lat", "start_lon", "end_lat", "end_lon")
