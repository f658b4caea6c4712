"""Trip warehouse queries over all partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlith.plans import trips as T
from sensorlith.queries.trip_tables import RAW_TRIPS, STAGED, ZONES, raw_trips, rnd, stored_trips, zones
from sensorlith.registry import query
from sensorlith.session import work_path, written
from sensorlith.sources.landing import landing_path, read_trips

P = "taxi_type, data_year, data_month"
SUMS = {k: f"{rnd(f'sum({k}_amount)')} AS gross_{k}_amount" for k in ("total", "fare", "tip", "tolls")}
AVGS = {k: f"{rnd('(' + rnd(f'sum({c})') + f' / count({c}))')} AS {n}" for k, (c, n) in T.MEANS.items()}
MEDS = {k: f"{rnd(f'median({c})')} AS {n.replace('avg_', 'median_')}" for k, (c, n) in T.MEANS.items()}


def pick(source, *names):
    return ", ".join(source[n] for n in names)


ALL6 = ("total", "fare", "tip", "distance", "duration", "speed")


def staging(spark, sf):
    return T.staged(raw_trips(spark, sf))


def clean(spark, sf):
    return T.clean(staging(spark, sf))


def stored_clean(spark, sf):
    """Clean trips for reports that go over them several times: when, where and how much."""
    columns = [*T.PARTITION, "pickup_date", "pickup_hour", "pickup_location_id", "total_amount", *[T.MEANS[w][0] for w in ("distance", "duration", "speed")]]
    return T.narrow(clean(spark, sf), columns, "clean-trips")


@query(
    "trip_anomaly_counts",
    f"WITH {STAGED} " + " UNION ALL ".join(
        f"SELECT '{r}' AS anomaly_type, CAST(count(*) FILTER (WHERE {r}) AS BIGINT) AS row_count FROM flagged" for r in T.RULES
    ),
)
def trip_anomaly_counts(spark, sf):
    return T.anomaly_counts(staging(spark, sf))


@query(
    "trip_staging",
    f"""WITH {STAGED} SELECT taxi_type, data_year, data_month, CAST(pickup_date AS VARCHAR) AS pickup_date, pickup_hour, count(*) AS n,
        {rnd('sum(duration_min)')} AS minutes, {rnd('sum(speed_mph)', 3)} AS speed_sum, count(speed_mph) AS with_speed
        FROM staged GROUP BY ALL""",
)
def trip_staging(spark, sf):
    return staging(spark, sf).groupBy(*T.PARTITION, F.col("pickup_date").cast("string").alias("pickup_date"), "pickup_hour").agg(
        F.count(F.lit(1)).alias("n"),
        T.half_up(F.sum("duration_min"), 4).alias("minutes"),
        T.half_up(F.sum("speed_mph"), 3).alias("speed_sum"),
        F.count("speed_mph").alias("with_speed"),
    )


CLEAN_COLS = "order_id, line_id, pickup_datetime, dropoff_datetime, trip_distance, duration_min, pickup_location_id, dropoff_location_id"


@query("trip_clean_rows", f"WITH {STAGED} SELECT {CLEAN_COLS}, {rnd('speed_mph', 6)} AS speed_mph, {rnd('total_amount')} AS total_amount FROM clean")
def trip_clean_rows(spark, sf):
    return clean(spark, sf).select(
        *CLEAN_COLS.split(", "), T.half_up(F.col("speed_mph"), 6).alias("speed_mph"), T.half_up(F.col("total_amount"), 4).alias("total_amount")
    )


FLAG_COLS = ", ".join(T.RULES)
FLAG_INTS = ", ".join(f"CAST({r} AS INTEGER) AS {r}" for r in T.RULES)


def flags_as_int():
    return [F.col(r).cast("int").alias(r) for r in T.RULES]



@query("trip_anomaly_flags", f"WITH {STAGED} SELECT order_id, line_id, {FLAG_INTS} FROM flagged")
def trip_anomaly_flags(spark, sf):
    return T.flagged(staging(spark, sf)).select("order_id", "line_id", *flags_as_int())


@query(
    "trip_anomaly_samples",
    f"""WITH {STAGED} SELECT order_id, line_id, trip_distance, {rnd('speed_mph')} AS speed_mph, {FLAG_INTS} FROM flagged
        WHERE {' OR '.join(T.RULES)}
        ORDER BY flagged.speed_mph DESC NULLS LAST, trip_distance DESC NULLS LAST, abs(total_amount) DESC NULLS LAST, order_id, line_id LIMIT 500""",
)
def trip_anomaly_samples(spark, sf):
    out = T.anomaly_samples(staging(spark, sf), 500, ["order_id", "line_id"])
    return out.select("order_id", "line_id", "trip_distance", T.half_up(F.col("speed_mph"), 4).alias("speed_mph"), *flags_as_int())


@query(
    "trip_month_summary",
    f"""WITH {STAGED} SELECT {P}, count(*) AS clean_trip_count, min(pickup_datetime) AS min_pickup_datetime,
        max(pickup_datetime) AS max_pickup_datetime, {pick(SUMS, 'total', 'fare', 'tip', 'tolls')}, {pick(AVGS, *ALL6)}, {pick(MEDS, *ALL6)},
        {rnd('max(trip_distance)')} AS max_trip_distance_miles, {rnd('max(duration_min)')} AS max_duration_min,
        {rnd('max(speed_mph)')} AS max_speed_mph FROM clean GROUP BY {P}""",
)
def trip_month_summary(spark, sf):
    return T.month_summary(clean(spark, sf))


@query(
    "trip_raw_vs_clean",
    f"""WITH {STAGED}, r AS (SELECT {P}, count(*) AS raw_count FROM staged GROUP BY {P}),
        c AS (SELECT {P}, count(*) AS clean_count FROM clean GROUP BY {P})
        SELECT {P}, raw_count, coalesce(clean_count, 0) AS clean_count, raw_count - coalesce(clean_count, 0) AS rejected_count,
        {rnd('((raw_count - coalesce(clean_count, 0)) / raw_count)', 6)} AS rejected_fraction FROM r LEFT JOIN c USING ({P})""",
)
def trip_raw_vs_clean(spark, sf):
    return T.raw_vs_clean(staging(spark, sf))


@query(
    "trip_ingest_audit",
    f"""WITH {STAGED}, r AS (SELECT {P}, count(*) AS raw_count, {', '.join(f'count(*) FILTER (WHERE {r}) AS {r}' for r in T.RULES)} FROM flagged GROUP BY {P}),
        c AS (SELECT {P}, count(*) AS n FROM clean GROUP BY {P})
        SELECT {P}, raw_count, coalesce(n, 0) AS clean_count, {FLAG_COLS}, raw_count - coalesce(n, 0) AS rejected_count,
        (SELECT count(*) FROM clean) AS clean_total_count_all_loaded_partitions,
        {rnd('((raw_count - coalesce(n, 0)) / raw_count)', 6)} AS rejected_fraction FROM r LEFT JOIN c USING ({P})""",
)
def trip_ingest_audit(spark, sf):
    return T.ingest_audit(T.staged(stored_trips(spark, sf)))


@query("trip_partition_inventory", f"WITH {STAGED} SELECT {P}, count(*) AS clean_count FROM clean GROUP BY {P}")
def trip_partition_inventory(spark, sf):
    return T.partition_inventory(clean(spark, sf))


@query(
    "trip_daily_revenue",
    f"""WITH {STAGED} SELECT {P}, CAST(pickup_date AS VARCHAR) AS pickup_date, count(*) AS trip_count, {pick(SUMS, 'total', 'fare', 'tip')},
        {pick(AVGS, 'total', 'distance', 'duration', 'speed')} FROM clean GROUP BY {P}, pickup_date""",
)
def trip_daily_revenue(spark, sf):
    return T.daily_revenue(clean(spark, sf)).withColumn("pickup_date", F.col("pickup_date").cast("string"))


@query(
    "trip_hourly_demand",
    f"""WITH {STAGED} SELECT {P}, pickup_hour, count(*) AS trip_count, {pick(SUMS, 'total')},
        {pick(AVGS, 'total', 'distance', 'duration', 'speed')} FROM clean GROUP BY {P}, pickup_hour""",
)
def trip_hourly_demand(spark, sf):
    return T.hourly_demand(clean(spark, sf))


@query(
    "trip_weekday_hour_demand",
    f"""WITH {STAGED} SELECT {P}, CAST(strftime(pickup_datetime, '%w') AS INTEGER) AS day_of_week, pickup_hour, count(*) AS trip_count,
        {pick(SUMS, 'total')}, {pick(AVGS, 'total', 'distance', 'duration')} FROM clean GROUP BY {P}, day_of_week, pickup_hour""",
)
def trip_weekday_hour_demand(spark, sf):
    return T.weekday_hour_demand(clean(spark, sf))


COUNTED = f"count(*) AS trip_count, {pick(SUMS, 'total')}, {pick(AVGS, 'total', 'distance', 'duration')}"


@query(
    "trip_top_pickup_locations",
    f"WITH {STAGED} SELECT pickup_location_id, {COUNTED} FROM clean GROUP BY pickup_location_id ORDER BY trip_count DESC, pickup_location_id LIMIT 25",
)
def trip_top_pickup_locations(spark, sf):
    return T.busiest(clean(spark, sf), ["pickup_location_id"], 25)


@query(
    "trip_top_routes",
    f"""WITH {STAGED} SELECT pickup_location_id, dropoff_location_id, {COUNTED} FROM clean GROUP BY ALL
        ORDER BY trip_count DESC, pickup_location_id, dropoff_location_id LIMIT 50""",
)
def trip_top_routes(spark, sf):
    return T.busiest(clean(spark, sf), ["pickup_location_id", "dropoff_location_id"], 50)


@query(
    "trip_top_routes_per_month",
    f"""WITH {STAGED}, c AS (SELECT {P}, pickup_location_id, dropoff_location_id, {COUNTED} FROM clean GROUP BY ALL)
        SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY {P} ORDER BY trip_count DESC, pickup_location_id, dropoff_location_id) <= 50""",
)
def trip_top_routes_per_month(spark, sf):
    return T.busiest(clean(spark, sf), ["pickup_location_id", "dropoff_location_id"], 50, T.PARTITION)


@query("trip_period_coverage", f"WITH {STAGED} SELECT data_year, data_month, count(*) AS clean_trip_count, count(DISTINCT pickup_date) AS active_pickup_days FROM clean GROUP BY ALL")
def trip_period_coverage(spark, sf):
    return T.period_coverage(clean(spark, sf))


FOUR = ("total", "distance", "duration", "speed")


@query(
    "trip_period_summary",
    f"""WITH {STAGED} SELECT count(*) AS clean_trip_count, count(DISTINCT pickup_date) AS active_pickup_days,
        min(pickup_datetime) AS min_pickup_datetime, max(pickup_datetime) AS max_pickup_datetime,
        {pick(SUMS, 'total', 'fare', 'tip')}, {pick(AVGS, *FOUR)}, {pick(MEDS, *FOUR)} FROM clean""",
)
def trip_period_summary(spark, sf):
    return T.period_summary(clean(spark, sf))


@query(
    "trip_monthly_trend",
    f"""WITH {STAGED} SELECT data_year, data_month, count(*) AS clean_trip_count, count(DISTINCT pickup_date) AS active_pickup_days,
        {pick(SUMS, 'total')}, {rnd('(' + rnd('sum(total_amount)') + ' / count(DISTINCT pickup_date))')} AS avg_gross_total_per_day,
        {rnd('(count(*) / count(DISTINCT pickup_date))')} AS avg_trips_per_day, {pick(AVGS, 'total', 'distance', 'duration')}
        FROM clean GROUP BY ALL""",
)
def trip_monthly_trend(spark, sf):
    return T.monthly_trend(clean(spark, sf))


DAYS = "days AS (SELECT count(DISTINCT pickup_date) AS d FROM clean)"
PER_DAY = f"""count(*) AS total_trip_count, {rnd('(count(*) / max(d))')} AS avg_pickups_per_day{{0}},
  {rnd('(' + rnd('sum(total_amount)') + ' / max(d))')} AS avg_gross_total_per_day{{0}}"""


@query(
    "trip_hour_profile_average_day",
    f"""WITH {STAGED}, {DAYS} SELECT pickup_hour, {PER_DAY.format('')}, {pick(SUMS, 'total')},
        {pick(AVGS, 'total', 'distance', 'duration')} FROM clean CROSS JOIN days GROUP BY pickup_hour""",
)
def trip_hour_profile_average_day(spark, sf):
    return T.hour_profile_average_day(stored_clean(spark, sf))


NAMED = "coalesce(z.borough, 'Unknown') AS pickup_borough, coalesce(z.zone, 'Unknown') AS pickup_zone"


@query(
    "trip_top_zones_average_day",
    f"""WITH {STAGED}, {DAYS}, {ZONES} SELECT pickup_location_id, {NAMED}, {PER_DAY.format('')}, {pick(SUMS, 'total')}
        FROM clean CROSS JOIN days LEFT JOIN zones z ON pickup_location_id = location_id GROUP BY ALL
        ORDER BY total_trip_count DESC, pickup_location_id LIMIT 100""",
)
def trip_top_zones_average_day(spark, sf):
    return T.top_zones_average_day(stored_clean(spark, sf), zones(spark, sf))


@query(
    "trip_zone_hour_average_day",
    f"""WITH {STAGED}, {DAYS}, {ZONES} SELECT pickup_location_id, pickup_hour, {NAMED}, {PER_DAY.format('_at_hour')}
        FROM clean CROSS JOIN days LEFT JOIN zones z ON pickup_location_id = location_id GROUP BY ALL""",
)
def trip_zone_hour_average_day(spark, sf):
    return T.zone_hour_average_day(stored_clean(spark, sf), zones(spark, sf))


def _named_zone_sql(role, names):
    return f"""WITH {STAGED}, {ZONES} SELECT {role}_location_id,
        {', '.join(f"coalesce(z.{a}, 'Unknown') AS {role}_{a}" for a in T.ZONE_NAMES)},
        count(*) AS trip_count, {pick(SUMS, 'total')}, {pick(AVGS, *names)}
        FROM clean LEFT JOIN zones z ON {role}_location_id = location_id GROUP BY ALL
        ORDER BY trip_count DESC, {role}_location_id LIMIT 50"""


@query("trip_top_pickup_zones_named", _named_zone_sql("pickup", ALL6))
def trip_top_pickup_zones_named(spark, sf):
    return T.zones_named(clean(spark, sf), zones(spark, sf), "pickup")


@query("trip_top_dropoff_zones_named", _named_zone_sql("dropoff", ("total", "distance", "duration")))
def trip_top_dropoff_zones_named(spark, sf):
    return T.zones_named(clean(spark, sf), zones(spark, sf), "dropoff")


@query(
    "trip_top_routes_named",
    f"""WITH {STAGED}, {ZONES} SELECT pickup_location_id, dropoff_location_id, coalesce(a.borough, 'Unknown') AS pickup_borough,
        coalesce(a.zone, 'Unknown') AS pickup_zone, coalesce(b.borough, 'Unknown') AS dropoff_borough,
        coalesce(b.zone, 'Unknown') AS dropoff_zone, {COUNTED} FROM clean LEFT JOIN zones a ON pickup_location_id = a.location_id
        LEFT JOIN zones b ON dropoff_location_id = b.location_id GROUP BY ALL
        ORDER BY trip_count DESC, pickup_location_id, dropoff_location_id LIMIT 100""",
)
def trip_top_routes_named(spark, sf):
    return T.routes_named(clean(spark, sf), zones(spark, sf))


@query(
    "trip_borough_hour_demand",
    f"""WITH {STAGED}, {ZONES} SELECT coalesce(z.borough, 'Unknown') AS pickup_borough, pickup_hour, {COUNTED}
        FROM clean LEFT JOIN zones z ON pickup_location_id = location_id GROUP BY ALL""",
)
def trip_borough_hour_demand(spark, sf):
    return T.borough_hour_demand(clean(spark, sf), zones(spark, sf))


@query("trip_zone_hour_counts", f"WITH {STAGED} SELECT {P}, pickup_location_id AS location_id, pickup_hour, count(*) AS trip_count, {pick(SUMS, 'total')}, {pick(AVGS, 'total')} FROM clean GROUP BY ALL")
def trip_zone_hour_counts(spark, sf):
    return T.zone_hour_counts(clean(spark, sf))


@query(
    "trip_zone_density",
    f"""WITH {STAGED}, {DAYS}, {ZONES}, counts AS (
          SELECT pickup_location_id AS location_id, pickup_hour, {rnd('(count(*) / max(d))')} AS trip_count,
                 {rnd('(' + rnd('sum(total_amount)') + ' / max(d))')} AS gross FROM clean CROSS JOIN days GROUP BY ALL),
        hours AS (SELECT unnest(range(24)) AS h)
        SELECT z.location_id, borough, zone, service_zone, (SELECT max(trip_count) FROM counts) AS max_trip_count,
          array_to_string(list(CAST(coalesce(trip_count, 0) AS DECIMAL(18, 4)) ORDER BY h), ' ') AS series,
          array_to_string(list(CAST(coalesce(gross, 0) AS DECIMAL(18, 4)) ORDER BY h), ' ') AS gross_series
        FROM zones z CROSS JOIN hours LEFT JOIN counts c ON c.location_id = z.location_id AND pickup_hour = h
        GROUP BY ALL""",
)
def trip_zone_density(spark, sf):
    doc = T.density_document(zones(spark, sf), T.zone_hour_counts_per_day(stored_clean(spark, sf)))
    text = lambda c: F.array_join(F.transform(F.col(c), lambda x: x.cast("decimal(18,4)").cast("string")), " ")
    return doc.withColumns({"series": text("series"), "gross_series": text("gross_series")})


PROFILE_RULES = {
    "pickup_after_dropoff": "dropoff_datetime < pickup_datetime",
    "non_positive_trip_distance": "trip_distance <= 0",
    "negative_fare_amount": "fare_amount < 0",
    "negative_total_amount": "total_amount < 0",
    "non_positive_duration": "duration_min <= 0",
    "duration_over_24h": "duration_min > 1440",
    "speed_over_100_mph": "speed_mph > 100",
    "negative_passenger_count": "passenger_count < 0",
}
PROFILE_NULLS = {
    "null_pickup_datetime": "pickup_datetime", "null_dropoff_datetime": "dropoff_datetime", "null_pu_location": "pickup_location_id",
    "null_do_location": "dropoff_location_id", "null_trip_distance": "trip_distance", "null_fare_amount": "fare_amount",
    "null_total_amount": "total_amount",
}
# Columns of a trip file and their types.
FILE_TYPES = {
    "order_id": "bigint", "line_id": "int", "tpep_pickup_datetime": "timestamp_ntz", "tpep_dropoff_datetime": "timestamp_ntz",
    "passenger_count": "int", "trip_distance": "double", "RatecodeID": "int", "PULocationID": "int", "DOLocationID": "int",
    "payment_type": "string", "fare_amount": "double", "tip_amount": "double", "tolls_amount": "double", "total_amount": "double",
}
VALID = "FILTER (WHERE dropoff_datetime > pickup_datetime AND trip_distance > 0)"
FIVE = ("distance", "duration", "speed", "fare", "total")


@query(
    "trip_file_profile",
    f"""WITH {STAGED} SELECT source_file, count(*) AS row_count, min(pickup_datetime) AS min_pickup_datetime, max(pickup_datetime) AS max_pickup_datetime,
        min(dropoff_datetime) AS min_dropoff_datetime, max(dropoff_datetime) AS max_dropoff_datetime,
        {', '.join(f'count(*) FILTER (WHERE {c} IS NULL) AS {n}' for n, c in PROFILE_NULLS.items())},
        {', '.join(f'count(*) FILTER (WHERE {c}) AS {n}' for n, c in PROFILE_RULES.items())},
        {', '.join(f"{rnd('(' + rnd(f'(sum({T.MEANS[w][0]}) {VALID})') + f' / (count({T.MEANS[w][0]}) {VALID}))')} AS {T.MEANS[w][1]}" for w in FIVE)},
        {', '.join(f"{rnd(f'(median({T.MEANS[w][0]}) {VALID})')} AS {T.MEANS[w][1].replace('avg_', 'median_')}" for w in FIVE)},
        {rnd(f'(max(trip_distance) {VALID})')} AS max_trip_distance_miles, {rnd(f'(max(speed_mph) {VALID})')} AS max_speed_mph
        FROM staged GROUP BY source_file""",
)
def trip_file_profile(spark, sf):
    return T.file_profile(raw_trips(spark, sf))


@query(
    "trip_file_columns",
    f"""WITH {RAW_TRIPS}, f AS (SELECT taxi_type, data_year, data_month, count(*) AS row_count, {', '.join(f'count({c}) AS {c}' for c in FILE_TYPES)} FROM raw_trips GROUP BY ALL)
        SELECT taxi_type, data_year, data_month, row_count, column_name, data_type, not_null_count, TRUE AS has_size FROM (
        {' UNION ALL '.join(f"SELECT taxi_type, data_year, data_month, row_count, '{c}' AS column_name, '{t}' AS data_type, {c} AS not_null_count FROM f" for c, t in FILE_TYPES.items())})""",
)
def trip_file_columns(spark, sf):
    """Trips written to the landing layout, one folder a file, and read back by the pattern of their names."""
    root = work_path(spark, "landing")
    rows = raw_trips(spark, sf)
    at = F.format_string("%s_tripdata_%d-%02d.parquet", "taxi_type", "data_year", "data_month")
    files = ["type", "year", "month", "file"]
    named = rows.select(*FILE_TYPES, F.col("taxi_type").alias("type"), F.col("data_year").alias("year"), F.col("data_month").alias("month"), at.alias("file"))
    named.hint("rebalance", *files).write.partitionBy(*files).parquet(root)  # else every task has a part of every file
    found = T.file_columns(read_trips(spark, root).drop("type", "year", "month", "file"))
    return found.withColumn("has_size", F.col("file_size_mb") > 0).drop("file_size_mb")


@query(
    "source_landing_months",
    f"""WITH {RAW_TRIPS} SELECT taxi_type, data_year, data_month, count(*) AS trip_count, {rnd('sum(total_amount)')} AS gross
        FROM raw_trips WHERE data_year = 1996 AND data_month <= 2 GROUP BY ALL""",
)
def source_landing_months(spark, sf):
    """Months under their landing paths, type / year / month / file, read back with what the names say."""
    root = work_path(spark, "landing")
    rows = written(raw_trips(spark, sf).where("data_year = 1996 AND data_month <= 2"), "landing-months")
    for taxi_type in ("green", "yellow"):
        for month in (1, 2):
            part = rows.where((F.col("taxi_type") == taxi_type) & (F.col("data_month") == month)).select(*FILE_TYPES)
            part.write.parquet(landing_path(root, taxi_type, 1996, month))
    found = read_trips(spark, root)
    return found.groupBy("taxi_type", "data_year", "data_month").agg(F.count(F.lit(1)).alias("trip_count"), T.half_up(F.sum("total_amount"), 4).alias("gross"))


@query("trip_payment_histogram", f"WITH {RAW_TRIPS} SELECT payment_type, count(*) AS trip_count FROM raw_trips GROUP BY payment_type")
def trip_payment_histogram(spark, sf):
    return T.value_histogram(raw_trips(spark, sf), "payment_type")


@query("trip_rate_code_histogram", f"WITH {RAW_TRIPS} SELECT RatecodeID, count(*) AS trip_count FROM raw_trips GROUP BY RatecodeID")
def trip_rate_code_histogram(spark, sf):
    return T.value_histogram(raw_trips(spark, sf), "RatecodeID")


@query("trip_month_selection", f"WITH {STAGED} SELECT data_year, data_month, count(*) AS clean_trip_count FROM clean WHERE data_month IN (11, 12, 1) GROUP BY ALL")
def trip_month_selection(spark, sf):
    """Parameters bound by name in SQL text, months from a list."""
    clean(spark, sf).createOrReplaceTempView("clean_trips")
    return spark.sql(
        "SELECT data_year, data_month, count(*) AS clean_trip_count FROM clean_trips "
        "WHERE array_contains(:months, data_month) GROUP BY data_year, data_month",
        args={"months": F.array(*[F.lit(m) for m in T.month_list(months="11,12,1,12")])},
    )
