"""Trip warehouse: staging, rules, clean rows and the month, period and zone reports.

Every report takes the clean trips of all partitions. ``by`` names the partition columns
to report on; filter the trips first to get a single month.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorlith.functions.numbers import half_up, stable_mean
from sensorlith.functions.times import month_start, next_month_start, seconds_between, sunday_zero_weekday
from sensorlith.operators.quantiles import join_on_keys, percentiles
from sensorlith.session import written
from sensorlith.sources.landing import FILE_PATTERN, lineage

PARTITION = ("taxi_type", "data_year", "data_month")

# What reading adds to the columns of a trip file.
LINEAGE = ("taxi_type", "data_year", "data_month", "source_file", "ingested_at_utc")

# Limits of the clean rules.
MAX_MINUTES = 24 * 60
MAX_MILES = 100
MAX_MPH = 100

# Names of the rules, in report order.
RULES = (
    "outside_target_month",
    "invalid_duration_order",
    "non_positive_duration",
    "duration_over_24h",
    "non_positive_trip_distance",
    "distance_over_100_miles",
    "speed_over_100_mph",
    "negative_fare_amount",
    "negative_total_amount",
)

# Source column names and what they are called from staging on.
RENAMES = {
    "tpep_pickup_datetime": "pickup_datetime",
    "tpep_dropoff_datetime": "dropoff_datetime",
    "PULocationID": "pickup_location_id",
    "DOLocationID": "dropoff_location_id",
}

DIGITS = 4


def staged(raw: DataFrame) -> DataFrame:
    """Renamed columns plus date, hour, minutes and miles per hour.

    The trip's seconds come out of a generator: filters on them stay above it and read the value, where a plain
    column would be written out again in every test, down to the scans or joins below.
    """
    df = raw.withColumnsRenamed(RENAMES)
    seconds = seconds_between(F.col("pickup_datetime"), F.col("dropoff_datetime"))
    df = df.select("*", F.explode(F.array(seconds)).alias("_seconds"))
    seconds = F.col("_seconds")
    return df.withColumns(
        {
            "pickup_date": F.to_date("pickup_datetime"),
            "pickup_hour": F.hour("pickup_datetime"),
            "duration_min": seconds / 60.0,
            "speed_mph": F.when(seconds > 0, F.col("trip_distance") / (seconds / 3600.0)),
        }
    ).drop("_seconds")


def outside_month() -> Column:
    start = month_start(F.col("data_year"), F.col("data_month"))
    end = next_month_start(F.col("data_year"), F.col("data_month"))
    return (F.col("pickup_datetime") < start) | (F.col("pickup_datetime") >= end)


def rule_columns() -> dict[str, Column]:
    """The nine rules as three-valued flags."""
    c = F.col
    conditions = (
        outside_month(),
        c("dropoff_datetime") <= c("pickup_datetime"),
        c("duration_min") <= 0,
        c("duration_min") > MAX_MINUTES,
        c("trip_distance") <= 0,
        c("trip_distance") > MAX_MILES,
        c("speed_mph") > MAX_MPH,
        c("fare_amount") < 0,
        c("total_amount") < 0,
    )
    return dict(zip(RULES, conditions))


def clean_condition() -> Column:
    """A trip is clean when every rule is known to hold; tests on stored columns come first, for the scan."""
    c = F.col
    stored = (
        c("trip_distance").isNotNull()
        & (c("trip_distance") > 0)
        & (c("trip_distance") <= MAX_MILES)
        & (c("fare_amount") >= 0)
        & (c("total_amount") >= 0)
        & (c("dropoff_datetime") > c("pickup_datetime"))
    )
    derived = (
        ~outside_month()
        & (c("duration_min") > 0)
        & (c("duration_min") <= MAX_MINUTES)
        & (c("speed_mph") > 0)
        & (c("speed_mph") <= MAX_MPH)
    )
    return stored & derived


def clean(staging: DataFrame) -> DataFrame:
    return staging.filter(clean_condition())


def flagged(staging: DataFrame) -> DataFrame:
    return staging.withColumns(rule_columns())


def anomaly_samples(staging: DataFrame, limit: int = 500, tie_break: Sequence[str] = ()) -> DataFrame:
    """Rows that break any rule, the fastest, longest and dearest first."""
    any_rule = F.lit(False)
    for r in RULES:
        any_rule = any_rule | F.col(r)
    order = [F.desc_nulls_last("speed_mph"), F.desc_nulls_last("trip_distance"), F.abs("total_amount").desc_nulls_last()]
    return flagged(staging).filter(any_rule).orderBy(*order, *[F.asc(c) for c in tie_break]).limit(limit)


def rule_counts(staging: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One column per rule, in one pass."""
    return staging.groupBy(*by).agg(*[F.count_if(c).alias(r) for r, c in rule_columns().items()])


def anomaly_counts(staging: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per rule: nine sums in one pass, then turned to rows."""
    return (
        rule_counts(staging, by)
        .unpivot(list(by), list(RULES), "anomaly_type", "row_count")
        .orderBy(*by, F.desc("row_count"), "anomaly_type")
    )


def money_sums() -> list[Column]:
    return [half_up(F.sum(f"{k}_amount"), DIGITS).alias(f"gross_{k}_amount") for k in ("total", "fare", "tip", "tolls")]


def mean(column: str, name: str | None = None) -> Column:
    return stable_mean(F.sum(column), F.count(column)).alias(name or f"avg_{column}")


MEANS = {
    "total": ("total_amount", "avg_total_amount"),
    "fare": ("fare_amount", "avg_fare_amount"),
    "tip": ("tip_amount", "avg_tip_amount"),
    "distance": ("trip_distance", "avg_trip_distance_miles"),
    "duration": ("duration_min", "avg_duration_min"),
    "speed": ("speed_mph", "avg_speed_mph"),
}


def means(*which: str) -> list[Column]:
    return [mean(*MEANS[w]) for w in which]


def medians(trips: DataFrame, by: Sequence[str], which: Sequence[str]) -> DataFrame:
    wanted = {MEANS[w][1].replace("avg_", "median_"): (MEANS[w][0], 0.5) for w in which}
    out = percentiles(trips, by, wanted)
    return out.withColumns({n: half_up(F.col(n), DIGITS) for n in wanted})


def narrow(trips: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Only these columns, written once: percentiles go over their values in rounds."""
    return written(trips.select(*dict.fromkeys(columns)), name)


def month_summary(trips: DataFrame, by: Sequence[str] = PARTITION) -> DataFrame:
    which = ("total", "fare", "tip", "distance", "duration", "speed")
    trips = narrow(trips, [*by, "pickup_datetime", "tolls_amount", *[MEANS[w][0] for w in which]], "month-trips")
    base = trips.groupBy(*by).agg(
        F.count(F.lit(1)).alias("clean_trip_count"),
        F.min("pickup_datetime").alias("min_pickup_datetime"),
        F.max("pickup_datetime").alias("max_pickup_datetime"),
        *money_sums(),
        *means(*which),
        half_up(F.max("trip_distance"), DIGITS).alias("max_trip_distance_miles"),
        half_up(F.max("duration_min"), DIGITS).alias("max_duration_min"),
        half_up(F.max("speed_mph"), DIGITS).alias("max_speed_mph"),
    )
    return join_on_keys(base, medians(trips, by, which), by)


def raw_vs_clean(staging: DataFrame, by: Sequence[str] = PARTITION) -> DataFrame:
    """Loaded, clean and rejected rows in one pass; no rows, no fraction."""
    counts = staging.groupBy(*by).agg(
        F.count(F.lit(1)).alias("raw_count"), F.count_if(clean_condition()).alias("clean_count")
    )
    rejected = F.col("raw_count") - F.col("clean_count")
    return counts.withColumn("rejected_count", rejected).withColumn(
        "rejected_fraction", half_up(F.try_divide(rejected.cast("double"), F.col("raw_count").cast("double")), 6)
    )


def ingest_audit(staging: DataFrame, by: Sequence[str] = PARTITION) -> DataFrame:
    """Rule counts and loaded, clean, rejected counts of each partition, with the clean total of all."""
    audit = staging.groupBy(*by).agg(
        F.count(F.lit(1)).alias("raw_count"),
        F.count_if(clean_condition()).alias("clean_count"),
        *[F.count_if(c).alias(r) for r, c in rule_columns().items()],
    )
    total = audit.select(F.sum("clean_count")).scalar()
    rejected = F.col("raw_count") - F.col("clean_count")
    return audit.withColumns(
        {
            "clean_total_count_all_loaded_partitions": total,
            "rejected_count": rejected,
            "rejected_fraction": half_up(F.try_divide(rejected.cast("double"), F.col("raw_count").cast("double")), 6),
        }
    )


def partition_inventory(trips: DataFrame) -> DataFrame:
    return trips.groupBy(*PARTITION).agg(F.count(F.lit(1)).alias("clean_count")).orderBy(*PARTITION)


def daily_revenue(trips: DataFrame, by: Sequence[str] = PARTITION) -> DataFrame:
    return (
        trips.groupBy(*by, "pickup_date")
        .agg(F.count(F.lit(1)).alias("trip_count"), *money_sums()[:3], *means("total", "distance", "duration", "speed"))
        .orderBy(*by, "pickup_date")
    )


def hourly_demand(trips: DataFrame, by: Sequence[str] = PARTITION) -> DataFrame:
    return (
        trips.groupBy(*by, "pickup_hour")
        .agg(F.count(F.lit(1)).alias("trip_count"), *money_sums()[:1], *means("total", "distance", "duration", "speed"))
        .orderBy(*by, "pickup_hour")
    )


def weekday_hour_demand(trips: DataFrame, by: Sequence[str] = PARTITION) -> DataFrame:
    return (
        trips.groupBy(*by, sunday_zero_weekday(F.col("pickup_datetime")).alias("day_of_week"), "pickup_hour")
        .agg(F.count(F.lit(1)).alias("trip_count"), *money_sums()[:1], *means("total", "distance", "duration"))
        .orderBy(*by, "day_of_week", "pickup_hour")
    )


def top_per(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k of each partition of an already aggregated table; without ``by`` a plain top-k."""
    if not by:
        return df.orderBy(*order).limit(k)
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= k).drop("_rank")


def busiest(trips: DataFrame, keys: Sequence[str], k: int, by: Sequence[str] = ()) -> DataFrame:
    """Top pickup places or routes by number of trips, ties by key."""
    counted = trips.groupBy(*by, *keys).agg(
        F.count(F.lit(1)).alias("trip_count"), *money_sums()[:1], *means("total", "distance", "duration")
    )
    return top_per(counted, by, [F.desc("trip_count"), *[F.asc_nulls_last(c) for c in keys]], k)


def with_zone(df: DataFrame, zones: DataFrame, role: str, attributes: Sequence[str]) -> DataFrame:
    """Zone attributes under a role name, 'Unknown' where the id has no zone.

    Applied to aggregates, so that at most one row per zone pair is joined; the planner
    broadcasts the zones when their measured size allows.
    """
    picked = zones.select(
        F.col("location_id").alias(f"_{role}_id"), *[F.col(a).alias(f"_{role}_{a}") for a in attributes]
    )
    joined = df.join(picked, F.col(f"{role}_location_id") == F.col(f"_{role}_id"), "left")
    named = {f"{role}_{a}": F.coalesce(F.col(f"_{role}_{a}"), F.lit("Unknown")) for a in attributes}
    return joined.withColumns(named).drop(*picked.columns)


ZONE_NAMES = ("borough", "zone", "service_zone")


def zones_named(trips: DataFrame, zones: DataFrame, role: str, k: int = 50, by: Sequence[str] = ()) -> DataFrame:
    key = f"{role}_location_id"
    which = ("total", "fare", "tip", "distance", "duration", "speed") if role == "pickup" else ("total", "distance", "duration")
    counted = trips.groupBy(*by, key).agg(F.count(F.lit(1)).alias("trip_count"), *money_sums()[:1], *means(*which))
    top = top_per(counted, by, [F.desc("trip_count"), F.asc_nulls_last(key)], k)
    return with_zone(top, zones, role, ZONE_NAMES)


def routes_named(trips: DataFrame, zones: DataFrame, k: int = 100, by: Sequence[str] = ()) -> DataFrame:
    top = busiest(trips, ["pickup_location_id", "dropoff_location_id"], k, by)
    return with_zone(with_zone(top, zones, "pickup", ZONE_NAMES[:2]), zones, "dropoff", ZONE_NAMES[:2])


def borough_hour_demand(trips: DataFrame, zones: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sums per place and hour first, then the zone join, then boroughs: the join never sees single trips."""
    parts = trips.groupBy(*by, "pickup_location_id", "pickup_hour").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("total_amount").alias("total"),
        F.count("total_amount").alias("n_total"),
        F.sum("trip_distance").alias("distance"),
        F.count("trip_distance").alias("n_distance"),
        F.sum("duration_min").alias("duration"),
        F.count("duration_min").alias("n_duration"),
    )
    named = with_zone(parts, zones, "pickup", ("borough",))
    avg = lambda c: stable_mean(F.sum(c), F.sum(f"n_{c}"))
    return (
        named.groupBy(*by, "pickup_borough", "pickup_hour")
        .agg(
            F.sum("n").alias("trip_count"),
            half_up(F.sum("total"), DIGITS).alias("gross_total_amount"),
            avg("total").alias("avg_total_amount"),
            avg("distance").alias("avg_trip_distance_miles"),
            avg("duration").alias("avg_duration_min"),
        )
        .orderBy(*by, "pickup_borough", "pickup_hour")
    )


def period_coverage(trips: DataFrame) -> DataFrame:
    return (
        trips.groupBy("data_year", "data_month")
        .agg(F.count(F.lit(1)).alias("clean_trip_count"), F.count_distinct("pickup_date").alias("active_pickup_days"))
        .orderBy("data_year", "data_month")
    )


def period_summary(trips: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    which = ("total", "distance", "duration", "speed")
    trips = narrow(trips, [*by, "pickup_date", "pickup_datetime", "fare_amount", "tip_amount", *[MEANS[w][0] for w in which]], "period-trips")
    base = trips.groupBy(*by).agg(
        F.count(F.lit(1)).alias("clean_trip_count"),
        F.count_distinct("pickup_date").alias("active_pickup_days"),
        F.min("pickup_datetime").alias("min_pickup_datetime"),
        F.max("pickup_datetime").alias("max_pickup_datetime"),
        *money_sums()[:3],
        *means(*which),
    )
    return join_on_keys(base, medians(trips, by, which), by)


def monthly_trend(trips: DataFrame) -> DataFrame:
    days = F.count_distinct("pickup_date")
    return (
        trips.groupBy("data_year", "data_month")
        .agg(
            F.count(F.lit(1)).alias("clean_trip_count"),
            days.alias("active_pickup_days"),
            *money_sums()[:1],
            stable_mean(F.sum("total_amount"), days).alias("avg_gross_total_per_day"),
            half_up(F.count(F.lit(1)) / days, DIGITS).alias("avg_trips_per_day"),
            *means("total", "distance", "duration"),
        )
        .orderBy("data_year", "data_month")
    )


def active_days(trips: DataFrame) -> Column:
    """Number of different pickup dates, as a scalar subquery."""
    return trips.select(F.count_distinct("pickup_date").cast("double")).scalar()


def per_day(trips: DataFrame, keys: Sequence[str], extra: Sequence[Column] = ()) -> DataFrame:
    counted = trips.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trip_count"),
        F.sum("total_amount").alias("_gross"),
        *extra,
    )
    days = active_days(trips)
    return counted.withColumns(
        {
            "avg_pickups_per_day": half_up(F.col("total_trip_count") / days, DIGITS),
            "avg_gross_total_per_day": stable_mean(F.col("_gross"), days),
            "gross_total_amount": half_up(F.col("_gross"), DIGITS),
        }
    ).drop("_gross")


def hour_profile_average_day(trips: DataFrame) -> DataFrame:
    return per_day(trips, ["pickup_hour"], means("total", "distance", "duration")).orderBy("pickup_hour")


def top_zones_average_day(trips: DataFrame, zones: DataFrame, k: int = 100) -> DataFrame:
    top = per_day(trips, ["pickup_location_id"]).orderBy(
        F.desc("total_trip_count"), F.asc_nulls_last("pickup_location_id")
    ).limit(k)
    return with_zone(top, zones, "pickup", ZONE_NAMES[:2])


def zone_hour_average_day(trips: DataFrame, zones: DataFrame) -> DataFrame:
    out = per_day(trips, ["pickup_location_id", "pickup_hour"]).drop("gross_total_amount")
    out = out.withColumnsRenamed(
        {
            "avg_pickups_per_day": "avg_pickups_per_day_at_hour",
            "avg_gross_total_per_day": "avg_gross_total_per_day_at_hour",
        }
    )
    return with_zone(out, zones, "pickup", ZONE_NAMES[:2]).orderBy(
        "pickup_hour", F.desc("avg_pickups_per_day_at_hour"), "pickup_location_id"
    )


def zone_hour_counts(trips: DataFrame, by: Sequence[str] = PARTITION) -> DataFrame:
    """Input of the density document, one month at a time."""
    return trips.groupBy(*by, F.col("pickup_location_id").alias("location_id"), "pickup_hour").agg(
        F.count(F.lit(1)).alias("trip_count"), *money_sums()[:1], *means("total")
    )


def zone_hour_counts_per_day(trips: DataFrame) -> DataFrame:
    """Input of the density document for a period: counts per active day, kept as fractions."""
    days = active_days(trips)
    counted = trips.groupBy(F.col("pickup_location_id").alias("location_id"), "pickup_hour").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("total_amount").alias("_gross"), *means("total")
    )
    return counted.withColumns(
        {
            "trip_count": half_up(F.col("_n") / days, DIGITS),
            "gross_total_amount": stable_mean(F.col("_gross"), days),
        }
    ).drop("_n", "_gross")


def density_document(zones: DataFrame, counts: DataFrame) -> DataFrame:
    """Per zone the 24 counts and amounts of a day, zero where an hour has none, and the overall largest count."""
    per_zone = counts.groupBy("location_id").agg(
        F.map_from_entries(F.collect_list(F.struct("pickup_hour", "trip_count"))).alias("_n"),
        F.map_from_entries(F.collect_list(F.struct("pickup_hour", "gross_total_amount"))).alias("_gross"),
    )
    hours = F.sequence(F.lit(0), F.lit(23))
    series = lambda m: F.transform(
        hours, lambda h: F.coalesce(F.try_element_at(F.col(m), h).cast("double"), F.lit(0.0))
    )
    largest = counts.select(F.max("trip_count").cast("double")).scalar()
    return (
        zones.join(per_zone, "location_id", "left")
        .withColumns({"series": series("_n"), "gross_series": series("_gross"), "max_trip_count": largest})
        .drop("_n", "_gross")
    )


def file_profile(raw: DataFrame, by: Sequence[str] = ("source_file",)) -> DataFrame:
    """Rows, times, nulls and rule counts of each file, and statistics over its valid trips."""
    c = F.col
    valid = (c("dropoff_datetime") > c("pickup_datetime")) & (c("trip_distance") > 0)
    nulls = {
        "null_pickup_datetime": "pickup_datetime",
        "null_dropoff_datetime": "dropoff_datetime",
        "null_pu_location": "pickup_location_id",
        "null_do_location": "dropoff_location_id",
        "null_trip_distance": "trip_distance",
        "null_fare_amount": "fare_amount",
        "null_total_amount": "total_amount",
    }
    rules = {
        "pickup_after_dropoff": c("dropoff_datetime") < c("pickup_datetime"),
        "non_positive_trip_distance": c("trip_distance") <= 0,
        "negative_fare_amount": c("fare_amount") < 0,
        "negative_total_amount": c("total_amount") < 0,
        "non_positive_duration": c("duration_min") <= 0,
        "duration_over_24h": c("duration_min") > MAX_MINUTES,
        "speed_over_100_mph": c("speed_mph") > MAX_MPH,
        "negative_passenger_count": c("passenger_count") < 0,
    }
    which = ("distance", "duration", "speed", "fare", "total")
    df = narrow(staged(raw), [*by, *nulls.values(), "passenger_count", *[MEANS[w][0] for w in which]], "profile-trips")
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        *[f(n).alias(f"{f.__name__}_{n}") for n in ("pickup_datetime", "dropoff_datetime") for f in (F.min, F.max)],
        *[F.count_if(c(col).isNull()).alias(n) for n, col in nulls.items()],
        *[F.count_if(cond).alias(n) for n, cond in rules.items()],
        *[
            stable_mean(F.sum(F.when(valid, c(MEANS[w][0]))), F.count(F.when(valid, c(MEANS[w][0])))).alias(MEANS[w][1])
            for w in which
        ],
        *[
            half_up(F.max(F.when(valid, c(MEANS[w][0]))), DIGITS).alias(MEANS[w][1].replace("avg_", "max_"))
            for w in ("distance", "speed")
        ],
    )
    only_valid = df.withColumns({MEANS[w][0]: F.when(valid, c(MEANS[w][0])) for w in which})
    return join_on_keys(counted, medians(only_valid, by, which), by)


def file_columns(files: DataFrame, pattern: str = FILE_PATTERN) -> DataFrame:
    """For each file name and column of trip files: the type, the values that are not null, and the size of the file. Names are read once
    a file, not once a trip."""
    columns = [c for c in files.columns if c not in LINEAGE]
    sized = files.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_size").alias("_size"))
    parts = sized.groupBy("_path", "_size").agg(F.count(F.lit(1)).alias("row_count"), *[F.count(c).alias(c) for c in columns])
    named = parts.select("*", *lineage(F.col("_path"), pattern))
    whole = named.groupBy("taxi_type", "data_year", "data_month").agg(F.sum("row_count").alias("row_count"), (F.sum("_size") / 1_000_000).alias("file_size_mb"), *[F.sum(c).alias(c) for c in columns])
    types = dict(files.dtypes)
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("data_type"), F.col(c).alias("not_null_count")) for c in columns])
    return whole.select("taxi_type", "data_year", "data_month", "row_count", "file_size_mb", F.explode(each).alias("_c")).select("taxi_type", "data_year", "data_month", "row_count", "file_size_mb", "_c.*")


def value_histogram(raw: DataFrame, column: str) -> DataFrame:
    return raw.groupBy(column).agg(F.count(F.lit(1)).alias("trip_count")).orderBy(F.desc("trip_count"), F.asc_nulls_last(column))


def month_list(month: int | None = None, months: str | None = None, first: int | None = None, last: int | None = None) -> list[int]:
    """Months from a single number, a comma list or an inclusive range; each once, in order, within 1–12."""
    if months:
        asked = [int(m) for m in months.split(",") if m.strip()]
    elif first is not None and last is not None:
        if last < first:
            raise ValueError("the last month lies before the first")
        asked = list(range(first, last + 1))
    elif month is not None:
        asked = [month]
    else:
        raise ValueError("no month given")
    if any(not 1 <= m <= 12 for m in asked):
        raise ValueError("months run from 1 to 12")
    return list(dict.fromkeys(asked))
