"""Source and sink queries: tables go out as files in each layout and are read back."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from sensorlith.functions.numbers import settled
from sensorlith.operators import upserts as U
from sensorlith.plans import trips as T
from sensorlith.queries import missions as MI
from sensorlith.queries.city_tables import EVENTS, events, link_speeds
from sensorlith.queries.imu import samples, sensors
from sensorlith.queries.speeds import settle
from sensorlith.queries.trip_tables import RAW_TRIPS, STAGED, ZONES, raw_trips, table, zones
from sensorlith.queries.trips import staging
from sensorlith.registry import query
from sensorlith.schemas import BIKE_SNAPSHOT, RESULT_COLUMNS, ROAD_SNAPSHOT, WEATHER_SNAPSHOT
from sensorlith.session import cut, work_path
from sensorlith.sources import landing as L
from sensorlith.sources import reports as RP
from sensorlith.sources import runlogs as RL
from sensorlith.sources import sensors as SE
from sensorlith.sources import snapshots as SN
from sensorlith.sources import waveforms as WV
from sensorlith.streaming.tables import keep_tables

c = F.col
PARTITION_PATTERN = r"taxi_type=([a-z]+)/data_year=(\d+)/data_month=(\d+)/"


@query("source_trip_files", f"WITH {RAW_TRIPS} SELECT taxi_type, data_year, data_month, count(*) AS n FROM raw_trips GROUP BY ALL")
def source_trip_files(spark, sf):
    """Trips written as one folder per month and read back with lineage from their paths."""
    root = work_path(spark, "landing")
    raw_trips(spark, sf).drop("source_file").repartition("data_year", "data_month").write.partitionBy(*T.PARTITION).parquet(root)
    back = L.read_trips(spark, root, PARTITION_PATTERN)
    return back.groupBy(*T.PARTITION).agg(F.count(F.lit(1)).alias("n"))


@query("sink_trip_partitions", f"WITH {STAGED} SELECT taxi_type, data_year, data_month, count(*) AS clean_count FROM clean GROUP BY ALL")
def sink_trip_partitions(spark, sf):
    """Load, load again (nothing to do), force one year again, then list the partitions."""
    path = work_path(spark, "clean")
    rows = cut(T.clean(staging(spark, sf)).repartition("data_year", "data_month"))
    U.create_empty(rows, path, T.PARTITION)
    U.load_partitions(rows, path, T.PARTITION)
    U.load_partitions(rows, path, T.PARTITION)
    U.load_partitions(rows.filter(c("data_year") == 1997), path, T.PARTITION, force=True)
    return T.partition_inventory(spark.read.parquet(path))


@query("source_zone_csv", f"WITH {ZONES} SELECT * FROM zones")
def source_zone_csv(spark, sf):
    path = work_path(spark, "zones")
    z = zones(spark, sf).select(c("location_id").alias("LocationID"), c("borough").alias("Borough"), c("zone").alias("Zone"), "service_zone")
    RP.write_csv(z, path)
    return L.read_zones_csv(spark, path)


@query("source_zone_features", f"WITH {ZONES} SELECT location_id, zone, borough, '' AS service_zone FROM zones")
def source_zone_features(spark, sf):
    """Zones as features of a map file that lacks one attribute."""
    path = work_path(spark, "features")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(c("location_id").alias("LocationID"), c("zone").alias("Zone"), c("borough").alias("Borough")).alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array(F.lit(0.0), F.lit(0.0)).alias("coordinates")).alias("geometry"),
    )
    RP.write_json(zones(spark, sf).groupBy("borough").agg(F.collect_list(feature).alias("features")), path)
    return L.read_zones_geojson(spark, path, lines=True).drop("geometry")


# --- bike snapshots: 500 events are one document --------------------------------------------


def bike_documents(spark, sf):
    e = events(spark, sf)
    kind, k = c("event_type"), c("k")
    station = F.struct(
        c("user_id").cast("string").alias("station_id"),
        F.concat(F.lit("Station "), c("user_id").cast("string")).alias("name"),
        (k % 30).cast("long").alias("capacity"),
        F.when((kind == "view") & (k < 60), 0).otherwise(k % 20).cast("long").alias("num_bikes_available"),
        F.when((kind == "purchase") & (k < 60), 0).otherwise(20 - k % 20).cast("long").alias("num_docks_available"),
        F.when((kind == "signup") & (k % 10 == 9), 0).otherwise(1).cast("long").alias("is_installed"),
        F.when(kind == "error", 0).otherwise(1).cast("long").alias("is_renting"),
        F.when((kind == "error") & (k < 80), 0).otherwise(1).cast("long").alias("is_returning"),
        F.when(k != 0, 1704067200 + c("event_id")).otherwise(0).alias("last_reported"),
    )
    doc = F.floor(c("event_id") / 500)
    docs = e.withColumn("doc", doc).groupBy("doc").agg(F.collect_list(station).alias("stations"))
    return docs.select(
        F.format_string("%08d", "doc").alias("snapshot"),
        F.lit("station_status").alias("source_name"),
        F.concat(F.date_format(F.timestamp_seconds(1704067200 + c("doc") * 65), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("observed_at_utc"),
        F.struct(
            (1704067200 + F.floor(c("doc") / 2) * 130).alias("last_updated"), F.lit(60).cast("long").alias("ttl"), F.struct("stations").alias("data")
        ).alias("payload"),
    )


def stored_documents(spark, docs, schema, name):
    """A file for each snapshot, read back with the file's stem as snapshot id."""
    path = work_path(spark, name)
    SN.write_documents(docs, path)
    return SN.read_documents(spark, path, schema, lines=True)


BIKE = (
    EVENTS
    + """,
bk AS (SELECT *, printf('%08d', event_id // 500) AS snapshot_id, event_id // 500 AS doc, TIMESTAMP '2024-01-01' + to_seconds(event_id // 500 * 65) AS observed_at_utc,
  TIMESTAMP '2024-01-01' + to_seconds(event_id // 1000 * 130) AS source_last_updated_utc,
  CASE WHEN event_type = 'signup' AND k % 10 = 9 THEN 'not_installed' WHEN event_type = 'error' AND k < 80 THEN 'offline'
    WHEN event_type <> 'error' AND (CASE WHEN event_type = 'view' AND k < 60 THEN 0 ELSE k % 20 END) = 0 THEN 'empty'
    WHEN event_type = 'purchase' AND k < 60 THEN 'full' ELSE 'available' END AS status_class FROM ev)"""
)


@query(
    "snapshot_bike_facts",
    f"""WITH {BIKE}, l AS (SELECT *, max(snapshot_id) OVER (PARTITION BY source_last_updated_utc) AS m FROM bk)
        SELECT source_last_updated_utc, status_class, count(*) AS n, count(DISTINCT user_id) AS stations, count(*) FILTER (WHERE k = 0) AS without_report FROM l WHERE snapshot_id = m GROUP BY ALL""",
)
def snapshot_bike_facts(spark, sf):
    """Status facts of the last snapshot of each source version."""
    docs = stored_documents(spark, bike_documents(spark, sf), BIKE_SNAPSHOT, "bike")
    facts = U.last_load_of_version(cut(SN.bike_status(docs)), "source_last_updated_utc", "snapshot_id")
    return facts.groupBy("source_last_updated_utc", "status_class").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("station_id").alias("stations"), F.count_if(c("last_reported_utc").isNull()).alias("without_report")
    )


@query("snapshot_bike_manifest", f"WITH {BIKE} SELECT snapshot_id, any_value(observed_at_utc) AS observed_at_utc, CAST(count(*) AS INTEGER) AS station_count, any_value(1704067200 + doc // 2 * 130) AS source_last_updated, 60 AS source_ttl_sec FROM bk GROUP BY snapshot_id")
def snapshot_bike_manifest(spark, sf):
    """Manifest rows, loaded twice into the same table."""
    docs = stored_documents(spark, bike_documents(spark, sf), BIKE_SNAPSHOT, "bike")
    rows = cut(SN.bike_manifest(docs).drop("source_name"))
    path = work_path(spark, "manifest")
    U.upsert_table(path, rows, ["snapshot_id"])
    return U.upsert_table(path, rows, ["snapshot_id"])


@query("snapshot_bike_stations", f"WITH {BIKE} SELECT CAST(user_id AS VARCHAR) AS station_id, max(snapshot_id) AS source_snapshot_id, 'Station ' || CAST(user_id AS VARCHAR) AS name FROM bk GROUP BY user_id")
def snapshot_bike_stations(spark, sf):
    docs = stored_documents(spark, bike_documents(spark, sf), BIKE_SNAPSHOT, "bike")
    return SN.bike_stations(docs).select("station_id", "source_snapshot_id", "name")


@query("snapshot_freshness", f"WITH {BIKE} SELECT max(observed_at_utc) AS latest_observed_at_utc, true AS needs_refresh FROM bk")
def snapshot_freshness(spark, sf):
    docs = SN.identified(bike_documents(spark, sf).withColumn("_metadata", F.struct(F.lit("a.json").alias("file_name"), F.lit("a").alias("file_path"))), c("snapshot"))
    return SN.is_stale(docs, F.lit("2024-03-01").cast("timestamp_ntz"), 24)


@query(
    "snapshot_count_report",
    f"""WITH {BIKE} SELECT status_class, count(*) AS n, count(DISTINCT user_id) AS stations, count(DISTINCT source_last_updated_utc) AS versions, min(observed_at_utc) AS first_seen, max(observed_at_utc) AS last_seen
        FROM bk GROUP BY status_class""",
)
def snapshot_count_report(spark, sf):
    docs = stored_documents(spark, bike_documents(spark, sf), BIKE_SNAPSHOT, "bike")
    return SN.bike_status(docs).groupBy("status_class").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("station_id").alias("stations"), F.count_distinct("source_last_updated_utc").alias("versions"),
        F.min("observed_at_utc").alias("first_seen"), F.max("observed_at_utc").alias("last_seen"),
    )


@query("snapshot_stream_tables", f"WITH {BIKE}, l AS (SELECT snapshot_id, user_id, any_value(observed_at_utc) AS o FROM bk GROUP BY ALL) SELECT (SELECT count(DISTINCT snapshot_id) FROM bk) AS manifests, (SELECT count(DISTINCT user_id) FROM bk) AS stations")
def snapshot_stream_tables(spark, sf):
    """Documents as a file stream that keeps a manifest and a station table."""
    root = work_path(spark, "bikestream")
    bike_documents(spark, sf).write.partitionBy("snapshot").json(f"{root}/in")
    stream = spark.readStream.schema(BIKE_SNAPSHOT).option("recursiveFileLookup", "true").json(f"{root}/in")
    docs = SN.identified(stream, F.regexp_extract(c("_metadata.file_path"), r"snapshot=([^/]+)/", 1))
    tables = {"manifest": (SN.bike_manifest, ["snapshot_id"]), "stations": (SN.bike_stations, ["station_id"], ["last_seen_at_utc", "source_snapshot_id"])}
    keep_tables(docs, tables, f"{root}/tables", f"{root}/checkpoint")
    counts = {n: spark.read.parquet(f"{root}/tables/{n}").select(F.count(F.lit(1))).scalar() for n in tables}
    return spark.read.parquet(f"{root}/tables/manifest").agg(F.count(F.lit(1)).alias("manifests")).withColumn("stations", counts["stations"])


# --- road snapshots -------------------------------------------------------------------------


def road_documents(spark, sf):
    e = events(spark, sf)
    k = c("k")
    link = F.struct(
        F.when(k != 99, c("user_id").cast("string")).alias("link_id"),
        F.when(k != 98, F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS")).alias("data_as_of"),
        F.when(k % 10 == 0, "").when(k % 10 == 1, "n/a").otherwise(k.cast("string")).alias("speed"),
        F.concat(k.cast("string"), F.lit(".7")).alias("travel_time"),
        F.lit("0").alias("status"),
        c("event_type").alias("borough"),
        F.lit("40.5,-73.9 40.6,-73.8 40.7,").alias("link_points"),
    )
    docs = e.withColumn("doc", F.floor(c("event_id") / 500)).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("event_id", link.alias("l")))).alias("p"))
    return docs.select(
        F.format_string("%08d", "doc").alias("snapshot"),
        F.lit("road_speeds").alias("source_name"),
        F.date_format(F.timestamp_seconds(1704067200 + c("doc") * 65), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("observed_at_utc"),
        F.transform("p", lambda x: x["l"]).alias("payload"),
    )


ROAD = (
    EVENTS
    + """,
rd AS (SELECT *, printf('%08d', event_id // 500) AS snapshot_id, CASE WHEN k <> 98 THEN date_trunc('hour', ts) END AS data_as_of FROM ev WHERE k <> 99)"""
)


@query(
    "snapshot_road_facts",
    f"""WITH {ROAD}, f AS (SELECT *, max(snapshot_id) OVER (PARTITION BY user_id, data_as_of) AS m FROM rd WHERE data_as_of IS NOT NULL)
        SELECT CAST(user_id AS VARCHAR) AS link_id, count(*) AS n, count(*) FILTER (WHERE k % 10 > 1) AS with_speed, CAST(sum(k) AS BIGINT) AS travel_time_sum, min(data_as_of) AS first_seen FROM f WHERE snapshot_id = m GROUP BY user_id""",
)
def snapshot_road_facts(spark, sf):
    """Speed facts, each link and time as the last snapshot gave it."""
    docs = stored_documents(spark, road_documents(spark, sf), ROAD_SNAPSHOT, "road")
    facts = U.last_load_of_key(cut(SN.link_speeds(docs)), ["link_id", "data_as_of"], "snapshot_id")
    return facts.groupBy("link_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("speed_mph").alias("with_speed"), F.sum("travel_time_sec").alias("travel_time_sum"), F.min("data_as_of").alias("first_seen")
    )


@query(
    "snapshot_road_segments",
    f"""WITH {ROAD} SELECT CAST(user_id AS VARCHAR) AS link_id, snapshot_id AS source_snapshot_id, event_type AS borough, 40.5 AS start_lat, -73.8 AS end_lon, 2 AS point_count FROM rd
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY snapshot_id DESC, data_as_of DESC NULLS LAST, event_id) = 1""",
)
def snapshot_road_segments(spark, sf):
    docs = stored_documents(spark, road_documents(spark, sf), ROAD_SNAPSHOT, "road")
    return SN.link_segments(docs).select("link_id", "source_snapshot_id", "borough", "start_lat", "end_lon", "point_count")


# --- weather snapshots ----------------------------------------------------------------------


def weather_documents(spark, sf):
    e = events(spark, sf)
    k = c("k")
    value = lambda x: F.struct(x.cast("string").alias("value"))
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00"))
    period = F.struct(
        c("event_id").alias("number"), stamp.alias("startTime"), k.alias("temperature").cast("string").alias("temperature"),
        F.when(k % 2 == 0, "C").otherwise("F").alias("temperatureUnit"), value(F.when(k % 5 != 0, k)).alias("probabilityOfPrecipitation"),
        F.concat(k.cast("string"), F.lit(" to "), (k + 5).cast("string"), F.lit(" mph")).alias("windSpeed"),
    )
    observation = F.struct(F.struct(stamp.alias("timestamp"), value(k).alias("temperature"), value(k / 2).alias("windSpeed")).alias("properties"))
    entry = F.struct(
        F.struct(F.concat(F.lit("S"), (k % 4).cast("string")).alias("stationIdentifier")).alias("station"),
        F.when(c("event_type") != "error", observation).alias("observation"),
    )
    alert = F.struct(
        F.when(k % 2 == 0, F.concat(F.lit("A"), c("event_id").cast("string"))).alias("id"),
        F.struct(F.concat(F.lit("P"), c("event_id").cast("string")).alias("id"), F.lit("Minor").alias("severity"), F.lit("Wind").alias("event")).alias("properties"),
    )
    docs = e.withColumn("doc", F.floor(c("event_id") / 500)).groupBy("doc", "user_id").agg(
        F.collect_list(period).alias("periods"), F.collect_list(entry).alias("obs"), F.collect_list(F.when(c("event_type") == "signup", alert)).alias("alerts")
    )
    location = F.struct(
        F.concat(F.lit("loc"), c("user_id").cast("string")).alias("location_id"),
        (c("user_id") / 10.0).alias("lat"),
        F.struct(F.struct(F.lit("OKX").alias("cwa")).alias("properties")).alias("point"),
        F.struct(F.struct("periods").alias("properties")).alias("hourly_forecast"),
        c("obs").alias("latest_observations"),
        F.struct(c("alerts").alias("features")).alias("active_alerts"),
    )
    return docs.groupBy("doc").agg(F.collect_list(location).alias("locations")).select(
        F.format_string("%08d", "doc").alias("snapshot"),
        F.date_format(F.timestamp_seconds(1704067200 + c("doc") * 65), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("observed_at_utc"),
        "locations",
    )


def stored_weather(spark, sf):
    return stored_documents(spark, weather_documents(spark, sf), WEATHER_SNAPSHOT, "weather")


@query(
    "snapshot_weather_forecasts",
    f"""WITH {EVENTS} SELECT 'loc' || CAST(user_id AS VARCHAR) AS location_id, count(*) AS n, {settle('sum(CASE WHEN k % 2 = 0 THEN k * 9.0 / 5.0 + 32.0 ELSE k END)', 4)} AS temperature_sum,
        count(*) FILTER (WHERE k % 5 <> 0) AS with_precip, CAST(sum(k + 5) AS DOUBLE) AS wind_sum, min(date_trunc('second', ts) + INTERVAL 5 HOUR) AS first_start FROM ev GROUP BY user_id""",
)
def snapshot_weather_forecasts(spark, sf):
    return SN.hourly_forecasts(stored_weather(spark, sf)).groupBy("location_id").agg(
        F.count(F.lit(1)).alias("n"), settled(F.sum("temperature_f"), 4).alias("temperature_sum"), F.count("precipitation_probability_pct").alias("with_precip"),
        F.sum("wind_speed_mph_est").alias("wind_sum"), F.min("forecast_start_utc").alias("first_start"),
    )


@query(
    "snapshot_weather_observations",
    f"""WITH {EVENTS} SELECT 'loc' || CAST(user_id AS VARCHAR) AS location_id, count(*) AS n, {settle('sum(k * 9.0 / 5.0 + 32.0)', 4)} AS temperature_sum, {settle('sum(k / 2 * CAST(2.2369362921 AS DOUBLE))', 4)} AS wind_sum,
        count(DISTINCT k % 4) AS stations FROM ev WHERE event_type <> 'error' GROUP BY user_id""",
)
def snapshot_weather_observations(spark, sf):
    return SN.latest_observations(stored_weather(spark, sf)).groupBy("location_id").agg(
        F.count(F.lit(1)).alias("n"), settled(F.sum("temperature_f"), 4).alias("temperature_sum"), settled(F.sum("wind_speed_mph"), 4).alias("wind_sum"),
        F.count_distinct("station_id").alias("stations"),
    )


@query("snapshot_weather_alerts", f"WITH {EVENTS} SELECT 'loc' || CAST(user_id AS VARCHAR) AS location_id, CASE WHEN k % 2 = 0 THEN 'A' ELSE 'P' END || CAST(event_id AS VARCHAR) AS alert_id, 'Minor' AS severity FROM ev WHERE event_type = 'signup'")
def snapshot_weather_alerts(spark, sf):
    return SN.active_alerts(stored_weather(spark, sf)).select("location_id", "alert_id", "severity")


def replayed(spark, sf, rows, name):
    """Rows of all snapshots in a table by snapshot, into which every second snapshot is loaded again, with each row twice and then once."""
    facts = cut(rows(stored_weather(spark, sf)))
    again = facts.where(F.col("snapshot_id").cast("int") % 2 == 0)
    path = work_path(spark, name)
    U.upsert_table(path, facts, ["snapshot_id"])
    U.upsert_table(path, again.unionAll(again), ["snapshot_id"])
    return U.upsert_table(path, again, ["snapshot_id"])


SNAPSHOT = "printf('%08d', event_id // 500) AS snapshot_id"


@query(
    "snapshot_forecast_table",
    f"""WITH {EVENTS} SELECT {SNAPSHOT}, count(*) AS n, count(DISTINCT user_id) AS locations, min(date_trunc('second', ts) + INTERVAL 5 HOUR) AS first_start,
        CAST(sum(k) AS BIGINT) AS wind_from, 'number' AS first_json_key FROM ev GROUP BY 1""",
)
def snapshot_forecast_table(spark, sf):
    """Forecast facts kept by snapshot, with the period as JSON text."""
    first_number = F.regexp_extract(F.get_json_object("raw_period_json", "$.windSpeed"), r"^(\d+)", 1).cast("long")
    return replayed(spark, sf, SN.hourly_forecasts, "forecasts").groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("location_id").alias("locations"), F.min("forecast_start_utc").alias("first_start"),
        F.sum(first_number).alias("wind_from"), F.max(F.regexp_extract("raw_period_json", r'^\{"(\w+)"', 1)).alias("first_json_key"),
    )


@query(
    "snapshot_observation_table",
    f"""WITH {EVENTS} SELECT {SNAPSHOT}, count(*) AS n, count(DISTINCT user_id) AS locations, count(DISTINCT k % 4) AS stations, {settle('sum(CAST(k AS DOUBLE))', 4)} AS celsius_sum
        FROM ev WHERE event_type <> 'error' GROUP BY 1""",
)
def snapshot_observation_table(spark, sf):
    return replayed(spark, sf, SN.latest_observations, "observations").groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("location_id").alias("locations"), F.count_distinct("station_id").alias("stations"), settled(F.sum("temperature_c"), 4).alias("celsius_sum")
    )


@query("snapshot_alert_table", f"WITH {EVENTS} SELECT {SNAPSHOT}, count(*) AS n, count(DISTINCT user_id) AS locations, min(CASE WHEN k % 2 = 0 THEN 'A' ELSE 'P' END || CAST(event_id AS VARCHAR)) AS first_alert FROM ev WHERE event_type = 'signup' GROUP BY 1")
def snapshot_alert_table(spark, sf):
    return replayed(spark, sf, SN.active_alerts, "alerts").groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("location_id").alias("locations"), F.min("alert_id").alias("first_alert"))


@query(
    "snapshot_weather_counts",
    f"""WITH {EVENTS}, s AS (SELECT *, {SNAPSHOT} FROM ev)
        SELECT 'forecasts' AS table_name, count(*) AS n, count(DISTINCT user_id) AS locations, count(DISTINCT snapshot_id) AS snapshots, max(snapshot_id) AS newest FROM s
        UNION ALL SELECT 'observations', count(*), count(DISTINCT user_id), count(DISTINCT snapshot_id), max(snapshot_id) FROM s WHERE event_type <> 'error'
        UNION ALL SELECT 'alerts', count(*), count(DISTINCT user_id), count(DISTINCT snapshot_id), max(snapshot_id) FROM s WHERE event_type = 'signup'""",
)
def snapshot_weather_counts(spark, sf):
    """What the weather tables hold after an ingest."""
    docs = stored_weather(spark, sf)
    out = None
    for name, rows in (("forecasts", SN.hourly_forecasts), ("observations", SN.latest_observations), ("alerts", SN.active_alerts)):
        counted = rows(docs).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("location_id").alias("locations"), F.count_distinct("snapshot_id").alias("snapshots"), F.max("snapshot_id").alias("newest"))
        counted = counted.select(F.lit(name).alias("table_name"), "*")
        out = counted if out is None else out.unionByName(counted)
    return out


@query(
    "snapshot_road_counts",
    f"""WITH {ROAD} SELECT event_type AS borough, count(*) AS n, count(DISTINCT user_id) AS links, count(DISTINCT data_as_of) AS versions, count(*) FILTER (WHERE k % 10 > 1) AS with_speed,
        max(snapshot_id) AS newest FROM rd WHERE data_as_of IS NOT NULL GROUP BY 1""",
)
def snapshot_road_counts(spark, sf):
    """Rows per borough after an ingest."""
    docs = stored_documents(spark, road_documents(spark, sf), ROAD_SNAPSHOT, "road")
    return SN.link_speeds(docs).groupBy("borough").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("link_id").alias("links"), F.count_distinct("data_as_of").alias("versions"), F.count("speed_mph").alias("with_speed"), F.max("snapshot_id").alias("newest")
    )


@query("snapshot_weather_locations", f"WITH {EVENTS} SELECT 'loc' || CAST(user_id AS VARCHAR) AS location_id, user_id / 10.0 AS lat, 'OKX' AS office, printf('%08d', max(event_id // 500)) AS last_seen_snapshot_id FROM ev GROUP BY user_id")
def snapshot_weather_locations(spark, sf):
    return SN.weather_locations(stored_weather(spark, sf)).select("location_id", "lat", "office", "last_seen_snapshot_id")


# --- sensor files ---------------------------------------------------------------------------


@query(
    "source_sensor_csv",
    f"""WITH {EVENTS} SELECT event_type AS run_id, count(*) AS n, {settle('sum(value)', 4)} AS acc_sum, count(*) FILTER (WHERE k % 5 <> 0) AS gyro_count FROM ev WHERE k % 9 <> 0 GROUP BY event_type""",
)
def source_sensor_csv(spark, sf):
    """Exports with untidy headers, texts among the numbers and rows without time."""
    path = work_path(spark, "csv")
    rows = samples(spark, sf).select(
        "event_type",
        F.when(c("k") % 9 != 0, c("time_sec").cast("string")).otherwise("-").alias(" Time (s)"),
        c("value").cast("string").alias("Acceleration x (m/s^2) "),
        F.when(c("k") % 5 != 0, c("k").cast("string")).otherwise("bad").alias("Gyroscope x (rad/s)"),
    )
    rows.write.partitionBy("event_type").option("header", "true").csv(path)
    wide = SE.read_csv(spark, f"{path}/*/*.csv", F.regexp_extract(c("_metadata.file_path"), r"event_type=([a-z]+)/", 1))
    wide = wide.withColumnsRenamed({"Acceleration x (m/s^2)": "acc", "Gyroscope x (rad/s)": "gyro"})
    return wide.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), settled(F.sum("acc"), 4).alias("acc_sum"), F.count("gyro").alias("gyro_count"))


@query("source_sensor_manifest", f"WITH {EVENTS} SELECT event_type AS run_id, count(*) AS row_count, '[\"timestamp_sec\",\"value\"]' AS columns_json, 64 AS hash_length, 0 AS new_after_load FROM ev GROUP BY event_type")
def source_sensor_manifest(spark, sf):
    """Hash every file, load the manifest, and find nothing new on a second look."""
    path = work_path(spark, "hashed")
    samples(spark, sf).select("event_type", "time_sec", "value").repartition("event_type").write.partitionBy("event_type").option("header", "true").csv(path)
    wide = SE.read_csv(spark, f"{path}/*/*.csv", F.regexp_extract(c("_metadata.file_path"), r"event_type=([a-z]+)/", 1))
    hashes = cut(SE.content_hashes(spark, path, "*.csv").withColumn("source_file", F.regexp_replace("source_file", "^file:/+", "file:///")))
    again = SE.new_files(hashes, hashes).select(F.count(F.lit(1))).scalar()
    table_ = SE.manifest(wide.withColumn("source_file", F.regexp_replace("source_file", "^file:/+", "file:///")), hashes)
    return table_.select("run_id", "row_count", "columns_json", F.length("file_hash").alias("hash_length"), again.alias("new_after_load"))


@query("source_buffer_documents", f"WITH {EVENTS} SELECT user_id AS run_id, count(*) AS rows, {settle('max(value) - min(value)', 4)} AS duration_sec FROM ev GROUP BY user_id")
def source_buffer_documents(spark, sf):
    """Buffer documents of all runs, a document per run, to sensor frames."""
    per_run = samples(spark, sf).groupBy("run_id").agg(F.collect_list("value").alias("v"))
    names = [n for group in SE.BUFFERS.values() for n in group]
    docs = per_run.select("run_id", F.struct(*[F.struct(c("v").alias("buffer")).alias(n) for n in names]).alias("buffer"))
    path = work_path(spark, "buffers")
    RP.write_json(docs, path)
    frames = SE.buffer_frames(spark.read.schema(docs.schema).json(path))
    return SE.frame_summary(frames["acc"]).select("run_id", "rows", settled(c("duration_sec"), 4).alias("duration_sec"))


@F.pandas_udf(BinaryType())
def _wav(columns: pd.Series) -> pd.Series:
    """Stand-in data: samples as the bytes of a 16-bit file."""

    def one(x):
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(1)
            f.setsampwidth(2)
            f.setframerate(64)
            f.writeframes(np.round(np.asarray(x, dtype=float) * 32768.0).astype("<i2").tobytes())
        return out.getvalue()

    return columns.map(one)


@query(
    "source_waveform_blocks",
    "SELECT CAST(vec_id AS VARCHAR) AS source, 64 AS rate_hz, CAST(i // 16 AS BIGINT) AS block_idx, CAST(sum(round_even(embedding[i + 1] * CAST(32768 AS DOUBLE), 0)) AS BIGINT) AS sample_sum "
    "FROM embeddings, LATERAL (SELECT unnest(range(64)) AS i) GROUP BY ALL",
)
def source_waveform_blocks(spark, sf):
    files = table(spark, sf, "embeddings").select(c("vec_id").cast("string").alias("path"), _wav("embedding").alias("content"))
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return WV.blocks(files, 16).select("source", "rate_hz", "block_idx", F.rint(total * 32768.0).cast("long").alias("sample_sum"))


@query(
    "source_waveform_files",
    f"""WITH s AS (SELECT vec_id, i, embedding[i + 1] AS x, [1, 2, 4][vec_id % 3 + 1] AS width, vec_id % 2 + 1 AS channels FROM embeddings, LATERAL (SELECT unnest(range(64)) AS i)),
        p AS (SELECT *, CASE width WHEN 1 THEN 128 WHEN 2 THEN 32768 ELSE 2147483648 END::DOUBLE AS scale FROM s),
        d AS (SELECT vec_id, i, CASE WHEN channels = 1 THEN round_even(x * scale, 0) / scale ELSE (round_even(x * scale, 0) + round_even(x * scale / 2, 0)) / 2 / scale END AS y FROM p)
        SELECT CAST(vec_id AS VARCHAR) AS source, 64 AS rate_hz, CAST(i // 16 AS BIGINT) AS block_idx, 16 AS n, {settle('sum(y)', 6)} AS total FROM d GROUP BY vec_id, i // 16""",
)
def source_waveform_files(spark, sf):
    """Files of 8, 16 and 32 bits, mono and stereo, written by tasks and read back in parts of a few hundred bytes."""
    width = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), (c("vec_id") % 3 + 1).cast("int"))
    full = F.when(width == 1, 128.0).when(width == 2, 32768.0).otherwise(2147483648.0)
    whole = lambda y: F.rint(y).cast("long") + F.when(width == 1, 128).otherwise(0)
    frame = lambda x: F.when(c("vec_id") % 2 == 0, F.array(whole(x.cast("double") * full))).otherwise(F.array(whole(x.cast("double") * full), whole(x.cast("double") * full / 2)))
    rows = table(spark, sf, "embeddings").select(
        c("vec_id").cast("string").alias("name"), F.lit(64).alias("rate_hz"), (c("vec_id") % 2 + 1).cast("int").alias("channels"), width.alias("width"), F.flatten(F.transform("embedding", frame)).alias("pcm")
    )
    path = work_path(spark, "waveforms")
    WV.write_files(rows, path)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    read = WV.read_files(spark, path, block=16, part_bytes=540)
    return read.select(F.regexp_extract("source", r"([^/]+)\.wav$", 1).alias("source"), "rate_hz", "block_idx", F.size("samples").alias("n"), settled(total, 6).alias("total"))


# --- run logs and reports -------------------------------------------------------------------


@query(
    "source_run_log_lines",
    f"WITH {EVENTS} SELECT CASE WHEN k % 13 = 0 OR k % 17 = 0 THEN 'rejected' ELSE 'valid' END AS part, count(*) AS n, count(*) FILTER (WHERE k % 17 = 0) AS broken_lines FROM ev GROUP BY 1",
)
def source_run_log_lines(spark, sf):
    """Log lines as text files, some without a field and some cut off; read with errors per line."""
    k = c("k")
    log = MI.run_log(spark, sf).join(events(spark, sf).select(c("event_id").cast("string").alias("event_id"), "k"), "event_id")
    fields = [F.when(k % 13 != 0, "m").alias("mission_id"), *[F.lit("x").alias(n) for n in ("robot_id", "recorded_at", "schema_version")]]
    line = F.to_json(F.struct(*[c(n) for n in log.columns if n not in ("k", "run_id")], c("run_id").cast("string").alias("run_id"), *fields))
    path = work_path(spark, "lines")
    log.select(F.when(k % 17 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    lines = RL.read_lines(spark, path)
    good = RL.events(lines).filter(c("payload").isNotNull()).select(F.lit("valid").alias("part"), F.lit(False).alias("broken"))
    bad = RL.rejected(lines).select(F.lit("rejected").alias("part"), F.array_contains("errors", "line is not a JSON object").alias("broken"))
    return good.unionByName(bad).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("broken").alias("broken_lines"))


@query("sink_result_csv", f"WITH {MI.LOG}, {MI.SCENARIO_SQL} SELECT scenario_name, software_version, count(*) AS runs, count(completion_time_s) AS completed, {len(RESULT_COLUMNS)} AS columns FROM res GROUP BY ALL")
def sink_result_csv(spark, sf):
    """Result rows as CSV in the fixed column order; empty cells come back as null."""
    path = work_path(spark, "results")
    RP.write_columns_csv(MI.results(spark, sf), RESULT_COLUMNS, path)
    back = spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    assert back.columns == list(RESULT_COLUMNS)
    return back.groupBy("scenario_name", "software_version").agg(
        F.count(F.lit(1)).alias("runs"), F.count("completion_time_s").alias("completed"), F.lit(len(back.columns)).alias("columns")
    )


@query("sink_nested_report", f"WITH {STAGED} SELECT (SELECT count(*) FROM clean) AS clean_count, (SELECT count(*) FROM (SELECT DISTINCT data_year, data_month FROM clean)) AS months")
def sink_nested_report(spark, sf):
    """Coverage and counts of the period as one JSON document in parts, read back line by line."""
    trips = cut(T.clean(staging(spark, sf)).select(*T.PARTITION, "pickup_date"))
    report = RP.nested_report({"counts": trips.agg(F.count(F.lit(1)).alias("clean_count"))}, {"coverage": (T.period_coverage(trips), ["data_year", "data_month"])})
    path = work_path(spark, "report")
    RP.write_nested_report(report, path)
    lines = spark.read.text(path)
    counted = F.regexp_extract("value", r'^"counts":\{"clean_count":(\d+)', 1)
    return lines.agg(F.max(counted.try_cast("long")).alias("clean_count"), F.count_if(c("value").rlike(r'^,?\{"data_year":\d')).alias("months"))


@query("sink_appended_lines", f"WITH {EVENTS} SELECT event_type, CAST(2 * count(*) AS BIGINT) AS n FROM ev GROUP BY event_type")
def sink_appended_lines(spark, sf):
    path = work_path(spark, "appended")
    for _ in range(2):
        RP.append_lines(events(spark, sf).select("event_id", "event_type", "value"), path)
    return spark.read.schema("event_id long, event_type string, value double").json(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("sink_run_outputs", f"WITH {EVENTS} SELECT user_id AS run_id, count(*) FILTER (WHERE event_type IN ('signup', 'error')) AS gyro, count(*) FILTER (WHERE event_type IN ('view', 'purchase')) AS acc FROM ev GROUP BY user_id")
def sink_run_outputs(spark, sf):
    """One table per kind, runs dealt out to groups."""
    gyro, acc, _ = sensors(spark, sf)
    root = work_path(spark, "outputs")
    RP.write_run_outputs({"gyro": gyro, "acc": acc}, root, groups=8)
    count = lambda n: spark.read.parquet(f"{root}/{n}").groupBy("run_id").agg(F.count(F.lit(1)).alias(n))
    return count("gyro").join(count("acc"), "run_id", "full").select("run_id", F.coalesce("gyro", F.lit(0)).alias("gyro"), F.coalesce("acc", F.lit(0)).alias("acc"))


@query("sink_newest_rows", f"WITH {EVENTS} SELECT user_id AS link_id, ts AS data_as_of, event_id AS reading_id FROM ev ORDER BY ts DESC, event_id LIMIT 10")
def sink_newest_rows(spark, sf):
    return U.newest_rows(link_speeds(spark, sf), "data_as_of", 10, ["reading_id"]).select("link_id", "data_as_of", "reading_id")


@query(
    "dimension_replace_by_key",
    "SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT s_suppkey FROM supplier) THEN 'new' ELSE 'old' END AS version FROM customer "
    "UNION ALL SELECT s_suppkey, 'new' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer)",
)
def dimension_replace_by_key(spark, sf):
    old = table(spark, sf, "customer").select(c("c_custkey").alias("id"), F.lit("old").alias("version"))
    new = table(spark, sf, "supplier").select(c("s_suppkey").alias("id"), F.lit("new").alias("version"))
    return U.replace_by_key(old, new, ["id"])
