"""Snapshot documents: one JSON document per poll, turned into fact and dimension rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sensorlith.functions.geo import parse_points
from sensorlith.functions.numbers import safe_double, safe_int
from sensorlith.functions.scores import station_status
from sensorlith.functions.times import epoch_to_utc, micros, parse_iso
from sensorlith.functions.units import c_to_f, fahrenheit, mps_to_mph, wind_text_mph
from sensorlith.operators.series import latest
from sensorlith.sources.files import write_lines


def file_stem() -> Column:
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def read_documents(
    spark: SparkSession, path: str, schema: StructType, glob: str = "*.json", snapshot_id: Column | None = None, lines: bool = False
) -> DataFrame:
    """Documents with snapshot_id (the file's stem unless told otherwise), path and observation time."""
    reader = spark.read.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if not lines:
        reader = reader.option("multiLine", "true")
    return identified(reader.json(path), snapshot_id)


def write_documents(docs: DataFrame, path: str) -> None:
    """Documents as lines of the file <snapshot>.json."""
    line = F.to_json(F.struct(*[F.col(n) for n in docs.columns if n != "snapshot"]))
    write_lines(docs.select(F.concat("snapshot", F.lit(".json")).alias("file"), line.alias("line")), path)


def stream_documents(
    spark: SparkSession, path: str, schema: StructType, glob: str = "*.json", files_per_trigger: int = 10, lines: bool = False
) -> DataFrame:
    """The same folder as a stream, a limited number of files per batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger)
    if not lines:
        reader = reader.option("multiLine", "true")
    return identified(reader.json(path), None)


def identified(docs: DataFrame, snapshot_id: Column | None) -> DataFrame:
    return docs.select(
        "*",
        (file_stem() if snapshot_id is None else snapshot_id).alias("snapshot_id"),
        F.col("_metadata.file_path").alias("raw_file_path"),
    ).withColumn("observed_at_utc", parse_iso(F.col("observed_at_utc")))


def is_stale(docs: DataFrame, now: Column, max_age_hours: float) -> DataFrame:
    """One row: newest observation and whether the feed has to be read again (too old, or nothing there)."""
    newest = docs.agg(F.max("observed_at_utc").alias("latest_observed_at_utc"))
    age = (micros(now) - micros(F.col("latest_observed_at_utc"))) / 3.6e9
    return newest.withColumn("needs_refresh", F.coalesce(age >= max_age_hours, F.lit(True)))


# --- bike stations -------------------------------------------------------------------------


def bike_manifest(docs: DataFrame) -> DataFrame:
    """One row per document: how many stations, version time, time to live."""
    return docs.select(
        "snapshot_id",
        "source_name",
        "observed_at_utc",
        F.coalesce(F.size("payload.data.stations"), F.lit(0)).alias("station_count"),
        F.col("payload.last_updated").alias("source_last_updated"),
        F.col("payload.ttl").alias("source_ttl_sec"),
    )


def bike_status(docs: DataFrame) -> DataFrame:
    rows = docs.select(
        "snapshot_id",
        "observed_at_utc",
        epoch_to_utc(F.col("payload.last_updated")).alias("source_last_updated_utc"),
        F.explode("payload.data.stations").alias("s"),
        "raw_file_path",
    )
    counts = ("num_bikes_available", "num_ebikes_available", "num_bikes_disabled", "num_docks_available", "num_docks_disabled")
    flags = ("is_installed", "is_renting", "is_returning")
    return rows.select(
        "snapshot_id",
        "observed_at_utc",
        "source_last_updated_utc",
        "s.station_id",
        *[F.col(f"s.{c}") for c in (*counts, *flags)],
        F.col("s.last_reported").alias("last_reported_epoch"),
        epoch_to_utc(F.col("s.last_reported")).alias("last_reported_utc"),
        station_status(
            F.col("s.is_installed"), F.col("s.is_renting"), F.col("s.is_returning"), F.col("s.num_bikes_available"), F.col("s.num_docks_available")
        ).alias("status_class"),
        "raw_file_path",
    )


def bike_stations(docs: DataFrame) -> DataFrame:
    """Station attributes, the newest document winning."""
    rows = docs.select("snapshot_id", "observed_at_utc", F.explode("payload.data.stations").alias("s"))
    flat = rows.select(
        F.col("s.station_id").alias("station_id"),
        *[F.col(f"s.{c}").alias(c) for c in ("name", "short_name", "lat", "lon", "capacity", "region_id", "station_type", "has_kiosk", "external_id")],
        F.to_json("s.rental_methods").alias("rental_methods_json"),
        F.col("observed_at_utc").alias("last_seen_at_utc"),
        F.col("snapshot_id").alias("source_snapshot_id"),
    )
    return latest(flat, ["station_id"], [F.col("last_seen_at_utc"), F.col("source_snapshot_id")])


# --- road links ----------------------------------------------------------------------------


def _links(docs: DataFrame) -> DataFrame:
    rows = docs.select("snapshot_id", "observed_at_utc", "raw_file_path", F.posexplode("payload").alias("position", "r"))
    return rows.filter(F.col("r.link_id").isNotNull() & (F.col("r.link_id") != ""))


def link_speeds(docs: DataFrame) -> DataFrame:
    """Readings with a link and a time; texts become numbers where they are numbers."""
    out = _links(docs).select(
        "snapshot_id",
        "observed_at_utc",
        parse_iso(F.col("r.data_as_of")).alias("data_as_of"),
        "r.link_id",
        safe_double(F.col("r.speed")).alias("speed_mph"),
        safe_int(F.col("r.travel_time")).alias("travel_time_sec"),
        safe_int(F.col("r.status")).alias("status"),
        "r.borough",
        "r.link_name",
        "r.owner",
        "raw_file_path",
    )
    return out.filter(F.col("data_as_of").isNotNull())


def link_segments(docs: DataFrame) -> DataFrame:
    """Link attributes and geometry ends. In a document the newest reading of a link counts (the first of
    equals, one without time loses); over documents the newest document."""
    rows = _links(docs).select(
        "snapshot_id",
        "observed_at_utc",
        "position",
        F.col("r.link_id").alias("link_id"),
        parse_iso(F.col("r.data_as_of")).alias("_as_of"),
        *[F.col(f"r.{c}").alias(c) for c in ("link_name", "borough", "owner", "transcom_id", "link_points", "encoded_poly_line", "encoded_poly_line_lvls")],
    )
    best = latest(rows, ["link_id"], [F.col("observed_at_utc"), F.col("snapshot_id"), F.col("_as_of"), -F.col("position")])
    points = parse_points(F.col("link_points"))
    best = best.withColumn("_p", points)
    ends = {f"{n}_{a}": F.try_element_at("_p", F.lit(i))[a] for n, i in (("start", 1), ("end", -1)) for a in ("lat", "lon")}
    return (
        best.withColumns({**ends, "point_count": F.size("_p")})
        .withColumnsRenamed({"observed_at_utc": "last_seen_at_utc", "snapshot_id": "source_snapshot_id"})
        .drop("_p", "_as_of", "position")
    )


# --- weather -------------------------------------------------------------------------------


def value_of(quantity: str) -> Column:
    return safe_double(F.col(f"{quantity}.value"))


def _locations(docs: DataFrame) -> DataFrame:
    return docs.select("snapshot_id", "observed_at_utc", "raw_file_path", F.explode("locations").alias("l"))


def weather_locations(docs: DataFrame) -> DataFrame:
    p = "l.point.properties"
    rows = _locations(docs).select(
        F.col("l.location_id").alias("location_id"),
        F.col("l.lat").alias("lat"),
        F.col("l.lon").alias("lon"),
        F.col(f"{p}.cwa").alias("office"),
        F.col(f"{p}.gridId").alias("grid_id"),
        F.col(f"{p}.gridX").alias("grid_x"),
        F.col(f"{p}.gridY").alias("grid_y"),
        F.col(f"{p}.forecastZone").alias("forecast_zone"),
        F.col(f"{p}.county").alias("county_zone"),
        F.col("observed_at_utc").alias("last_seen_at_utc"),
        F.col("snapshot_id").alias("last_seen_snapshot_id"),
    )
    return latest(rows, ["location_id"], [F.col("last_seen_at_utc"), F.col("last_seen_snapshot_id")])


def hourly_forecasts(docs: DataFrame) -> DataFrame:
    rows = _locations(docs).select("snapshot_id", "observed_at_utc", "l", F.explode("l.hourly_forecast.properties.periods").alias("p"))
    return rows.select(
        "snapshot_id",
        F.col("l.location_id").alias("location_id"),
        "observed_at_utc",
        parse_iso(F.col("l.hourly_forecast.properties.generatedAt")).alias("forecast_generated_at_utc"),
        parse_iso(F.col("l.hourly_forecast.properties.updateTime")).alias("forecast_update_time_utc"),
        F.col("p.number").cast("int").alias("period_number"),
        F.col("p.name").alias("period_name"),
        parse_iso(F.col("p.startTime")).alias("forecast_start_utc"),
        parse_iso(F.col("p.endTime")).alias("forecast_end_utc"),
        F.col("p.isDaytime").alias("is_daytime"),
        fahrenheit(safe_double(F.col("p.temperature")), F.col("p.temperatureUnit")).alias("temperature_f"),
        value_of("p.probabilityOfPrecipitation").alias("precipitation_probability_pct"),
        value_of("p.relativeHumidity").alias("relative_humidity_pct"),
        value_of("p.dewpoint").alias("dewpoint_c"),
        wind_text_mph(F.col("p.windSpeed")).alias("wind_speed_mph_est"),
        F.col("p.windDirection").alias("wind_direction"),
        F.col("p.shortForecast").alias("short_forecast"),
        F.col("p.detailedForecast").alias("detailed_forecast"),
        sorted_json("p", rows.schema["p"].dataType).alias("raw_period_json"),
    )


def latest_observations(docs: DataFrame) -> DataFrame:
    """Observation entries; one that holds an error instead of an observation is left out."""
    rows = _locations(docs).select("snapshot_id", "observed_at_utc", F.col("l.location_id").alias("location_id"), F.explode("l.latest_observations").alias("o"))
    rows = rows.filter(F.col("o.observation").isNotNull())
    p = "o.observation.properties"
    temp, dew, wind, gust = (value_of(f"{p}.{n}") for n in ("temperature", "dewpoint", "windSpeed", "windGust"))
    return rows.select(
        "snapshot_id",
        "location_id",
        "observed_at_utc",
        F.col("o.station.stationIdentifier").alias("station_id"),
        F.col("o.station.name").alias("station_name"),
        F.col("o.station_url").alias("station_url"),
        parse_iso(F.col(f"{p}.timestamp")).alias("observation_time_utc"),
        temp.alias("temperature_c"),
        c_to_f(temp).alias("temperature_f"),
        dew.alias("dewpoint_c"),
        value_of(f"{p}.relativeHumidity").alias("relative_humidity_pct"),
        wind.alias("wind_speed_mps"),
        mps_to_mph(wind).alias("wind_speed_mph"),
        gust.alias("wind_gust_mps"),
        mps_to_mph(gust).alias("wind_gust_mph"),
        value_of(f"{p}.barometricPressure").alias("barometric_pressure_pa"),
        F.col(f"{p}.textDescription").alias("text_description"),
    )


def active_alerts(docs: DataFrame) -> DataFrame:
    rows = _locations(docs).select("snapshot_id", "observed_at_utc", F.col("l.location_id").alias("location_id"), F.explode("l.active_alerts.features").alias("f"))
    p = "f.properties"
    return rows.select(
        "snapshot_id",
        "location_id",
        "observed_at_utc",
        F.coalesce(F.nullif(F.col("f.id"), F.lit("")), F.col(f"{p}.id")).alias("alert_id"),
        *[parse_iso(F.col(f"{p}.{n}")).alias(f"{n}_utc") for n in ("sent", "effective", "onset", "expires", "ends")],
        F.col(f"{p}.messageType").alias("message_type"),
        F.col(f"{p}.areaDesc").alias("area_desc"),
        *[F.col(f"{p}.{n}").alias(n) for n in ("status", "category", "severity", "certainty", "urgency", "event", "headline", "description", "instruction")],
    )


def sorted_json(path: str, kind: StructType) -> Column:
    """JSON text with keys in alphabetical order."""
    return F.to_json(F.struct(*[F.col(f"{path}.{n}").alias(n) for n in sorted(kind.names)]))
