"""Trip and zone files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Name pattern of trip files.
FILE_PATTERN = r"([a-z]+)_tripdata_(\d{4})-(\d{2})\.parquet"


def landing_path(root: str, taxi_type: str, year: int, month: int) -> str:
    return f"{root}/{taxi_type}/{year}/{month:02d}/{taxi_type}_tripdata_{year}-{month:02d}.parquet"


def lineage(path: Column, pattern: str = FILE_PATTERN) -> list[Column]:
    """Type, year and month that a file's path tells."""
    return [
        F.regexp_extract(path, pattern, 1).alias("taxi_type"),
        F.regexp_extract(path, pattern, 2).try_cast("int").alias("data_year"),
        F.regexp_extract(path, pattern, 3).try_cast("int").alias("data_month"),
    ]


def with_lineage(df: DataFrame, pattern: str = FILE_PATTERN) -> DataFrame:
    """Type, year and month from the file's path, the path itself, and the load time."""
    path = F.col("_metadata.file_path")
    return df.select(
        "*",
        *lineage(path, pattern),
        path.alias("source_file"),
        F.current_timestamp().cast("timestamp_ntz").alias("ingested_at_utc"),
    )


def read_trips(spark: SparkSession, root: str, pattern: str = FILE_PATTERN) -> DataFrame:
    """All trip files under ``root``; columns that some files lack are null there."""
    files = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").option("pathGlobFilter", "*.parquet")
    return with_lineage(files.parquet(root), pattern)


def read_zones_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    return raw.select(
        F.col("LocationID").cast("int").alias("location_id"),
        F.col("Borough").cast("string").alias("borough"),
        F.col("Zone").cast("string").alias("zone"),
        F.col("service_zone").cast("string").alias("service_zone"),
    )


# Names under which zone files carry their attributes.
ZONE_ALIASES = {"zone": ("zone",), "borough": ("borough",), "service_zone": ("service_zone", "servicezone")}


def zone_attributes(df: DataFrame) -> DataFrame:
    """location_id and text attributes by any of their names, in any case; a missing attribute is empty text."""
    by_lower = {c.lower(): c for c in df.columns}
    ids = [by_lower[n] for n in ("locationid", "location_id") if n in by_lower]
    if not ids:
        raise ValueError(f"no LocationID or location_id among {df.columns}")

    def attribute(names: tuple[str, ...]):
        found = [F.col(by_lower[n]).cast("string") for n in names if n in by_lower]
        return F.coalesce(*found, F.lit(""))

    kept = [by_lower["geometry"]] if "geometry" in by_lower else []
    return df.select(F.col(ids[0]).cast("int").alias("location_id"), *[attribute(v).alias(n) for n, v in ZONE_ALIASES.items()], *kept)


def read_zones_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features of GeoJSON documents, one per file or one per line; the geometry is carried along as JSON text."""
    doc = spark.read.option("multiLine", not lines).json(path)
    feature = doc.select(F.explode("features").alias("f"))
    flat = feature.select("f.properties.*", F.to_json("f.geometry").alias("geometry"))
    return zone_attributes(flat)


def read_zones_parquet(spark: SparkSession, path: str) -> DataFrame:
    return zone_attributes(spark.read.parquet(path))
