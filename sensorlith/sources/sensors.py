"""Phone-sensor files: CSV exports, three-sensor runs and buffer documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlith.session import cut, written
from sensorlith.sources.files import read_lines, write_lines

SENSORS = {"accelerometer": "acc", "gravity": "gravity", "gyroscope": "gyro"}

# Names in the buffer document: time, x, y, z.
BUFFERS = {
    "accelerometer": ("acc_time", "accX", "accY", "accZ"),
    "gravity": ("graT", "graX", "graY", "graZ"),
    "gyroscope": ("gyro_time", "gyroX", "gyroY", "gyroZ"),
}


def clean_name(name: str) -> str:
    return name.strip().replace("\n", " ").replace("\r", " ")


def time_column(df: DataFrame) -> str:
    """The first column whose name speaks of time, else the first numeric one."""
    for name in df.columns:
        low = name.lower()
        if "time" in low or low.strip() in ("t", "seconds", "sec"):
            return name
    for name, kind in df.dtypes:
        if kind in ("double", "float", "int", "bigint"):
            return name
    raise ValueError("no time column and no numeric column")


def read_csv(spark: SparkSession, path: str, run_id: Column | None = None) -> DataFrame:
    """Wide rows with cleaned names and numbers; what is no number is null, rows without time fall out.

    Adds run_id (the file's stem unless given), timestamp_sec and source_file. No rows at all is an error.
    """
    raw = spark.read.option("header", "true").option("multiLine", "true").csv(path)
    if raw.isEmpty():
        raise ValueError(f"no rows in {path}")
    stem = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""), " ", "_")
    raw = raw.select("*", (stem if run_id is None else run_id).alias("_run"), F.col("_metadata.file_path").alias("_file"))
    data = [c for c in raw.columns if c not in ("_run", "_file")]
    numeric = raw.select("_run", "_file", *[F.col(f"`{c}`").try_cast("double").alias(clean_name(c)) for c in data])
    names = [clean_name(c) for c in data]
    time = time_column(numeric.select(*[F.col(f"`{n}`") for n in names]))
    sensors = [n for n in names if n != time]
    if not sensors:
        raise ValueError(f"no sensor columns in {path}")
    return numeric.select(
        F.col("_run").alias("run_id"), F.col("_file").alias("source_file"), F.col(f"`{time}`").alias("timestamp_sec"), *[F.col(f"`{n}`") for n in sensors]
    ).filter(F.col("timestamp_sec").isNotNull())


def manifest(wide: DataFrame, hashes: DataFrame) -> DataFrame:
    """One row per file: hash, rows and columns."""
    names = [c for c in wide.columns if c not in ("run_id", "source_file", "timestamp_sec")]
    counts = wide.groupBy("run_id", "source_file").agg(F.count(F.lit(1)).alias("row_count"))
    return counts.join(hashes, "source_file").withColumn("columns_json", F.to_json(F.array(*[F.lit(n) for n in ["timestamp_sec", *names]])))


def content_hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SHA-256 of each file's bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("source_file"), F.sha2("content", 256).alias("file_hash"))


def new_files(hashes: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content is not yet in the manifest; of equal files the first by path."""
    first = hashes.groupBy("file_hash").agg(F.min("source_file").alias("source_file"))
    return first.join(known.select("file_hash"), "file_hash", "left_anti")


def write_three_sensor_runs(rows: DataFrame, path: str) -> None:
    """Rows (run_id, sensor, time_sec, x, y, z) as files <run>_<sensor>.csv."""
    columns = ("time_sec", "x", "y", "z")
    write_lines(rows.select(F.concat("run_id", F.lit("_"), "sensor", F.lit(".csv")).alias("file"), F.to_csv(F.struct(*columns)).alias("line")), path, header=",".join(columns))


def read_three_sensor_runs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Frames by sensor from files <run>_<sensor>.csv, or folders of that name with the parts of a file; each run needs exactly one of each
    sensor."""
    name = rf"(?P<_file>(?P<run_id>[^/=]*)_(?P<sensor>{'|'.join(SENSORS)})\.csv)(/part-[^/]*)?$"
    lines = read_lines(spark, path, rf"^(?P<_folder>.*?){name}", "*.csv", header=True)
    rows = lines.select("run_id", "sensor", F.concat("_folder", "_file").alias("_file"), F.from_csv("line", "time_sec double, x double, y double, z double").alias("_row"))
    rows = written(rows.select("run_id", "sensor", "_file", "_row.*"), "sensor-rows")
    files = cut(rows.select("run_id", "sensor", "_file").distinct())
    counts = files.groupBy("run_id").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("sensor").alias("sensors"))
    wrong = counts.filter((F.col("files") != len(SENSORS)) | (F.col("sensors") != len(SENSORS))).limit(5).collect()
    if wrong:
        raise ValueError(f"runs without exactly one file per sensor: {[r['run_id'] for r in wrong]}")
    return {
        short: rows.filter(F.col("sensor") == sensor).select("run_id", "time_sec", *[F.col(a).alias(f"{short}_{a}") for a in "xyz"])
        for sensor, short in SENSORS.items()
    }


def buffer_frames(docs: DataFrame) -> dict[str, DataFrame]:
    """Buffer documents (run_id, buffer struct of named arrays) to one frame per sensor; a run without rows of a sensor is an error."""
    out = {}
    for sensor, names in BUFFERS.items():
        columns = ("time_sec", *[f"{SENSORS[sensor]}_{a}" for a in "xyz"])
        zipped = F.arrays_zip(*[F.col(f"buffer.{n}.buffer").alias(c) for n, c in zip(names, columns)])
        empty = docs.filter(F.coalesce(F.size(f"buffer.{names[0]}.buffer"), F.lit(0)) <= 0)
        if not empty.isEmpty():
            raise ValueError(f"a run has no {sensor} rows")
        out[SENSORS[sensor]] = docs.select("run_id", F.inline(zipped)).toDF("run_id", *columns)
    return out


def frame_summary(frame: DataFrame) -> DataFrame:
    return frame.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"), (F.max("time_sec") - F.min("time_sec")).alias("duration_sec"))


def read_run(store: DataFrame, run_ids: Sequence[str]) -> DataFrame:
    """Rows of the named runs from the long store; a run that is not there is an error."""
    rows = store.filter(F.col("run_id").isin(*run_ids))
    found = {r[0] for r in rows.select("run_id").distinct().collect()}
    missing = sorted(set(run_ids) - found)
    if missing:
        raise ValueError(f"no rows for runs {missing}")
    return rows
