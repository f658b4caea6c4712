"""Robot event logs as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlith.plans.missions import FIELDS, contract_errors
from sensorlith.schemas import PAYLOAD, RUN_EVENT


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its fields as text, and what is wrong with it; a line that is no JSON object has all fields missing."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS] + [T.StructField("_corrupt_record", T.StringType())])
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").json(path, recursiveFileLookup=True)
    broken = F.when(F.col("_corrupt_record").isNotNull(), F.array(F.lit("line is not a JSON object")))
    return raw.withColumn("source_file", F.col("_metadata.file_path")).withColumn("errors", F.coalesce(broken, contract_errors()))


def events(lines: DataFrame) -> DataFrame:
    """Typed events of the lines without errors."""
    payload = F.from_json("payload", PAYLOAD)
    return lines.filter(F.size("errors") == 0).select(
        *[(payload if f == "payload" else F.col(f).cast(RUN_EVENT[f].dataType)).alias(f) for f in FIELDS]
    )


def rejected(lines: DataFrame) -> DataFrame:
    return lines.filter(F.size("errors") > 0)


def read_states(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)
