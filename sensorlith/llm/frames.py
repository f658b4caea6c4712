"""Small helpers for DataFrames that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlith.session import work_path


def bucket_of(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def bounded_sample(ids: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows of narrow ``ids``: those whose key has the smallest hashes, so that reruns agree."""
    return ids.orderBy(F.xxhash64(F.col(key), F.lit(17)), key).limit(rows)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read from there: nothing before them runs again."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def bucketed(df: DataFrame, name: str, key: str, compression: str = "zstd") -> DataFrame:
    """Like ``stored``, in buckets of ``key``: joins and groups by it move the other side only. The catalog forgets the table at once, the files stay."""
    spark = df.sparkSession
    path = work_path(spark, name)
    table = "spark_catalog.default." + path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("compression", compression).option("path", path).saveAsTable(table)
    rows = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return rows


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that ``stored`` wrote, once nothing reads it any more: what came out of it is written."""
    spark = df.sparkSession
    for folder in {path.rsplit("/", 1)[0] for path in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
