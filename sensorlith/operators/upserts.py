"""Keeping tables up to date with batches of rows, as joins over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sensorlith.operators.series import latest
from sensorlith.session import cut


def replace_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose key is not in the batch, and the whole batch. Null keys match each other."""
    batch_keys = new.select(*[F.col(k).alias(f"_n_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_n_{k}"))
    return old.join(batch_keys, same, "left_anti").unionByName(new, allowMissingColumns=True)


def newest_attributes(rows: DataFrame, key: str, seen: str, snapshot: str) -> DataFrame:
    """Dimension of the newest row per key."""
    return latest(rows, [key], [F.col(seen), F.col(snapshot)])


def last_load_of_version(facts: DataFrame, version: str, snapshot: str) -> DataFrame:
    """Of several loads of one source version only the last; a missing version is one version too."""
    last = facts.groupBy(F.col(version).alias("_v")).agg(F.max(snapshot).alias("_s"))
    return facts.join(last, F.col(version).eqNullSafe(F.col("_v")) & (F.col(snapshot) == F.col("_s")), "left_semi")


def last_load_of_key(facts: DataFrame, keys: Sequence[str], snapshot: str) -> DataFrame:
    """As if snapshots had been loaded in order, each replacing its natural keys; duplicates within a snapshot stay."""
    last = facts.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max(snapshot).alias("_s"))
    same = F.col(snapshot) == F.col("_s")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return facts.join(last, same, "left_semi")


#: folders that a keyed table's rows are dealt out to, by a hash of the key
BUCKETS = 64
_BUCKET = "_bucket_of_"


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None before its first load."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except AnalysisException:
        return None


def create_empty(like: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Lay down an empty table with the columns of ``like``, unless there is one."""
    like.limit(0).write.mode("ignore").partitionBy(*partition_by).parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a table that ``upsert_table`` keeps."""
    table = read_table(spark, path)
    return table if table is None else table.drop(*[c for c in table.columns if c.startswith(_BUCKET)])


def upsert_table(path: str, new: DataFrame, keys: Sequence[str], newest: Sequence[str] = (), buckets: int = BUCKETS) -> DataFrame:
    """Replace the batch's keys in the stored table. With ``newest``, of old and new rows of a key only the
    largest by these columns stays, so that a batch that comes late doesn't undo a later one.

    The table lies in ``buckets`` folders by a hash of the key; the number stays as it was at the first load. A batch reads and
    writes only the folders of its keys, whatever the size of the table. What it writes is made in the shared folder first, so the table is
    never read and overwritten at once; a batch that fails is run again and gives the same rows.
    """
    spark = new.sparkSession
    old = read_table(spark, path)
    column = next((c for c in old.columns if c.startswith(_BUCKET)), None) if old is not None else f"{_BUCKET}{buckets}"
    if column is None:
        raise ValueError(f"{path} is not a table in buckets")
    number = F.pmod(F.xxhash64(*keys), F.lit(int(column.removeprefix(_BUCKET)))).cast("int")
    new = cut(new.withColumn(column, number))
    if old is not None:
        touched = [r[0] for r in new.select(column).distinct().collect()]  # at most the number of folders
        old = old.where(F.col(column).isin(touched))
    if newest:
        every = new if old is None else old.unionByName(new, allowMissingColumns=True)
        merged = latest(every, list(keys), [F.col(c) for c in newest])
    else:
        merged = new if old is None else replace_by_key(old, new, keys)
    replace_partitions(cut(merged).repartition(column), path, [column])
    return read_keyed(spark, path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Overwrite just the partitions that occur in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def load_partitions(df: DataFrame, path: str, partition_by: Sequence[str], force: bool = False) -> int:
    """Load partitions that are not there yet; with ``force`` all of them. Returns how many were written.

    The list of partitions is metadata: one row per partition directory.
    """
    spark = df.sparkSession
    wanted = df.select(*partition_by).distinct()
    old = read_table(spark, path)
    if old is not None and not force:
        wanted = wanted.join(*_null_safe(wanted, old.select(*partition_by).distinct()), "left_anti")
    wanted = cut(wanted)
    count = wanted.count()
    if count:
        replace_partitions(df.join(*_null_safe(df, wanted), "left_semi"), path, partition_by)
    return count


def _null_safe(df: DataFrame, other: DataFrame) -> tuple[DataFrame, Column]:
    """``other`` and the condition that its columns equal those of ``df``; nulls are equal."""
    named = other.toDF(*[f"_p_{c}" for c in other.columns])
    same = F.lit(True)
    for c in other.columns:
        same = same & df[c].eqNullSafe(named[f"_p_{c}"])
    return named, same


def newest_rows(df: DataFrame, time: str, k: int = 10, tie_break: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(time), *tie_break).limit(k)
