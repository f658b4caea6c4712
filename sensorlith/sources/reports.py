"""Report outputs."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlith.session import written


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_columns_csv(df: DataFrame, columns: Sequence[str], path: str) -> None:
    """CSV in a fixed column order; nulls are empty cells."""
    write_csv(df.select(*columns), path)


def nested_report(one_row: Mapping[str, DataFrame], many_rows: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """(section, place, value): the lines of one JSON document. One-row tables are objects, the others arrays of objects in the
    order of the given columns. No table is gathered: each row is a line of its own."""
    spark = next(iter([*one_row.values(), *[df for df, _ in many_rows.values()]])).sparkSession
    line = lambda section, place, text: spark.range(1).select(F.lit(section).alias("section"), F.lit(place).cast("long").alias("place"), F.lit(text).alias("value"))
    lines, comma, section = [line(0, 0, "{")], "", 0
    for section, (name, df) in enumerate(one_row.items(), 1):
        lines.append(df.select(F.lit(section).alias("section"), F.lit(0).cast("long").alias("place"), F.concat(F.lit(f"{comma}{json.dumps(name)}:"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).alias("value")))
        comma = ","
    for section, (name, (df, order)) in enumerate(many_rows.items(), section + 1):
        placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("place"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
        placed = written(placed, "report-section")
        first = placed.select(F.min("place")).scalar()
        lines += [
            line(section, -1, f"{comma}{json.dumps(name)}:["),
            placed.select(F.lit(section).alias("section"), "place", F.concat(F.when(F.col("place") == first, "").otherwise(","), "value").alias("value")),
            line(section, (1 << 63) - 1, "]"),
        ]
        comma = ","
    return reduce(DataFrame.unionByName, [*lines, line(section + 1, 0, "}")])


def write_nested_report(report: DataFrame, path: str) -> None:
    """Text parts that are the document when they are put one after the other by their names."""
    report.repartitionByRange("section", "place").sortWithinPartitions("section", "place").select("value").write.mode("overwrite").text(path)


def markdown_rows(table: DataFrame) -> DataFrame:
    """Text cells as one table line per row."""
    cells = F.array_join(F.array(*[F.col(c) for c in table.columns]), " | ")
    return table.select(F.concat(F.lit("| "), cells, F.lit(" |")).alias("value"))


def write_run_outputs(tables: Mapping[str, DataFrame], root: str, groups: int = 64) -> None:
    """One Parquet table per kind. Runs are dealt out to a fixed number of folders and sorted in them,
    so that many runs do not mean many folders and a single run is still found by file statistics."""
    group = F.pmod(F.xxhash64("run_id"), F.lit(groups)).cast("int")
    for name, df in tables.items():
        df.withColumn("run_group", group).repartitionByRange("run_group", "run_id").sortWithinPartitions("run_group", "run_id").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("run_group").parquet(f"{root}/{name}")
