"""Exact interpolated percentiles per key by histograms, whatever a key holds.

A rank is narrowed down in rounds. A round cuts the range that holds it into equal cells, counts the values of each cell and
notes its smallest and largest one. The rank lies in one of the cells, whose smallest and largest value are the range of the next
round; when they are equal, they are the answer. All columns and fractions share a round, counts are combined before they are
shuffled, and a window runs over the cells of one range. So a key with most of the rows is a row of counts for each task and cell.

Keys of at most ``FEW`` rows take no rounds: Spark's own percentile holds their values, of one key at a time, in a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sensorlith.session import cut, written

#: cells of a range, and how many of its values share one at least: few values need few cells, or nothing is combined
CELLS, SHARE = (32, 1 << 14), 64
#: rows of a key that a task may hold
FEW = 10_000
#: ranges that are sent to every task; more are joined by a shuffle
SENT_ROWS = 50_000
_MOST = 1.7976931348623157e308


def _cell(v: Column, low: Column, high: Column, n: Column) -> Column:
    """Number of the cell of a value within ``low`` to ``high``, which hold ``n``. The two ends are always in different cells. NaN is the largest."""
    cells = F.greatest(F.lit(CELLS[0]), F.least(F.lit(CELLS[1]), F.floor(n / SHARE)))
    low, high = F.greatest(low, F.lit(-_MOST)), F.least(high, F.lit(_MOST))
    width = high - low
    share = F.when(width <= _MOST, F.try_divide(v - low, width)).otherwise(F.try_divide(v / 2 - low / 2, high / 2 - low / 2))
    return (
        F.when(F.isnan(v), cells + 2).when(v > _MOST, cells + 1).when(v < -_MOST, -1)
        .otherwise(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * cells), cells)).cast("int")
    )


def _on(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equal columns, a null being equal to a null."""
    on = F.lit(True)
    for a, b in zip(left, right):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def percentiles(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """One row per key with ``{output name: (value column, fraction)}``; nulls do not count."""
    columns = sorted({c for c, _ in wanted.values()})
    ks = [f"_k{i}" for i in range(len(keys))]
    base = df.select(*[F.col(k).alias(n) for k, n in zip(keys, ks)], F.array(*[F.col(c).cast("double") for c in columns]).alias("_v"))
    if not keys:
        return _in_rounds(base, keys, ks, columns, wanted)
    sizes = base.groupBy(*ks).agg(F.count(F.lit(1)).alias("_n"))
    if (sizes.agg(F.max("_n")).first()[0] or 0) <= FEW:
        return _at_once(base, keys, ks, columns, wanted)
    large = cut(sizes.where(F.col("_n") > FEW).select(*[F.col(k).alias(f"_r{k}") for k in ks]))
    on = _on(ks, [f"_r{k}" for k in ks])
    few = _at_once(base.join(large, on, "left_anti"), keys, ks, columns, wanted)
    return few.unionByName(_in_rounds(base.join(large, on, "left_semi"), keys, ks, columns, wanted))


def _at_once(base: DataFrame, keys: Sequence[str], ks: Sequence[str], columns: Sequence[str], wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Percentiles of keys whose values fit a task."""
    found = base.groupBy(*ks).agg(*[F.percentile(F.col("_v")[columns.index(c)], float(p)).alias(name) for name, (c, p) in wanted.items()])
    return found.withColumnsRenamed(dict(zip(ks, keys)))


def _in_rounds(base: DataFrame, keys: Sequence[str], ks: Sequence[str], columns: Sequence[str], wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Percentiles of keys of any size."""
    totals = base.groupBy(*ks).agg(*[f(F.col("_v")[i]).alias(f"_{n}{i}") for i in range(len(columns)) for n, f in (("n", F.count), ("low", F.min), ("high", F.max))])
    totals = _Kept(totals.select(*ks, *[F.struct(F.col(f"_n{i}").alias("n"), F.col(f"_low{i}").alias("low"), F.col(f"_high{i}").alias("high")).alias(f"_m{i}") for i in range(len(columns))])).df
    asked = []
    for number, (column, p) in enumerate(wanted.values()):
        m = columns.index(column)
        at = (F.col(f"_m{m}.n") - 1) * F.lit(float(p))
        asked += [F.struct(F.lit(m).alias("_m"), F.lit(2 * number + side).alias("_rank_of"), F.col(f"_m{m}.low").alias("_low"), F.col(f"_m{m}.high").alias("_high"), F.col(f"_m{m}.n").alias("_size"), f(at).cast("long").alias("_rank")) for side, f in enumerate((F.floor, F.ceil))]
    step = _Kept(totals.select(*ks, F.explode(F.array(*asked)).alias("_a")).select(*ks, "_a._m", F.lit(0).cast("long").alias("_in"), *[f"_a.{n}" for n in ("_rank_of", "_low", "_high", "_size", "_rank")]).where("_low IS NOT NULL"))
    found = step.closed()
    rows, number = base, 0
    while (open_ := step.open()) is not None:
        ranges, at = open_.ranges(ks)
        rows = _within(base, ranges, ks) if number < 2 else _narrowed(rows, ranges)
        if number == 1:  # the values of a few cells: later rounds read these only
            rows = written(rows, "percentile-values")
        number += 1
        hist = _histogram(rows)
        upto = F.sum("_n").over(Window.partitionBy("_id").orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        hist = hist.withColumn("_upto", upto).join(at, "_id").where("_rank < _upto AND _rank >= _upto - _n")
        step = _Kept(hist.select(*ks, "_m", F.col("_id").alias("_in"), "_rank_of", F.col("_least").alias("_low"), F.col("_most").alias("_high"), F.col("_n").alias("_size"), (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank")))
        found = found.unionByName(step.closed())
    value = lambda r: F.max(F.when(F.col("_rank_of") == r, F.col("_low"))).alias(f"_x{r}")
    values = found.groupBy(*ks).agg(*[value(r) for r in range(2 * len(wanted))])
    out = []
    for number, (name, (column, p)) in enumerate(wanted.items()):
        at = (F.col(f"_m{columns.index(column)}.n") - 1) * F.lit(float(p))
        low, high = F.col(f"_x{2 * number}"), F.col(f"_x{2 * number + 1}")
        out.append(F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name))
    right = [f"_r{k}" for k in ks]
    values = values.withColumnsRenamed(dict(zip(ks, right)))
    return totals.join(values, _on(ks, right), "left").select(*[F.col(n).alias(k) for n, k in zip(ks, keys)], *out)


def _within(base: DataFrame, ranges: DataFrame, ks: Sequence[str]) -> DataFrame:
    """The values that lie in a range, with its number, ends and size."""
    other = [f"_r{k}" for k in ks]
    rows = base.join(ranges.withColumnsRenamed(dict(zip(ks, other))), _on(ks, other))
    return rows.select("_id", "_low", "_high", "_size", F.element_at("_v", F.col("_m") + 1).alias("_x")).where("_x >= _low AND _x <= _high")


def _narrowed(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """The values that lie in a part of the range they were found in."""
    rows = rows.select(F.col("_id").alias("_in"), "_x").join(ranges.select("_in", "_id", "_low", "_high", "_size"), "_in")
    return rows.where("_x >= _low AND _x <= _high").select("_id", "_low", "_high", "_size", "_x")


def _histogram(rows: DataFrame) -> DataFrame:
    """Count, smallest and largest value of each cell of each range."""
    rows = rows.select("_id", "_x", _cell(F.col("_x"), F.col("_low"), F.col("_high"), F.col("_size")).alias("_cell"))
    return rows.groupBy("_id", "_cell").agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))


class _Kept:
    """Rows that are computed once. Up to ``SENT_ROWS`` become a table of the plan, which is sent where it is joined; more are written."""

    def __init__(self, df: DataFrame | None, rows: pa.Table | None = None, schema: StructType | None = None, spark: SparkSession | None = None) -> None:
        self.spark, self.schema = spark or df.sparkSession, schema or df.schema
        if rows is None:
            rows = df.limit(SENT_ROWS + 1).toArrow()
            rows = rows if rows.num_rows <= SENT_ROWS else None
        self.rows = rows
        self.df = cut(df) if rows is None else self.spark.createDataFrame(rows, self.schema)

    def _part(self, rows: pa.Table, schema: StructType) -> _Kept:
        return _Kept(None, rows, schema, self.spark)

    def closed(self) -> DataFrame:
        """The ranges of one value."""
        return self.df.where("NOT (_low < _high)")

    def open(self) -> _Kept | None:
        if self.rows is None:
            rest = self.df.where("_low < _high")
            return None if rest.isEmpty() else _Kept(rest)
        low, high = self.rows["_low"], self.rows["_high"]
        wide = pc.or_(pc.less(low, high), pc.and_(pc.is_nan(high), pc.invert(pc.is_nan(low))))
        return self._part(self.rows.filter(wide), self.schema) if pc.any(wide).as_py() else None

    def ranges(self, ks: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        """The ranges, numbered (``_id``), and the ranks that are looked for in them."""
        names, rest = [*ks, "_m", "_in", "_low", "_high", "_size"], [*ks, "_m", "_rank_of", "_rank"]
        if self.rows is None:
            ranges = cut(self.df.select(*names).distinct().withColumn("_id", F.monotonically_increasing_id()))
            other = [f"_r{n}" for n in names]
            at = self.df.join(ranges.withColumnsRenamed(dict(zip(names, other))), _on(names, other))
            return ranges, at.select("_id", *rest)
        numbers: dict[str, int] = {}
        ids = [numbers.setdefault(repr(r), len(numbers)) for r in zip(*(self.rows[n].to_pylist() for n in names))]
        rows = self.rows.append_column("_id", pa.array(ids, pa.int64()))
        seen: set[int] = set()
        first = pa.array([not (i in seen or seen.add(i)) for i in ids])
        kind = lambda columns: StructType([self.schema[c] for c in columns]).add("_id", "long")
        return (
            self.spark.createDataFrame(rows.filter(first).select([*names, "_id"]), kind(names)),
            self.spark.createDataFrame(rows.select([*rest, "_id"]), kind(rest)),
        )


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that also matches null keys; with no keys both sides hold one row."""
    names = {k: f"_r_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    on = F.lit(True)
    for k, n in names.items():
        on = on & F.col(k).eqNullSafe(F.col(n))
    return left.join(right, on).drop(*names.values())
