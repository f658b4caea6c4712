"""Ordered operators (shift, running sum, fill, rolling) that also hold when one key has most rows.

A plain window function puts all rows of a key into one task. ``arrange`` therefore looks
at the largest key first. While every key is within ``max_rows`` the plain window is used.
Beyond that the rows are range-partitioned by (key, order), so that a long key is cut into
contiguous parts, and written once to the shared folder. Each operator then works inside
(key, part) and takes over what crosses a cut from a table with one row per (key, part).
Of that table only the rows of cut keys are kept, fewer than there are parts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from math import ceil

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sensorlith.session import cut

PART = "_part"
MAX_ROWS_CONF = "sensorlith.series.maxRowsPerTask"
MAX_ROWS_DEFAULT = 2_000_000


@dataclass(frozen=True)
class Series:
    """Rows, the key columns that name a series, and the columns that order it."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    parts: int = 0
    max_rows: int = MAX_ROWS_DEFAULT

    @property
    def cut_up(self) -> bool:
        return self.parts > 0

    @property
    def group_keys(self) -> tuple[str, ...]:
        return (*self.keys, PART) if self.cut_up else self.keys

    def window(self) -> WindowSpec:
        """One task's share of a series, in order."""
        return Window.partitionBy(*self.group_keys).orderBy(*self.order)

    def position(self) -> Column:
        """Order columns as one comparable value."""
        return F.struct(*[F.col(c) for c in self.order])

    def with_df(self, df: DataFrame) -> Series:
        return replace(self, df=df)

    def result(self) -> DataFrame:
        return self.df.drop(PART)


def row_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(MAX_ROWS_CONF, str(MAX_ROWS_DEFAULT)))


def largest_group(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(rows of the largest key, all rows); counts are combined before the shuffle."""
    row = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.max("n").alias("largest"), F.sum("n").alias("total"))
        .first()
    )
    return int(row["largest"] or 0), int(row["total"] or 0)


def arrange(df: DataFrame, keys: Sequence[str], order: Sequence[str], probe: DataFrame | None = None) -> Series:
    """``probe`` may give the keys from a cheaper source, when ``df`` takes work to compute."""
    limit = row_limit(df)
    largest, total = largest_group(df if probe is None else probe, keys)
    series = Series(df, tuple(keys), tuple(order), 0, limit)
    if largest <= limit:
        return series
    parts = max(2, ceil(2 * total / limit))
    ranged = df.repartitionByRange(parts, *keys, *order).withColumn(PART, F.spark_partition_id())
    return replace(series, df=cut(ranged), parts=parts)


def _same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(right[k])
    return on


def _take_over(s: Series, carry: DataFrame, out: Mapping[str, Column]) -> DataFrame:
    """Add ``out`` columns, which may read ``_c``, the value carried into each (key, part)."""
    names = [f"_k{i}" for i in range(len(s.group_keys))]
    small = carry.select(*[F.col(k).alias(n) for k, n in zip(s.group_keys, names)], "_c")
    on = F.lit(True)
    for k, n in zip(s.group_keys, names):
        on = on & F.col(k).eqNullSafe(F.col(n))
    return s.df.join(small, on, "left").withColumns(dict(out)).drop("_c", *names)


def shift(s: Series, columns: Mapping[str, Column], by: int = 1) -> Series:
    """Previous (by=1) or next (by=−1) row's value for each ``{new name: expression}``."""
    if by not in (1, -1):
        raise ValueError("shift goes one row back or ahead")
    move = F.lag if by == 1 else F.lead
    w = s.window()
    if not s.cut_up:
        return s.with_df(s.df.withColumns({n: move(c).over(w) for n, c in columns.items()}))
    pick = F.max_by if by == 1 else F.min_by
    edge = s.df.groupBy(*s.group_keys).agg(
        pick(F.struct(*[c.alias(n) for n, c in columns.items()]), s.position()).alias("_c")
    )
    carry = edge.withColumn("_c", move("_c").over(Window.partitionBy(*s.keys).orderBy(PART))).filter("_c is not null")
    at_edge = F.row_number().over(Window.partitionBy(*s.group_keys).orderBy(*[
        (F.col(c).asc() if by == 1 else F.col(c).desc()) for c in s.order
    ])) == 1
    marked = s.with_df(
        s.df.withColumns({**{n: move(c).over(w) for n, c in columns.items()}, "_edge": at_edge})
    )
    joined = _take_over(marked, carry, {n: F.when(F.col("_edge"), F.col(f"_c.{n}")).otherwise(F.col(n)) for n in columns})
    return s.with_df(joined.drop("_edge"))


def running_sum(s: Series, columns: Mapping[str, Column]) -> Series:
    """Sum of all rows up to and including this one."""
    w = s.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = s.df.withColumns({n: F.sum(c).over(w) for n, c in columns.items()})
    if not s.cut_up:
        return s.with_df(inside)
    totals = s.df.groupBy(*s.group_keys).agg(*[F.sum(c).alias(n) for n, c in columns.items()])
    before = Window.partitionBy(*s.keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        totals.withColumn("_first", F.row_number().over(Window.partitionBy(*s.keys).orderBy(PART)) == 1)
        .withColumn("_c", F.struct(*[F.sum(n).over(before).alias(n) for n in columns]))
        .filter(~F.col("_first"))
    )
    out = {n: F.col(n) + F.coalesce(F.col(f"_c.{n}"), F.lit(0)) for n in columns}
    return s.with_df(_take_over(s.with_df(inside), carry, out))


def number(s: Series, name: str) -> Series:
    """Position in the series, from 1."""
    return running_sum(s, {name: F.lit(1).cast("long")})


def fill(s: Series, columns: Mapping[str, Column], ahead: bool = False, inclusive: bool = True) -> Series:
    """Newest non-null value up to this row, or with ``ahead`` the next one from this row on."""
    end = 0 if inclusive else (1 if ahead else -1)
    if ahead:
        w = s.window().rowsBetween(end, Window.unboundedFollowing)
        take, far = F.first, F.min_by
    else:
        w = s.window().rowsBetween(Window.unboundedPreceding, end)
        take, far = F.last, F.max_by
    inside = s.df.withColumns({n: take(c, ignorenulls=True).over(w) for n, c in columns.items()})
    if not s.cut_up:
        return s.with_df(inside)
    edge = s.df.groupBy(*s.group_keys).agg(
        *[far(c, F.when(c.isNotNull(), s.position())).alias(n) for n, c in columns.items()]
    )
    by_part = Window.partitionBy(*s.keys).orderBy(PART)
    beyond = by_part.rowsBetween(1, Window.unboundedFollowing) if ahead else by_part.rowsBetween(Window.unboundedPreceding, -1)
    carry = edge.withColumn(
        "_c", F.struct(*[take(n, ignorenulls=True).over(beyond).alias(n) for n in columns])
    ).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*s.keys))).filter("_n > 1")
    return s.with_df(_take_over(s.with_df(inside), carry, {n: F.coalesce(F.col(n), F.col(f"_c.{n}")) for n in columns}))


def rolling(s: Series, before: int, after: int, aggregates: Mapping[str, Callable[[WindowSpec], Column]]) -> Series:
    """Aggregates over rows −before … +after.

    Cut series are dealt out in blocks of consecutive rows; each block also gets the
    neighbouring rows its frames reach into.
    """
    if not s.cut_up:
        w = s.window().rowsBetween(-before, after)
        return s.with_df(s.df.withColumns({n: f(w) for n, f in aggregates.items()}))
    block = max(s.max_rows // 2, 4 * (before + after), 1)
    numbered = number(s, "_rn").df
    home = F.floor((F.col("_rn") - 1) / block)
    reach = F.array_distinct(
        F.array(home, F.floor((F.col("_rn") - 1 - after) / block), F.floor((F.col("_rn") - 1 + before) / block))
    )
    dealt = numbered.withColumn("_home", home).withColumn("_block", F.explode(reach))
    w = Window.partitionBy(*s.keys, "_block").orderBy("_rn").rowsBetween(-before, after)
    out = dealt.withColumns({n: f(w) for n, f in aggregates.items()}).filter(F.col("_block") == F.col("_home"))
    return s.with_df(out.drop("_rn", "_home", "_block"))


def islands(s: Series, label: Column, name: str, changed: str = "_changed") -> Series:
    """Number the runs of equal consecutive labels, from 1."""
    s = s.with_df(s.df.withColumn("_label", label))
    s = shift(s, {"_before": F.struct(F.col("_label").alias("l"))})
    change = F.when(F.col("_before").isNull() | ~F.col("_label").eqNullSafe(F.col("_before.l")), 1).otherwise(0)
    s = s.with_df(s.df.withColumn(changed, change))
    s = running_sum(s, {name: F.col(changed)})
    return s.with_df(s.df.drop("_label", "_before", changed))


def first_of(s: Series, columns: Mapping[str, Column]) -> Series:
    """The series' first value on every row, by a pre-aggregated join instead of one window per key."""
    if not s.cut_up:
        return s.with_df(s.df.withColumns({n: F.first(c).over(s.window()) for n, c in columns.items()}))
    firsts = s.df.groupBy(*s.keys).agg(
        F.min_by(F.struct(*[c.alias(n) for n, c in columns.items()]), s.position()).alias("_c")
    )
    names = [f"_k{i}" for i in range(len(s.keys))]
    right = firsts.select(*[F.col(k).alias(n) for k, n in zip(s.keys, names)], "_c")
    on = F.lit(True)
    for k, n in zip(s.keys, names):
        on = on & F.col(k).eqNullSafe(F.col(n))
    joined = s.df.join(right, on, "left").withColumns({n: F.col(f"_c.{n}") for n in columns})
    return s.with_df(joined.drop("_c", *names))


def latest(df: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    """The row of each key that is largest by ``newest_first`` (nulls lose); combined before the shuffle."""
    names = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(n) for n in names]), F.struct(*newest_first)).alias("_row")
    )
    return best.select(*keys, "_row.*").select(*df.columns)
