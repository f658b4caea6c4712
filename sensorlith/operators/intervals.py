"""Overlap join of two interval tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _level(start: str, end: str, base: float):
    """Smallest power-of-two multiple of ``base`` that is at least the interval's length."""
    length = F.greatest(F.col(end) - F.col(start), F.lit(base))
    return F.ceil(F.log2(length / base) - 1e-12).cast("int")


def overlaps(
    left: DataFrame, right: DataFrame, keys: Sequence[str], start: str, end: str, base: float = 1.0
) -> DataFrame:
    """Pairs with a common stretch, and its length as ``overlap``; right columns get the prefix ``r_``.

    Every interval lies in at most two buckets of its own size class. A pair meets in the
    buckets of the longer one's class, by an equi-join on (keys, class, bucket): a run's
    intervals are never all paired with each other, and a long one is not copied many times.
    """
    right = right.withColumnsRenamed({c: f"r_{c}" for c in right.columns})
    a = left.withColumn("_lv", _level(start, end, base))
    b = right.withColumn("_rlv", _level(f"r_{start}", f"r_{end}", base))
    levels = sorted(
        {r[0] for r in a.select("_lv").distinct().collect()} | {r[0] for r in b.select("_rlv").distinct().collect()}
    )

    def laid(df: DataFrame, s: str, e: str, own: str, name: str, classes) -> DataFrame:
        """One row per bucket of each class that ``classes(own, class)`` admits."""
        entries = []
        for lv in levels:
            width = base * 2.0**lv
            at = F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))
            spots = F.arrays_zip(F.array_repeat(F.lit(lv), F.size(at)).alias("lv"), at.alias("at"))
            entries.append(F.when(classes(F.col(own), lv), spots))
        return df.withColumn(name, F.explode(F.flatten(F.array_compact(F.array(*entries)))))

    exact, at_least, above = (lambda own, lv: own == lv), (lambda own, lv: own <= lv), (lambda own, lv: own < lv)
    same_bucket = (F.col("_at.lv") == F.col("_bt.lv")) & (F.col("_at.at") == F.col("_bt.at"))
    for k in keys:
        same_bucket = same_bucket & (F.col(k) == F.col(f"r_{k}"))
    left_args, right_args = (start, end, "_lv", "_at"), (f"r_{start}", f"r_{end}", "_rlv", "_bt")
    left_longer = laid(a, *left_args, exact).join(laid(b, *right_args, at_least), same_bucket)
    right_longer = laid(a, *left_args, above).join(laid(b, *right_args, exact), same_bucket)
    later_start = F.greatest(F.col(start), F.col(f"r_{start}"))
    width = F.pow(F.lit(2.0), F.col("_at.lv")) * base
    return (
        left_longer.unionByName(right_longer)
        .filter(F.floor(later_start / width) == F.col("_at.at"))
        .withColumn("overlap", F.least(F.col(end), F.col(f"r_{end}")) - later_start)
        .filter(F.col("overlap") > 0)
        .drop("_lv", "_rlv", "_at", "_bt", *[f"r_{k}" for k in keys])
    )
