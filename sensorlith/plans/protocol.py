"""Check detected segments against a protocol of expected intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlith.operators.intervals import overlaps

# Detected labels that fit an expected one; None is not checked.
EXPECTED = {
    "calibration_stationary": ("stationary",),
    "stationary": ("stationary",),
    "small_motion": ("small_motion",),
    "rotation": ("rotation",),
    "active_motion": ("active_motion",),
    "motion": ("active_motion", "rotation", "small_motion"),
    "shake": ("active_motion", "impact_or_shake", "rotation"),
    "active_shake": ("active_motion", "impact_or_shake", "rotation"),
    "rotation_or_motion": ("rotation", "active_motion"),
    "impact": ("impact_or_shake",),
    "impact_or_shake": ("impact_or_shake",),
    "marker": ("impact_or_shake",),
    "transition": None,
    "ignore": None,
}
BRIEF = ("impact", "impact_or_shake", "marker")
MIN_FRACTION = 0.50
MIN_BRIEF_SEC = 0.01


def usable_rows(protocol: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to check, rows that break a rule: end after start, known label)."""
    fine = F.coalesce((F.col("end_time_sec") > F.col("start_time_sec")) & F.col("expected_label").isin(*EXPECTED), F.lit(False))
    return protocol.filter(fine), protocol.filter(~fine)


def check(protocol: DataFrame, segments: DataFrame, label: str, min_fraction: float = MIN_FRACTION, min_brief: float = MIN_BRIEF_SEC) -> DataFrame:
    """One row per protocol row (run_id, row_id): matched share, dominant label, status, and all overlaps as JSON.

    Of equally long overlaps the label detected first is dominant.
    """
    detected = segments.select("run_id", "start_time_sec", "end_time_sec", F.col(label).alias("label"))
    expected = protocol.select("run_id", "row_id", "start_time_sec", "end_time_sec", "expected_label")
    pairs = overlaps(expected, detected, ["run_id"], "start_time_sec", "end_time_sec")
    per_label = pairs.groupBy("run_id", "row_id", F.col("r_label").alias("label")).agg(
        F.sum("overlap").alias("overlap"), F.min("r_start_time_sec").alias("seen")
    )
    allowed = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(v) for v in x]) for k, vs in EXPECTED.items() if vs for x in (k, vs)])
    per_label = per_label.join(expected.select("run_id", "row_id", F.try_element_at(allowed, "expected_label").alias("fits")), ["run_id", "row_id"])
    by_row = per_label.groupBy("run_id", "row_id").agg(
        F.sum(F.when(F.array_contains("fits", F.col("label")), F.col("overlap"))).alias("hit"),
        F.max_by(F.struct("label", "overlap"), F.struct("overlap", -F.col("seen"))).alias("top"),
        F.array_sort(F.collect_list(F.struct("seen", "label", "overlap"))).alias("found"),
    )
    rows = expected.join(by_row, ["run_id", "row_id"], "left")
    duration = F.col("end_time_sec") - F.col("start_time_sec")
    checked = F.try_element_at(allowed, F.col("expected_label")).isNotNull()
    hit = F.when(checked, F.coalesce("hit", F.lit(0.0))).otherwise(0.0)
    fraction = F.when(checked, F.when(duration > 0, hit / duration).otherwise(0.0))
    passed = F.when(F.col("expected_label").isin(*BRIEF), hit >= min_brief).otherwise(fraction >= min_fraction)
    pairs_map = F.map_from_arrays(F.transform("found", lambda x: x["label"]), F.transform("found", lambda x: x["overlap"]))
    return rows.select(
        "run_id",
        "row_id",
        "start_time_sec",
        "end_time_sec",
        duration.alias("duration_sec"),
        "expected_label",
        F.coalesce(F.array_join(F.array_sort(F.try_element_at(allowed, F.col("expected_label"))), ","), F.lit("ignored")).alias("allowed_detected_labels"),
        F.coalesce("top.label", F.lit("none")).alias("dominant_detected_label"),
        F.coalesce("top.overlap", F.lit(0.0)).alias("dominant_overlap_sec"),
        hit.alias("allowed_overlap_sec"),
        fraction.alias("match_fraction"),
        F.when(~checked, "ignored").when(passed, "pass").otherwise("fail").alias("status"),
        F.coalesce(F.to_json(pairs_map), F.lit("{}")).alias("overlap_detail_json"),
    )


def summary(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    status = F.col("status")
    counted = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("protocol_rows"),
        F.count_if(status != "ignored").alias("evaluated_rows"),
        F.count_if(status == "ignored").alias("ignored_rows"),
        F.count_if(status == "pass").alias("passed_rows"),
        F.count_if(status == "fail").alias("failed_rows"),
    )
    return counted.withColumn("pass_rate", F.try_divide(F.col("passed_rows"), F.col("evaluated_rows")))
