"""Robot run logs: contract, replay order, run metrics and scenario comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlith.functions.numbers import half_even, number_text
from sensorlith.operators.series import Series, arrange, fill, number, running_sum, shift
from sensorlith.schemas import RESULT_COLUMNS

# Required fields, known event types, detector settings.
FIELDS = (
    "event_id",
    "run_id",
    "mission_id",
    "robot_id",
    "software_version",
    "event_type",
    "sequence",
    "event_time_s",
    "recorded_at",
    "schema_version",
    "payload",
)
EVENT_TYPES = ("robot.telemetry", "software.health", "mission.event", "fault.injection")
FAULT = "left_wheel_slip"
ALERT_M = 0.20
ALERT_SAMPLES = 2


def contract_errors() -> Column:
    """Messages on what is wrong with an event whose fields are all text; an empty array is a valid event."""
    missing = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f"'{f}'")) for f in FIELDS])))
    whole = F.coalesce(F.col("sequence").rlike(r"^-?\d+$"), F.lit(False))
    numeric = F.col("event_time_s").try_cast("double").isNotNull()
    is_object = F.json_object_keys("payload").isNotNull()
    known = F.coalesce(F.col("event_type").isin(*EVENT_TYPES), F.lit(False))
    return F.array_compact(
        F.array(
            F.when(F.size(missing) > 0, F.concat(F.lit("missing fields: ["), F.array_join(missing, ", "), F.lit("]"))),
            F.when(~whole, F.lit("sequence must be an integer")),
            F.when(~numeric, F.lit("event_time_s must be numeric")),
            F.when(~is_object, F.lit("payload must be an object")),
            F.when(~known, F.lit("event_type is unknown")),
        )
    )


def split_valid(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, rejected events with their messages)."""
    checked = raw.withColumn("errors", contract_errors())
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def duplicate_sequences(events: DataFrame) -> DataFrame:
    """(run, sequence) used more than once: such a run must not be replayed."""
    return events.groupBy("run_id", "sequence").agg(F.count(F.lit(1)).alias("uses")).filter("uses > 1")


def replay(events: DataFrame) -> Series:
    """Events of each run in replay order; a duplicate sequence is an error."""
    if not duplicate_sequences(events).isEmpty():
        raise ValueError("a run uses a sequence number twice")
    return arrange(events, ["run_id"], ["event_time_s", "sequence"])


def selected(events: DataFrame, kinds: tuple[str, ...] = ("mission.event", "fault.injection")) -> DataFrame:
    return events.filter(F.col("event_type").isin(*kinds))


def alerts(telemetry: DataFrame, threshold_m: float = ALERT_M, consecutive: int = ALERT_SAMPLES) -> DataFrame:
    """One row per alert: the k-th sample in a row at or above the threshold; samples without a value are skipped."""
    seen = telemetry.select("run_id", "event_time_s", "sequence", F.col("payload.localization.gps_innovation_m").alias("v")).filter("v is not null")
    s = number(arrange(seen, ["run_id"], ["event_time_s", "sequence"]), "_n")
    s = fill(s, {"_reset": F.when(F.col("v") < threshold_m, F.col("_n"))})
    streak = F.col("_n") - F.coalesce("_reset", F.lit(0))
    return s.result().filter((F.col("v") >= threshold_m) & (streak == consecutive)).select("run_id", "event_time_s", "sequence")


def fault_times(events: DataFrame, fault: str = FAULT) -> DataFrame:
    """First start and first end of the named fault per run."""
    mine = (F.col("event_type") == "fault.injection") & (F.col("payload.name") == fault)
    active = F.coalesce("payload.active", F.lit(False))
    return events.filter(mine).groupBy("run_id").agg(
        F.min(F.when(active, F.col("event_time_s"))).alias("fault_start_s"), F.min(F.when(~active, F.col("event_time_s"))).alias("fault_end_s")
    )


def sequence_gaps(events: DataFrame) -> DataFrame:
    s = shift(arrange(events.select("run_id", "sequence"), ["run_id"], ["sequence"]), {"_before": F.col("sequence")})
    gap = F.greatest(F.col("sequence") - F.col("_before") - 1, F.lit(0))
    return s.df.groupBy("run_id").agg(F.coalesce(F.sum(gap), F.lit(0)).alias("log_sequence_gaps"))


def path_metrics(telemetry: DataFrame) -> DataFrame:
    """Length of the true path from the origin, its end, and the sideways error."""
    points = telemetry.select("run_id", "event_time_s", "sequence", F.col("payload.truth.x_m").alias("x"), F.col("payload.truth.y_m").alias("y"))
    s = shift(arrange(points, ["run_id"], ["event_time_s", "sequence"]), {"_x": F.col("x"), "_y": F.col("y")})
    step = F.hypot(F.col("x") - F.coalesce("_x", F.lit(0.0)), F.col("y") - F.coalesce("_y", F.lit(0.0)))
    return s.df.groupBy("run_id").agg(
        F.sum(step).alias("path_length_m"),
        F.max_by(F.hypot("x", "y"), F.struct("event_time_s", "sequence")).alias("_displacement"),
        F.sqrt(F.avg(F.col("y") * F.col("y"))).alias("cross_track_rmse_m"),
        F.max(F.abs("y")).alias("cross_track_max_error_m"),
    )


def run_metrics(events: DataFrame, threshold_m: float = ALERT_M, consecutive: int = ALERT_SAMPLES) -> DataFrame:
    """One row per run with mission result, localisation, detector, log and path measures."""
    telemetry = events.filter(F.col("event_type") == "robot.telemetry")
    order = F.struct("event_time_s", "sequence")
    mission = F.col("event_type") == "mission.event"
    error = F.when(F.col("event_type") == "robot.telemetry", F.col("payload.localization.pose_error_m"))
    base = events.groupBy("run_id").agg(
        F.min_by("software_version", order).alias("software_version"),
        F.max_by(F.struct("payload.name", "payload.waypoints_reached"), F.when(mission, order)).alias("_end"),
        F.max("event_time_s").alias("duration_s"),
        F.count_if(F.col("event_type") == "robot.telemetry").alias("telemetry_samples"),
        F.sqrt(F.avg(error * error)).alias("localization_rmse_m"),
        F.max(error).alias("localization_max_error_m"),
    )
    faults = fault_times(events)
    found = alerts(telemetry, threshold_m, consecutive).join(faults, "run_id", "left")
    early = F.col("fault_start_s").isNull() | (F.col("event_time_s") < F.col("fault_start_s"))
    detector = found.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("detector_alerts"),
        F.count_if(early).alias("detector_false_positives"),
        half_even(F.min(F.when(~early, F.col("event_time_s") - F.col("fault_start_s"))), 6).alias("detection_latency_s"),
    )
    joined = (
        base.join(detector, "run_id", "left").join(sequence_gaps(events), "run_id").join(path_metrics(telemetry), "run_id", "left")
    )
    success = F.coalesce(F.col("_end.name") == "mission_completed", F.lit(False))
    return joined.select(
        "run_id",
        "software_version",
        success.alias("mission_success"),
        F.col("_end.waypoints_reached").alias("waypoints_reached"),
        "duration_s",
        F.when(success, F.col("duration_s")).alias("completion_time_s"),
        "telemetry_samples",
        "localization_rmse_m",
        "localization_max_error_m",
        F.coalesce("detector_alerts", F.lit(0)).alias("detector_alerts"),
        F.coalesce("detector_false_positives", F.lit(0)).alias("detector_false_positives"),
        "detection_latency_s",
        "log_sequence_gaps",
        "path_length_m",
        F.when(success & (F.col("path_length_m") > 0), F.col("_displacement") / F.col("path_length_m")).alias("path_efficiency"),
        "cross_track_rmse_m",
        "cross_track_max_error_m",
    )


def result_rows(metrics: DataFrame, runs: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Metrics with the run's scenario parameters, in the fixed column order."""
    return metrics.join(runs, "run_id").join(scenarios, "scenario_name").select(*RESULT_COLUMNS)


def scenario_summary(results: DataFrame) -> DataFrame:
    """Means per scenario and version; times and efficiency only over runs that have them."""
    return results.groupBy("scenario_name", "software_version").agg(
        F.count(F.lit(1)).alias("run_count"),
        F.count_if("mission_success").alias("successful_runs"),
        F.avg(F.col("mission_success").cast("double")).alias("success_rate"),
        F.avg("waypoints_reached").alias("mean_waypoints_reached"),
        F.avg("completion_time_s").alias("mean_completion_time_s"),
        F.avg("localization_rmse_m").alias("mean_localization_rmse_m"),
        F.avg("cross_track_rmse_m").alias("mean_cross_track_rmse_m"),
        F.avg("path_efficiency").alias("mean_path_efficiency"),
    )


def comparison_text(summary: DataFrame) -> DataFrame:
    """The summary as the text cells of the comparison table; a dash where there is no value."""
    success = F.format_string("%d/%d (%.0f%%)", F.col("successful_runs"), F.col("run_count"), 100.0 * F.col("success_rate"))
    return summary.select(
        F.col("scenario_name").alias("scenario"),
        F.col("software_version").alias("version"),
        F.col("run_count").cast("string").alias("runs"),
        success.alias("success"),
        number_text(F.col("mean_waypoints_reached"), 1).alias("mean_waypoints"),
        number_text(F.col("mean_completion_time_s"), 2).alias("mean_completion_time_s"),
        number_text(F.col("mean_localization_rmse_m"), 3).alias("localization_rmse_m"),
        number_text(F.col("mean_cross_track_rmse_m"), 3).alias("cross_track_rmse_m"),
        number_text(F.col("mean_path_efficiency"), 3).alias("path_efficiency"),
    )


def versions_side_by_side(summary: DataFrame, measure: str, versions: tuple[str, ...] = ("v1", "v2")) -> DataFrame:
    """One row per scenario, one column per version, and whether a version is missing."""
    table = summary.groupBy("scenario_name").pivot("software_version", list(versions)).agg(F.first(measure))
    present = summary.groupBy("scenario_name").agg(F.count_distinct("software_version").alias("_n"))
    return table.join(present, "scenario_name").withColumn("is_complete", F.col("_n") == len(versions)).drop("_n")


def waypoints(events: DataFrame) -> DataFrame:
    """Distinct targets of each run in the order they were first seen."""
    target = events.filter(F.col("event_type") == "robot.telemetry").select(
        "run_id", "event_time_s", "sequence", F.col("payload.mission.target_x_m").alias("x"), F.col("payload.mission.target_y_m").alias("y")
    )
    first = target.groupBy("run_id", "x", "y").agg(F.min(F.struct("event_time_s", "sequence")).alias("_seen"))
    first = first.select("run_id", "x", "y", F.col("_seen.event_time_s").alias("first_seen_s"), F.col("_seen.sequence").alias("_q"))
    return number(arrange(first, ["run_id"], ["first_seen_s", "_q"]), "position").result().drop("_q")


def thinned_frames(events: DataFrame, every: int = 2) -> DataFrame:
    """Every second telemetry row of a run, and its last one."""
    frames = events.filter(F.col("event_type") == "robot.telemetry").select("run_id", "event_time_s", "sequence")
    s = running_sum(arrange(frames, ["run_id"], ["event_time_s", "sequence"]), {"_n": F.lit(1).cast("long")})
    last = s.df.groupBy("run_id").agg(F.max("_n").alias("_last"))
    kept = s.result().join(last, "run_id").filter(((F.col("_n") - 1) % every == 0) | (F.col("_n") == F.col("_last")))
    return kept.select("run_id", "event_time_s", "sequence")
