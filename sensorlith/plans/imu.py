"""Phone-sensor runs: long store, alignment, calibration, orientation, motion labels and segments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorlith.functions import rotation
from sensorlith.functions.numbers import magnitude, rmse
from sensorlith.functions.units import STANDARD_GRAVITY
from sensorlith.operators.quantiles import join_on_keys, percentiles
from sensorlith.operators.series import (
    Series,
    arrange,
    fill,
    first_of,
    islands,
    number,
    rolling,
    running_sum,
    shift,
)
from sensorlith.operators.segments import without_tiny
from sensorlith.plans.filters import with_dt
from sensorlith.session import cut

AXES = ("x", "y", "z")
GYRO = tuple(f"gyro_{a}" for a in AXES)
ACC = tuple(f"acc_{a}" for a in AXES)
GRAVITY = tuple(f"gravity_{a}" for a in AXES)

# Limits of the smoothed linear acceleration (m/s²) and rotation (rad/s).
STILL_ACC, MOVING_ACC, HIGH_ACC, IMPACT_ACC = 0.35, 1.0, 4.0, 8.0
STILL_GYRO = 0.05
SMOOTH_BEFORE, SMOOTH_AFTER = 5, 4
TINY_SEGMENT_SEC = 0.15
MERGE_PASSES = 5
PROTECTED = ("impact_or_shake",)

# Label groups.
GROUPS = {
    "stationary": "stationary",
    "small_motion": "small_motion",
    "rotation": "rotation",
    "motion": "active_motion",
    "high_accel": "active_motion",
    "impact_or_shake": "impact_or_shake",
    "unknown": "unknown",
}


def wide(long: DataFrame, names: Sequence[str], keys: Sequence[str] = ("run_id", "timestamp_sec")) -> DataFrame:
    """One column per sensor name; several values at one time are averaged."""
    return long.groupBy(*keys).pivot("sensor_name", list(names)).agg(F.avg("value"))


def long(wide_df: DataFrame, names: Sequence[str], keys: Sequence[str] = ("run_id", "timestamp_sec")) -> DataFrame:
    return wide_df.unpivot(list(keys), list(names), "sensor_name", "value").dropna(subset=["value"])


def sensor_statistics(long_df: DataFrame) -> DataFrame:
    return long_df.groupBy("run_id", "sensor_name").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    )


def find_column(columns: Sequence[str], text: str) -> str:
    """The first column whose name holds the text, in any case."""
    for c in columns:
        if text.lower() in c.lower():
            return c
    raise ValueError(f"no column holds {text!r}: {list(columns)}")


def canonical_axes(df: DataFrame, stems: Mapping[str, str]) -> DataFrame:
    """{"Gyroscope": "gyro"} renames "Gyroscope x (rad/s)" to gyro_x and so on."""
    return df.withColumnsRenamed(
        {find_column(df.columns, f"{stem} {a}"): f"{short}_{a}" for stem, short in stems.items() for a in AXES}
    )


def from_zero(frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Shift all sensors of a run by the earliest time any of them has."""
    starts = reduce(lambda a, b: a.unionByName(b), [f.select("run_id", "time_sec") for f in frames.values()])
    zero = starts.groupBy("run_id").agg(F.min("time_sec").alias("_zero"))
    return {
        n: f.join(zero, "run_id").withColumn("time_sec", F.col("time_sec") - F.col("_zero")).drop("_zero") for n, f in frames.items()
    }


def until_common_end(frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Drop what lies after the first sensor to stop."""
    ends = [f.groupBy("run_id").agg(F.max("time_sec").alias("_end")) for f in frames.values()]
    end = reduce(lambda a, b: a.unionByName(b), ends).groupBy("run_id").agg(F.min("_end").alias("_end"), F.count(F.lit(1)).alias("_n"))
    end = end.filter(F.col("_n") == len(frames)).drop("_n")
    return {n: f.join(end, "run_id").filter(F.col("time_sec") <= F.col("_end")).drop("_end") for n, f in frames.items()}


def align(master: DataFrame, others: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Interpolate the other sensors linearly at the master's times; beyond their ends their last value holds.

    All clocks go into one ordered series; the neighbours of each master row are filled in
    from before and after, so no row is paired with more than two of each sensor.
    """
    own = [c for c in master.columns if c not in ("run_id", "time_sec")]
    rows = master.select("run_id", "time_sec", F.lit(1).alias("_master"), F.struct(*own).alias("_own"), *[
        F.lit(None).cast(_sample_type(df, cols)).alias(f"_{n}") for n, (df, cols) in others.items()
    ])
    parts = [rows]
    own_type = rows.schema["_own"].dataType
    for n, (df, cols) in others.items():
        parts.append(
            df.select(
                "run_id",
                "time_sec",
                F.lit(0).alias("_master"),
                F.lit(None).cast(own_type).alias("_own"),
                *[
                    (F.struct(F.col("time_sec").alias("t"), *cols) if m == n else F.lit(None).cast(_sample_type(d, cs))).alias(f"_{m}")
                    for m, (d, cs) in others.items()
                ],
            )
        )
    s = arrange(reduce(lambda a, b: a.unionByName(b), parts), ["run_id"], ["time_sec", "_master"])
    s = fill(s, {f"_b{n}": F.col(f"_{n}") for n in others})
    s = fill(s, {f"_a{n}": F.col(f"_{n}") for n in others}, ahead=True)

    def at(n: str, column: str) -> Column:
        b, a = F.col(f"_b{n}"), F.col(f"_a{n}")
        span = a["t"] - b["t"]
        between = b[column] + (a[column] - b[column]) / F.nullif(span, F.lit(0.0)) * (F.col("time_sec") - b["t"])
        return F.coalesce(between, b[column], a[column])

    aligned = s.result().filter(F.col("_master") == 1)
    return aligned.select("run_id", "time_sec", "_own.*", *[at(n, c).alias(c) for n, (_, cols) in others.items() for c in cols])


def _sample_type(df: DataFrame, columns: Sequence[str]):
    return df.select(F.struct(F.col("time_sec").alias("t"), *columns).alias("s")).schema["s"].dataType


def magnitudes(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{n}_mag": magnitude(*[F.col(f"{n}_{a}") for a in AXES]) for n in ("acc", "gravity", "gyro")})


def tilted(df: DataFrame) -> DataFrame:
    roll, pitch = rotation.tilt(*[F.col(c) for c in GRAVITY])
    return df.withColumns({"roll_rad": roll, "pitch_rad": pitch, "roll_deg": F.degrees(roll), "pitch_deg": F.degrees(pitch)})


def window_bias(df: DataFrame, seconds: float, min_samples: int = 5) -> DataFrame:
    """Mean gyro rate of each run's first seconds; runs with fewer samples there get none."""
    return (
        df.filter(F.col("time_sec") <= seconds)
        .groupBy("run_id")
        .agg(*[F.avg(c).alias(f"gyro_bias_{c[-1]}") for c in GYRO], F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") >= min_samples)
        .drop("_n")
    )


def stationary_bias(df: DataFrame) -> DataFrame:
    """Median gyro rate over the stationary rows of each run, with counts and deviation; runs without such rows have no row."""
    still = df.filter("is_stationary")
    med = percentiles(still, ["run_id"], {f"gyro_bias_{c[-1]}": (c, 0.5) for c in GYRO})
    counts = df.groupBy("run_id").agg(
        F.count_if("is_stationary").alias("stationary_sample_count"),
        F.count(F.lit(1)).alias("total_sample_count"),
        *[F.stddev_samp(F.when(F.col("is_stationary"), F.col(c))).alias(f"stationary_std_{c[-1]}") for c in GYRO],
    )
    out = join_on_keys(counts, med, ["run_id"])
    return out.withColumn("stationary_fraction", F.col("stationary_sample_count") / F.col("total_sample_count"))


def calibrated(df: DataFrame, bias: DataFrame) -> DataFrame:
    """Rates without bias; runs without a bias fall out."""
    joined = df.join(bias.select("run_id", *[f"gyro_bias_{a}" for a in AXES]), "run_id")
    return joined.withColumns({f"gyro_{a}_calibrated": F.col(f"gyro_{a}") - F.col(f"gyro_bias_{a}") for a in AXES})


def integrated(s: Series, pairs: Mapping[str, tuple[str, str]]) -> Series:
    """{out: (rate, angle)}: the first angle plus the running sum of rate · dt (needs dt)."""
    s = first_of(s, {f"_s_{o}": F.col(angle) for o, (_, angle) in pairs.items()})
    s = running_sum(s, {f"_i_{o}": F.col(rate) * F.col("dt") for o, (rate, _) in pairs.items()})
    return s.with_df(
        s.df.withColumns({o: F.col(f"_s_{o}") + F.col(f"_i_{o}") for o in pairs}).drop(*[f"_{x}_{o}" for o in pairs for x in "si"])
    )


def unwrapped(s: Series, columns: Mapping[str, str]) -> Series:
    """Angles without jumps of a full turn: the running sum of steps taken back into (−π, π]."""
    s = shift(s, {f"_p_{o}": F.col(c) for o, c in columns.items()})
    s = first_of(s, {f"_f_{o}": F.col(c) for o, c in columns.items()})
    full = 2 * F.pi()

    def correction(o: str, c: str) -> Column:
        d = F.col(c) - F.col(f"_p_{o}")
        back = F.pmod(d + F.pi(), full) - F.pi()
        back = F.when((back == -F.pi()) & (d > 0), F.pi()).otherwise(back)
        return F.when(F.abs(d) < F.pi(), 0.0).otherwise(F.coalesce(back - d, F.lit(0.0)))

    s = running_sum(s, {f"_c_{o}": correction(o, c) for o, c in columns.items()})
    return s.with_df(
        s.df.withColumns({o: F.col(c) + F.col(f"_c_{o}") for o, c in columns.items()}).drop(
            *[f"_{x}_{o}" for o in columns for x in "pfc"]
        )
    )


def stationary(s: Series, acc_limit: float = 0.5, gyro_limit: float = 0.1) -> Series:
    """Flag rows whose last second was still.

    The window has as many rows as fit into a second at the run's mean step, so its length
    differs by run: trailing sums come from the running sums of that many rows before,
    fetched by an equi-join on (run, row number).
    """
    s = number(s, "_rn")
    stats = s.df.groupBy("run_id").agg(
        F.floor(F.try_divide(F.lit(1.0), (F.max("time_sec") - F.min("time_sec")) / (F.count(F.lit(1)) - 1))).cast("long").alias("_w"),
        F.avg("gyro_mag").alias("_mg"),
        F.avg("acc_mag").alias("_ma"),
    )
    s = s.with_df(s.df.join(stats, "run_id"))
    centred = {"g": F.col("gyro_mag") - F.col("_mg"), "a": F.col("acc_mag") - F.col("_ma")}
    s = running_sum(s, {**{f"_s{n}": c for n, c in centred.items()}, **{f"_q{n}": c * c for n, c in centred.items()}})
    sums = [f"_{x}{n}" for n in centred for x in "sq"]
    back = s.df.select(F.col("run_id").alias("_run"), F.col("_rn").alias("_at"), *[F.col(c).alias(f"_p{c}") for c in sums])
    joined = s.df.join(back, (F.col("run_id") == F.col("_run")) & (F.col("_rn") - F.col("_w") == F.col("_at")), "left")
    w = F.col("_w")
    full = (w >= 1) & (F.col("_rn") >= w)

    def trailing(c: str) -> Column:
        return F.col(c) - F.coalesce(F.col(f"_p{c}"), F.lit(0.0))

    def mean(n: str, centre: str) -> Column:
        return F.when(full, trailing(f"_s{n}") / w + F.col(centre))

    def std(n: str) -> Column:
        spread = trailing(f"_q{n}") - trailing(f"_s{n}") * trailing(f"_s{n}") / w
        return F.when(full & (w > 1), F.sqrt(F.greatest(spread, F.lit(0.0)) / (w - 1)))

    out = joined.withColumns(
        {"gyro_mag_mean": mean("g", "_mg"), "gyro_mag_std": std("g"), "acc_mag_mean": mean("a", "_ma"), "acc_mag_std": std("a")}
    )
    still = (
        (F.col("gyro_mag_mean") < gyro_limit)
        & (F.col("gyro_mag_std") < gyro_limit)
        & (F.abs(F.col("acc_mag_mean") - STANDARD_GRAVITY) < acc_limit)
        & (F.col("acc_mag_std") < acc_limit)
    )
    out = out.withColumn("is_stationary", F.coalesce(still, F.lit(False)))
    return s.with_df(out.drop("_rn", "_w", "_mg", "_ma", "_run", "_at", *sums, *[f"_p{c}" for c in sums]))


def aligned_runs(gyro: DataFrame, acc: DataFrame, gravity: DataFrame) -> DataFrame:
    """Gyroscope rows with the other sensors at their times."""
    frames = from_zero({"gyro": gyro, "acc": acc, "gravity": gravity})
    return align(frames["gyro"], {"acc": (frames["acc"], ACC), "gravity": (frames["gravity"], GRAVITY)})


def short_runs(gyro: DataFrame, acc: DataFrame, gravity: DataFrame, bias_seconds: float, min_samples: int = 5) -> DataFrame:
    """Runs that ``processed`` leaves out, with their samples in the bias window: too few to tell the bias."""
    early = aligned_runs(gyro, acc, gravity).filter(F.col("time_sec") <= bias_seconds).groupBy("run_id").agg(F.count(F.lit(1)).alias("early_samples"))
    runs = gyro.select("run_id").union(acc.select("run_id")).union(gravity.select("run_id")).distinct()
    counted = runs.join(early, "run_id", "left").withColumn("early_samples", F.coalesce("early_samples", F.lit(0).cast("long")))
    return counted.filter(F.col("early_samples") < min_samples)


def restless_runs(df: DataFrame) -> DataFrame:
    """Runs without a stationary row, which ``stationary_bias`` leaves out, with their samples."""
    counts = df.groupBy("run_id").agg(F.count_if("is_stationary").alias("_still"), F.count(F.lit(1)).alias("total_sample_count"))
    return counts.filter("_still = 0").drop("_still")


def processed(gyro: DataFrame, acc: DataFrame, gravity: DataFrame, bias_seconds: float) -> DataFrame:
    """The aligned, calibrated run table with tilt and integrated angles, dt and is_first; see ``short_runs`` for the others."""
    df = aligned_runs(gyro, acc, gravity)
    df = df.withColumn("acc_mag", magnitude(*[F.col(c) for c in ACC])).withColumn("gravity_mag", magnitude(*[F.col(c) for c in GRAVITY]))
    df = cut(df)
    df = tilted(calibrated(df, window_bias(df, bias_seconds)))
    df = df.withColumns(
        {
            "gyro_mag_raw": magnitude(*[F.col(c) for c in GYRO]),
            "gyro_mag": magnitude(*[F.col(f"{c}_calibrated") for c in GYRO]),
            "bias_window_sec": F.lit(float(bias_seconds)),
        }
    )
    s = with_dt(arrange(df, ["run_id"], ["time_sec"], probe=df.select("run_id")), "time_sec")
    s = integrated(s, {"gyro_roll_rad": ("gyro_x_calibrated", "roll_rad"), "gyro_pitch_rad": ("gyro_y_calibrated", "pitch_rad")})
    return s.result().withColumns({"gyro_roll_deg": F.degrees("gyro_roll_rad"), "gyro_pitch_deg": F.degrees("gyro_pitch_rad")})


def run_series(df: DataFrame) -> Series:
    return arrange(df, ["run_id"], ["time_sec"])


def accelerometer_calibration(df: DataFrame) -> DataFrame:
    mag = magnitude(*[F.col(c) for c in ACC])
    base = df.groupBy("run_id").agg(
        *[F.avg(c).alias(f"mean_{c}") for c in ACC],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in ACC],
        F.avg(mag).alias("mean_magnitude"),
        F.stddev_pop(mag).alias("std_magnitude"),
    )
    mean = [F.col(f"mean_{c}") for c in ACC]
    roll, pitch = rotation.tilt(*mean)
    return base.withColumns(
        {
            "mean_vector_magnitude": magnitude(*mean),
            "gravity_error": F.col("mean_magnitude") - STANDARD_GRAVITY,
            "roll_deg": F.degrees(roll),
            "pitch_deg": F.degrees(pitch),
        }
    )


def gyro_calibration(df: DataFrame) -> DataFrame:
    """Bias and noise per axis, and the angle that bias alone would add in one and in ten minutes."""
    speed = magnitude(*[F.col(c) for c in GYRO])
    base = df.groupBy("run_id").agg(
        *[F.avg(c).alias(f"bias_{c[-1]}_rad") for c in GYRO],
        *[F.stddev_pop(c).alias(f"noise_{c[-1]}_rad") for c in GYRO],
        F.avg(speed).alias("mean_angular_speed"),
        F.stddev_pop(speed).alias("std_angular_speed"),
    )
    extra = {}
    for a in AXES:
        extra[f"bias_{a}_deg"] = F.degrees(f"bias_{a}_rad")
        extra[f"noise_{a}_deg"] = F.degrees(f"noise_{a}_rad")
        extra[f"drift_60s_{a}_deg"] = F.degrees(F.col(f"bias_{a}_rad") * 60.0)
        extra[f"drift_600s_{a}_deg"] = F.degrees(F.col(f"bias_{a}_rad") * 600.0)
    return base.withColumns(extra)


def axis_integration(df: DataFrame, axis: str, bias: float, expected_deg: Column | None = None) -> DataFrame:
    """Angle after turning about one axis, against an expected angle where there is one."""
    s = with_dt(run_series(df), "time_sec")
    out = s.df.groupBy("run_id").agg(
        (F.max("time_sec") - F.min("time_sec")).alias("duration_sec"),
        F.count(F.lit(1)).alias("sample_count"),
        F.sum((F.col(f"gyro_{axis}") - bias) * F.col("dt")).alias("final_angle_rad"),
    )
    mean_dt = F.coalesce(F.try_divide(F.col("duration_sec"), F.col("sample_count") - 1), F.lit(0.0))
    expected = F.lit(None).cast("double") if expected_deg is None else expected_deg
    out = out.withColumns(
        {
            "mean_dt_sec": mean_dt,
            "sample_rate_hz": F.coalesce(F.try_divide(F.lit(1.0), mean_dt), F.lit(0.0)),
            "final_angle_deg": F.degrees("final_angle_rad"),
            "expected_angle_deg": expected,
        }
    )
    error = F.col("final_angle_deg") - F.col("expected_angle_deg")
    return out.withColumns(
        {
            "angle_error_deg": error,
            "angle_abs_error_deg": F.abs(error),
            "angle_percent_error": F.try_divide(100.0 * F.abs(error), F.abs("expected_angle_deg")),
        }
    )


def alignment_summary(df: DataFrame) -> DataFrame:
    """Duration, rate and magnitudes; with the median step as well as the mean one. Needs dt and is_first."""
    base = df.groupBy("run_id").agg(
        (F.max("time_sec") - F.min("time_sec")).alias("duration_sec"),
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(F.when(~F.col("is_first"), F.col("dt"))).alias("mean_dt_sec"),
        *[f(f"{n}_mag").alias(f"{p}_{n}_mag") for n in ("acc", "gravity", "gyro") for p, f in (("mean", F.avg), ("std", F.stddev_pop))],
    )
    med = percentiles(df.withColumn("_step", F.when(~F.col("is_first"), F.col("dt"))), ["run_id"], {"median_dt_sec": ("_step", 0.5)})
    return join_on_keys(base, med, ["run_id"]).withColumn("sample_rate_hz", F.try_divide(F.lit(1.0), F.col("mean_dt_sec")))


def ends(column: str, name: str, time: str = "time_sec") -> list[Column]:
    return [F.min_by(column, time).alias(f"{name}_start_deg"), F.max_by(column, time).alias(f"{name}_end_deg")]


def orientation_summary(df: DataFrame) -> DataFrame:
    out = df.groupBy("run_id").agg(
        *ends("roll_deg", "roll_gravity"),
        *ends("gyro_roll_deg", "roll_gyro"),
        *ends("pitch_deg", "pitch_gravity"),
        *ends("gyro_pitch_deg", "pitch_gyro"),
        *[f(f"{x}_deg").alias(f"{x}_gravity_{f.__name__}_deg") for x in ("roll", "pitch") for f in (F.min, F.max)],
    )
    return out.withColumns(
        {
            **{f"{x}_end_difference_deg": F.col(f"{x}_gyro_end_deg") - F.col(f"{x}_gravity_end_deg") for x in ("roll", "pitch")},
            **{f"{x}_gravity_range_deg": F.col(f"{x}_gravity_max_deg") - F.col(f"{x}_gravity_min_deg") for x in ("roll", "pitch")},
        }
    )


AXIS_CANDIDATES = ("+gyro_x", "-gyro_x", "+gyro_y", "-gyro_y")


def axis_mapping(df: DataFrame) -> DataFrame:
    """Which signed gyro axis follows roll and pitch best: RMSE of its integral against the unwrapped angle."""
    s = with_dt(run_series(df.drop("dt", "is_first")), "time_sec")
    s = unwrapped(s, {"_roll": "roll_rad", "_pitch": "pitch_rad"})
    s = running_sum(s, {f"_sum_{a}": F.col(f"gyro_{a}_calibrated") * F.col("dt") for a in "xy"})
    s = first_of(s, {"_roll0": F.col("_roll"), "_pitch0": F.col("_pitch")})
    fits = {}
    for ref in ("roll", "pitch"):
        for name in AXIS_CANDIDATES:
            signed = F.col(f"_sum_{name[-1]}") * (1.0 if name[0] == "+" else -1.0)
            fits[(ref, name)] = F.degrees(rmse(F.col(f"_{ref}0") + signed - F.col(f"_{ref}")))
    rows = s.df.groupBy("run_id").agg(
        *[
            F.array(*[F.struct(fits[(ref, n)].alias("rmse"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, n in enumerate(AXIS_CANDIDATES)]).alias(ref)
            for ref in ("roll", "pitch")
        ]
    )
    return rows.select(
        "run_id",
        *[F.col(ref)[i]["rmse"].alias(f"{ref}_rmse_{i}") for ref in ("roll", "pitch") for i in range(len(AXIS_CANDIDATES))],
        *[F.array_min(ref)["name"].alias(f"best_{ref}_mapping") for ref in ("roll", "pitch")],
    )


def filter_performance(df: DataFrame, estimates: Sequence[tuple[str, str]]) -> DataFrame:
    """RMSE in degrees of each (estimate, reference) pair of columns."""
    return df.groupBy("run_id").agg(*[rmse(F.col(e) - F.col(r)).alias(f"{e.removesuffix('_deg')}_rmse_deg") for e, r in estimates])


def adaptive_summary(df: DataFrame) -> DataFrame:
    base = df.groupBy("run_id").agg(
        F.min("adaptive_alpha").alias("adaptive_alpha_min"),
        F.max("adaptive_alpha").alias("adaptive_alpha_max"),
        F.avg("adaptive_alpha").alias("adaptive_alpha_mean"),
        F.avg((F.col("adaptive_alpha") > 0.98).cast("double")).alias("fraction_alpha_high_accel"),
        F.avg("acc_error_from_g").alias("acc_error_mean"),
        F.max("acc_error_from_g").alias("acc_error_max"),
    )
    return join_on_keys(base, percentiles(df, ["run_id"], {"acc_error_p95": ("acc_error_from_g", 0.95)}), ["run_id"])


Q_COLUMNS = ("q_w", "q_x", "q_y", "q_z")


def quaternion_columns(df: DataFrame) -> DataFrame:
    """Euler angles and world-frame acceleration of each row's orientation."""
    q = tuple(F.col(c) for c in Q_COLUMNS)
    roll, pitch, yaw = rotation.to_euler(q)
    world = rotation.rotate(q, tuple(F.col(c) for c in ACC))
    lin = rotation.linear_acceleration(world)
    return df.withColumns(
        {
            "quat_roll_deg": F.degrees(roll),
            "quat_pitch_deg": F.degrees(pitch),
            "quat_yaw_deg": F.degrees(yaw),
            **{f"acc_world_{a}": w for a, w in zip(AXES, world)},
            **{f"linear_acc_world_{a}": v for a, v in zip((*AXES, "mag"), lin)},
        }
    )


def deltas(s: Series, columns: Sequence[str]) -> Series:
    """Angles relative to the run's first row, as <name>_delta_deg."""
    s = first_of(s, {f"_0{c}": F.col(c) for c in columns})
    return s.with_df(
        s.df.withColumns({c.replace("_deg", "_delta_deg"): F.col(c) - F.col(f"_0{c}") for c in columns}).drop(*[f"_0{c}" for c in columns])
    )


def quaternion_summary(df: DataFrame) -> DataFrame:
    """Norm statistics and agreement with integrated and gravity angles. Needs the delta columns."""
    norm = magnitude(*[F.col(c) for c in Q_COLUMNS])
    pair = lambda a, b: rmse(F.col(f"{a}_delta_deg") - F.col(f"{b}_delta_deg"))
    return df.groupBy("run_id").agg(
        F.min(norm).alias("quat_norm_min"),
        F.max(norm).alias("quat_norm_max"),
        F.avg(norm).alias("quat_norm_mean"),
        F.stddev_pop(norm).alias("quat_norm_std"),
        F.max(F.abs(norm - 1.0)).alias("quat_norm_max_error"),
        *[pair(f"quat_{x}", f"gyro_{x}").alias(f"quat_vs_euler_{x}_rmse_deg") for x in ("roll", "pitch")],
        *[pair(f"quat_{x}", x).alias(f"quat_vs_gravity_{x}_rmse_deg") for x in ("roll", "pitch")],
        *[
            F.max_by(f"{n}_delta_deg", "time_sec").alias(f"{n}_delta_end_deg")
            for n in ("quat_roll", "gyro_roll", "roll", "quat_pitch", "gyro_pitch", "pitch", "quat_yaw")
        ],
    )


def linear_acceleration_summary(df: DataFrame) -> DataFrame:
    m = "linear_acc_world_mag"
    base = df.groupBy("run_id").agg(
        F.avg(m).alias("linear_acc_mean"), F.stddev_pop(m).alias("linear_acc_std"), F.max(m).alias("linear_acc_max"), F.avg("linear_acc_world_z").alias("linear_acc_z_mean")
    )
    return join_on_keys(base, percentiles(df, ["run_id"], {"linear_acc_p95": (m, 0.95)}), ["run_id"])


def smoothed(s: Series) -> Series:
    return rolling(
        s,
        SMOOTH_BEFORE,
        SMOOTH_AFTER,
        {f"{c}_smooth": (lambda w, c=c: F.avg(c).over(w)) for c in ("linear_acc_world_mag", "gyro_mag")},
    )


def motion_label(acc: Column, gyro: Column) -> Column:
    """Strongest rule first; nothing known gives unknown."""
    return (
        F.when(acc >= IMPACT_ACC, "impact_or_shake")
        .when(acc >= HIGH_ACC, "high_accel")
        .when(acc >= MOVING_ACC, "motion")
        .when((gyro >= STILL_GYRO) & (acc < MOVING_ACC), "rotation")
        .when((acc >= STILL_ACC) & (gyro < STILL_GYRO), "small_motion")
        .when((acc < STILL_ACC) & (gyro < STILL_GYRO), "stationary")
        .otherwise("unknown")
    )


def label_group(label: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in GROUPS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, label), F.lit("unknown"))


def labelled(s: Series) -> Series:
    s = smoothed(s)
    label = motion_label(F.col("linear_acc_world_mag_smooth"), F.col("gyro_mag_smooth"))
    return s.with_df(s.df.withColumn("event_label", label).withColumn("event_group", label_group(F.col("event_label"))))


def label_histogram(df: DataFrame, label: str = "event_label") -> DataFrame:
    """Counts and percentages of each label per run."""
    counts = df.groupBy("run_id", label).agg(F.count(F.lit(1)).alias("event_count"))
    return counts.withColumn("event_percentage", 100.0 * F.col("event_count") / F.sum("event_count").over(Window.partitionBy("run_id")))


MEASURES = ("linear_acc_world_mag", "linear_acc_world_mag_smooth", "gyro_mag", "gyro_mag_smooth")


def median_step(df: DataFrame) -> DataFrame:
    """Median time step per run (needs dt and is_first)."""
    return percentiles(df.select("run_id", F.when(~F.col("is_first"), F.col("dt")).alias("_d")), ["run_id"], {"step": ("_d", 0.5)})


def segments(s: Series, label: str, measures: Sequence[str] = MEASURES) -> DataFrame:
    """One row per run of equal labels: start, end, rows, and maximum and sum-based mean of each measure."""
    s = islands(s, F.col(label), "segment_id")
    out = s.df.groupBy("run_id", "segment_id").agg(
        F.first(label).alias(label),
        F.min("time_sec").alias("start_time_sec"),
        F.max("time_sec").alias("end_time_sec"),
        F.count("time_sec").alias("sample_count"),
        *[F.max(m).alias(f"max_{m}") for m in measures],
        *[F.avg(m).alias(f"mean_{m}") for m in measures],
    )
    step = median_step(s.df)
    return with_duration(out, step)


def with_duration(segs: DataFrame, step: DataFrame) -> DataFrame:
    out = segs.join(step, "run_id").withColumn("duration_sec", F.col("end_time_sec") - F.col("start_time_sec") + F.col("step"))
    return out.drop("step").withColumn("is_tiny_segment", F.coalesce(F.col("duration_sec") < TINY_SEGMENT_SEC, F.lit(False)))


def merged_labels(s: Series, label: str, out: str, min_sec: float = TINY_SEGMENT_SEC, passes: int = MERGE_PASSES) -> DataFrame:
    """Segments after tiny ones have taken a neighbour's label, pass by pass. Each result row says which rows (by time) it holds."""
    numbered = islands(s, F.col(label), "_seg")
    step = median_step(s.df)
    segs = numbered.df.groupBy("run_id", "_seg").agg(
        F.first(label).alias("label"), F.min("time_sec").alias("start_time_sec"), F.max("time_sec").alias("end_time_sec"), F.count(F.lit(1)).alias("sample_count")
    )
    labels = list(dict.fromkeys(GROUPS.values()))
    merged = without_tiny(segs.drop("_seg").join(step, "run_id"), ["run_id"], labels, PROTECTED, min_sec, passes, s.df)
    merged = number(arrange(merged, ["run_id"], ["start_time_sec"], s.df), "segment_id").result()
    return with_duration(merged.withColumnRenamed("label", out), step)


def run_summary(samples: DataFrame, fine: DataFrame, group: DataFrame, clean: DataFrame) -> DataFrame:
    """Rows per run, and segments and tiny segments at the three label levels."""
    out = samples.groupBy("run_id").agg(F.count(F.lit(1)).alias("sample_count"))
    for name, segs in (("fine", fine), ("group", group), ("clean", clean)):
        counts = segs.groupBy("run_id").agg(F.count(F.lit(1)).alias(f"{name}_segments"), F.count_if("is_tiny_segment").alias(f"{name}_tiny_segments"))
        out = out.join(counts, "run_id")
    return out
