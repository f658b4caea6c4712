"""Phone-sensor queries: events as samples, each user one run."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sensorlith.functions import rotation
from sensorlith.functions.numbers import rmse, settled
from sensorlith.functions.times import micros
from sensorlith.operators.series import arrange, number, shift
from sensorlith.plans import filters as FI
from sensorlith.plans import imu as I
from sensorlith.plans import protocol as P
from sensorlith.queries.city_tables import EVENTS, events
from sensorlith.queries.speeds import settle
from sensorlith.registry import query
from sensorlith.session import cut

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01, the first day of the events
BIAS_SEC = 1.0
c = F.col


def samples(spark, sf):
    return events(spark, sf).select(
        c("user_id").alias("run_id"), "event_id", "event_type", "k", "value", ((micros(c("ts")) - EPOCH_US) / F.lit(1e12)).alias("time_sec")
    )


def sensors(spark, sf):
    s = samples(spark, sf)
    k, v = c("k"), c("value")
    gyro = s.filter(c("event_type").isin("signup", "error")).select(
        "run_id", "time_sec", ((k - 50) / 500.0).alias("gyro_x"), ((v - 35.0) / 1000.0).alias("gyro_y"), ((k % 7 - 3) / 100.0).alias("gyro_z")
    )
    acc = s.filter(c("event_type").isin("view", "purchase")).select(
        "run_id", "time_sec", ((k - 50) / 100.0).alias("acc_x"), ((k % 13 - 6) / 20.0).alias("acc_y"), (9.5 + (v - 35.0) / 50.0).alias("acc_z")
    )
    gravity = s.filter(c("event_type") == "click").select(
        "run_id", "time_sec", ((k - 50) / 60.0).alias("gravity_x"), ((k % 11 - 5) / 8.0).alias("gravity_y"), (9.5 + (k % 5) / 20.0).alias("gravity_z")
    )
    return gyro, acc, gravity


def processed(spark, sf):
    return I.processed(*sensors(spark, sf), BIAS_SEC)


D = lambda x: f"CAST({x} AS DOUBLE)"

SENSORS = (
    EVENTS
    + f""",
smp AS (SELECT user_id AS run_id, event_id, event_type, k, value, (epoch_us(ts) - {EPOCH_US}) / 1e12 AS t0 FROM ev),
zero AS (SELECT run_id, min(t0) AS z FROM smp GROUP BY run_id),
sm AS (SELECT smp.*, t0 - z AS t FROM smp JOIN zero USING (run_id)),
gyro AS (SELECT run_id, t, (k - 50) / {D(500)} AS gyro_x, (value - 35) / {D(1000)} AS gyro_y, (k % 7 - 3) / {D(100)} AS gyro_z FROM sm WHERE event_type IN ('signup', 'error')),
acc AS (SELECT run_id, t, (k - 50) / {D(100)} AS acc_x, (k % 13 - 6) / {D(20)} AS acc_y, {D(9.5)} + (value - 35) / {D(50)} AS acc_z FROM sm WHERE event_type IN ('view', 'purchase')),
gravity AS (SELECT run_id, t, (k - 50) / {D(60)} AS gravity_x, (k % 11 - 5) / {D(8)} AS gravity_y, {D(9.5)} + (k % 5) / {D(20)} AS gravity_z FROM sm WHERE event_type = 'click')"""
)


def _interp(n, b, a):
    return f"coalesce({b}.{n} + ({a}.{n} - {b}.{n}) / nullif({a}.t - {b}.t, 0) * (g.t - {b}.t), {b}.{n}, {a}.{n}) AS {n}"


ALIGNED = (
    SENSORS
    + f""",
aligned AS MATERIALIZED (
  SELECT g.*, {', '.join(_interp(n, 'b1', 'a1') for n in I.ACC)}, {', '.join(_interp(n, 'b2', 'a2') for n in I.GRAVITY)}
  FROM gyro g ASOF LEFT JOIN acc b1 ON g.run_id = b1.run_id AND g.t >= b1.t ASOF LEFT JOIN acc a1 ON g.run_id = a1.run_id AND g.t <= a1.t
    ASOF LEFT JOIN gravity b2 ON g.run_id = b2.run_id AND g.t >= b2.t ASOF LEFT JOIN gravity a2 ON g.run_id = a2.run_id AND g.t <= a2.t
),
bias AS (SELECT run_id, avg(gyro_x) AS bx, avg(gyro_y) AS by_, avg(gyro_z) AS bz FROM aligned WHERE t <= {BIAS_SEC} GROUP BY run_id HAVING count(*) >= 5),
tilt AS MATERIALIZED (
  SELECT a.*, gyro_x - bx AS cx, gyro_y - by_ AS cy, gyro_z - bz AS cz, bx, by_, bz, sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z) AS acc_mag,
    sqrt(gravity_x * gravity_x + gravity_y * gravity_y + gravity_z * gravity_z) AS gravity_mag,
    atan2(gravity_y, gravity_z) AS roll, atan2(-gravity_x, sqrt(gravity_y * gravity_y + gravity_z * gravity_z)) AS pitch,
    row_number() OVER (PARTITION BY a.run_id ORDER BY t) AS rn, coalesce(t - lag(t) OVER (PARTITION BY a.run_id ORDER BY t), 0) AS dt
  FROM aligned a JOIN bias USING (run_id)
),
pr AS MATERIALIZED (
  SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS gyro_mag,
    first(roll) OVER w + sum(cx * dt) OVER w AS groll, first(pitch) OVER w + sum(cy * dt) OVER w AS gpitch
  FROM tilt WINDOW w AS (PARTITION BY run_id ORDER BY t ROWS UNBOUNDED PRECEDING)
)"""
)


def out(df, names, *plain, digits=6):
    """Selected columns, the named ones settled to ``digits``."""
    return df.select(*plain, *[settled(c(n), digits).alias(n) for n in names])


def sql_out(pairs, digits=6):
    return ", ".join(f"{settle(e, digits)} AS {n}" for n, e in pairs.items())


@query("imu_aligned", f"WITH {ALIGNED} SELECT run_id, {sql_out({'time_sec': 't', **{n: n for n in I.GYRO + I.ACC + I.GRAVITY}})} FROM aligned")
def imu_aligned(spark, sf):
    frames = I.from_zero(dict(zip(("gyro", "acc", "gravity"), sensors(spark, sf))))
    df = I.align(frames["gyro"], {"acc": (frames["acc"], I.ACC), "gravity": (frames["gravity"], I.GRAVITY)})
    return out(df, ["time_sec", *I.GYRO, *I.ACC, *I.GRAVITY], "run_id")


PROCESSED = {
    "time_sec": "t", "acc_mag": "acc_mag", "gravity_mag": "gravity_mag", "gyro_mag": "gyro_mag", "gyro_bias_x": "bx", "gyro_bias_y": "by_", "gyro_bias_z": "bz",
    "roll_deg": "degrees(roll)", "pitch_deg": "degrees(pitch)", "gyro_roll_deg": "degrees(groll)", "gyro_pitch_deg": "degrees(gpitch)", "dt": "dt",
}


@query("imu_processed_runs", f"WITH {ALIGNED} SELECT run_id, {sql_out(PROCESSED)} FROM pr")
def imu_processed_runs(spark, sf):
    return out(processed(spark, sf), PROCESSED, "run_id")


@query(
    "imu_common_end",
    f"""WITH {SENSORS}, e AS (SELECT run_id, min(m) AS e FROM (SELECT run_id, max(t) AS m FROM gyro GROUP BY 1 UNION ALL SELECT run_id, max(t) FROM acc GROUP BY 1
          UNION ALL SELECT run_id, max(t) FROM gravity GROUP BY 1) GROUP BY run_id HAVING count(*) = 3)
        SELECT run_id, count(*) AS samples, {settle('max(t)', 6)} AS last_time FROM gyro JOIN e USING (run_id) WHERE t <= e GROUP BY run_id""",
)
def imu_common_end(spark, sf):
    frames = I.until_common_end(I.from_zero(dict(zip(("gyro", "acc", "gravity"), sensors(spark, sf)))))
    return frames["gyro"].groupBy("run_id").agg(F.count(F.lit(1)).alias("samples"), settled(F.max("time_sec"), 6).alias("last_time"))


@query(
    "imu_sensor_statistics",
    f"""WITH {EVENTS} SELECT user_id AS run_id, event_type AS sensor_name, {sql_out({'mean': 'avg(value)', 'std': 'stddev_samp(value)', 'min': 'min(value)', 'max': 'max(value)'})}
        FROM ev GROUP BY ALL""",
)
def imu_sensor_statistics(spark, sf):
    long = samples(spark, sf).select("run_id", c("event_type").alias("sensor_name"), "value")
    return out(I.sensor_statistics(long), ["mean", "std", "min", "max"], "run_id", "sensor_name")


TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "imu_pivot",
    f"""WITH {EVENTS} SELECT user_id AS run_id, k AS timestamp_sec, {', '.join(f"{settle(f'(avg(value) FILTER (WHERE event_type = {t!r}))', 4)} AS {t}" for t in TYPES)} FROM ev GROUP BY ALL""",
)
def imu_pivot(spark, sf):
    long = samples(spark, sf).select("run_id", c("k").alias("timestamp_sec"), c("event_type").alias("sensor_name"), "value")
    return out(I.wide(long, TYPES), TYPES, "run_id", "timestamp_sec", digits=4)


@query(
    "imu_melt",
    f"""WITH {EVENTS} SELECT user_id AS run_id, k AS timestamp_sec, event_type AS sensor_name, {settle('avg(value)', 4)} AS value FROM ev GROUP BY ALL""",
)
def imu_melt(spark, sf):
    long = samples(spark, sf).select("run_id", c("k").alias("timestamp_sec"), c("event_type").alias("sensor_name"), "value")
    return out(I.long(I.wide(long, TYPES), TYPES), ["value"], "run_id", "timestamp_sec", "sensor_name", digits=4)


ACC_CAL = {
    **{f"mean_{n}": f"avg({n})" for n in I.ACC}, **{f"std_{n}": f"stddev_pop({n})" for n in I.ACC}, "mean_magnitude": "avg(m)", "std_magnitude": "stddev_pop(m)",
    "mean_vector_magnitude": "sqrt(pow(avg(acc_x), 2) + pow(avg(acc_y), 2) + pow(avg(acc_z), 2))", "gravity_error": f"(avg(m) - {D(9.80665)})",
    "roll_deg": "degrees(atan2(avg(acc_y), avg(acc_z)))", "pitch_deg": "degrees(atan2(-avg(acc_x), sqrt(pow(avg(acc_y), 2) + pow(avg(acc_z), 2))))",
}


@query("imu_accelerometer_calibration", f"WITH {SENSORS}, x AS (SELECT *, sqrt(acc_x * acc_x + acc_y * acc_y + acc_z * acc_z) AS m FROM acc) SELECT run_id, {sql_out(ACC_CAL)} FROM x GROUP BY run_id")
def imu_accelerometer_calibration(spark, sf):
    return out(I.accelerometer_calibration(sensors(spark, sf)[1]), ACC_CAL, "run_id")


GYRO_CAL = {"mean_angular_speed": "avg(m)", "std_angular_speed": "stddev_pop(m)"}
for _a in I.AXES:
    GYRO_CAL |= {
        f"bias_{_a}_rad": f"avg(gyro_{_a})", f"noise_{_a}_rad": f"stddev_pop(gyro_{_a})", f"bias_{_a}_deg": f"degrees(avg(gyro_{_a}))",
        f"noise_{_a}_deg": f"degrees(stddev_pop(gyro_{_a}))", f"drift_60s_{_a}_deg": f"degrees(avg(gyro_{_a}) * 60)", f"drift_600s_{_a}_deg": f"degrees(avg(gyro_{_a}) * 600)",
    }


@query("imu_gyro_calibration", f"WITH {SENSORS}, x AS (SELECT *, sqrt(gyro_x * gyro_x + gyro_y * gyro_y + gyro_z * gyro_z) AS m FROM gyro) SELECT run_id, {sql_out(GYRO_CAL, 5)} FROM x GROUP BY run_id")
def imu_gyro_calibration(spark, sf):
    return out(I.gyro_calibration(sensors(spark, sf)[0]), GYRO_CAL, "run_id", digits=5)


AXIS = {
    "duration_sec": "d", "mean_dt_sec": "coalesce(d / nullif(n - 1, 0), 0)", "sample_rate_hz": "coalesce(1.0 / nullif(coalesce(d / nullif(n - 1, 0), 0), 0), 0)",
    "final_angle_deg": "degrees(a)", "angle_error_deg": "(degrees(a) - 0.5)", "angle_abs_error_deg": "abs(degrees(a) - 0.5)", "angle_percent_error": "(100.0 * abs(degrees(a) - 0.5) / 0.5)",
}


@query(
    "imu_axis_integration",
    f"""WITH {SENSORS}, d AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY run_id ORDER BY t), 0) AS dt FROM gyro),
        x AS (SELECT run_id, max(t) - min(t) AS d, count(*) AS n, sum((gyro_x - {D(0.01)}) * dt) AS a FROM d GROUP BY run_id)
        SELECT run_id, n AS sample_count, {sql_out(AXIS, 5)} FROM x""",
)
def imu_axis_integration(spark, sf):
    return out(I.axis_integration(sensors(spark, sf)[0], "x", 0.01, F.lit(0.5)), AXIS, "run_id", "sample_count", digits=5)


ALIGN_SUM = {
    "duration_sec": "max(t) - min(t)", "mean_dt_sec": "avg(dt) FILTER (WHERE rn > 1)", "median_dt_sec": "median(dt) FILTER (WHERE rn > 1)",
    **{f"{p}_{n}_mag": f"{f}({n}_mag)" for n in ("acc", "gravity", "gyro") for p, f in (("mean", "avg"), ("std", "stddev_pop"))},
}
ALIGN_SUM = {n: f"({e})" for n, e in ALIGN_SUM.items()}


@query("imu_alignment_summary", f"WITH {ALIGNED} SELECT run_id, count(*) AS sample_count, {sql_out(ALIGN_SUM)} FROM pr GROUP BY run_id")
def imu_alignment_summary(spark, sf):
    return out(I.alignment_summary(processed(spark, sf)), ALIGN_SUM, "run_id", "sample_count")


ORIENT = {}
for _x, _g in (("roll", "groll"), ("pitch", "gpitch")):
    ORIENT |= {
        f"{_x}_gravity_start_deg": f"degrees(arg_min({_x}, t))", f"{_x}_gravity_end_deg": f"degrees(arg_max({_x}, t))", f"{_x}_gyro_start_deg": f"degrees(arg_min({_g}, t))",
        f"{_x}_gyro_end_deg": f"degrees(arg_max({_g}, t))", f"{_x}_gravity_min_deg": f"degrees(min({_x}))", f"{_x}_gravity_max_deg": f"degrees(max({_x}))",
        f"{_x}_end_difference_deg": f"(degrees(arg_max({_g}, t)) - degrees(arg_max({_x}, t)))", f"{_x}_gravity_range_deg": f"(degrees(max({_x})) - degrees(min({_x})))",
    }


@query("imu_orientation_summary", f"WITH {ALIGNED} SELECT run_id, {sql_out(ORIENT)} FROM pr GROUP BY run_id")
def imu_orientation_summary(spark, sf):
    return out(I.orientation_summary(processed(spark, sf)), ORIENT, "run_id")


MAPPING = (
    ALIGNED
    + """,
un AS (
  SELECT *, roll + sum(fr) OVER w AS ur, pitch + sum(fp) OVER w AS up, sum(cx * dt) OVER w AS sx, sum(cy * dt) OVER w AS sy FROM (
    SELECT *, CASE WHEN abs(roll - pr_) < pi() OR pr_ IS NULL THEN 0 ELSE -2 * pi() * round((roll - pr_) / (2 * pi())) END AS fr,
      CASE WHEN abs(pitch - pp_) < pi() OR pp_ IS NULL THEN 0 ELSE -2 * pi() * round((pitch - pp_) / (2 * pi())) END AS fp FROM (
      SELECT *, lag(roll) OVER (PARTITION BY run_id ORDER BY t) AS pr_, lag(pitch) OVER (PARTITION BY run_id ORDER BY t) AS pp_ FROM pr))
  WINDOW w AS (PARTITION BY run_id ORDER BY t ROWS UNBOUNDED PRECEDING)
),
u0 AS (SELECT run_id, arg_min(ur, t) AS r0, arg_min(up, t) AS p0 FROM un GROUP BY run_id)"""
)
CAND = {"+gyro_x": "sx", "-gyro_x": "-sx", "+gyro_y": "sy", "-gyro_y": "-sy"}
MAP_OUT = {f"{ref}_rmse_{i}": f"degrees(sqrt(avg(pow({z} + {e} - {u}, 2))))" for ref, z, u in (("roll", "r0", "ur"), ("pitch", "p0", "up")) for i, e in enumerate(CAND.values())}
_best = lambda ref: " ".join(
    f"WHEN {ref}_rmse_{i} <= least({', '.join(f'{ref}_rmse_{j}' for j in range(4))}) THEN '{n}'" for i, n in enumerate(CAND)
)


@query(
    "imu_axis_mapping",
    f"""WITH {MAPPING}, m AS (SELECT run_id, {', '.join(f'{e} AS {n}' for n, e in MAP_OUT.items())} FROM un JOIN u0 USING (run_id) GROUP BY run_id)
        SELECT run_id, {sql_out({n: n for n in MAP_OUT})}, CASE {_best('roll')} END AS best_roll_mapping, CASE {_best('pitch')} END AS best_pitch_mapping FROM m""",
)
def imu_axis_mapping(spark, sf):
    return out(I.axis_mapping(processed(spark, sf)), MAP_OUT, "run_id", "best_roll_mapping", "best_pitch_mapping")


ACC_LIMIT, GYRO_LIMIT = 4.0, 0.5
STILL = (
    ALIGNED
    + f""",
wn AS (SELECT run_id, CAST(floor(1.0 / ((max(t) - min(t)) / (count(*) - 1))) AS BIGINT) AS w FROM pr GROUP BY run_id),
st AS (
  SELECT p.run_id, p.rn, any_value(p.t) AS t, any_value(p.gyro_x) AS gyro_x, any_value(p.gyro_y) AS gyro_y, any_value(p.gyro_z) AS gyro_z, any_value(w) AS w, count(q.rn) AS n,
    avg(q.gyro_mag) AS gm, stddev_samp(q.gyro_mag) AS gs, avg(q.acc_mag) AS am, stddev_samp(q.acc_mag) AS asd
  FROM pr p JOIN wn USING (run_id) LEFT JOIN pr q ON q.run_id = p.run_id AND q.rn > p.rn - w AND q.rn <= p.rn GROUP BY p.run_id, p.rn
),
still AS (
  SELECT *, coalesce(n = w AND w >= 1 AND gm < {GYRO_LIMIT} AND gs < {GYRO_LIMIT} AND abs(am - {D(9.80665)}) < {ACC_LIMIT} AND asd < {ACC_LIMIT}, false) AS s FROM st
)"""
)


def still(spark, sf):
    s = I.run_series(processed(spark, sf))
    return I.stationary(s, ACC_LIMIT, GYRO_LIMIT).result()


@query(
    "imu_stationary_rows",
    f"""WITH {STILL} SELECT run_id, {settle('t', 6)} AS time_sec, {sql_out({'gyro_mag_mean': 'CASE WHEN n = w THEN gm END', 'gyro_mag_std': 'CASE WHEN n = w THEN gs END',
        'acc_mag_mean': 'CASE WHEN n = w THEN am END', 'acc_mag_std': 'CASE WHEN n = w THEN asd END'}, 5)}, CAST(s AS INTEGER) AS is_stationary FROM still""",
)
def imu_stationary_rows(spark, sf):
    names = ["gyro_mag_mean", "gyro_mag_std", "acc_mag_mean", "acc_mag_std"]
    return out(still(spark, sf), names, "run_id", settled(c("time_sec"), 6).alias("time_sec"), c("is_stationary").cast("int").alias("is_stationary"), digits=5)


ST_BIAS = {f"gyro_bias_{a}": f"(median(gyro_{a}) FILTER (WHERE s))" for a in I.AXES} | {
    f"stationary_std_{a}": f"(stddev_samp(gyro_{a}) FILTER (WHERE s))" for a in I.AXES
} | {"stationary_fraction": "(count(*) FILTER (WHERE s) / count(*))"}


@query(
    "imu_stationary_bias",
    f"""WITH {STILL} SELECT run_id, count(*) FILTER (WHERE s) AS stationary_sample_count, count(*) AS total_sample_count, {sql_out(ST_BIAS)}
        FROM still GROUP BY run_id HAVING count(*) FILTER (WHERE s) > 0""",
)
def imu_stationary_bias(spark, sf):
    return out(I.stationary_bias(still(spark, sf)), ST_BIAS, "run_id", "stationary_sample_count", "total_sample_count")


@query(
    "imu_rejected_runs",
    f"""WITH {STILL}, few AS (SELECT u.run_id, count(a.t) FILTER (WHERE a.t <= {BIAS_SEC}) AS n FROM (SELECT DISTINCT run_id FROM smp) u LEFT JOIN aligned a ON a.run_id = u.run_id GROUP BY u.run_id)
        SELECT run_id, 'too few samples' AS reason, n AS samples FROM few WHERE n < 5
        UNION ALL SELECT run_id, 'never still', count(*) FROM still GROUP BY run_id HAVING count(*) FILTER (WHERE s) = 0""",
)
def imu_rejected_runs(spark, sf):
    """Every run that a later table lacks, and why."""
    few = I.short_runs(*sensors(spark, sf), BIAS_SEC).select("run_id", F.lit("too few samples").alias("reason"), c("early_samples").alias("samples"))
    return few.unionByName(I.restless_runs(still(spark, sf)).select("run_id", F.lit("never still").alias("reason"), c("total_sample_count").alias("samples")))


def filtered(spark, sf):
    """Runs with fixed, adaptive and Kalman estimates side by side."""
    s = number(I.run_series(cut(processed(spark, sf))), "_n")
    row = ["_n"]  # samples may share a time
    df = s.result()
    for est in (
        FI.complementary(s, row),
        FI.adaptive(s, row),
        FI.kalman_angle_bias(s, row, "gyro_y_calibrated", "pitch_rad"),
    ):
        df = df.join(est, ["run_id", "_n"])
    df = df.drop("_n")
    for n in ("fused_roll", "fused_pitch", "adaptive_fused_roll", "adaptive_fused_pitch", "kalman_angle"):
        df = df.withColumn(f"{n}_deg", F.degrees(f"{n}_rad"))
    return df.withColumn("kalman_bias_deg_s", F.degrees("kalman_bias_rad_s"))


RECURSIVE = "RECURSIVE " + ALIGNED + f""",
cf AS (
  SELECT run_id, rn, roll AS r, pitch AS p FROM pr WHERE rn = 1
  UNION ALL SELECT pr.run_id, pr.rn, {D(0.98)} * (r + cx * dt) + (1 - {D(0.98)}) * roll, {D(0.98)} * (p + cy * dt) + (1 - {D(0.98)}) * pitch
  FROM cf JOIN pr ON pr.run_id = cf.run_id AND pr.rn = cf.rn + 1
),
ad AS (
  SELECT run_id, rn, roll AS r, pitch AS p, {D(0.85)} AS alpha FROM pr WHERE rn = 1
  UNION ALL SELECT run_id, rn, alpha * (r + cx * dt) + (1 - alpha) * roll, alpha * (p + cy * dt) + (1 - alpha) * pitch, alpha FROM (
    SELECT pr.*, ad.r, ad.p, CASE WHEN abs(acc_mag - {D(9.80665)}) < 5 THEN {D(0.85)} ELSE {D(0.98)} END AS alpha
    FROM ad JOIN pr ON pr.run_id = ad.run_id AND pr.rn = ad.rn + 1)
),
kp AS (SELECT run_id, rn, cy AS u, pitch AS z, dt FROM pr),
kf AS (
  SELECT run_id, rn, z AS x0, {D(0)} AS x1, 1 - a / (a + 1e-3) * 1 AS d0, a * 1e-3 / (a + 1e-3) AS p00, {D(0)} AS p01, {D(1)} + 1e-7 AS p11
  FROM (SELECT *, {D(1)} + 1e-5 AS a FROM kp WHERE rn = 1)
  UNION ALL
  SELECT run_id, rn, y0 + a / s * (z - y0), y1 + b / s * (z - y0), 0, (1 - a / s) * a, (1 - a / s) * b, d - b / s * b FROM (
    SELECT kp.run_id, kp.rn, z, x0 - dt * x1 + dt * u AS y0, x1 AS y1, p00 - 2 * dt * p01 + dt * dt * p11 + 1e-5 AS a, p01 - dt * p11 AS b, p11 + 1e-7 AS d,
      p00 - 2 * dt * p01 + dt * dt * p11 + 1e-5 + 1e-3 AS s
    FROM kf JOIN kp ON kp.run_id = kf.run_id AND kp.rn = kf.rn + 1)
),
est AS (
  SELECT pr.*, degrees(roll) AS roll_deg, degrees(pitch) AS pitch_deg, degrees(groll) AS gyro_roll_deg, degrees(gpitch) AS gyro_pitch_deg,
    degrees(cf.r) AS fused_roll_deg, degrees(cf.p) AS fused_pitch_deg, degrees(ad.r) AS adaptive_fused_roll_deg, degrees(ad.p) AS adaptive_fused_pitch_deg,
    ad.alpha AS adaptive_alpha, abs(acc_mag - {D(9.80665)}) AS acc_error_from_g, degrees(x0) AS kalman_angle_deg, degrees(x1) AS kalman_bias_deg_s
  FROM pr JOIN cf USING (run_id, rn) JOIN ad USING (run_id, rn) JOIN kf USING (run_id, rn)
)"""

EST = ["fused_roll_deg", "fused_pitch_deg", "adaptive_fused_roll_deg", "adaptive_fused_pitch_deg", "adaptive_alpha", "kalman_angle_deg", "kalman_bias_deg_s"]


@query("imu_filter_estimates", f"WITH {RECURSIVE} SELECT run_id, {sql_out({'time_sec': 't', **{n: n for n in EST}}, 5)} FROM est")
def imu_filter_estimates(spark, sf):
    return out(filtered(spark, sf), ["time_sec", *EST], "run_id", digits=5)


PERF = [("gyro_roll_deg", "roll_deg"), ("fused_roll_deg", "roll_deg"), ("adaptive_fused_roll_deg", "roll_deg"), ("gyro_pitch_deg", "pitch_deg"),
        ("fused_pitch_deg", "pitch_deg"), ("adaptive_fused_pitch_deg", "pitch_deg"), ("kalman_angle_deg", "pitch_deg")]
PERF_OUT = {f"{e.removesuffix('_deg')}_rmse_deg": f"sqrt(avg(pow({e} - {r}, 2)))" for e, r in PERF}
PERF_ENDS = {f"{n}_{w}": f"{f}({n}, t)" for n in ("kalman_bias_deg_s", "kalman_angle_deg") for w, f in (("start", "arg_min"), ("end", "arg_max"))}


@query("imu_filter_performance", f"WITH {RECURSIVE} SELECT run_id, {sql_out(PERF_OUT | PERF_ENDS, 5)} FROM est GROUP BY run_id")
def imu_filter_performance(spark, sf):
    df = filtered(spark, sf)
    ends = df.groupBy("run_id").agg(
        *[f(n, "time_sec").alias(f"{n}_{w}") for n in ("kalman_bias_deg_s", "kalman_angle_deg") for w, f in (("start", F.min_by), ("end", F.max_by))]
    )
    return out(I.filter_performance(df, PERF).join(ends, "run_id"), PERF_OUT | PERF_ENDS, "run_id", digits=5)


ADAPT = {
    "adaptive_alpha_min": "min(adaptive_alpha)", "adaptive_alpha_max": "max(adaptive_alpha)", "adaptive_alpha_mean": "avg(adaptive_alpha)",
    "fraction_alpha_high_accel": f"avg(CASE WHEN adaptive_alpha > {D(0.98)} THEN 1.0 ELSE 0.0 END)", "acc_error_mean": "avg(acc_error_from_g)",
    "acc_error_max": "max(acc_error_from_g)", "acc_error_p95": "quantile_cont(acc_error_from_g, 0.95)",
}


@query("imu_adaptive_summary", f"WITH {RECURSIVE} SELECT run_id, {sql_out(ADAPT)} FROM est GROUP BY run_id")
def imu_adaptive_summary(spark, sf):
    s = I.run_series(processed(spark, sf))
    return out(I.adaptive_summary(FI.adaptive(s, ["time_sec"])), ADAPT, "run_id")


@query("imu_adaptive_sweep")
def imu_adaptive_sweep(spark, sf):
    """Every setting on every run, the best first; checked by brute force in the tests."""
    s = I.run_series(processed(spark, sf))
    return FI.adaptive_sweep(s, [0.80, 0.85, 0.90, 0.95], [0.98, 0.99, 0.995], [1.0, 3.0, 5.0]).orderBy("run_id", "mean_rmse_deg")


@query("imu_adaptive_best_setting")
def imu_adaptive_best_setting(spark, sf):
    s = I.run_series(processed(spark, sf))
    sweep = FI.adaptive_sweep(s, [0.80, 0.85, 0.90, 0.95], [0.98, 0.99, 0.995], [1.0, 3.0, 5.0])
    return FI.best_setting(sweep, ["run_id"], "mean_rmse_deg", ["alpha_normal", "alpha_high_accel", "acc_threshold"])


@query("imu_kalman_sweep")
def imu_kalman_sweep(spark, sf):
    s = I.run_series(processed(spark, sf))
    return FI.kalman_sweep(s, "gyro_y_calibrated", "pitch_rad", [1e-6, 1e-5, 1e-4], [1e-8, 1e-7, 1e-6], [1e-4, 1e-3, 1e-2]).orderBy("run_id", "kalman_rmse_deg")


def oriented(spark, sf):
    """Runs with quaternion orientation, world acceleration and angle deltas."""
    s = number(I.run_series(cut(processed(spark, sf))), "_n")
    df = s.result().join(FI.quaternion_track(s, ["_n"]), ["run_id", "_n"]).drop("_n")
    s = I.run_series(cut(I.quaternion_columns(df)))
    return I.deltas(s, ["roll_deg", "pitch_deg", "gyro_roll_deg", "gyro_pitch_deg", "quat_roll_deg", "quat_pitch_deg", "quat_yaw_deg"])


QUAT = "RECURSIVE " + ALIGNED + """,
qd AS MATERIALIZED (
  SELECT run_id, rn, CASE WHEN th > 0 THEN cos(th / 2) ELSE 1 END AS dw, CASE WHEN th > 0 THEN cx * dt / th * sin(th / 2) ELSE 0 END AS dx,
    CASE WHEN th > 0 THEN cy * dt / th * sin(th / 2) ELSE 0 END AS dy, CASE WHEN th > 0 THEN cz * dt / th * sin(th / 2) ELSE 0 END AS dz
  FROM (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) * dt AS th FROM pr)
),
qt AS (
  SELECT run_id, rn, cos(roll / 2) * cos(pitch / 2) AS w, sin(roll / 2) * cos(pitch / 2) AS x, cos(roll / 2) * sin(pitch / 2) AS y, -sin(roll / 2) * sin(pitch / 2) AS z
  FROM pr WHERE rn = 1
  UNION ALL
  SELECT run_id, rn, a / n, b / n, c / n, d / n FROM (SELECT *, sqrt(a * a + b * b + c * c + d * d) AS n FROM (
    SELECT qd.run_id, qd.rn, w * dw - x * dx - y * dy - z * dz AS a, w * dx + x * dw + y * dz - z * dy AS b,
      w * dy - x * dz + y * dw + z * dx AS c, w * dz + x * dy - y * dx + z * dw AS d FROM qt JOIN qd ON qd.run_id = qt.run_id AND qd.rn = qt.rn + 1))
),
qe AS MATERIALIZED (
  SELECT pr.*, w, x, y, z, degrees(roll) AS roll_deg, degrees(pitch) AS pitch_deg, degrees(groll) AS gyro_roll_deg, degrees(gpitch) AS gyro_pitch_deg,
    degrees(atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))) AS quat_roll_deg, degrees(asin(greatest(-1, least(1, 2 * (w * y - z * x))))) AS quat_pitch_deg,
    degrees(atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))) AS quat_yaw_deg,
    (1 - 2 * (y * y + z * z)) * acc_x + 2 * (x * y - z * w) * acc_y + 2 * (x * z + y * w) * acc_z AS wx,
    2 * (x * y + z * w) * acc_x + (1 - 2 * (x * x + z * z)) * acc_y + 2 * (y * z - x * w) * acc_z AS wy,
    2 * (x * z - y * w) * acc_x + 2 * (y * z + x * w) * acc_y + (1 - 2 * (x * x + y * y)) * acc_z - CAST(9.80665 AS DOUBLE) AS lz
  FROM pr JOIN qt USING (run_id, rn)
),
q0 AS (SELECT *, sqrt(wx * wx + wy * wy + lz * lz) AS lin, """ + ", ".join(
    f"{n} - first({n}) OVER (PARTITION BY run_id ORDER BY t) AS {n.replace('_deg', '_delta_deg')}"
    for n in ("roll_deg", "pitch_deg", "gyro_roll_deg", "gyro_pitch_deg", "quat_roll_deg", "quat_pitch_deg", "quat_yaw_deg")
) + " FROM qe)"

QROWS = {"time_sec": "t", "q_w": "w", "q_x": "x", "q_y": "y", "q_z": "z", "quat_roll_deg": "quat_roll_deg", "quat_pitch_deg": "quat_pitch_deg", "quat_yaw_deg": "quat_yaw_deg",
         "linear_acc_world_x": "wx", "linear_acc_world_y": "wy", "linear_acc_world_z": "lz", "linear_acc_world_mag": "lin"}


@query("imu_quaternion_rows", f"WITH {QUAT} SELECT run_id, {sql_out(QROWS)} FROM q0")
def imu_quaternion_rows(spark, sf):
    return out(oriented(spark, sf).result(), QROWS, "run_id")


QSUM = {
    "quat_vs_euler_roll_rmse_deg": "sqrt(avg(pow(quat_roll_delta_deg - gyro_roll_delta_deg, 2)))", "quat_vs_euler_pitch_rmse_deg": "sqrt(avg(pow(quat_pitch_delta_deg - gyro_pitch_delta_deg, 2)))",
    "quat_vs_gravity_roll_rmse_deg": "sqrt(avg(pow(quat_roll_delta_deg - roll_delta_deg, 2)))", "quat_vs_gravity_pitch_rmse_deg": "sqrt(avg(pow(quat_pitch_delta_deg - pitch_delta_deg, 2)))",
    "quat_norm_min": "min(sqrt(w * w + x * x + y * y + z * z))", "quat_norm_max": "max(sqrt(w * w + x * x + y * y + z * z))",
    **{f"{n}_delta_end_deg": f"arg_max({n}_delta_deg, t)" for n in ("quat_roll", "gyro_roll", "roll", "quat_pitch", "gyro_pitch", "pitch", "quat_yaw")},
}


@query("imu_quaternion_summary", f"WITH {QUAT} SELECT run_id, {sql_out(QSUM)} FROM q0 GROUP BY run_id")
def imu_quaternion_summary(spark, sf):
    return out(I.quaternion_summary(oriented(spark, sf).result()), QSUM, "run_id")


LIN = {"linear_acc_mean": "avg(lin)", "linear_acc_std": "stddev_pop(lin)", "linear_acc_max": "max(lin)", "linear_acc_z_mean": "avg(lz)", "linear_acc_p95": "quantile_cont(lin, 0.95)"}


@query("imu_linear_acceleration", f"WITH {QUAT} SELECT run_id, {sql_out(LIN)} FROM q0 GROUP BY run_id")
def imu_linear_acceleration(spark, sf):
    return out(I.linear_acceleration_summary(oriented(spark, sf).result()), LIN, "run_id")


def labelled(spark, sf):
    s = I.labelled(oriented(spark, sf))
    return s.with_df(cut(s.df))


LABELS = QUAT + """,
sm_ AS (SELECT *, avg(lin) OVER v AS ls, avg(gyro_mag) OVER v AS gs FROM q0 WINDOW v AS (PARTITION BY run_id ORDER BY t ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)),
lb0 AS (SELECT *, CASE WHEN ls >= 8 THEN 'impact_or_shake' WHEN ls >= 4 THEN 'high_accel' WHEN ls >= 1 THEN 'motion' WHEN gs >= 0.05 THEN 'rotation'
    WHEN ls >= 0.35 THEN 'small_motion' WHEN ls < 0.35 THEN 'stationary' ELSE 'unknown' END AS event_label FROM sm_),
lb AS MATERIALIZED (SELECT *, CASE event_label WHEN 'motion' THEN 'active_motion' WHEN 'high_accel' THEN 'active_motion' ELSE event_label END AS event_group FROM lb0),
stp AS (SELECT run_id, median(dt) AS step FROM lb WHERE rn > 1 GROUP BY run_id)"""


@query("imu_motion_labels", f"WITH {LABELS} SELECT run_id, {settle('t', 6)} AS time_sec, {settle('ls', 5)} AS linear_acc_world_mag_smooth, {settle('gs', 5)} AS gyro_mag_smooth, event_label, event_group FROM lb")
def imu_motion_labels(spark, sf):
    return labelled(spark, sf).result().select(
        "run_id", settled(c("time_sec"), 6).alias("time_sec"), *[settled(c(n), 5).alias(n) for n in ("linear_acc_world_mag_smooth", "gyro_mag_smooth")], "event_label", "event_group"
    )


@query(
    "imu_label_histogram",
    f"""WITH {LABELS} SELECT run_id, event_label, count(*) AS event_count, {settle('(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY run_id))', 4)} AS event_percentage
        FROM lb GROUP BY run_id, event_label""",
)
def imu_label_histogram(spark, sf):
    return out(I.label_histogram(labelled(spark, sf).result()), ["event_percentage"], "run_id", "event_label", "event_count", digits=4)


def _seg_sql(label):
    return f"""(SELECT run_id, sid, any_value({label}) AS {label}, min(t) AS a, max(t) AS b, count(*) AS sample_count, max(lin) AS ml, avg(lin) AS al, max(ls) AS mls, avg(ls) AS als,
      max(gyro_mag) AS mg, avg(gyro_mag) AS ag, max(gs) AS mgs, avg(gs) AS ags FROM (
        SELECT *, sum(ch) OVER (PARTITION BY run_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS sid FROM (
          SELECT *, CASE WHEN {label} IS DISTINCT FROM lag({label}) OVER (PARTITION BY run_id ORDER BY t) THEN 1 ELSE 0 END AS ch FROM lb)) GROUP BY run_id, sid)"""


SEG = {"start_time_sec": "a", "end_time_sec": "b", "duration_sec": "(b - a + step)", "max_linear_acc_world_mag": "ml", "mean_linear_acc_world_mag": "al",
       "max_linear_acc_world_mag_smooth": "mls", "mean_linear_acc_world_mag_smooth": "als", "max_gyro_mag": "mg", "mean_gyro_mag": "ag", "max_gyro_mag_smooth": "mgs", "mean_gyro_mag_smooth": "ags"}
TINY = "CAST(coalesce(b - a + step < 0.15, false) AS INTEGER) AS is_tiny_segment"


def _segment_rows(df, label):
    return out(df, SEG, "run_id", "segment_id", label, "sample_count", c("is_tiny_segment").cast("int").alias("is_tiny_segment"), digits=5)


@query("imu_label_segments", f"WITH {LABELS} SELECT run_id, CAST(sid AS BIGINT) AS segment_id, event_label, sample_count, {sql_out(SEG, 5)}, {TINY} FROM {_seg_sql('event_label')} JOIN stp USING (run_id)")
def imu_label_segments(spark, sf):
    return _segment_rows(I.segments(labelled(spark, sf), "event_label"), "event_label")


@query("imu_group_segments", f"WITH {LABELS} SELECT run_id, CAST(sid AS BIGINT) AS segment_id, event_group, sample_count, {sql_out(SEG, 5)}, {TINY} FROM {_seg_sql('event_group')} JOIN stp USING (run_id)")
def imu_group_segments(spark, sf):
    return _segment_rows(I.segments(labelled(spark, sf), "event_group"), "event_group")


def _island(source):
    return f"""SELECT run_id, CAST(sum(ch) OVER (PARTITION BY run_id ORDER BY a) AS BIGINT) AS sid, lab, a, b, n FROM (
      SELECT *, CASE WHEN lab IS DISTINCT FROM lag(lab) OVER (PARTITION BY run_id ORDER BY a) THEN 1 ELSE 0 END AS ch FROM {source})"""


def _merge_sql():
    """The passes one after the other, each from the segments the last one left."""
    parts = ["g0 AS MATERIALIZED (SELECT run_id, sid, any_value(lab) AS lab, min(a) AS a, max(b) AS b, sum(n) AS n FROM ("
             + _island("(SELECT run_id, event_group AS lab, t AS a, t AS b, 1 AS n FROM lb)") + ") GROUP BY run_id, sid)"]
    for i in range(1, I.MERGE_PASSES + 1):
        parts.append(
            f"""m{i} AS (SELECT run_id, a, b, n, CASE WHEN dur < 0.15 AND lab <> 'impact_or_shake' THEN coalesce(CASE WHEN pl IS NULL THEN nl WHEN nl IS NULL OR pl = nl OR pd >= nd THEN pl ELSE nl END, lab) ELSE lab END AS lab
              FROM (SELECT *, lag(lab) OVER v AS pl, lag(dur) OVER v AS pd, lead(lab) OVER v AS nl, lead(dur) OVER v AS nd
                FROM (SELECT g.*, b - a + step AS dur FROM g{i - 1} g JOIN stp USING (run_id)) WINDOW v AS (PARTITION BY run_id ORDER BY a)))"""
        )
        parts.append(f"g{i} AS MATERIALIZED (SELECT run_id, sid, any_value(lab) AS lab, min(a) AS a, max(b) AS b, sum(n) AS n FROM ({_island(f'm{i}')}) GROUP BY run_id, sid)")
    return ", ".join(parts)


MERGED = LABELS + ", " + _merge_sql()
LAST = f"g{I.MERGE_PASSES}"


def merged(spark, sf):
    return I.merged_labels(labelled(spark, sf), "event_group", "event_group_clean")


@query("imu_clean_segments", f"WITH {MERGED} SELECT run_id, sid AS segment_id, lab AS event_group_clean, CAST(n AS BIGINT) AS sample_count, {sql_out({'start_time_sec': 'a', 'end_time_sec': 'b', 'duration_sec': '(b - a + step)'}, 5)}, {TINY} FROM {LAST} JOIN stp USING (run_id)")
def imu_clean_segments(spark, sf):
    return out(
        merged(spark, sf), ["start_time_sec", "end_time_sec", "duration_sec"], "run_id", "segment_id", "event_group_clean", "sample_count",
        c("is_tiny_segment").cast("int").alias("is_tiny_segment"), digits=5,
    )


@query(
    "imu_run_summary",
    f"""WITH {MERGED}, f AS (SELECT run_id, count(*) AS fine_segments, count(*) FILTER (WHERE b - a + step < 0.15) AS fine_tiny_segments FROM {_seg_sql('event_label')} JOIN stp USING (run_id) GROUP BY run_id),
        g AS (SELECT run_id, count(*) AS group_segments, count(*) FILTER (WHERE b - a + step < 0.15) AS group_tiny_segments FROM {_seg_sql('event_group')} JOIN stp USING (run_id) GROUP BY run_id),
        k AS (SELECT run_id, count(*) AS clean_segments, count(*) FILTER (WHERE b - a + step < 0.15) AS clean_tiny_segments FROM {LAST} JOIN stp USING (run_id) GROUP BY run_id),
        s AS (SELECT run_id, count(*) AS sample_count FROM lb GROUP BY run_id) SELECT * FROM s JOIN f USING (run_id) JOIN g USING (run_id) JOIN k USING (run_id)""",
)
def imu_run_summary(spark, sf):
    s = labelled(spark, sf)
    return I.run_summary(s.df, I.segments(s, "event_label"), I.segments(s, "event_group"), I.merged_labels(s, "event_group", "event_group_clean"))


def expected_rows(spark, sf):
    """Four expected stretches per run, of labels that change with the run."""
    runs = samples(spark, sf).select("run_id").distinct()
    names = F.array(*[F.lit(n) for n in P.EXPECTED])
    return runs.withColumn("row_id", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
        "run_id",
        "row_id",
        (c("row_id") * 0.6).alias("start_time_sec"),
        (c("row_id") * 0.6 + 0.7).alias("end_time_sec"),
        F.element_at(names, ((c("run_id") + c("row_id") * 3) % len(P.EXPECTED) + 1).cast("int")).alias("expected_label"),
    )


_ALLOWED = " UNION ALL ".join(f"SELECT '{k}' AS expected_label, '{v}' AS lab" for k, vs in P.EXPECTED.items() if vs for v in vs)
PROTOCOL = MERGED + f""",
names AS (SELECT unnest([{', '.join(repr(n) for n in P.EXPECTED)}]) AS expected_label, unnest(range({len(P.EXPECTED)})) AS i),
allowed AS ({_ALLOWED}),
ex AS (SELECT run_id, row_id, row_id * {D(0.6)} AS a, row_id * {D(0.6)} + {D(0.7)} AS b, expected_label
  FROM (SELECT DISTINCT run_id FROM smp) CROSS JOIN (SELECT unnest(range(4)) AS row_id) JOIN names ON i = (run_id + row_id * 3) % {len(P.EXPECTED)}),
ov AS (SELECT run_id, row_id, expected_label, lab, sum(o) AS o, min(s) AS s FROM (
  SELECT ex.run_id, row_id, expected_label, lab, least(ex.b, g.b) - greatest(ex.a, g.a) AS o, g.a AS s FROM ex JOIN {LAST} g ON g.run_id = ex.run_id AND ex.a < g.b AND g.a < ex.b) WHERE o > 0 GROUP BY ALL),
hit AS (SELECT run_id, row_id, sum(o) AS h FROM ov JOIN allowed USING (expected_label, lab) GROUP BY ALL),
top AS (SELECT run_id, row_id, lab AS dominant, o AS top_o FROM ov QUALIFY row_number() OVER (PARTITION BY run_id, row_id ORDER BY o DESC, s) = 1),
res AS (
  SELECT ex.*, coalesce(dominant, 'none') AS dominant, coalesce(top_o, 0) AS top_o, expected_label NOT IN ('transition', 'ignore') AS checked, coalesce(h, 0) AS h
  FROM ex LEFT JOIN hit USING (run_id, row_id) LEFT JOIN top USING (run_id, row_id)
),
fin AS (SELECT *, CASE WHEN NOT checked THEN 'ignored' WHEN expected_label IN ('impact', 'impact_or_shake', 'marker') THEN CASE WHEN h >= 0.01 THEN 'pass' ELSE 'fail' END
  WHEN h / (b - a) >= 0.5 THEN 'pass' ELSE 'fail' END AS status FROM res)"""
CHECKED = {"start_time_sec": "a", "end_time_sec": "b", "dominant_overlap_sec": "top_o", "allowed_overlap_sec": "(CASE WHEN checked THEN h ELSE 0 END)", "match_fraction": "(CASE WHEN checked THEN h / (b - a) END)"}


@query(
    "protocol_rejected",
    f"""WITH {PROTOCOL}, br AS (SELECT run_id, row_id, CASE WHEN run_id % 2 = 0 AND row_id = 3 THEN a - {D(0.1)} ELSE b END AS b, a,
          CASE WHEN run_id % 3 = 0 AND row_id = 2 THEN 'unheard of' WHEN run_id % 3 = 1 AND row_id = 1 THEN NULL ELSE expected_label END AS expected_label FROM ex)
        SELECT run_id, row_id, coalesce(expected_label, '-') AS expected_label, {sql_out({'start_time_sec': 'a', 'end_time_sec': 'b'}, 5)} FROM br
        WHERE NOT coalesce(b > a AND expected_label IN ({', '.join(repr(n) for n in P.EXPECTED)}), false)""",
)
def protocol_rejected(spark, sf):
    """Protocol rows with a broken rule, some of which are broken here on purpose."""
    label = F.when((c("run_id") % 3 == 0) & (c("row_id") == 2), "unheard of").when((c("run_id") % 3 != 1) | (c("row_id") != 1), c("expected_label"))
    end = F.when((c("run_id") % 2 == 0) & (c("row_id") == 3), c("start_time_sec") - 0.1).otherwise(c("end_time_sec"))
    _, broken = P.usable_rows(expected_rows(spark, sf).withColumns({"expected_label": label, "end_time_sec": end}))
    return out(broken.fillna("-", ["expected_label"]), ["start_time_sec", "end_time_sec"], "run_id", "row_id", "expected_label", digits=5)


def checked(spark, sf):
    rows, _ = P.usable_rows(expected_rows(spark, sf))
    return P.check(rows, cut(merged(spark, sf)), "event_group_clean")


@query("protocol_check", f"WITH {PROTOCOL} SELECT run_id, row_id, expected_label, dominant AS dominant_detected_label, status, {sql_out(CHECKED, 5)} FROM fin")
def protocol_check(spark, sf):
    return out(checked(spark, sf), CHECKED, "run_id", "row_id", "expected_label", "dominant_detected_label", "status", digits=5)


@query(
    "protocol_summary",
    f"""WITH {PROTOCOL} SELECT count(*) AS protocol_rows, count(*) FILTER (WHERE status <> 'ignored') AS evaluated_rows, count(*) FILTER (WHERE status = 'ignored') AS ignored_rows,
        count(*) FILTER (WHERE status = 'pass') AS passed_rows, count(*) FILTER (WHERE status = 'fail') AS failed_rows,
        {settle("(count(*) FILTER (WHERE status = 'pass') / count(*) FILTER (WHERE status <> 'ignored'))", 6)} AS pass_rate FROM fin""",
)
def protocol_summary(spark, sf):
    done = P.summary(checked(spark, sf))
    return done.withColumn("pass_rate", settled(c("pass_rate"), 6))


# --- position tracks: value as position reading, k as velocity reading --------------------


def tracks(spark, sf):
    s = samples(spark, sf).select(
        "run_id", "event_id", "time_sec", (c("value") / 10.0).alias("position"), (c("k") / 50.0 - 1.0).alias("velocity"),
        F.when(c("event_type") == "click", c("value") / 10.0).alias("gps"), (c("k") / 10.0).alias("true_position"),
    )
    return FI.with_dt(arrange(s, ["run_id"], ["time_sec", "event_id"]), "time_sec")


def _cov_recursion(name, q, updates, source="trk"):
    """Two-state filter with scalar updates one after the other, as a recursive table."""
    q00, q01, q11 = q
    first = {"p": (D(10) + f" + {D(0.01)} * 10 + {q00}", f"{D(1)} + {q01}", f"{D(10)} + {q11}")}
    steps = {}
    for start in (True, False):
        body = (
            f"SELECT *, {D(0)} AS y0, {D(0)} AS y1, {first['p'][0]} AS a, {first['p'][1]} AS b, {first['p'][2]} AS d FROM {source} WHERE rn = 1"
            if start
            else f"""SELECT t.*, x0 + {D(0.1)} * x1 AS y0, x1 AS y1, p00 + 2 * {D(0.1)} * p01 + {D(0.01)} * p11 + {q00} AS a, p01 + {D(0.1)} * p11 + {q01} AS b, p11 + {q11} AS d
                FROM {name} f JOIN {source} t ON t.run_id = f.run_id AND t.rn = f.rn + 1"""
        )
        for column, index, r in updates:
            if index == 0:
                s, k0, k1, inn = f"(a + {r})", f"a / (a + {r})", f"b / (a + {r})", f"({column} - y0)"
                na, nb, nd = f"a - a * a / {s}", f"b - a * b / {s}", f"d - b * b / {s}"
            else:
                s, k0, k1, inn = f"(d + {r})", f"b / (d + {r})", f"d / (d + {r})", f"({column} - y1)"
                na, nb, nd = f"a - b * b / {s}", f"b - b * d / {s}", f"d - d * d / {s}"
            pick = lambda new, old: f"CASE WHEN {column} IS NULL THEN {old} ELSE {new} END AS {old}"
            body = f"""SELECT * EXCLUDE (y0, y1, a, b, d), {pick(f'y0 + {k0} * {inn}', 'y0')}, {pick(f'y1 + {k1} * {inn}', 'y1')}, {pick(na, 'a')}, {pick(nb, 'b')}, {pick(nd, 'd')} FROM ({body})"""
        steps[start] = f"SELECT run_id, rn, y0 AS x0, y1 AS x1, a AS p00, b AS p01, d AS p11 FROM ({body})"
    return f"{name} AS ({steps[True]} UNION ALL {steps[False]})"


TRACKS = "RECURSIVE " + EVENTS + f""",
trk AS MATERIALIZED (SELECT user_id AS run_id, event_id, (epoch_us(ts) - {EPOCH_US}) / 1e12 AS t, value / {D(10)} AS position, k / {D(50)} - 1 AS velocity,
  CASE WHEN event_type = 'click' THEN value / {D(10)} END AS gps, k / {D(10)} AS true_position, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM ev)"""
DT = 0.1
ACC_Q = FI.acceleration_noise(DT)
ACC_Q_SQL = tuple(f"CAST({v!r} AS DOUBLE)" for v in (float(ACC_Q[0, 0]), float(ACC_Q[0, 1]), float(ACC_Q[1, 1])))
TRACK_OUT = {"estimated_position": "x0", "estimated_velocity": "x1", "position_uncertainty": "sqrt(p00)"}

VARIANTS = {
    "track_position_only": (ACC_Q, ACC_Q_SQL, [("position", 0, 4.0)]),
    "track_two_sensors": (ACC_Q, ACC_Q_SQL, [("position", 0, 4.0), ("velocity", 1, 0.25)]),
    "track_intermittent_gps": (np.diag(FI.TRACK_Q), (D(0.02), D(0), D(0.05)), [("velocity", 1, 0.25), ("gps", 0, 4.0)]),
}


def estimated(spark, sf, variant):
    q, _, measured = VARIANTS[variant]
    return FI.track(tracks(spark, sf), ["event_id"], DT, q, measured)


def _register(variant):
    _, q_sql, measured = VARIANTS[variant]
    recursion = _cov_recursion("kf", q_sql, [(n, i, D(r)) for n, i, r in measured])

    @query(variant, f"WITH {TRACKS}, {recursion} SELECT run_id, event_id, {sql_out(TRACK_OUT, 5)} FROM kf JOIN trk USING (run_id, rn)")
    def run(spark, sf):
        return out(estimated(spark, sf, variant), TRACK_OUT, "run_id", "event_id", digits=5)


for _v in VARIANTS:
    _register(_v)

DEAD = """dr AS (SELECT *, coalesce(sum(pv * CAST(0.1 AS DOUBLE)) OVER (PARTITION BY run_id ORDER BY rn ROWS UNBOUNDED PRECEDING), 0) AS dead
  FROM (SELECT *, lag(velocity) OVER (PARTITION BY run_id ORDER BY rn) AS pv FROM trk))"""


def dead_reckoned(spark, sf):
    """Position from the previous row's velocity, step by step."""
    from sensorlith.operators.series import running_sum

    s = shift(tracks(spark, sf), {"_v": c("velocity")})
    return running_sum(s, {"dead_reckoned_position": F.coalesce(c("_v"), F.lit(0.0)) * DT}).result()


@query("track_dead_reckoning", f"WITH {TRACKS}, {DEAD} SELECT run_id, event_id, {settle('dead', 6)} AS dead_reckoned_position FROM dr")
def track_dead_reckoning(spark, sf):
    return out(dead_reckoned(spark, sf), ["dead_reckoned_position"], "run_id", "event_id")


REPORT = {
    "dead_reckoning_position_rmse": "sqrt(avg(pow(dead - true_position, 2)))", "gps_position_rmse": "sqrt(avg(pow(gps - true_position, 2)))",
    "kalman_position_rmse": "sqrt(avg(pow(x0 - true_position, 2)))", "velocity_sensor_rmse": "sqrt(avg(pow(velocity - 0.5, 2)))", "fused_velocity_rmse": "sqrt(avg(pow(x1 - 0.5, 2)))",
    "mean_uncertainty": "avg(sqrt(p00))",
}
_GPS = _cov_recursion("kf", VARIANTS["track_intermittent_gps"][1], [(n, i, D(r)) for n, i, r in VARIANTS["track_intermittent_gps"][2]])


@query(
    "track_error_report",
    f"""WITH {TRACKS}, {DEAD}, {_GPS} SELECT run_id, {sql_out(REPORT, 5)}, arg_max(event_id, abs(x0 - true_position)) AS worst_event_id FROM dr JOIN kf USING (run_id, rn) GROUP BY run_id""",
)
def track_error_report(spark, sf):
    df = dead_reckoned(spark, sf).join(estimated(spark, sf, "track_intermittent_gps"), ["run_id", "event_id"])
    truth = c("true_position")
    rep = df.groupBy("run_id").agg(
        rmse(c("dead_reckoned_position") - truth).alias("dead_reckoning_position_rmse"),
        rmse(c("gps") - truth).alias("gps_position_rmse"),
        rmse(c("estimated_position") - truth).alias("kalman_position_rmse"),
        rmse(c("velocity") - 0.5).alias("velocity_sensor_rmse"),
        rmse(c("estimated_velocity") - 0.5).alias("fused_velocity_rmse"),
        F.avg("position_uncertainty").alias("mean_uncertainty"),
        F.max_by("event_id", F.abs(c("estimated_position") - truth)).alias("worst_event_id"),
    )
    return out(rep, REPORT, "run_id", "worst_event_id", digits=5)


@query(
    "quaternion_functions",
    f"""WITH {EVENTS}, a AS (SELECT event_id, (k - 50) / {D(40)} AS r, (value - 100) / {D(400)} AS p, (k % 17 - 8) / {D(3)} AS y FROM ev)
        SELECT event_id, {sql_out({'roll': 'r', 'pitch': 'p', 'yaw': 'y'})}, {D(1)} AS norm FROM a""",
)
def quaternion_functions(spark, sf):
    """Angles to a quaternion and back, by way of a product with the unit rotation."""
    e = events(spark, sf)
    r, p, y = (c("k") - 50) / 40.0, (c("value") - 100.0) / 400.0, (c("k") % 17 - 8) / 3.0
    zero = F.lit(0.0)
    q = rotation.multiply(rotation.from_euler(r, p, y), rotation.from_rate(zero, zero, zero, F.lit(0.1)))
    e = e.withColumns(dict(zip(("qw", "qx", "qy", "qz"), q)))
    q = tuple(c(n) for n in ("qw", "qx", "qy", "qz"))
    roll, pitch, yaw = rotation.to_euler(q)
    norm = F.sqrt(sum((x * x for x in q), F.lit(0.0)))
    return e.select("event_id", *[settled(v, 6).alias(n) for n, v in (("roll", roll), ("pitch", pitch), ("yaw", yaw), ("norm", norm))])
