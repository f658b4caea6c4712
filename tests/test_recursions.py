"""Array scans against plain loops, whole and cut."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorlith.operators import recursions as R
from sensorlith.operators.series import arrange
from sensorlith.plans import filters as FI
from sensorlith.plans import rovers as RV
from sensorlith.plans import signals as S


@pytest.fixture(scope="module")
def run(spark):
    rng = np.random.default_rng(11)
    n = 120
    pdf = pd.DataFrame(
        {
            "run_id": np.where(np.arange(n) < 90, 1, 2),
            "time_sec": np.cumsum(rng.uniform(0.01, 0.2, n)),
            "gyro_x_calibrated": rng.normal(0, 0.5, n),
            "gyro_y_calibrated": rng.normal(0, 0.5, n),
            "gyro_z_calibrated": rng.normal(0, 0.5, n),
            "roll_rad": rng.normal(0, 0.4, n),
            "pitch_rad": rng.normal(0, 0.4, n),
            "acc_mag": rng.normal(9.8, 4.0, n),
            "gps": np.where(rng.random(n) < 0.3, rng.normal(0, 2, n), np.nan),
            "velocity": rng.normal(1, 0.5, n),
        }
    )
    df = spark.createDataFrame(pdf).withColumn("gps", F.when(~F.isnan("gps"), F.col("gps")))
    return pdf, df


def series(df):
    return FI.with_dt(arrange(df, ["run_id"], ["time_sec"]), "time_sec")


def by_run(out, *names):
    return out.orderBy("run_id", "time_sec").toPandas()[list(names)].to_numpy()


def loop(pdf, start, step):
    out = []
    for _, g in pdf.groupby("run_id"):
        dt = np.diff(g["time_sec"], prepend=g["time_sec"].iloc[0])
        state = None
        for i, row in enumerate(g.itertuples()):
            state = start(row) if state is None else step(state, row, dt[i])
            out.append(state)
    return out


@pytest.mark.parametrize("cut", [False, True])
def test_complementary_and_adaptive(run, cut, request):
    if cut:
        request.getfixturevalue("cut_series")
    pdf, df = run
    start = lambda r: np.array([r.roll_rad, r.pitch_rad])

    def fixed(x, r, dt):
        return 0.98 * (x + np.array([r.gyro_x_calibrated, r.gyro_y_calibrated]) * dt) + 0.02 * np.array([r.roll_rad, r.pitch_rad])

    got = by_run(FI.complementary(series(df), ["time_sec"]), "fused_roll_rad", "fused_pitch_rad")
    np.testing.assert_allclose(got, np.array(loop(pdf, start, fixed)), atol=1e-10)

    def adaptive(x, r, dt):
        a = 0.85 if abs(r.acc_mag - 9.80665) < 5.0 else 0.98
        return a * (x + np.array([r.gyro_x_calibrated, r.gyro_y_calibrated]) * dt) + (1 - a) * np.array([r.roll_rad, r.pitch_rad])

    want = np.array(loop(pdf, start, adaptive))
    got = by_run(FI.adaptive(series(df), ["time_sec"]), "adaptive_fused_roll_rad", "adaptive_fused_pitch_rad")
    np.testing.assert_allclose(got, want, atol=1e-10)
    sweep = FI.adaptive_sweep(series(df), [0.85, 0.9], [0.98], [5.0]).filter("alpha_normal = 0.85").orderBy("run_id").toPandas()
    for i, (_, g) in enumerate(pdf.groupby("run_id")):
        error = np.degrees(want[g.index, 0] - g["roll_rad"])
        assert sweep["roll_rmse_deg"].iloc[i] == pytest.approx(np.sqrt(np.mean(error**2)))


def kalman_loop(pdf, r=1e-3, q=(1e-5, 1e-7)):
    out = []
    for _, g in pdf.groupby("run_id"):
        dt = np.diff(g["time_sec"], prepend=g["time_sec"].iloc[0])
        x, p = np.array([g["pitch_rad"].iloc[0], 0.0]), np.eye(2)
        for d, u, z in zip(dt, g["gyro_y_calibrated"], g["pitch_rad"]):
            f = np.array([[1.0, -d], [0.0, 1.0]])
            x, p = f @ x + np.array([d * u, 0.0]), f @ p @ f.T + np.diag(q)
            gain = p[:, 0] / (p[0, 0] + r)
            x, p = x + gain * (z - x[0]), p - np.outer(gain, p[0])
            out.append(x)
    return np.array(out)


@pytest.mark.parametrize("cut", [False, True])
def test_kalman_angle_bias_and_sweep(run, cut, request):
    if cut:
        request.getfixturevalue("cut_series")
    pdf, df = run
    want = kalman_loop(pdf)
    got = by_run(FI.kalman_angle_bias(series(df), ["time_sec"], "gyro_y_calibrated", "pitch_rad"), "kalman_angle_rad", "kalman_bias_rad_s")
    np.testing.assert_allclose(got, want, atol=1e-9)
    sweep = FI.kalman_sweep(series(df), "gyro_y_calibrated", "pitch_rad", [1e-5], [1e-7], [1e-3, 1e-2]).orderBy("run_id", "r_measurement").toPandas()
    assert len(sweep) == 4
    other = kalman_loop(pdf, r=1e-2)
    for i, (_, g) in enumerate(pdf.groupby("run_id")):
        for j, x in enumerate((want, other)):
            error = np.degrees(x[g.index, 0] - g["pitch_rad"])
            assert sweep["kalman_rmse_deg"].iloc[2 * i + j] == pytest.approx(np.sqrt(np.mean(error**2)))
            assert sweep["bias_end_deg_s"].iloc[2 * i + j] == pytest.approx(np.degrees(x[g.index[-1], 1]))
    best = FI.best_setting(FI.kalman_sweep(series(df), "gyro_y_calibrated", "pitch_rad", [1e-5], [1e-7], [1e-3, 1e-2]), ["run_id"], "kalman_rmse_deg", ["r_measurement"])
    assert best.count() == 2


@pytest.mark.parametrize("cut", [False, True])
def test_intermittent_track(run, cut, request):
    if cut:
        request.getfixturevalue("cut_series")
    pdf, df = run
    got = by_run(
        FI.track(series(df), ["time_sec"], 0.1, np.diag(FI.TRACK_Q), [("velocity", 1, 0.25), ("gps", 0, 4.0)]),
        "estimated_position", "estimated_velocity", "position_uncertainty",
    )
    want = []
    for _, g in pdf.groupby("run_id"):
        x, p, f = np.zeros(2), 10 * np.eye(2), np.array([[1, 0.1], [0, 1]])
        for v, z in zip(g["velocity"], g["gps"]):
            x, p = f @ x, f @ p @ f.T + np.diag([0.02, 0.05])
            for i, m, r in ((1, v, 0.25), (0, z, 4.0)):
                if not np.isnan(m):
                    k = p[:, i] / (p[i, i] + r)
                    x, p = x + k * (m - x[i]), p - np.outer(k, p[i])
            want.append([*x, np.sqrt(p[0, 0])])
    np.testing.assert_allclose(got, np.array(want), atol=1e-9)


@pytest.mark.parametrize("cut", [False, True])
def test_quaternions_stay_unit_and_match_a_loop(run, cut, request):
    if cut:
        request.getfixturevalue("cut_series")
    pdf, df = run
    got = by_run(FI.quaternion_track(series(df), ["time_sec"]), "q_w", "q_x", "q_y", "q_z")
    np.testing.assert_allclose(np.linalg.norm(got, axis=1), 1.0, atol=1e-12)

    def start(r):
        cr, sr, cp, sp = np.cos(r.roll_rad / 2), np.sin(r.roll_rad / 2), np.cos(r.pitch_rad / 2), np.sin(r.pitch_rad / 2)
        return np.array([cr * cp, sr * cp, cr * sp, -sr * sp])

    def step(q, r, dt):
        w = np.array([r.gyro_x_calibrated, r.gyro_y_calibrated, r.gyro_z_calibrated]) * dt
        a = np.linalg.norm(w)
        d = np.r_[np.cos(a / 2), w / a * np.sin(a / 2)]
        out = np.r_[q[0] * d[0] - q[1:] @ d[1:], q[0] * d[1:] + d[0] * q[1:] + np.cross(q[1:], d[1:])]
        return out / np.linalg.norm(out)

    np.testing.assert_allclose(got, np.array(loop(pdf, start, step)), atol=1e-10)


@pytest.mark.parametrize("cut", [False, True])
def test_highpass_against_sample_loop(spark, cut, request):
    if cut:
        request.getfixturevalue("cut_series")
    rng = np.random.default_rng(3)
    lengths = [16] * 69 + [7]
    blocks = [rng.normal(0, 1, m).tolist() for m in lengths]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(blocks)], "source string, block_idx long, samples array<double>")
    b, a = S.highpass_coefficients(4, 150.0, 1000.0)
    # Known properties: nothing of a constant passes, everything of the fastest wave does.
    assert abs(b.sum()) < 1e-9 and (b * (-1.0) ** np.arange(5)).sum() / (a * (-1.0) ** np.arange(5)).sum() == pytest.approx(1.0)
    x, y = np.concatenate(blocks), np.zeros(sum(lengths))
    for i in range(len(x)):
        y[i] = sum(b[k] * x[i - k] for k in range(5) if i >= k) - sum(a[k] * y[i - k] for k in range(1, 5) if i >= k)
    got = S.highpass_energy(arrange(df, ["source"], ["block_idx"]), b, a).orderBy("block_idx").toPandas()["energy"]
    np.testing.assert_allclose(np.concatenate(got.to_list()), y * y, atol=1e-9)


@pytest.mark.parametrize("cut", [False, True])
def test_gps_correction_against_a_loop(spark, cut, request):
    if cut:
        request.getfixturevalue("cut_series")
    rng = np.random.default_rng(4)
    n = 80
    pdf = pd.DataFrame({"run_id": 1, "time_sec": np.arange(n) * 0.1, "left_mps": rng.uniform(0, 1, n), "right_mps": rng.uniform(0, 1, n)})
    fix = rng.random(n) < 0.3
    pdf["gps_x"], pdf["gps_y"] = np.where(fix, rng.normal(0, 1, n), np.nan), np.where(fix, rng.normal(0, 1, n), np.nan)
    df = spark.createDataFrame(pdf)
    got = FI.gps_correction(arrange(df, ["run_id"], ["time_sec"]), ["time_sec"]).orderBy("time_sec").toPandas()
    wrap = lambda v: (v + np.pi) % (2 * np.pi) - np.pi
    pose, last, want = np.zeros(3), None, []
    for r in pdf.itertuples():
        v, w = (r.left_mps + r.right_mps) / 2, (r.right_mps - r.left_mps) / 0.42
        mid = pose[2] + w * 0.05
        pose = np.array([pose[0] + v * np.cos(mid) * 0.1, pose[1] + v * np.sin(mid) * 0.1, wrap(pose[2] + w * 0.1)])
        if not np.isnan(r.gps_x):
            pose[:2] += 0.55 * (np.array([r.gps_x, r.gps_y]) - pose[:2])
            if last is not None and np.hypot(r.gps_x - last[0], r.gps_y - last[1]) >= 0.18:
                pose[2] = wrap(pose[2] + 0.45 * wrap(np.arctan2(r.gps_y - last[1], r.gps_x - last[0]) - pose[2]))
            last = (r.gps_x, r.gps_y)
        want.append(pose.copy())
    np.testing.assert_allclose(got[["corrected_x", "corrected_y", "corrected_yaw"]], np.array(want), atol=1e-9)


@pytest.mark.parametrize("cut", [False, True])
def test_detector_keeps_every_event(spark, cut, request):
    """Quiet noise with three bursts, two of them closer together than a clip is long."""
    if cut:
        request.getfixturevalue("cut_series")
    cfg = S.Detector(rate_hz=1280.0, block=64, calibration_sec=8.0)
    rng = np.random.default_rng(8)
    x = rng.normal(0, 0.01, 64 * 280)
    for at in (200, 220, 260):
        x[at * 64 + 10 : at * 64 + 50] += 1.0
    df = spark.createDataFrame([("s", i, x[i * 64 : i * 64 + 64].tolist()) for i in range(280)], "source string, block_idx long, samples array<double>")
    env = S.envelope(arrange(S.squared(df), ["source"], ["block_idx"]), cfg.envelope_samples)
    trace = S.detect(S.block_features(env.result(), cfg), cfg)
    lengths = df.groupBy("source").agg(F.sum(F.size("samples")).alias("n_samples"))
    ev = S.event_records(trace, lengths, cfg).orderBy("event_id").toPandas()
    assert (ev["trigger_sample"] // 64).tolist() == [200, 220, 260]
    clips = {r["event_id"]: r["pcm"] for r in S.clips(S.event_records(trace, lengths, cfg), df, cfg).collect()}
    for e in ev.itertuples():
        part = x[e.clip_start_sample : e.clip_end_sample]
        want = (np.clip(part - part.mean(), -1, 1) * 32767.0).astype(np.int16)
        np.testing.assert_allclose(np.array(clips[e.event_id]), want, atol=1)


def test_highpass_does_not_leak_between_sources(spark):
    """Source b lacks its first block; what came before it in the task is another source's."""
    rng = np.random.default_rng(4)
    rows = [("a", i, (1000 * rng.normal(size=16)).tolist()) for i in range(4)] + [("b", i, [0.0] * 16) for i in (1, 2, 4)]
    df = spark.createDataFrame(rows, "source string, block_idx long, samples array<double>").coalesce(1)
    b, a = S.highpass_coefficients(4, 100.0, 1000.0)
    got = S.highpass_energy(arrange(df, ["source"], ["block_idx"]), b, a).filter("source = 'b'").collect()
    assert len(got) == 3 and all(v == 0.0 for r in got for v in r["energy"])


def turn_loop(rows, trigger, clear):
    turn, out = 0.0, []
    for front, left, right in rows:
        forward = False
        if np.isnan(front):
            pass
        elif turn:
            if front > clear:
                turn, forward = 0.0, True
        elif front > trigger:
            forward = True
        elif not (np.isnan(left) and np.isnan(right)):
            turn = -1.0 if np.isnan(left) or (not np.isnan(right) and right > left) else 1.0
        out.append((turn, forward))
    return out


@pytest.mark.parametrize("cut", [False, True])
def test_turn_states_against_a_loop(spark, cut, request):
    if cut:
        request.getfixturevalue("cut_series")
    rng = np.random.default_rng(5)
    frames = []
    for robot, n in ((1, 150), (2, 1), (3, 40)):
        values = rng.uniform(0, 1, (n, 3))
        values[rng.random((n, 3)) < 0.2] = np.nan
        frames.append(pd.DataFrame(values, columns=["front", "left", "right"]).assign(robot_id=robot, ts=np.arange(n) * 0.1))
    pdf = pd.concat(frames, ignore_index=True)
    got = RV.turn_states(spark.createDataFrame(pdf).repartition(3), 0.4, 0.6).orderBy("robot_id", "ts").toPandas()
    want = [x for _, g in pdf.groupby("robot_id") for x in turn_loop(g[["front", "left", "right"]].to_numpy(), 0.4, 0.6)]
    assert [tuple(x) for x in got[["turn", "forward"]].itertuples(index=False)] == want


def test_folds_of_sixteen_parts_run_few_rows_again(spark):
    """The detector forgets, so a part that is entered anew meets its first run again after some hundred rows."""
    rng = np.random.default_rng(7)
    cfg = S.Detector(rate_hz=640.0, block=64, calibration_sec=8.0)
    n = 16 * 1600
    rows = [("s", i, 64, float(p), 3, float(sc), float(m), float(g), bool(o)) for i, p, sc, m, g, o in zip(range(n), rng.random(n), np.where(rng.random(n) < 0.002, 9.0, rng.random(n)), 0.2 + 0.01 * rng.random(n), 0.05 + 0.01 * rng.random(n), rng.random(n) < 0.9)]
    df = spark.createDataFrame(rows, "source string, block_idx long, length long, peak double, peak_idx long, score double, median double, sigma double, gate boolean")
    folded = spark.sparkContext.accumulator(0)

    def fold(pdf, state):
        folded.add(len(pdf))
        state, out = tuple(state) if state is not None else S.START, []
        for row in pdf[S.INPUTS].itertuples(index=False, name=None):
            state, trace = S.detector_step(cfg, state, row)
            out.append(trace)
        return pd.DataFrame(out, columns=S.TRACE.names).astype({"trigger_sample": "Int64"}), list(state)

    s = arrange(df, ["source"], ["block_idx"])
    parts = R.cut(df.repartitionByRange(16, "source", "block_idx").withColumn(R.PART, F.spark_partition_id()))
    cut_up = R.run_fold(replace(s, df=parts, parts=16), fold, S.TRACE, S.quiet_state).orderBy("block_idx").toPandas()
    print(f"rows folded on 16 parts: {folded.value} of {n}")
    assert n < folded.value <= 2 * n
    whole = R.run_fold(s, fold, S.TRACE).orderBy("block_idx").toPandas()
    pd.testing.assert_frame_equal(cut_up, whole)
    assert whole["trigger_sample"].notna().sum() > 10


def test_short_series_of_a_fold_share_batches(spark):
    """Series without number: a fold's state ends with its series, goes on over batches, and large keys beside a null stay whole."""
    import pandas as pd
    from pyspark.sql import types as T

    from sensorlith.operators import recursions as R
    from sensorlith.operators.series import arrange

    def fold(pdf, state):
        sums = (0.0 if state is None else state[0]) + pdf["v"].cumsum()
        return pd.DataFrame({"t": pdf["t"], "sum": sums})[lambda x: x["t"] % 2 == 1], [float(sums.iloc[-1])]

    df = spark.sql("SELECT CASE WHEN id % 7 = 0 THEN NULL ELSE 9007199254740993 + id % 7 END AS k, id AS t, CAST(id AS DOUBLE) AS v FROM range(210)")
    plan = R.run_fold(arrange(df, ["k"], ["t"]), fold, T.StructType([T.StructField("t", T.LongType()), T.StructField("sum", T.DoubleType())]))
    assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        got = sorted(map(str, plan.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(None if i % 7 == 0 else 9007199254740993 + i % 7, i, float(sum(range(i % 7, i + 1, 7)))) for i in range(1, 210, 2)]
    assert got == sorted(f"Row(k={k}, t={t}, sum={v})" for k, t, v in want)
