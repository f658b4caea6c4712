"""Orientation and position estimators over many runs."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlith.functions.units import STANDARD_GRAVITY
from sensorlith.operators import recursions as R
from sensorlith.operators.series import Series, shift

# Filter settings.
ALPHA = 0.98
ALPHA_NORMAL, ALPHA_HIGH, ACC_LIMIT = 0.85, 0.98, 5.0
Q_ANGLE, Q_BIAS, R_MEASUREMENT = 1e-5, 1e-7, 1e-3
SIGMA_ACCELERATION = 0.5
TRACK_Q = (0.02, 0.05)
PRIOR_VARIANCE = 10.0


def doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def with_dt(s: Series, time: str) -> Series:
    """Time since the previous row as ``dt``, 0 on the first, and ``is_first``."""
    s = shift(s, {"_t0": F.col(time)})
    return s.with_df(
        s.df.withColumns({"dt": F.coalesce(F.col(time) - F.col("_t0"), F.lit(0.0)), "is_first": F.col("_t0").isNull()}).drop("_t0")
    )


def _per_run(pdf: pd.DataFrame, keys: Sequence[str], columns: dict[str, np.ndarray], settings: dict[str, np.ndarray]) -> pd.DataFrame:
    """Sum (rows × settings) arrays over the rows of each run in a sorted batch: one row per run and setting."""
    change = (pdf[list(keys)] != pdf[list(keys)].shift()).any(axis=1).to_numpy()
    start = np.flatnonzero(change)
    many = len(next(iter(settings.values())))
    out = {k: np.repeat(pdf[k].to_numpy()[start], many) for k in keys}
    out |= {n: np.tile(v, len(start)) for n, v in settings.items()}
    return pd.DataFrame(out | {n: np.add.reduceat(v, start, axis=0).ravel() for n, v in columns.items()})


def _first(pdf: pd.DataFrame) -> np.ndarray:
    return pdf["is_first"].to_numpy(dtype=bool)


def complementary(s: Series, row_id: Sequence[str], alpha: float = ALPHA) -> DataFrame:
    """Gyro steps corrected towards gravity; needs dt, is_first, gyro_?_calibrated, roll_rad, pitch_rad."""

    def elements(pdf):
        dt = pdf["dt"].to_numpy()[:, None]
        step = pdf[["gyro_x_calibrated", "gyro_y_calibrated"]].to_numpy() * dt
        return R.blend_elements(np.full_like(step, alpha), step, pdf[["roll_rad", "pitch_rad"]].to_numpy(), _first(pdf))

    def emit(state, pdf, _):
        x = state[1]
        return pdf[list(row_id)].assign(fused_roll_rad=x[:, 0], fused_pitch_rad=x[:, 1])

    scan = R.Scan(elements, R.affine_compose, R.affine_identity(2), emit)
    schema = T.StructType([s.df.schema[c] for c in row_id] + doubles("fused_roll_rad", "fused_pitch_rad").fields)
    return R.run_scan(s, scan, schema)


def adaptive(
    s: Series, row_id: Sequence[str], normal: float = ALPHA_NORMAL, high: float = ALPHA_HIGH, limit: float = ACC_LIMIT
) -> DataFrame:
    """As ``complementary``, trusting the gyro more while the acceleration is far from gravity."""

    def elements(pdf):
        dt = pdf["dt"].to_numpy()[:, None]
        step = pdf[["gyro_x_calibrated", "gyro_y_calibrated"]].to_numpy() * dt
        error = np.abs(pdf["acc_mag"].to_numpy() - STANDARD_GRAVITY)[:, None]
        alpha = np.where(error < limit, normal, high) * np.ones((1, 2))
        return R.blend_elements(alpha, step, pdf[["roll_rad", "pitch_rad"]].to_numpy(), _first(pdf))

    def emit(state, pdf, _):
        error = np.abs(pdf["acc_mag"].to_numpy() - STANDARD_GRAVITY)
        used = np.where(_first(pdf) | (error < limit), normal, high)
        x = state[1]
        return pdf[list(row_id)].assign(
            adaptive_fused_roll_rad=x[:, 0], adaptive_fused_pitch_rad=x[:, 1], adaptive_alpha=used, acc_error_from_g=error
        )

    scan = R.Scan(elements, R.affine_compose, R.affine_identity(2), emit)
    names = ("adaptive_fused_roll_rad", "adaptive_fused_pitch_rad", "adaptive_alpha", "acc_error_from_g")
    return R.run_scan(s, scan, T.StructType([s.df.schema[c] for c in row_id] + doubles(*names).fields))


def adaptive_sweep(s: Series, normals: Sequence[float], highs: Sequence[float], limits: Sequence[float]) -> DataFrame:
    """Error of every setting on every run in one pass: the settings are a second array axis, not more rows."""
    grid = np.array(list(product(normals, highs, limits)))

    def alphas(pdf):
        error = np.abs(pdf["acc_mag"].to_numpy() - STANDARD_GRAVITY)[:, None]
        return np.where(error < grid[:, 2], grid[:, 0], grid[:, 1])

    def elements(pdf):
        dt = pdf["dt"].to_numpy()[:, None, None]
        step = pdf[["gyro_x_calibrated", "gyro_y_calibrated"]].to_numpy()[:, :, None] * dt
        alpha = alphas(pdf)[:, None, :] * np.ones((1, 2, 1))
        ref = pdf[["roll_rad", "pitch_rad"]].to_numpy()[:, :, None] * np.ones((1, 1, len(grid)))
        start = _first(pdf)[:, None, None]
        return np.where(start, 0.0, alpha), np.where(start, ref, alpha * step + (1.0 - alpha) * ref)

    keys = s.keys

    def emit(state, pdf, _):
        squares = np.degrees(state[1] - pdf[["roll_rad", "pitch_rad"]].to_numpy()[:, :, None]) ** 2
        used = np.where(_first(pdf)[:, None], grid[:, 0], alphas(pdf))
        sums = {
            "roll_squares": squares[:, 0],
            "pitch_squares": squares[:, 1],
            "alpha_sum": used,
            "high_count": (used > 0.98).astype(float),
            "samples": np.ones_like(used),
        }
        return _per_run(pdf, keys, sums, dict(zip(("alpha_normal", "alpha_high_accel", "acc_threshold"), grid.T)))

    names = "alpha_normal alpha_high_accel acc_threshold roll_squares pitch_squares alpha_sum high_count samples".split()
    shape = (2, len(grid))
    scan = R.Scan(elements, R.affine_compose, (np.ones(shape), np.zeros(shape)), emit)
    parts = R.run_scan(s, scan, doubles(*names))
    root = lambda c: F.sqrt(F.sum(c) / F.sum("samples"))
    return parts.groupBy(*s.keys, *names[:3]).agg(
        root("roll_squares").alias("roll_rmse_deg"),
        root("pitch_squares").alias("pitch_rmse_deg"),
        ((root("roll_squares") + root("pitch_squares")) / 2.0).alias("mean_rmse_deg"),
        (F.sum("alpha_sum") / F.sum("samples")).alias("adaptive_alpha_mean"),
        (F.sum("high_count") / F.sum("samples")).alias("fraction_alpha_high_accel"),
    )


def _angle_bias_elements(pdf: pd.DataFrame, gyro: str, angle: str, settings: np.ndarray) -> R.Element:
    """settings: rows of (q_angle, q_bias, r)."""
    n, p = len(pdf), len(settings)
    dt = pdf["dt"].to_numpy()
    f = np.zeros((n, p, 2, 2))
    f[..., 0, 0] = f[..., 1, 1] = 1.0
    f[..., 0, 1] = -dt[:, None]
    u = np.zeros((n, p, 2))
    u[..., 0] = (pdf[gyro].to_numpy() * dt)[:, None]
    q = np.zeros((n, p, 2, 2))
    q[..., 0, 0], q[..., 1, 1] = settings[:, 0], settings[:, 1]
    z = pdf[angle].to_numpy()[:, None] * np.ones((1, p))
    h = np.broadcast_to(np.array([1.0, 0.0]), (n, p, 2))
    measured = R.measure_element(h, z, np.broadcast_to(settings[:, 2], (n, p)), np.ones((n, p), dtype=bool))
    steps = R.gaussian_compose(R.predict_element(f, u, q), measured)
    mean = np.stack([z, np.zeros_like(z)], axis=-1)
    return R.with_prior(steps, _first(pdf), mean, np.eye(2))


def kalman_angle_bias(
    s: Series, row_id: Sequence[str], gyro: str, angle: str, q_angle: float = Q_ANGLE, q_bias: float = Q_BIAS, r: float = R_MEASUREMENT
) -> DataFrame:
    """Angle and gyro bias from rate and measured angle."""
    settings = np.array([[q_angle, q_bias, r]])

    def emit(state, pdf, _):
        x = state[1][:, 0]
        return pdf[list(row_id)].assign(kalman_angle_rad=x[:, 0], kalman_bias_rad_s=x[:, 1])

    scan = R.Scan(lambda pdf: _angle_bias_elements(pdf, gyro, angle, settings), R.gaussian_compose, R.gaussian_identity((1,)), emit)
    return R.run_scan(s, scan, T.StructType([s.df.schema[c] for c in row_id] + doubles("kalman_angle_rad", "kalman_bias_rad_s").fields))


def kalman_sweep(
    s: Series, gyro: str, angle: str, q_angles: Sequence[float], q_biases: Sequence[float], rs: Sequence[float]
) -> DataFrame:
    settings = np.array(list(product(q_angles, q_biases, rs)))
    time = s.order[0]

    keys = s.keys

    def emit(state, pdf, _):
        x = state[1]
        squares = np.degrees(x[..., 0] - pdf[angle].to_numpy()[:, None]) ** 2
        last = (pdf[list(keys)] != pdf[list(keys)].shift(-1)).any(axis=1).to_numpy()[:, None]
        sums = {
            "squares": squares,
            "samples": np.ones_like(squares),
            "end_time": np.where(last, pdf[time].to_numpy()[:, None], np.zeros_like(squares)),
            "end_bias": np.where(last, np.degrees(x[..., 1]), 0.0),
        }
        return _per_run(pdf, keys, sums, dict(zip(("q_angle", "q_bias", "r_measurement"), settings.T)))

    names = "q_angle q_bias r_measurement squares samples end_time end_bias".split()
    scan = R.Scan(
        lambda pdf: _angle_bias_elements(pdf, gyro, angle, settings), R.gaussian_compose, R.gaussian_identity((len(settings),)), emit
    )
    return (
        R.run_scan(s, scan, doubles(*names))
        .groupBy(*s.keys, *names[:3])
        .agg(
            F.sqrt(F.sum("squares") / F.sum("samples")).alias("kalman_rmse_deg"),
            F.max_by("end_bias", "end_time").alias("bias_end_deg_s"),
        )
    )


def best_setting(sweep: DataFrame, keys: Sequence[str], error: str, settings: Sequence[str]) -> DataFrame:
    """The setting with the smallest error per run; among equals the smallest setting."""
    names = [c for c in sweep.columns if c not in keys]
    best = sweep.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(error, *settings)).alias("_b"))
    return best.select(*keys, "_b.*")


def _track_elements(
    pdf: pd.DataFrame, dt: float, q: np.ndarray, measured: Sequence[tuple[str, int, float]], prior: float
) -> R.Element:
    """Position and velocity at a fixed step; ``measured`` lists (column, state index, variance); null is no measurement."""
    n = len(pdf)
    f = np.broadcast_to(np.array([[1.0, dt], [0.0, 1.0]]), (n, 2, 2))
    steps = R.predict_element(f, np.zeros((n, 2)), np.broadcast_to(q, (n, 2, 2)))
    for column, index, variance in measured:
        z = pdf[column].to_numpy(dtype=float)
        h = np.zeros((n, 2))
        h[:, index] = 1.0
        steps = R.gaussian_compose(steps, R.measure_element(h, z, np.full(n, variance), ~np.isnan(z)))
    return R.with_prior(steps, _first(pdf), np.zeros((n, 2)), prior * np.eye(2))


def acceleration_noise(dt: float, sigma: float = SIGMA_ACCELERATION) -> np.ndarray:
    return sigma**2 * np.array([[dt**4 / 4.0, dt**3 / 2.0], [dt**3 / 2.0, dt**2]])


def track(
    s: Series,
    row_id: Sequence[str],
    dt: float,
    q: np.ndarray,
    measured: Sequence[tuple[str, int, float]],
    prior: float = PRIOR_VARIANCE,
) -> DataFrame:
    """Position and velocity estimate with its position uncertainty."""

    def emit(state, pdf, _):
        x, cov = state[1], state[2]
        return pdf[list(row_id)].assign(
            estimated_position=x[:, 0], estimated_velocity=x[:, 1], position_uncertainty=np.sqrt(cov[:, 0, 0])
        )

    scan = R.Scan(lambda pdf: _track_elements(pdf, dt, q, measured, prior), R.gaussian_compose, R.gaussian_identity(), emit)
    names = ("estimated_position", "estimated_velocity", "position_uncertainty")
    return R.run_scan(s, scan, T.StructType([s.df.schema[c] for c in row_id] + doubles(*names).fields))


def quaternion_track(s: Series, row_id: Sequence[str]) -> DataFrame:
    """Orientation from calibrated rates, starting at the first row's roll and pitch."""

    def elements(pdf):
        steps = R.rotation_steps(
            pdf[["gyro_x_calibrated", "gyro_y_calibrated", "gyro_z_calibrated"]].to_numpy(), pdf["dt"].to_numpy()
        )
        start = R.rotation_from_euler(pdf["roll_rad"].to_numpy(), pdf["pitch_rad"].to_numpy())
        first = _first(pdf)
        return np.where(first[:, None], start, steps), first.astype(float)

    def emit(state, pdf, _):
        q = state[0]
        return pdf[list(row_id)].assign(q_w=q[:, 0], q_x=q[:, 1], q_y=q[:, 2], q_z=q[:, 3])

    scan = R.Scan(elements, R.rotation_compose, R.rotation_identity(), emit)
    return R.run_scan(s, scan, T.StructType([s.df.schema[c] for c in row_id] + doubles("q_w", "q_x", "q_y", "q_z").fields))


def gps_correction(
    s: Series,
    row_id: Sequence[str],
    dt: float = 0.1,
    wheel_base_m: float = 0.42,
    position_gain: float = 0.55,
    yaw_gain: float = 0.45,
    min_move_m: float = 0.18,
) -> DataFrame:
    """Replay of logged wheel commands, pulled towards GPS fixes (left_mps, right_mps, gps_x, gps_y; no fix is null).

    Position takes a share of each fix; heading takes a share of the course between fixes far enough apart.
    """

    def wrap(a: float) -> float:
        return (a + np.pi) % (2 * np.pi) - np.pi

    def fold(pdf, state):
        x, y, yaw, last_x, last_y = state if state is not None else (0.0, 0.0, 0.0, np.nan, np.nan)
        out = np.empty((len(pdf), 3))
        for i, (left, right, gx, gy) in enumerate(pdf[["left_mps", "right_mps", "gps_x", "gps_y"]].to_numpy(dtype=float)):
            ahead, turn = (left + right) / 2.0 * dt, (right - left) / wheel_base_m * dt
            x, y, yaw = x + ahead * np.cos(yaw + turn / 2.0), y + ahead * np.sin(yaw + turn / 2.0), wrap(yaw + turn)
            if not np.isnan(gx):
                x, y = x + position_gain * (gx - x), y + position_gain * (gy - y)
                if not np.isnan(last_x) and np.hypot(gx - last_x, gy - last_y) >= min_move_m:
                    yaw = wrap(yaw + yaw_gain * wrap(np.arctan2(gy - last_y, gx - last_x) - yaw))
                last_x, last_y = gx, gy
            out[i] = x, y, yaw
        rows = pdf[list(row_id)].assign(corrected_x=out[:, 0], corrected_y=out[:, 1], corrected_yaw=out[:, 2])
        return rows, [x, y, yaw, last_x, last_y]

    schema = T.StructType([s.df.schema[c] for c in row_id] + doubles("corrected_x", "corrected_y", "corrected_yaw").fields)
    return R.run_fold(s, fold, schema)
