"""Energy-based event detection over block-wise signals of many sources.

A signal is a table of blocks: source, block_idx, samples (array). Heavy array work is done
per block in parallel; what runs in order is one small row of features per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlith.operators import recursions as R
from sensorlith.operators.quantiles import join_on_keys, percentiles
from sensorlith.operators.series import Series, arrange, rolling, shift

# Fixed value: MAD to standard deviation for normal noise.
MAD_SIGMA = 1.4826


@dataclass(frozen=True)
class Detector:
    """The detector's settings; rate and block size are those of the signal."""

    rate_hz: float
    block: int
    envelope_ms: float = 10.0
    threshold_sigmas: float = 6.0
    hysteresis: float = 0.6
    refractory_sec: float = 0.75
    calibration_sec: float = 3.0
    pre_sec: float = 0.5
    post_sec: float = 1.5
    noise_tau_sec: float = 2.0
    cutoff_hz: float = 150.0
    order: int = 4
    score_percentile: float = 95.0
    min_sigma: float = 1e-12
    slope_sigmas: float = 4.0

    @property
    def alpha(self) -> float:
        return min(max(self.block / self.rate_hz / self.noise_tau_sec, 0.001), 0.05)

    @property
    def envelope_samples(self) -> int:
        return max(int(self.rate_hz * self.envelope_ms / 1000.0), 1)


DOUBLES = T.ArrayType(T.DoubleType())


def highpass_coefficients(order: int, cutoff_hz: float, rate_hz: float) -> tuple[np.ndarray, np.ndarray]:
    """Digital Butterworth high-pass: analog prototype poles, inverted in frequency, bilinear transform."""
    warped = 2.0 * rate_hz * np.tan(np.pi * cutoff_hz / rate_hz)
    k = np.arange(1, order + 1)
    poles = warped / np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    digital = (2.0 * rate_hz + poles) / (2.0 * rate_hz - poles)
    gain = np.real(np.prod(2.0 * rate_hz / (2.0 * rate_hz - poles)))
    return gain * np.real(np.poly(np.ones(order))), np.real(np.poly(digital))


def _after_gap(blocks: Series) -> Series:
    """``_anew``: the block before is missing, or there is none."""
    s = shift(blocks, {"_before": F.struct(F.col("block_idx").alias("i"))})
    return s.with_df(s.df.withColumn("_anew", ~F.coalesce(F.col("_before.i") == F.col("block_idx") - 1, F.lit(False))).drop("_before"))


def highpass_energy(blocks: Series, b: np.ndarray, a: np.ndarray) -> DataFrame:
    """Filter each source's samples through (b, a) and square them; state carries over block ends.

    The filter state after a block is an affine function of the state before it, so blocks
    are composed as affine maps; samples of all blocks of a batch advance together.
    """
    n = len(a) - 1
    # the filter starts anew with a source and after missing blocks, whatever stands before in the task
    blocks = _after_gap(blocks)
    transition = np.zeros((n, n))
    transition[:, 0] = -a[1:]
    transition[: n - 1, 1:] = np.eye(n - 1)
    drive = b[1:] - a[1:] * b[0]

    def run(pdf: pd.DataFrame, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = pdf["samples"].map(len).to_numpy()
        x = np.zeros((len(pdf), lengths.max()))
        for i, v in enumerate(pdf["samples"]):
            x[i, : len(v)] = v
        y = np.zeros_like(x)
        for j in range(x.shape[1]):
            y[:, j] = b[0] * x[:, j] + state[:, 0]
            step = state @ transition.T + x[:, j, None] * drive
            state = np.where((j < lengths)[:, None], step, state)
        return y, state, lengths

    def elements(pdf: pd.DataFrame) -> R.Element:
        _, left, lengths = run(pdf, np.zeros((len(pdf), n)))
        powers = {m: np.linalg.matrix_power(transition, int(m)) for m in np.unique(lengths)}
        first = pdf["_anew"].to_numpy(bool)[:, None, None]
        return np.where(first, 0.0, np.stack([powers[m] for m in lengths])), left

    def compose(first: R.Element, then: R.Element) -> R.Element:
        return then[0] @ first[0], np.einsum("...ij,...j->...i", then[0], first[1]) + then[1]

    def emit(state: R.Element, pdf: pd.DataFrame, entering: R.Element) -> pd.DataFrame:
        entered = np.concatenate([entering[1], state[1][:-1]])
        entered[pdf["_anew"].to_numpy(bool)] = 0.0
        y, _, lengths = run(pdf, entered)
        return pdf[["block_idx"]].assign(energy=[(v[:m] * v[:m]).tolist() for v, m in zip(y, lengths)])

    scan = R.Scan(elements, compose, (np.eye(n), np.zeros(n)), emit)
    schema = T.StructType([blocks.df.schema["block_idx"], T.StructField("energy", DOUBLES)])
    return R.run_scan(blocks, scan, schema)


class BlockFilter:
    """The same filter for one block after the other: what comes out, and the state that is left, are sums over the
    block's samples and the state before it, whose factors are the same for all blocks of one length."""

    def __init__(self, b: np.ndarray, a: np.ndarray) -> None:
        self.order = len(a) - 1
        self.b, self.a = b, a
        self.known: dict[int, tuple[np.ndarray, ...]] = {}

    def _factors(self, length: int) -> tuple[np.ndarray, ...]:
        if length not in self.known:
            n = self.order
            transition = np.zeros((n, n))
            transition[:, 0] = -self.a[1:]
            transition[: n - 1, 1:] = np.eye(n - 1)
            drive = self.b[1:] - self.a[1:] * self.b[0]
            powers = [np.eye(n)]
            for _ in range(length):
                powers.append(transition @ powers[-1])
            answer = np.array([self.b[0], *[(p @ drive)[0] for p in powers[: length - 1]]])
            self.known[length] = answer, np.array([p[0] for p in powers[:length]]), np.stack([p @ drive for p in powers[length - 1 :: -1]], axis=1), powers[length]
        return self.known[length]

    def __call__(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(x):
            return x, state
        answer, seen, kept, over = self._factors(len(x))
        return np.convolve(x, answer)[: len(x)] + seen @ state, over @ state + kept @ x


def squared(blocks: DataFrame) -> DataFrame:
    """Energy without the high-pass."""
    return blocks.withColumn("energy", F.transform("samples", lambda x: x.cast("double") * x.cast("double"))).drop("samples")


@F.pandas_udf(DOUBLES)
def _trailing_mean(energy: pd.Series, before: pd.Series, width: pd.Series) -> pd.Series:
    out = []
    for now, past, m in zip(energy, before, width):
        tail = np.zeros(m - 1)
        if past is not None and m > 1:
            past = np.asarray(past)[-(m - 1) :]
            tail[len(tail) - len(past) :] = past
        out.append(np.convolve(np.concatenate([tail, now]), np.full(m, 1.0 / m), "valid"))
    return pd.Series(out)


def envelope(blocks: Series, width: int) -> Series:
    """Mean of the last ``width`` energies, zeros before the start, as arrays per block.

    Reaches into one previous block; wider means go through ``trailing_mean`` on sample rows.
    """
    s = shift(_after_gap(blocks), {"_past": F.col("energy")})
    s = s.with_df(s.df.withColumn("_past", F.when(~F.col("_anew"), F.col("_past"))).drop("_anew"))
    short = F.when(F.size("_past") < width - 1, F.raise_error(F.lit("blocks are shorter than the envelope window")))
    env = _trailing_mean("energy", "_past", F.lit(width))
    return s.with_df(s.df.withColumn("envelope", F.when(F.col("_past").isNull() | short.isNull(), env)).drop("_past"))


def sample_rows(blocks: DataFrame, column: str, block: int) -> DataFrame:
    """One row per sample with its position in the source."""
    return blocks.select("source", "block_idx", F.posexplode(column).alias("_p", "x")).select(
        "source", (F.col("block_idx") * block + F.col("_p")).alias("sample"), "x"
    )


def trailing_mean(s: Series, column: str, width: int, name: str) -> Series:
    """Mean over the last ``width`` rows; rows before the start count as zero."""
    return rolling(s, width - 1, 0, {name: lambda w: F.sum(column).over(w) / width})


def centred_mean(s: Series, column: str, width: int, name: str) -> Series:
    """Zero-padded centred mean as a same-length convolution gives it: width/2 rows back, (width−1)/2 ahead."""
    return rolling(s, width // 2, (width - 1) // 2, {name: lambda w: F.sum(column).over(w) / width})


FEATURES = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("peak", "score", "median", "sigma", "slope_peak", "slope_limit")]
    + [T.StructField("peak_idx", T.LongType()), T.StructField("length", T.LongType())]
)


def block_features(blocks: DataFrame, cfg: Detector) -> DataFrame:
    """Peak, its place, score percentile, median and MAD-based sigma of each block's envelope; steepest slope and its limit."""

    def robust(x: np.ndarray) -> tuple[float, float]:
        med = float(np.median(x))
        return med, max(float(MAD_SIGMA * np.median(np.abs(x - med))), cfg.min_sigma)

    def one(x: np.ndarray) -> tuple:
        peak = int(np.argmax(x))
        med, sigma = robust(x)
        slope = np.diff(x)
        steep = float(slope.max()) if slope.size else 0.0
        limit = sum(w * v for w, v in zip((1.0, cfg.slope_sigmas), robust(slope))) if slope.size else 0.0
        return float(x[peak]), float(np.percentile(x, cfg.score_percentile)), med, sigma, steep, limit, peak, len(x)

    @F.pandas_udf(FEATURES)
    def features(env: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(np.asarray(v)) for v in env], columns=FEATURES.names)

    return blocks.select("source", "block_idx", features("envelope").alias("f")).select("source", "block_idx", "f.*")


def slope_gate() -> Column:
    """True where the steepest rise is unusual for its block, and where there is no slope to judge."""
    return (F.col("slope_peak") > F.col("slope_limit")) | (F.col("length") < 2)


TRACE = T.StructType(
    [T.StructField("block_idx", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in ("threshold_high", "threshold_low", "noise_mu", "noise_sigma")]
    + [T.StructField("armed", T.BooleanType()), T.StructField("in_event", T.BooleanType()), T.StructField("trigger_sample", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in ("score", "peak")]
)

START = (0.0, 0.0, 0.0, 0.0, -1e18)


def detector_step(cfg: Detector, state: tuple, row: tuple, gate: bool = False) -> tuple[tuple, tuple]:
    """One block: (mu, sigma, armed, in_event, last trigger) and (block_idx, length, peak, peak_idx, score, median, sigma, gate open)."""
    mu, sigma, armed, inside, last = state
    block_idx, length, peak, peak_idx, score, med, spread, opened = row
    sigma = sigma or cfg.min_sigma
    start = int(block_idx) * cfg.block
    end = start + int(length)
    learned = (
        (1.0 - cfg.alpha) * mu + cfg.alpha * med,
        max((1.0 - cfg.alpha) * sigma + cfg.alpha * spread, cfg.min_sigma),
    )
    if not armed:
        mu, sigma = learned
    high = mu + cfg.threshold_sigmas * sigma
    low = mu + cfg.hysteresis * cfg.threshold_sigmas * sigma
    trigger, was = None, (mu, sigma)
    was_armed = bool(armed)
    if not armed:
        armed = float(end >= int(cfg.calibration_sec * cfg.rate_hz))
    elif inside:
        inside = 0.0 if score < low else 1.0
    elif score > high and end - last > int(cfg.refractory_sec * cfg.rate_hz) and (opened or not gate):
        trigger, inside = start + int(peak_idx), 1.0
        last = float(trigger)
    else:
        mu, sigma = learned
    if end - last > int(cfg.refractory_sec * cfg.rate_hz):
        last = START[-1]  # long past: it holds nothing back any more, whenever it was
    trace = (int(block_idx), high, low, *was, was_armed, bool(inside), trigger, score, peak)
    return (mu, sigma, float(armed), float(inside), last), trace


INPUTS = ["block_idx", "length", "peak", "peak_idx", "score", "median", "sigma", "gate"]


def quiet_state(rows: pd.DataFrame) -> list[float]:
    """Noise as the middle of these blocks has it, armed, no event."""
    return [float(rows["median"].median()), float(rows["sigma"].median()), 1.0, 0.0, START[-1]]


def detect(features: DataFrame, cfg: Detector, gate: bool = False) -> DataFrame:
    """Threshold trace of every block; a trigger sample marks an event.

    Noise is learned until armed and then on quiet blocks only. An event starts when the
    score passes the high threshold after the refractory time and lasts until the score
    falls below the low one.
    """
    df = features.withColumn("gate", slope_gate()).select("source", *INPUTS)

    def fold(pdf: pd.DataFrame, state) -> tuple[pd.DataFrame, list[float]]:
        state, rows = tuple(state) if state is not None else START, []
        for row in pdf[INPUTS].itertuples(index=False, name=None):
            state, trace = detector_step(cfg, state, row, gate)
            rows.append(trace)
        out = pd.DataFrame(rows, columns=TRACE.names)
        return out.astype({"trigger_sample": "Int64"}), list(state)

    return R.run_fold(arrange(df, ["source"], ["block_idx"]), fold, TRACE, quiet_state)


def event_records(trace: DataFrame, lengths: DataFrame, cfg: Detector) -> DataFrame:
    """One record per event with its clip bounds. ``lengths`` has the samples of each source.

    Every trigger is kept, also one that comes before the last one's clip is complete.
    """
    from sensorlith.operators.series import number

    hits = trace.filter("trigger_sample is not null")
    s = number(arrange(hits, ["source"], ["trigger_sample"]), "event_id")
    pre, post = int(cfg.rate_hz * cfg.pre_sec), int(cfg.rate_hz * cfg.post_sec)
    joined = s.result().join(lengths, "source")
    start = F.greatest(F.col("trigger_sample") - pre, F.lit(0))
    end = F.least(F.col("trigger_sample") + post, F.col("n_samples"))
    return joined.select(
        "source",
        "event_id",
        "trigger_sample",
        "score",
        "peak",
        "threshold_high",
        "threshold_low",
        "noise_mu",
        "noise_sigma",
        (F.col("trigger_sample") / cfg.rate_hz).alias("trigger_time_sec"),
        start.alias("clip_start_sample"),
        end.alias("clip_end_sample"),
        (start / cfg.rate_hz).alias("clip_start_time_sec"),
        (end / cfg.rate_hz).alias("clip_end_time_sec"),
    )


def pcm_of(clip: np.ndarray) -> np.ndarray:
    """A clip without its mean, limited to ±1, as 16-bit integers."""
    return (np.clip(clip - clip.mean(), -1.0, 1.0) * 32767.0).astype(np.int16) if len(clip) else np.zeros(0, np.int16)


def clips(events: DataFrame, blocks: DataFrame, cfg: Detector) -> DataFrame:
    """Samples of each event's clip without their mean, limited to ±1, as 16-bit integers.

    Events name the few blocks their clip touches and meet them by an equi-join; a clip's
    length is bounded by the settings.
    """
    spans = events.select(
        "source",
        "event_id",
        "clip_start_sample",
        "clip_end_sample",
        F.explode(
            F.sequence(F.floor(F.col("clip_start_sample") / cfg.block), F.floor((F.col("clip_end_sample") - 1) / cfg.block))
        ).alias("block_idx"),
    )
    begin = F.col("block_idx") * cfg.block
    first = F.greatest(F.col("clip_start_sample") - begin, F.lit(0))
    last = F.least(F.col("clip_end_sample") - begin, F.size("samples"))
    parts = spans.join(blocks, ["source", "block_idx"]).select(
        "source", "event_id", "block_idx", F.slice("samples", (first + 1).cast("int"), F.greatest(last - first, F.lit(0)).cast("int")).alias("part")
    )
    whole = parts.groupBy("source", "event_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", "part"))).alias("_p"))
    whole = whole.withColumn("clip", F.flatten(F.transform("_p", lambda p: F.transform(p["part"], lambda x: x.cast("double")))))
    mean = F.aggregate("clip", F.lit(0.0), lambda acc, x: acc + x) / F.size("clip")
    pcm = lambda x, m: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x - m)) * 32767.0).cast("int").cast("short")
    return whole.withColumn("_m", mean).withColumn("pcm", F.transform("clip", lambda x: pcm(x, F.col("_m")))).select("source", "event_id", "pcm")


def whole_signal_event(samples: DataFrame, width: int, rate_hz: float, sigmas: float = 6.0) -> DataFrame:
    """One event per source from the first to the last place where the smoothed energy passes a robust threshold."""
    s = arrange(samples.withColumn("_e", F.col("x") * F.col("x")), ["source"], ["sample"])
    env = centred_mean(s, "_e", width, "envelope").result()
    med = percentiles(env, ["source"], {"_med": ("envelope", 0.5)})
    env = env.join(med, "source").withColumn("_dev", F.abs(F.col("envelope") - F.col("_med")))
    mad = percentiles(env, ["source"], {"_mad": ("_dev", 0.5)})
    limits = join_on_keys(med, mad, ["source"]).select(
        "source", (F.col("_med") + sigmas * MAD_SIGMA * F.col("_mad")).alias("threshold")
    )
    over = env.select("source", "sample", "envelope").join(limits, "source").filter(F.col("envelope") > F.col("threshold"))
    out = over.groupBy("source", "threshold").agg(
        F.min("sample").alias("start_sample"), F.max("sample").alias("end_sample"), F.max("envelope").alias("score")
    )
    return out.withColumns(
        {
            "start_time_sec": F.col("start_sample") / rate_hz,
            "end_time_sec": F.col("end_sample") / rate_hz,
            "duration_sec": (F.col("end_sample") - F.col("start_sample")) / rate_hz,
            "confidence": F.least(F.lit(1.0), F.col("score") / (F.col("threshold") + 1e-12) / 3.0),
        }
    )


def pcm_to_float(raw: np.ndarray) -> np.ndarray:
    """Samples of a file to one channel within about ±1: by type, other integers by their largest value."""
    kind = raw.dtype
    x = raw.mean(axis=1) if raw.ndim == 2 else raw.astype(float)
    full = {"int16": 2.0**15, "int32": 2.0**31}.get(kind.name)
    if kind.name == "uint8":
        x = (x - 128.0) / 128.0
    elif full:
        x = x / full
    elif kind.kind != "f":
        x = x / (np.abs(x).max(initial=0.0) or 1.0)
    return np.where(np.isfinite(x), x, 0.0)


def iter_blocks(samples: np.ndarray, block: int) -> Iterator[tuple[int, list[float]]]:
    for i in range(0, len(samples), block):
        yield i // block, samples[i : i + block].tolist()
