"""Keyed streaming operators. Keys share states by a hash, and a batch's rows of a state are put in order and worked on as columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from sensorlith.functions.scans import RESUME_DISTANCE_M, SCAN_TIMEOUT_S, STOP_DISTANCE_M
from sensorlith.plans.missions import ALERT_M, ALERT_SAMPLES
from sensorlith.plans.signals import BlockFilter, MAD_SIGMA, START, Detector, detector_step, pcm_of
from sensorlith.streaming.buckets import BUCKETS, Keys, Ranges, bucketed, ends, grown, newest, packed, starts, unpacked


def _ordered(batches: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(order, kind="stable").reset_index(drop=True)


def intervals(status: DataFrame, max_gap_s: float, buckets: int = BUCKETS) -> DataFrame:
    """Status rows (station_id, micros, status_class) to intervals between consecutive rows; the last row waits in state."""

    def step(key, batches, state):
        known, last, labels = state.get if state.exists else ([], b"", [])
        keys, waiting = Keys(key[0], known), len(known)
        rows = pd.concat(list(batches), ignore_index=True)
        numbers, micros = keys.numbers(rows["station_id"]), rows["micros"].astype("int64").to_numpy()
        order = np.lexsort((micros, numbers))
        # a row from the state comes before the batch's
        numbers = np.concatenate([np.arange(waiting), numbers[order]])
        micros = np.concatenate([np.frombuffer(last, dtype=np.int64), micros[order]])
        label = np.concatenate([np.array(labels, dtype=object), rows["status_class"].to_numpy(dtype=object)[order]])
        order = np.argsort(numbers, kind="stable")
        numbers, micros, label = numbers[order], micros[order], label[order]
        is_last = ends(numbers)
        state.update((keys.known, micros[is_last].tobytes(), label[is_last].tolist()))
        seconds = micros[1:] // 1_000_000 - micros[:-1] // 1_000_000
        keep = np.flatnonzero(~is_last[:-1] & (seconds > 0) & (seconds <= max_gap_s))
        yield pd.DataFrame(
            {
                "station_id": keys.of(numbers[keep]),
                "start_micros": micros[keep],
                "end_micros": micros[keep + 1],
                "duration_sec": seconds[keep],
                "status_class": label[keep],
            }
        )

    key_type = status.schema["station_id"].dataType.simpleString()
    return bucketed(status, "station_id", buckets).applyInPandasWithState(
        step,
        f"station_id {key_type}, start_micros long, end_micros long, duration_sec long, status_class string",
        f"stations array<{key_type}>, micros binary, labels array<string>",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def slip_alerts(samples: DataFrame, threshold_m: float = ALERT_M, consecutive: int = ALERT_SAMPLES, buckets: int = BUCKETS) -> DataFrame:
    """(run_id, event_time_s, sequence, innovation) to alerts: a counter of samples in a row and a latch per run."""

    def step(key, batches, state):
        known, counts = state.get if state.exists else ([], b"")
        keys = Keys(key[0], known)
        rows = pd.concat(list(batches), ignore_index=True).dropna(subset=["innovation"])
        numbers = keys.numbers(rows["run_id"])
        counts = grown(np.frombuffer(counts, dtype=np.int64), len(keys.known), 0)
        times, sequences = rows["event_time_s"].to_numpy(), rows["sequence"].to_numpy()
        order = np.lexsort((sequences, times, numbers))
        numbers, at = numbers[order], np.arange(len(order))
        above = rows["innovation"].to_numpy()[order] >= threshold_m
        begin = newest(starts(numbers))
        below = np.maximum(newest(~above), begin - 1)
        # what a run brings along counts until its first sample below the threshold
        count = at - below + np.where(below < begin, counts[numbers], 0)
        is_last = ends(numbers)
        # Beyond the limit the count only says that the latch is set.
        counts[numbers[is_last]] = np.minimum(count[is_last], consecutive + 1)
        state.update((keys.known, counts.tobytes()))
        hits = np.flatnonzero(count == consecutive)
        yield pd.DataFrame({"run_id": keys.of(numbers[hits]), "event_time_s": times[order][hits], "sequence": sequences[order][hits]})

    key_type = samples.schema["run_id"].dataType.simpleString()
    return bucketed(samples, "run_id", buckets).applyInPandasWithState(
        step, f"run_id {key_type}, event_time_s double, sequence long", f"runs array<{key_type}>, counts binary", "append", GroupStateTimeout.NoTimeout
    )


def guard(
    messages: DataFrame, time: str, lateness: str, stop_m: float = STOP_DISTANCE_M, resume_m: float = RESUME_DISTANCE_M, timeout_s: float = SCAN_TIMEOUT_S,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Scans and commands of each robot in one stream to what is sent on.

    Input: robot_id, ts, kind ('scan' or 'command'), front, linear_x, angular_z, and ``time``, the same as ``ts``.
    Output kinds: 'command' (guarded) and 'stop' (newly blocked, or the scans have gone stale). Messages wait until
    the watermark has passed them, and are taken in order. A timer in event time sends the stop of a robot that has
    fallen silent.
    """
    parts = {"ts": "f8", "is_scan": "?", "front": "f8", "linear_x": "f8", "angular_z": "f8"}

    def step(key, batches, state):
        known, blocked, last_scan, told_stale, owner, *kept = state.get if state.exists else ([], *[b""] * (4 + len(parts)))
        keys, owners = Keys(key[0], known), [np.frombuffer(owner, dtype="i4")]
        columns = {n: [np.frombuffer(v, dtype=t)] for (n, t), v in zip(parts.items(), kept)}
        if not state.hasTimedOut:
            for pdf in batches:
                owners.append(keys.numbers(pdf["robot_id"]))
                for n, t in parts.items():
                    columns[n].append(pdf[n].to_numpy(dtype=t))
        n_keys = len(keys.known)
        blocked = grown(np.frombuffer(blocked, dtype="?"), n_keys, True)
        last_scan = grown(np.frombuffer(last_scan, dtype="f8"), n_keys, np.nan)
        told_stale = grown(np.frombuffer(told_stale, dtype="?"), n_keys, False)
        limit = state.getCurrentWatermarkMs() / 1000.0
        robot, columns = np.concatenate(owners), {n: np.concatenate(v) for n, v in columns.items()}
        is_ready, waits = columns["ts"] <= limit, columns["ts"] > limit
        waiting = [robot[waits].astype("i4"), *(v[waits] for v in columns.values())]
        robot, (ts, is_scan, front, linear, angular) = robot[is_ready], (v[is_ready] for v in columns.values())
        order = np.lexsort((~is_scan, ts, robot))
        robot, ts, is_scan, front, linear, angular = (v[order] for v in (robot, ts, is_scan, front, linear, angular))

        # blocked after each message: the last scan outside the band decides, or what was known before
        closes = is_scan & (np.isnan(front) | (front <= stop_m))
        begin, decides = newest(starts(robot)), newest(closes | is_scan & (front >= resume_m))
        now_blocked = np.where(decides >= begin, closes[decides], blocked[robot])
        was = np.where(begin == np.arange(len(robot)), blocked[robot], np.roll(now_blocked, 1))
        stopped = is_scan & now_blocked & ~was
        scan = newest(is_scan)
        seen = np.where(scan >= begin, ts[scan], last_scan[robot])
        unsafe = now_blocked | np.isnan(seen) | (ts - seen > timeout_s)
        linear = np.where(unsafe & (linear > 0), 0.0, linear)
        is_last = ends(robot)
        blocked[robot[is_last]] = now_blocked[is_last]

        # a scan goes stale if the next one, or the end of what is known, is later than the timeout
        before = np.flatnonzero(~np.isnan(last_scan))
        scanner, at = np.concatenate([before, robot[is_scan]]), np.concatenate([last_scan[before], ts[is_scan]])
        told = np.concatenate([told_stale[before], np.zeros(is_scan.sum(), dtype=bool)])
        order = np.argsort(scanner, kind="stable")
        scanner, at, told = scanner[order], at[order], told[order]
        is_last = ends(scanner)
        stale = np.where(is_last, limit, np.roll(at, -1)) - at > timeout_s
        silent = stale & ~told
        last_scan[scanner[is_last]], told_stale[scanner[is_last]] = at[is_last], (stale | told)[is_last]

        state.update((keys.known, *(v.tobytes() for v in (blocked, last_scan, told_stale, *waiting))))
        open_scans = last_scan[~np.isnan(last_scan) & ~told_stale]
        timers = [*([waiting[1].min()] if len(waiting[1]) else []), *([open_scans.min() + timeout_s] if len(open_scans) else [])]
        if timers:
            state.setTimeoutTimestamp(max(int(min(timers) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        orders, n = ~is_scan, int(stopped.sum() + silent.sum())
        yield pd.DataFrame(
            {
                "robot_id": keys.of(np.concatenate([robot[orders], robot[stopped], scanner[silent]])),
                "ts": np.concatenate([ts[orders], ts[stopped], at[silent] + timeout_s]),
                "kind": ["command"] * int(orders.sum()) + ["stop"] * n,
                "linear_x": np.concatenate([linear[orders], np.zeros(n)]),
                "angular_z": np.concatenate([angular[orders], np.zeros(n)]),
            }
        )

    key_type = messages.schema["robot_id"].dataType.simpleString()
    is_scan = F.coalesce(F.col("kind") == "scan", F.lit(False)).alias("is_scan")
    rows = messages.select("robot_id", F.col("ts").cast("double").alias("ts"), is_scan, *[F.col(n).cast("double").alias(n) for n in ("front", "linear_x", "angular_z")], time)
    return bucketed(rows.withWatermark(time, lateness), "robot_id", buckets).applyInPandasWithState(
        step,
        f"robot_id {key_type}, ts double, kind string, linear_x double, angular_z double",
        f"robots array<{key_type}>, blocked binary, last_scan binary, told_stale binary, owner binary, " + ", ".join(f"{n} binary" for n in parts),
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def in_order(events: DataFrame, time: str, lateness: str, buckets: int = BUCKETS) -> DataFrame:
    """Late and mixed-up events (run_id, sequence, event_time_s) in order per run.

    Events wait in state until the watermark has passed them; then they come out by time and
    sequence, a sequence number seen before is marked, and missing numbers are counted.
    """

    def step(key, batches, state):
        known, owner, times, sequences, *seen = state.get if state.exists else ([], b"", b"", b"", *[packed(np.zeros(0))] * 3)
        keys = Keys(key[0], known)
        run, times, sequences = ([np.frombuffer(v, dtype=t)] for v, t in ((owner, "i4"), (times, "f8"), (sequences, "i8")))
        if not state.hasTimedOut:
            for pdf in batches:
                run.append(keys.numbers(pdf["run_id"]))
                times.append(pdf["event_time_s"].to_numpy(dtype="f8"))
                sequences.append(pdf["sequence"].astype("int64").to_numpy())
        limit = state.getCurrentWatermarkMs() / 1000.0
        run, t, q = (np.concatenate(v) for v in (run, times, sequences))
        is_ready, waits = t <= limit, t > limit
        waiting = run[waits].astype("i4"), t[waits], q[waits]
        run, t, q = run[is_ready], t[is_ready], q[is_ready]
        order = np.lexsort((q, t, run))
        run, t, q = run[order], t[order], q[order]

        again, missing = np.zeros(len(q), dtype=bool), np.zeros(len(q), dtype=np.int64)
        if len(q):
            owners, lows, lengths = (unpacked(v) for v in seen)
            ranges = Ranges(lows, lows + lengths, owners)
            # the highest number before each event; those of the state come first
            owners, highest = ranges.highest()
            again = ~ranges.add_all(run, q)
            both, numbers = np.concatenate([owners, run]), np.concatenate([highest, q])
            order = np.argsort(both, kind="stable")
            both, numbers = both[order], numbers[order]
            top = pd.Series(numbers).groupby(both).cummax().to_numpy()
            gap = np.empty(len(both), dtype=np.int64)
            gap[order] = np.where(starts(both), 0, np.maximum(0, numbers - np.roll(top, 1) - 1))
            missing = np.where(again, 0, gap[len(owners) :])
            seen = packed(ranges.keys), packed(ranges.lows), packed(ranges.highs - ranges.lows)
        state.update((keys.known, *(v.tobytes() for v in waiting), *seen))
        if len(waiting[1]):
            state.setTimeoutTimestamp(max(int(waiting[1].min() * 1000) + 1, int(limit * 1000) + 1))
        yield pd.DataFrame({"run_id": keys.of(run), "event_time_s": t, "sequence": q, "is_duplicate": again, "missing_before": missing})

    key_type = events.schema["run_id"].dataType.simpleString()
    rows = events.select("run_id", "sequence", "event_time_s", time)
    return bucketed(rows.withWatermark(time, lateness), "run_id", buckets).applyInPandasWithState(
        step,
        f"run_id {key_type}, event_time_s double, sequence long, is_duplicate boolean, missing_before long",
        f"runs array<{key_type}>, owner binary, times binary, sequences binary, seen_runs binary, seen_from binary, seen_lengths binary",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def once_per_version(status: DataFrame, lateness: str) -> DataFrame:
    """One row per station and source version, however many snapshots carry it (needs observed_at as event time)."""
    return status.withWatermark("observed_at_utc", lateness).dropDuplicatesWithinWatermark(["station_id", "source_last_updated_utc"])


def sliding_report(intervals_df: DataFrame, length: str, slide: str, lateness: str) -> DataFrame:
    """Minutes per status over sliding windows by interval end."""
    return (
        intervals_df.withWatermark("interval_end_utc", lateness)
        .groupBy(F.window("interval_end_utc", length, slide), "status_class")
        .agg(F.sum("duration_sec").alias("seconds"), F.count(F.lit(1)).alias("interval_count"))
        .select("window.start", "window.end", "status_class", "seconds", "interval_count")
    )


def collection_spans(status: DataFrame, gap: str, lateness: str) -> DataFrame:
    """Stretches without a collection gap, per station."""
    return (
        status.withWatermark("source_last_updated_utc", lateness)
        .groupBy("station_id", F.session_window("source_last_updated_utc", gap))
        .agg(F.count(F.lit(1)).alias("snapshots"))
        .select("station_id", "session_window.start", "session_window.end", "snapshots")
    )


CLIPS = (
    ("trigger_sample", "long"), ("score", "double"), ("peak", "double"), ("threshold_high", "double"), ("clip_start_sample", "long"),
    ("clip_end_sample", "long"), ("lost_samples", "long"), ("clip_mean", "double"), ("pcm", "array<smallint>"),
)


def detector(blocks: DataFrame, cfg: Detector, history_sec: float = 10.0, highpass: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Blocks (source, block_idx, samples) as they come to event records with the samples of their clip.

    State per source: detector, the high-pass filter (if its coefficients are given), energies the envelope reaches back to, the last
    seconds of samples, and events whose clip is not complete yet. After a missing block filter and envelope start anew. A clip is sent when
    its last sample has come, or when the source ends: a last row without samples says so. Several events may
    wait. ``lost_samples`` tells how much of a clip had already left the history.
    """
    width = cfg.envelope_samples
    keep = int(history_sec * cfg.rate_hz)
    pre, post = int(cfg.rate_hz * cfg.pre_sec), int(cfg.rate_hz * cfg.post_sec)

    def features(env: np.ndarray) -> tuple:
        peak = int(np.argmax(env))
        med = float(np.median(env))
        sigma = max(float(MAD_SIGMA * np.median(np.abs(env - med))), cfg.min_sigma)
        return float(env[peak]), peak, float(np.percentile(env, cfg.score_percentile)), med, sigma

    def step(key, batches, state):
        rows = _ordered(batches, ["block_idx"])
        filtered = BlockFilter(*highpass) if highpass is not None else None
        order = filtered.order if filtered else 0
        if state.exists:
            machine, tail, held, last, history, first, pending = state.get
            machine, tail, held, history = tuple(machine), np.array(tail, dtype=float), np.array(held, dtype=float), np.array(history, dtype=float)
            pending = [tuple(pending[i : i + 4]) for i in range(0, len(pending), 4)]
        else:
            machine, tail, held, last, history, first, pending = START, np.zeros(width - 1), np.zeros(order), -1, np.empty(0), 0, []
        sent = []

        def send(waiting: list[tuple], end: int) -> None:
            for trigger, sc, high, pk in waiting:
                lo, hi = max(0, int(trigger) - pre), min(int(trigger) + post, end)
                clip = history[max(lo - first, 0) : max(hi - first, 0)]
                clip = clip[~np.isnan(clip)]
                sent.append((key[0], int(trigger), sc, pk, high, lo, hi, hi - lo - len(clip), float(clip.mean()) if len(clip) else None, pcm_of(clip)))

        for index, samples in rows[["block_idx", "samples"]].itertuples(index=False, name=None):
            if samples is None:  # the source has ended
                send(pending, first + len(history))
                pending = []
                continue
            if index != last + 1:
                tail, held = np.zeros(width - 1), np.zeros(order)
                missing = int(index) * cfg.block - first - len(history)
                if missing > keep:
                    history, first = np.empty(0), int(index) * cfg.block
                else:
                    history = np.concatenate([history, np.full(max(missing, 0), np.nan)])
            last = int(index)
            x = np.asarray(samples, dtype=float)
            y = x
            if filtered is not None:
                y, held = filtered(x, held)
            energy = np.concatenate([tail, y * y])
            env = np.convolve(energy, np.full(width, 1.0 / width), "valid")
            tail = energy[len(energy) - (width - 1) :]
            peak, at, score, med, sigma = features(env)
            machine, trace = detector_step(cfg, machine, (index, len(x), peak, at, score, med, sigma, True))
            history = np.concatenate([history, x])
            end = int(index) * cfg.block + len(x)
            done = [p for p in pending if end >= p[0] + post]
            pending = [p for p in pending if end < p[0] + post]
            if trace[7] is not None:
                pending.append((float(trace[7]), score, trace[1], peak))
            send(done, end)
            drop = max(0, len(history) - keep)
            history, first = history[drop:], first + drop
        state.update((list(machine), tail.tolist(), held.tolist(), last, history.tolist(), int(first), [float(v) for p in pending for v in p]))
        yield pd.DataFrame(sent, columns=["source", *[n for n, _ in CLIPS]])

    key_type = blocks.schema["source"].dataType.simpleString()
    return blocks.groupBy("source").applyInPandasWithState(
        step,
        f"source {key_type}, " + ", ".join(f"{n} {t}" for n, t in CLIPS),
        "machine array<double>, tail array<double>, held array<double>, last long, history array<double>, first long, pending array<double>",
        "append",
        GroupStateTimeout.NoTimeout,
    )
