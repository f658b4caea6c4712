"""Streams of many keys: keys share states, and what comes out is what a loop over each key gives."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorlith.queries.streams import halves
from sensorlith.streaming import runs, stateful
from sensorlith.streaming.buckets import BUCKETS, Keys, Ranges, packed, unpacked

N_KEYS = 700


@pytest.fixture
def played(monkeypatch):
    """Replays three pieces, and says how many states there are and over how many partitions they lie."""

    def play(pieces, build, name, closing=None):
        seen, real = [], runs.drain

        def drain(*args):
            q = real(*args)
            seen.extend((o.numRowsTotal, o.numShufflePartitions) for p in q.recentProgress for o in p.stateOperators)
            return q

        monkeypatch.setattr(runs, "drain", drain)
        out = runs.replay(pieces, build, name, closing=closing, partitions=3).collect()
        states, partitions = map(max, zip(*seen))
        assert states <= BUCKETS + 1 and partitions == 3
        assert out[0].__fields__ and pieces[0].sparkSession.conf.get(runs.PARTITIONS_CONF) == "4"
        return sorted((tuple(None if v != v else v for v in r) for r in out), key=repr)

    return play


def thirds(df, time):
    a, b = df.approxQuantile(time, [0.3, 0.6], 0.001)
    return [df.filter(F.col(time) <= a), df.filter((F.col(time) > a) & (F.col(time) <= b)), df.filter(F.col(time) > b)]


def by_key(rows, order):
    keys = {}
    for r in sorted(rows, key=order):
        keys.setdefault(r[0], []).append(r)
    return keys


def some_keys(rng, n):
    """Long keys that a double does not hold, and some without."""
    return [None if k == 0 else 2**53 + int(k) for k in rng.integers(0, N_KEYS, n)]


def test_keys_keep_their_numbers():
    import pandas as pd

    keys = Keys(5, [7, 2**53 + 1])
    assert keys.numbers(pd.Series([9, 2**53 + 1, 7, 9])).tolist() == [2, 1, 0, 2]
    assert keys.known == [7, 2**53 + 1, 9] and keys.of(np.array([1, 2])).tolist() == [2**53 + 1, 9]
    none = Keys(-1, [])
    assert none.numbers(pd.Series([np.nan, np.nan])).tolist() == [0, 0] and none.of(np.array([0])).tolist() == [None]


def test_pieces_of_a_skewed_time_are_of_one_size(spark):
    """Less than twice the rows of a piece, nearly all of them early."""
    df = spark.range(1900).withColumn("t", F.when(F.col("id") < 1890, F.col("id") / 1.0).otherwise(F.col("id") * 1e6))
    assert [p.count() > 800 for p in halves(df, "t", 1000)] == [True, True]
    assert [p.count() for p in halves(df, "t")] == [1890, 10]


def test_settings_of_a_bounded_stream_go_with_it(spark):
    """A long series' state goes to Python with few calls, over few partitions; the session keeps its own numbers."""
    names = (runs.PARTITIONS_CONF, runs.ROWS_CONF)
    usual = [spark.conf.get(n) for n in names]
    with runs.bounded(spark, 2):
        assert [spark.conf.get(n) for n in names] == ["2", str(runs.ROWS)]
    with runs.bounded(spark, 1000):
        assert spark.conf.get(runs.PARTITIONS_CONF) == usual[0]
    with runs.bounded(spark, None):
        assert [spark.conf.get(n) for n in names] == usual
    assert [spark.conf.get(n) for n in names] == usual


def test_intervals_of_many_stations_share_states(spark, played):
    rng = np.random.default_rng(1)
    rows = [(k, int(t), "xyz"[int(t) % 3]) for k, t in zip(some_keys(rng, 4000), rng.integers(0, 10**11, 4000))]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "station_id long, micros long, status_class string")
    got = played(thirds(df, "micros"), lambda s: stateful.intervals(s, 30_000), "many-stations")
    want = []
    for key, mine in by_key(rows, lambda r: r[1]).items():
        for (_, a, label), (_, b, _) in zip(mine, mine[1:]):
            if 0 < b // 10**6 - a // 10**6 <= 30_000:
                want.append((key, a, b, b // 10**6 - a // 10**6, label))
    assert len(want) > 2000 and None in {r[0] for r in want} and got == sorted(want, key=repr)


def test_alerts_of_many_runs_share_states(spark, played):
    rng = np.random.default_rng(2)
    values = [None if v < 0.1 else float(v) for v in rng.random(6000)]
    rows = [(k, float(t), i, v) for i, (k, t, v) in enumerate(zip(some_keys(rng, 6000), rng.integers(0, 3000, 6000), values))]
    df = spark.createDataFrame(rows, "run_id long, event_time_s double, sequence long, innovation double")
    got = played(thirds(df, "event_time_s"), lambda s: stateful.slip_alerts(s, 0.3, 3), "many-runs")
    want = []
    for key, mine in by_key(rows, lambda r: r[1:3]).items():
        count = 0
        for _, t, q, v in mine:
            count = count if v is None else count + 1 if v >= 0.3 else 0
            if v is not None and count == 3:
                want.append((key, t, q))
    assert len(want) > 300 and None in {r[0] for r in want} and got == sorted(want, key=repr)


def test_guard_of_many_robots_shares_states(spark, played):
    rng = np.random.default_rng(3)
    keys = [None if k is None else f"r{k}" for k in some_keys(rng, 6000)]
    fronts = [None if f < 0.1 else float(f) for f in rng.random(6000)]
    rows = [(k, 1000.0 + i // 2, "command" if i % 2 else "scan", None if i % 2 else f, float(rng.normal()), 1.0) for i, (k, f) in enumerate(zip(keys, fronts))]
    rows = [rows[i] for i in rng.permutation(6000)]
    df = spark.createDataFrame(rows, "robot_id string, ts double, kind string, front double, linear_x double, angular_z double").withColumn("at", F.timestamp_seconds("ts"))
    end = runs.closing_row(df, robot_id=F.lit("end"), ts=F.lit(7e9), kind=F.lit("command"), linear_x=F.lit(0.0), angular_z=F.lit(0.0), at=F.timestamp_seconds(F.lit(7e9)))
    got = played(thirds(df, "ts"), lambda s: stateful.guard(s, "at", "100 seconds", 0.4, 0.6, 200.0), "many-robots", end)
    want = []
    for key, mine in by_key(rows, lambda r: (r[1], r[2] == "command")).items():
        blocked, scan, told = True, None, False
        for _, ts, kind, front, linear, angular in [*mine, (key, 6e9, "", None, 0.0, 0.0)]:
            if scan is not None and ts - scan > 200.0 and not told:
                told = True
                want.append((key, scan + 200.0, "stop", 0.0, 0.0))
            if kind == "scan":
                was, blocked = blocked, True if front is None or front <= 0.4 else False if front >= 0.6 else blocked
                scan, told = ts, False
                want += [(key, ts, "stop", 0.0, 0.0)] if blocked and not was else []
            elif kind:
                want.append((key, ts, "command", 0.0 if linear > 0 and (blocked or scan is None or ts - scan > 200.0) else linear, angular))
    assert len(want) > 5000 and None in {r[0] for r in want} and got == sorted(want, key=repr)


def test_order_of_many_runs_shares_states(spark, played):
    rng = np.random.default_rng(4)
    rows = [(k, 1000.0 + int(t), int(q)) for k, t, q in zip(some_keys(rng, 6000), rng.integers(0, 5000, 6000), rng.integers(0, 20, 6000) + 2**53)]
    df = spark.createDataFrame([rows[i] for i in rng.permutation(6000)], "run_id long, event_time_s double, sequence long").withColumn("at", F.timestamp_seconds("event_time_s"))
    end = runs.closing_row(df, run_id=F.lit(-1), sequence=F.lit(0), event_time_s=F.lit(7e9), at=F.timestamp_seconds(F.lit(7e9)))
    got = played(thirds(df, "event_time_s"), lambda s: stateful.in_order(s, "at", "100 seconds"), "many-logs", end)
    want = []
    for key, mine in by_key(rows, lambda r: r[1:]).items():
        seen = set()
        for _, t, q in mine:
            want.append((key, t, q, q in seen, 0 if q in seen or not seen else max(0, q - max(seen) - 1)))
            seen.add(q)
    assert sum(r[3] for r in want) > 500 and sum(r[4] for r in want) > 500 and got == sorted(want, key=repr)


def test_ranges_of_many_keys_are_those_of_each():
    random = np.random.default_rng(5)
    ranges, seen = Ranges([], []), set()
    for _ in range(40):
        keys, values = random.integers(0, 5, 60), random.integers(0, 200, 60)
        want = []
        for pair in zip(keys.tolist(), values.tolist()):
            want.append(pair not in seen)
            seen.add(pair)
        assert ranges.add_all(keys, values).tolist() == want
    found = list(zip(ranges.keys.tolist(), ranges.lows.tolist(), ranges.highs.tolist()))
    assert {(k, v) for k, lo, hi in found for v in range(lo, hi + 1)} == seen and found == sorted(found)
    assert all(a[0] != b[0] or b[1] > a[2] + 1 for a, b in zip(found, found[1:]))
    assert dict(zip(*(v.tolist() for v in ranges.highest()))) == {k: max(v for j, v in seen if j == k) for k in range(5)}


def test_packed_numbers_come_back():
    for values in ([], [5], [3, 4, 9, 1], [-(2**63), 2**63 - 1, 0, 70_000, 2**40], list(range(1000, 1300))):
        assert unpacked(packed(np.array(values, dtype=np.int64))).tolist() == values
    assert len(packed(np.arange(0, 10**6, 100))) <= 2 + 10_000
