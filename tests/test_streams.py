"""Streams fed in pieces give the batch answer, and a batch run twice changes nothing."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from sensorlith.operators.series import arrange
from sensorlith.operators.upserts import last_load_of_version, load_partitions, replace_by_key, upsert_table
from sensorlith.plans import signals
from sensorlith.queries.streams import halves
from sensorlith.schemas import BIKE_SNAPSHOT
from sensorlith.session import work_path
from sensorlith.sources import runlogs, sensors, snapshots, waveforms
from sensorlith.streaming import stateful
from sensorlith.streaming.runs import budget, closing_row, drain, folder_stream, replay
from sensorlith.streaming.tables import keep_tables


def test_replay_order_marks_duplicates_and_gaps(spark):
    rows = [("r", 0, 1000.0), ("r", 2, 1002.0), ("r", 1, 1001.0), ("r", 5, 1005.0), ("r", 5, 1005.5), ("r", 9, 9000.0), ("r", 10, 20000.0)]
    df = spark.createDataFrame(rows, "run_id string, sequence long, event_time_s double").withColumn("at", F.timestamp_seconds("event_time_s"))
    out = replay(halves(df, "event_time_s"), lambda s: stateful.in_order(s, "at", "1 hour"), "order-test")
    got = out.orderBy("event_time_s").collect()
    assert [r["sequence"] for r in got][:5] == [0, 1, 2, 5, 5]
    assert [r["is_duplicate"] for r in got][:5] == [False, False, False, False, True]
    assert [r["missing_before"] for r in got][:4] == [0, 0, 0, 2]


def test_replay_order_forgets_no_number(spark):
    numbers = [*range(0, 50_000), 5, 49_999, 60_000, 50_000, 5]
    df = spark.createDataFrame([("r", q, 1000.0 + i) for i, q in enumerate(numbers)], "run_id string, sequence long, event_time_s double")
    df = df.withColumn("at", F.timestamp_seconds("event_time_s"))
    end = closing_row(df, sequence=F.lit(0), event_time_s=F.lit(7e9), at=F.timestamp_seconds(F.lit(7e9)))
    got = replay(halves(df, "event_time_s"), lambda s: stateful.in_order(s, "at", "1 hour"), "numbers-test", closing=end).toPandas().sort_values("event_time_s")
    assert len(got) == len(numbers) and got["is_duplicate"].tolist()[50_000:] == [True, True, False, False, True]
    assert not got["is_duplicate"].iloc[:50_000].any() and got["missing_before"].tolist()[50_000:] == [0, 0, 10_000, 0, 0]


def test_ranges_of_seen_numbers():
    random = np.random.default_rng(3)
    ranges, seen = stateful.Ranges([], []), set()
    for v in random.integers(0, 300, 600).tolist():
        assert ranges.add(v) == (v not in seen)
        seen.add(v)
    assert {v for lo, hi in zip(ranges.lows, ranges.highs) for v in range(lo, hi + 1)} == seen
    assert all(b > a + 1 for a, b in zip(ranges.highs, ranges.lows[1:]))


def test_silent_robot_is_stopped_by_the_timer(spark):
    rows = [("a", 1000.0, "scan", 5.0), ("a", 1000.2, "command", None), ("b", 1000.0, "scan", 5.0), ("b", 4000.0, "scan", 5.0), ("b", 9000.0, "scan", 5.0)]
    df = spark.createDataFrame(rows, "robot_id string, ts double, kind string, front double")
    df = df.withColumn("linear_x", F.lit(1.0)).withColumn("angular_z", F.lit(0.0)).withColumn("at", F.timestamp_seconds("ts"))
    got = replay([df.filter("ts < 4000"), df.filter("ts >= 4000")], lambda s: stateful.guard(s, "at", "1 second"), "silent-test")
    sent = {(r["robot_id"], r["kind"], round(r["ts"], 3), r["linear_x"]) for r in got.collect()}
    # nothing more comes from a, but the others' time goes on
    assert {("a", "command", 1000.2, 1.0), ("a", "stop", 1000.5, 0.0), ("b", "stop", 1000.5, 0.0), ("b", "stop", 4000.5, 0.0)} == sent


def test_guard_takes_many_rows_in_pieces(spark, monkeypatch):
    """No piece grows with the input, each row comes once and in order of time, and the guard sends the same as on two pieces."""
    from sensorlith.queries import streams

    rng = np.random.default_rng(4)
    rows = [("ab"[i % 2], 1000.0 + 5000.0 * float(t) ** 4, "scan" if i % 3 else "command", float(f)) for i, (t, f) in enumerate(rng.uniform(0, 1, (3000, 2)))]
    df = spark.createDataFrame(rows, "robot_id string, ts double, kind string, front double")
    df = df.withColumn("linear_x", F.lit(1.0)).withColumn("angular_z", F.lit(0.0)).withColumn("at", F.timestamp_seconds("ts"))
    end = closing_row(df, ts=F.lit(7e9), kind=F.lit("command"), linear_x=F.lit(0.0), angular_z=F.lit(0.0), at=F.timestamp_seconds(F.lit(7e9)))
    sent = {}
    for most in (1_000_000, 500):
        monkeypatch.setattr(streams, "PIECE_ROWS", most)
        pieces = halves(df, "ts")
        if most == 500:
            counts = [p.count() for p in pieces]
            assert sum(counts) == 3000 and max(counts) <= 600
            ranges = [p.agg(F.min("ts"), F.max("ts")).first() for p in pieces]
            assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
        out = replay(pieces, lambda s: stateful.guard(s, "at", "100 seconds"), "guard-pieces", closing=end)
        sent[most] = sorted(tuple(r) for r in out.filter("robot_id IS NOT NULL").collect())
    assert len(sent[500]) > 1000 and sent[500] == sent[1_000_000]


def test_detector_ends_with_its_source(spark):
    from sensorlith.plans.signals import Detector

    cfg = Detector(rate_hz=1280.0, block=64, calibration_sec=8.0)
    x = np.random.default_rng(8).normal(0, 0.01, 64 * 202)
    x[200 * 64 + 10 :] += 1.0
    rows = [("s", i, x[i * 64 : i * 64 + 64].tolist()) for i in range(202)]
    df = spark.createDataFrame(rows, "source string, block_idx long, samples array<double>")
    end = spark.createDataFrame([("s", 202, None)], df.schema)
    got = replay([df], lambda s: stateful.detector(s, cfg), "detector-end", closing=end).collect()
    assert [(r["trigger_sample"] // 64, r["clip_end_sample"], r["lost_samples"]) for r in got] == [(200, len(x), 0)]


def test_late_batch_does_not_undo_a_later_one(spark):
    path = work_path(spark, "late-test")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, v string, seen int")
    upsert_table(path, rows((1, "new", 2), (2, "x", 1)), ["k"], ["seen"])
    got = upsert_table(path, rows((1, "old", 1), (2, "y", 3)), ["k"], ["seen"])
    assert {(r["k"], r["v"]) for r in got.collect()} == {(1, "new"), (2, "y")}


def test_partitions_of_null_are_kept(spark):
    path = work_path(spark, "null-partitions")
    df = spark.createDataFrame([(1, "a"), (None, "b")], "p int, v string")
    assert load_partitions(df, path, ["p"]) == 2 and load_partitions(df, path, ["p"]) == 0
    assert {(r["p"], r["v"]) for r in spark.read.parquet(path).collect()} == {(1, "a"), (None, "b")}


def test_detector_state_spans_batches(spark):
    from sensorlith.plans.signals import Detector

    cfg = Detector(rate_hz=1280.0, block=64, calibration_sec=8.0)
    x = np.random.default_rng(8).normal(0, 0.01, 64 * 280)
    for at in (200, 220):
        x[at * 64 + 10 : at * 64 + 50] += 1.0
    df = spark.createDataFrame([("s", i, x[i * 64 : i * 64 + 64].tolist()) for i in range(280)], "source string, block_idx long, samples array<double>")
    got = replay([df.filter("block_idx < 210"), df.filter("block_idx >= 210")], lambda s: stateful.detector(s, cfg), "detector-test")
    rows = got.orderBy("trigger_sample").collect()
    assert [r["trigger_sample"] // 64 for r in rows] == [200, 220]
    assert all(r["lost_samples"] == 0 for r in rows)
    for r in rows:
        assert abs(r["clip_mean"] - x[r["clip_start_sample"] : r["clip_end_sample"]].mean()) < 1e-9


def test_progress_budget(spark):
    root = work_path(spark, "budget-test")
    spark.range(100).write.parquet(f"{root}/in")
    q = drain(folder_stream(spark, f"{root}/in", spark.range(1).schema, 1), f"{root}/out", f"{root}/c")
    rows = budget([json.loads(p.json) if hasattr(p, "json") and not isinstance(p, dict) else p for p in q.recentProgress], 1024 / 44100)
    assert sum(r["rows"] for r in rows) == 100 and all(r["duration_ms"] > 0 for r in rows)


def snapshot(path, name, updated, stations):
    doc = {"source_name": "station_status", "observed_at_utc": f"2024-01-01T00:0{updated}:00Z", "payload": {"last_updated": 1704067200 + 60 * updated, "ttl": 60, "data": {"stations": stations}}}
    (path / f"{name}.json").write_text(json.dumps(doc, indent=1))


def test_snapshot_stream_is_replay_safe(spark, tmp_path):
    one = {"station_id": "a", "name": "A", "num_bikes_available": 0, "num_docks_available": 3, "is_installed": 1, "is_renting": 1, "is_returning": 1, "last_reported": 0}
    snapshot(tmp_path, "s_1", 1, [one])
    snapshot(tmp_path, "s_2", 1, [{**one, "num_bikes_available": 4, "name": "A2"}])
    docs = snapshots.read_documents(spark, str(tmp_path), BIKE_SNAPSHOT, "s_*.json")
    status = snapshots.bike_status(docs)
    assert {r["snapshot_id"]: r["status_class"] for r in status.collect()} == {"s_1": "empty", "s_2": "available"}
    assert [r["snapshot_id"] for r in last_load_of_version(status, "source_last_updated_utc", "snapshot_id").collect()] == ["s_2"]
    assert [r["name"] for r in snapshots.bike_stations(docs).collect()] == ["A2"]
    root = work_path(spark, "tables-test")
    for run in ("x", "y"):
        stream = snapshots.stream_documents(spark, str(tmp_path), BIKE_SNAPSHOT, "s_*.json", 1)
        keep_tables(stream, {"manifest": (snapshots.bike_manifest, ["snapshot_id"])}, root, f"{root}/c-{run}")
    assert spark.read.parquet(f"{root}/manifest").count() == 2


def test_upsert_matches_null_keys(spark):
    old = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    new = spark.createDataFrame([(None, "c"), (3, "d")], "k int, v string")
    assert {(r["k"], r["v"]) for r in replace_by_key(old, new, ["k"]).collect()} == {(1, "a"), (None, "c"), (3, "d")}
    path = work_path(spark, "upsert-test")
    upsert_table(path, old, ["k"])
    upsert_table(path, new, ["k"])
    assert upsert_table(path, new, ["k"]).count() == 3


def test_sensor_files(spark, tmp_path):
    for sensor in ("accelerometer", "gravity", "gyroscope"):
        pd.DataFrame({"time_sec": [0.0, 0.1], "x": [1.0, 2.0], "y": [0.0, 0.0], "z": [9.0, 9.0]}).to_csv(tmp_path / f"run_7_{sensor}.csv", index=False)
    frames = sensors.read_three_sensor_runs(spark, str(tmp_path))
    assert {n: f.count() for n, f in frames.items()} == {"acc": 2, "gravity": 2, "gyro": 2}
    assert frames["acc"].columns == ["run_id", "time_sec", "acc_x", "acc_y", "acc_z"] and frames["acc"].first()["run_id"] == "run_7"
    (tmp_path / "run_8_gravity.csv").write_text("time_sec,x,y,z\n0,1,1,1\n")
    try:
        sensors.read_three_sensor_runs(spark, str(tmp_path))
        raise AssertionError("a run with one sensor was accepted")
    except ValueError as e:
        assert "run_8" in str(e)


def test_files_of_runs_lie_in_few_folders(spark, tmp_path, monkeypatch):
    """A file for each run and sensor, without a folder of its own, read whole however it is cut."""
    from pyspark.sql import functions as F

    from sensorlith.sources import files

    rows = spark.range(600).select((F.col("id") % 40).cast("string").alias("run_id"), F.element_at(F.array(*[F.lit(s) for s in sensors.SENSORS]), (F.col("id") % 3 + 1).cast("int")).alias("sensor"), (F.col("id") / 7).alias("time_sec"), (F.col("id") * 1e-9).alias("x"), F.when(F.col("id") % 11 != 0, F.col("id") / 3).alias("y"), F.lit(0.0).alias("z"))
    sensors.write_three_sensor_runs(rows, str(tmp_path / "runs"))
    found = [p for p in (tmp_path / "runs").rglob("*") if p.is_file()]
    assert len(found) == 120 and len(list((tmp_path / "runs").iterdir())) <= files.FOLDERS and all(p.name.endswith(".csv") for p in found)
    want = {s: sorted(map(tuple, rows.where(F.col("sensor") == n).select("run_id", "time_sec", "x", F.coalesce("y", F.lit(-1.0)), "z").collect())) for n, s in sensors.SENSORS.items()}
    for part in (files.PART_BYTES, 50):
        monkeypatch.setattr(files, "PART_BYTES", part)
        got = sensors.read_three_sensor_runs(spark, str(tmp_path / "runs"))
        assert {s: sorted(map(tuple, f.fillna(-1.0).collect())) for s, f in got.items()} == want


def test_lines_of_odd_files(spark, tmp_path, monkeypatch):
    from sensorlith.sources import files

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "_draft.csv").write_text("h\n0\n")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "head.csv").write_text("h\n")
    (tmp_path / "a" / "open.csv").write_text("\nh\n1\n\n  \n22")
    (tmp_path / "a" / "b" / "c d.csv").write_bytes(b"h\r\n333\r\n4\r\n")
    (tmp_path / "a" / "other.txt").write_text("h\n9\n")
    for part in (100, 5, 2, 1):
        monkeypatch.setattr(files, "PART_BYTES", part)
        got = files.read_lines(spark, str(tmp_path), r"(?P<name>[^/]*)\.csv$", "*.csv", header=part > 5)
        lines = [tuple(r) for r in got.collect() if part > 5 or r["line"] != "h"]
        assert sorted(lines) == [("c%20d", "333"), ("c%20d", "4"), ("open", "1"), ("open", "22")]


def test_documents_of_a_snapshot_share_a_file(spark, tmp_path):
    from sensorlith.sources import snapshots

    docs = spark.sql("SELECT CAST(id % 3 AS STRING) AS snapshot, id AS n, '2024-01-01T00:00:00Z' AS observed_at_utc FROM range(9)")
    snapshots.write_documents(docs, str(tmp_path / "docs"))
    assert sorted(p.name for p in (tmp_path / "docs").rglob("*") if p.is_file()) == ["0.json", "1.json", "2.json"]
    got = snapshots.read_documents(spark, str(tmp_path / "docs"), docs.drop("snapshot").schema, lines=True)
    assert sorted((r["snapshot_id"], r["n"]) for r in got.collect()) == sorted((str(n % 3), n) for n in range(9))


def test_long_waveform_in_parts(spark, tmp_path):
    """Each task reads its own bytes of a long file; blocks are those of the whole."""
    import wave

    rng = np.random.default_rng(2)
    for name, width, channels, n in (("long", 2, 2, 5003), ("deep/short", 1, 1, 70), ("none", 4, 1, 0)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as f:
            f.setnchannels(channels)
            f.setsampwidth(width)
            f.setframerate(1000)
            f.writeframes(rng.integers(0, 200, n * channels).astype(waveforms.KINDS[width]).tobytes())
    got = waveforms.read_files(spark, str(tmp_path), block=64, part_bytes=1500)
    assert got.rdd.getNumPartitions() >= 14
    rows = got.orderBy("source", "block_idx").collect()
    for name in ("long", "deep/short"):
        path = str(tmp_path / f"{name}.wav")
        rate, x = waveforms.decode(Path(path).read_bytes())
        mine = [r for r in rows if r.source == path]
        assert [r.block_idx for r in mine] == list(range(-(-len(x) // 64))) and {r.rate_hz for r in mine} == {rate}
        np.testing.assert_allclose(np.concatenate([r.samples for r in mine]), x)
    assert len(rows) == 79 + 2


def test_many_short_waveforms(spark, tmp_path):
    """Files by the thousand, each cut into parts, are read by a bounded number of tasks; no block is lost."""
    rows = spark.range(1500).select(
        F.col("id").cast("string").alias("name"), F.lit(8).alias("rate_hz"), F.lit(1).alias("channels"), F.lit(2).alias("width"),
        F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i * 100 - F.col("id")).alias("pcm"),
    )
    waveforms.write_files(rows, str(tmp_path))
    got = waveforms.read_files(spark, str(tmp_path), block=4, part_bytes=40)
    assert got.rdd.getNumPartitions() <= waveforms.MOST_TASKS
    back = got.select(F.regexp_extract("source", r"([^/]+)\.wav$", 1).cast("long").alias("id"), "block_idx", F.transform("samples", lambda x: F.rint(x * 32768.0).cast("long")).alias("s"))
    want = [(i, b, [j * 100 - i for j in range(4 * b, min(4 * b + 4, 10))]) for i in range(1500) for b in range(3)]
    assert sorted(map(tuple, back.collect())) == want


def test_waveform_files(spark, tmp_path):
    import wave

    x = (np.sin(np.arange(2500) / 20) * 20000).astype("<i2")
    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(1000)
        f.writeframes(np.repeat(x, 2).tobytes())
    blocks = waveforms.blocks(waveforms.list_files(spark, str(tmp_path)), 1024).orderBy("block_idx").collect()
    assert [len(b["samples"]) for b in blocks] == [1024, 1024, 452] and blocks[0]["rate_hz"] == 1000
    np.testing.assert_allclose(np.concatenate([b["samples"] for b in blocks]), x / 32768.0)


def test_run_log_lines(spark, tmp_path):
    good = dict(event_id="e", run_id="r", mission_id="m", robot_id="b", software_version="v1", event_type="mission.event", sequence=3, event_time_s=1.5,
                recorded_at="t", schema_version="1.0", payload={"name": "mission_completed", "waypoints_reached": 3})
    (tmp_path / "r.jsonl").write_text(json.dumps(good) + "\n" + json.dumps({**good, "payload": None}) + "\n{broken\n")
    lines = runlogs.read_lines(spark, str(tmp_path))
    event = runlogs.events(lines).first()
    assert (event["sequence"], event["payload"]["waypoints_reached"]) == (3, 3)
    assert sorted(len(r["errors"]) for r in runlogs.rejected(lines).collect()) == [1, 2]


def test_a_batch_rewrites_only_the_folders_of_its_keys(spark):
    path = work_path(spark, "buckets-test")
    rows = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "k long, v string")
    upsert_table(path, rows(range(400), "old"), ["k"], buckets=16)

    def files():
        return {(p.parent.name, p.name) for p in Path(path.removeprefix("file://")).rglob("part-*.parquet")}

    before = files()
    got = upsert_table(path, rows([3, 5, 900], "new"), ["k"], buckets=8)  # the number of folders stays
    after = files()
    touched = {folder for folder, _ in after - before}
    assert len({folder for folder, _ in before}) == 16 and 1 <= len(touched) <= 3
    assert {x for x in before if x[0] not in touched} == {x for x in after if x[0] not in touched}
    assert got.columns == ["k", "v"] and got.count() == 401
    assert {r.k for r in got.where("v = 'new'").collect()} == {3, 5, 900}


def test_a_later_column_is_null_in_older_rows(spark):
    path = work_path(spark, "buckets-test")
    upsert_table(path, spark.createDataFrame([(i, "x") for i in range(50)], "k long, v string"), ["k"])
    got = upsert_table(path, spark.createDataFrame([(1, "y", 7)], "k long, v string, w int"), ["k"])
    assert got.count() == 50 and [tuple(r) for r in got.where("w IS NOT NULL").select("k", "v", "w").collect()] == [(1, "y", 7)]


def test_live_detector_equals_the_stored_signal(spark):
    """With the high-pass, a missing block and a source that ends early: the same events, and the same samples in their clips."""
    cfg = signals.Detector(rate_hz=640.0, block=64, calibration_sec=2.0, pre_sec=0.2, post_sec=0.4)
    b, a = signals.highpass_coefficients(4, 40.0, cfg.rate_hz)
    rng = np.random.default_rng(9)
    rows = []
    for source, n in (("one", 120), ("two", 75)):
        x = rng.normal(0, 0.01, 64 * n) + 2.0 * np.sin(np.arange(64 * n) / 400.0)
        for at in (40, 60, n - 2):
            x[at * 64 + 10 : at * 64 + 50] += rng.choice([-0.8, 0.8], 40)
        rows += [(source, i, x[64 * i : 64 * i + 64].tolist()) for i in range(n) if (source, i) != ("two", 30)]
    df = spark.createDataFrame(rows, "source string, block_idx long, samples array<double>").cache()
    energy = signals.highpass_energy(arrange(df, ["source"], ["block_idx"]), b, a)
    env = signals.envelope(arrange(energy, ["source"], ["block_idx"]), cfg.envelope_samples).result()
    trace = signals.detect(signals.block_features(env, cfg), cfg)
    ends = df.groupBy("source").agg(((F.max("block_idx") + 1) * cfg.block).alias("n_samples"))
    events = signals.event_records(trace, ends, cfg)
    stored = {(r.source, r.trigger_sample): list(r.pcm) for r in signals.clips(events, df, cfg).join(events.select("source", "event_id", "trigger_sample"), ["source", "event_id"]).collect()}
    closing = df.groupBy("source").agg((F.max("block_idx") + 1).alias("block_idx")).withColumn("samples", F.lit(None).cast("array<double>"))
    live = replay(halves(df, "block_idx"), lambda s: stateful.detector(s, cfg, highpass=(b, a)), "live-highpass", closing=closing)
    got = {(r.source, r.trigger_sample): list(r.pcm) for r in live.collect()}
    assert len(got) >= 6 and got == stored


def test_block_filter_is_the_sample_loop():
    b, a = signals.highpass_coefficients(4, 30.0, 400.0)
    rng = np.random.default_rng(1)
    x, f, state, out = rng.normal(size=300), signals.BlockFilter(b, a), np.zeros(4), []
    for lo, hi in ((0, 64), (64, 128), (128, 130), (130, 300)):
        y, state = f(x[lo:hi], state)
        out.append(y)
    want = np.zeros(300)
    for i in range(300):
        want[i] = sum(b[k] * x[i - k] for k in range(5) if i >= k) - sum(a[k] * want[i - k] for k in range(1, 5) if i >= k)
    np.testing.assert_allclose(np.concatenate(out), want, atol=1e-10)
