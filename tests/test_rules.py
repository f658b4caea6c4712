"""Known answers of the scalar rules, contracts and reports."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from sensorlith.functions import geo, numbers, scores, times, units
from sensorlith.functions.scans import nearest_in_sector
from sensorlith.plans import fusion, missions, protocol, rovers, trips

RAD = math.radians


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_rounding_forms(spark):
    assert value(spark, numbers.half_up(F.lit(0.125), 2)) == 0.13
    assert value(spark, numbers.half_up(F.lit(-0.125), 2)) == -0.13
    assert value(spark, numbers.half_even(F.lit(0.125), 2)) == 0.12
    assert value(spark, numbers.clamp(F.lit(None).cast("double"), 0, 1)) is None


def test_boundaries_are_counted(spark):
    a, b = F.lit("2024-01-01 00:00:59").cast("timestamp_ntz"), F.lit("2024-01-01 00:01:01").cast("timestamp_ntz")
    assert value(spark, times.boundaries_between("minute", a, b)) == 1
    assert value(spark, times.boundaries_between("second", a, b)) == 2


def test_times_and_texts(spark):
    utc = value(spark, times.parse_iso(F.lit("2024-03-01T10:00:00-05:00")))
    assert str(utc) == "2024-03-01 15:00:00"
    assert value(spark, times.epoch_to_utc(F.lit("0"))) is None
    assert value(spark, times.epoch_to_utc(F.lit("x"))) is None
    assert value(spark, units.wind_text_mph(F.lit("5 to 10 mph"))) == 10.0
    assert value(spark, units.wind_text_mph(F.lit("calm"))) is None
    assert value(spark, numbers.safe_int(F.lit("12.7"))) == 12
    assert value(spark, numbers.safe_int(F.lit(""))) is None
    assert str(value(spark, times.next_month_start(F.lit(2023), F.lit(12)))) == "2024-01-01 00:00:00"


def test_encoded_polyline(spark):
    got = value(spark, geo.decode_polyline(F.lit("_p~iF~ps|U_ulLnnqC_mqNvxq`@")))
    assert [(round(p["lat"], 5), round(p["lon"], 5)) for p in got] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]


def test_broken_point_tokens_are_skipped(spark):
    got = value(spark, geo.parse_points(F.lit("40.7,-73.9  40.8,-73.8 40.9, x,1 7")))
    assert [(p["lat"], p["lon"]) for p in got] == [(40.7, -73.9), (40.8, -73.8)]


def test_polyline_checks(spark):
    line = lambda *p: F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in p])
    assert value(spark, geo.usable_polyline(line((40.7, -73.9), (40.71, -73.9)), geo.STRICT_BOX))
    assert not value(spark, geo.usable_polyline(line((40.6, -73.9), (40.8, -73.9)), geo.STRICT_BOX))
    assert value(spark, geo.usable_polyline(line((40.6, -73.9), (40.8, -73.9)), geo.WIDE_BOX))
    assert not value(spark, geo.usable_polyline(line((40.7, -73.9)), geo.WIDE_BOX))


@pytest.mark.parametrize(
    "ranges, want",
    [([0.05, 2.0, 0.7, 1.3, 0.04], 0.7), ([math.nan, math.inf, 0.03, 0.8, 13.0], 0.8), ([0.01] * 5, None), ([math.inf] * 5, 10.0), ([-math.inf] * 5, None)],
)
def test_nearest_range(spark, ranges, want):
    col = nearest_in_sector(F.array(*[F.lit(x) for x in ranges]), F.lit(RAD(-40)), F.lit(RAD(20)), F.lit(0.1), F.lit(10.0), 0.0, RAD(20) + 1e-9)
    assert value(spark, col) == want


def test_hysteresis_and_stops(spark):
    fronts = [0.60, 0.45, 0.50, 0.55, None, 2.0, 0.30, 0.30]
    df = spark.createDataFrame([(1, float(i), f) for i, f in enumerate(fronts)], "robot_id int, ts double, front double")
    got = rovers.blocked_states(df).orderBy("ts").collect()
    assert [r["blocked"] for r in got] == [False, True, True, False, True, False, True, True]
    assert [r["stop_sent"] for r in got] == [False, True, False, False, True, False, True, False]


def test_guard_before_any_scan_keeps_turning(spark):
    commands = spark.createDataFrame([(1, 0.0, 0.25, 0.4), (1, 5.1, 0.25, 0.4), (1, 6.0, 0.25, 0.4)], "robot_id int, ts double, linear_x double, angular_z double")
    states = spark.createDataFrame([(1, 5.0, False)], "robot_id int, ts double, blocked boolean")
    got = rovers.guarded(commands, states).orderBy("ts").collect()
    assert [(r["safe_linear_x"], r["safe_angular_z"]) for r in got] == [(0.0, 0.4), (0.25, 0.4), (0.0, 0.4)]


def record(**changes):
    good = dict(event_id="e", run_id="r", mission_id="m", robot_id="b", software_version="v1", event_type="mission.event", sequence="3", event_time_s="1.5",
                recorded_at="t", schema_version="1.0", payload='{"name": "x"}')
    return {**good, **changes}


def test_event_contract(spark):
    rows = [record(), record(sequence="x", event_time_s=None, payload="[]", event_type="other")]
    df = spark.createDataFrame([Row(**r) for r in rows], "event_id string, run_id string, mission_id string, robot_id string, software_version string, "
                               "event_type string, sequence string, event_time_s string, recorded_at string, schema_version string, payload string")
    good, bad = [r["errors"] for r in df.select(missions.contract_errors().alias("errors")).collect()]
    assert good == []
    assert bad == ["missing fields: ['event_time_s']", "sequence must be an integer", "event_time_s must be numeric", "payload must be an object", "event_type is unknown"]


def test_duplicate_sequence_is_an_error(spark):
    df = spark.createDataFrame([("r", 1, 0.0), ("r", 1, 0.1)], "run_id string, sequence long, event_time_s double")
    with pytest.raises(ValueError):
        missions.replay(df)


def test_comparison_text(spark):
    rows = [("a", "v1", False, 1, None, 0.2, 0.1, None), ("a", "v1", False, 2, None, 0.4, 0.3, None), ("a", "v2", True, 3, 9.0, 0.1, 0.1, 0.9), ("a", "v2", True, 3, 10.0, 0.1, 0.1, 0.0)]
    df = spark.createDataFrame(rows, "scenario_name string, software_version string, mission_success boolean, waypoints_reached int, completion_time_s double, "
                               "localization_rmse_m double, cross_track_rmse_m double, path_efficiency double")
    got = {r["version"]: r.asDict() for r in missions.comparison_text(missions.scenario_summary(df)).collect()}
    assert (got["v1"]["success"], got["v1"]["mean_completion_time_s"], got["v1"]["path_efficiency"]) == ("0/2 (0%)", "—", "—")
    assert (got["v2"]["success"], got["v2"]["mean_completion_time_s"], got["v2"]["path_efficiency"]) == ("2/2 (100%)", "9.50", "0.450")


def test_protocol_rows(spark):
    rows = spark.createDataFrame(
        [(1, 0, 0.0, 5.0, "calibration_stationary"), (1, 1, 5.0, 8.0, "transition"), (1, 2, 8.0, 10.0, "impact"), (1, 3, 8.0, 10.0, "rotation"), (1, 4, 3.0, 3.0, "rotation")],
        "run_id int, row_id int, start_time_sec double, end_time_sec double, expected_label string",
    )
    segments = spark.createDataFrame(
        [(1, 0.021, 5.5, "stationary"), (1, 5.5, 9.0, "rotation"), (1, 9.0, 9.02, "impact_or_shake"), (1, 9.02, 9.5, "stationary")],
        "run_id int, start_time_sec double, end_time_sec double, event_group_clean string",
    )
    fine, broken = protocol.usable_rows(rows)
    assert [r["row_id"] for r in broken.collect()] == [4]
    got = {r["row_id"]: r for r in protocol.check(fine, segments, "event_group_clean").collect()}
    assert (got[0]["status"], round(got[0]["allowed_overlap_sec"], 3), round(got[0]["match_fraction"], 3)) == ("pass", 4.979, 0.996)
    assert (got[1]["status"], got[1]["match_fraction"], got[1]["allowed_detected_labels"]) == ("ignored", None, "ignored")
    assert got[2]["status"] == "pass" and got[3]["status"] == "pass"
    assert got[3]["dominant_detected_label"] == "rotation"
    s = protocol.summary(protocol.check(fine, segments, "event_group_clean")).first()
    assert (s["protocol_rows"], s["evaluated_rows"], s["ignored_rows"], s["pass_rate"]) == (4, 3, 1, 1.0)


def test_month_lists_and_guards(spark):
    assert trips.month_list(months="3,1,3") == [3, 1]
    assert trips.month_list(first=11, last=12) == [11, 12]
    with pytest.raises(ValueError):
        trips.month_list(month=13)
    with pytest.raises(ValueError):
        fusion.weights(-1, 2)
    with pytest.raises(ValueError):
        fusion.weights(0, 0)
    with pytest.raises(ValueError):
        fusion.require_columns(spark.range(1), ["id", "x"], "table")


def test_slowdown_needs_a_baseline(spark):
    assert value(spark, scores.slowdown_ratio(F.lit(10.0), F.lit(None).cast("double"))) is None
    assert value(spark, scores.slowdown_ratio(F.lit(10.0), F.lit(0.0))) is None
    assert value(spark, scores.slowdown_ratio(F.lit(50.0), F.lit(40.0))) == 0.0
    assert value(spark, scores.slowdown_ratio(F.lit(10.0), F.lit(40.0))) == 0.75


def test_nested_report_is_one_document(spark, tmp_path):
    import json

    from sensorlith.sources import reports

    rows = spark.createDataFrame([(i % 50, f'say "{i}"', None if i % 3 else i) for i in range(200)], "a int, b string, c int").repartition(7)
    one = spark.createDataFrame([(5, None)], "n int, m string")
    report = reports.nested_report({"one": one, "other": one}, {"rows": (rows, ["a", "b"]), "none": (rows.limit(0), ["a"]), "twice": (rows.limit(1).union(rows.limit(1)), ["a"])})
    reports.write_nested_report(report, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    got = json.loads(text)
    assert got["one"] == got["other"] == {"n": 5, "m": None} and got["none"] == [] and len(got["twice"]) == 2
    assert got["rows"] == [{"a": a, "b": b, "c": x} for a, b, x in sorted(((i % 50, f'say "{i}"', None if i % 3 else i) for i in range(200)), key=lambda r: r[:2])]


def test_file_columns_read_names_once_a_file(spark, tmp_path):
    """The name of a file is looked at after its trips are counted; a task does not write a part of every file."""
    from sensorlith.plans.trips import file_columns
    from sensorlith.sources.landing import read_trips

    for month, n in ((1, 3), (2, 5)):
        folder = tmp_path / "yellow" / "2024" / f"{month:02d}" / f"yellow_tripdata_2024-{month:02d}.parquet"
        spark.sql(f"SELECT id AS order_id, IF(id = 0, NULL, id) AS fare_amount FROM range(0, {n}, 1, 2)").write.parquet(str(folder))
    found = file_columns(read_trips(spark, str(tmp_path)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    counted = plan.index("\n", plan.index("Aggregate [_path"))
    assert "regexp_extract" in plan[:counted] and "regexp_extract" not in plan[counted:]
    got = sorted((r["taxi_type"], r["data_year"], r["data_month"], r["row_count"], r["column_name"], r["not_null_count"]) for r in found.collect())
    assert got == [("yellow", 2024, m, n, c, v) for m, n in ((1, 3), (2, 5)) for c, v in (("fare_amount", n - 1), ("order_id", n))]
