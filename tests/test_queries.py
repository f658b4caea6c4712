"""Registered queries against their SQL. A share of them by default; all with SENSORLITH_ALL_QUERIES=1."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check_queries import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SHARE = """trip_anomaly_counts trip_month_summary trip_zone_density trip_top_routes_named station_reliability speed_current_segments
weather_context fusion_stations fusion_with_weather imu_processed_runs imu_clean_segments imu_filter_performance track_intermittent_gps
mission_run_metrics mission_contract_errors signal_event_records rover_guarded_commands map_candidates snapshot_road_facts
stream_slip_alerts""".split()
NAMES = sorted(entry.queries()) if os.environ.get("SENSORLITH_ALL_QUERIES") else SHARE

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns) > 0
        return
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_the_nine_rules(spark):
    assert entry.entry(spark).count() == 9
