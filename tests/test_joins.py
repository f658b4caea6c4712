"""Distance and overlap joins against all pairs on small data."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from sensorlith.operators import spatial
from sensorlith.operators.intervals import overlaps
from sensorlith.operators.spatial import lines_within, nearest_line, nearest_point, segments_of
from sensorlith.plans.fusion import local_traffic

R = 6_371_000.0


def to_line(lat, lon, points):
    p = np.radians(np.array(points))
    xy = np.c_[R * (p[:, 1] - np.radians(lon)) * np.cos(np.radians(lat)), R * (p[:, 0] - np.radians(lat))]
    best = np.inf
    for a, b in zip(xy[:-1], xy[1:]):
        d = b - a
        t = 0.0 if not d.any() else np.clip(-(a @ d) / (d @ d), 0, 1)
        best = min(best, np.hypot(*(a + t * d)))
    return best


@pytest.fixture(scope="module")
def places(spark):
    rng = np.random.default_rng(2)
    stations = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(40.5, 40.9, 60), rng.uniform(-74.2, -73.7, 60)))]
    # Some stations share a place, one lies far outside, and links differ much in length.
    stations += [(100 + i, *stations[0][1:]) for i in range(5)] + [(200, 41.9, -72.0)]
    lines = []
    for i in range(40):
        start = np.array([rng.uniform(40.5, 40.9), rng.uniform(-74.2, -73.7)])
        steps = rng.normal(0, 0.02 if i % 5 == 0 else 0.002, (rng.integers(1, 4), 2))
        lines.append((i, [tuple(map(float, p)) for p in np.vstack([start, start + np.cumsum(steps, axis=0)])]))
    s = spark.createDataFrame(stations, "station_id long, lat double, lon double")
    l = spark.createDataFrame([(i, [{"lat": a, "lon": b} for a, b in p]) for i, p in lines], "link_id long, points array<struct<lat:double,lon:double>>")
    return stations, lines, s, segments_of(l, "link_id", "points")


def test_all_lines_within_a_radius(places):
    stations, lines, s, seg = places
    got = {(r[0], r[1]): r[2] for r in lines_within(s, "station_id", seg, "link_id", 2500.0).collect()}
    want = {(i, j): d for i, a, b in stations for j, p in lines if (d := to_line(a, b, p)) <= 2500.0}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_pairs_of_few_rows_keep_their_tasks(spark, places):
    """Distances of a dense place take long though its rows are few bytes: they are not all put into one task."""
    _, _, s, seg = places
    close = spatial.lines_around(s, seg, "link_id", 2500.0)
    close.collect()
    plan = close._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert sum("hashpartitioning(_y" in line and "REPARTITION_BY_NUM" in line for line in plan.splitlines()) == 2
    assert close.count() == close.select("lat", "lon", "link_id").distinct().count()


def test_dense_lines_are_all_found(spark):
    """Short and long links by the hundred around few places, at the equator and far north; a place counts for each of its stations."""
    rng = np.random.default_rng(5)
    for lat0 in (0.0, 64.0):
        stations = [(i, lat0 + float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-0.02, 0.02, (25, 2)))]
        stations += [(99, *stations[0][1:])]
        lines = [(i, [(lat0 + float(p[0]), float(p[1])) for p in start + np.vstack([[0, 0], rng.normal(0, 0.03 if i % 9 == 0 else 0.003, (2, 2))])]) for i, start in enumerate(rng.uniform(-0.05, 0.05, (300, 2)))]
        s = spark.createDataFrame(stations, "station_id long, lat double, lon double")
        l = spark.createDataFrame([(i, [{"lat": a, "lon": b} for a, b in p], float(i % 100), f"l{i}") for i, p in lines], "link_id long, points array<struct<lat:double,lon:double>>, traffic_stress_score double, link_name string")
        want = {(i, j): d for i, a, b in stations for j, p in lines if (d := to_line(a, b, p)) <= 1500.0}
        got = {(r[0], r[1]): r[2] for r in lines_within(s, "station_id", segments_of(l, "link_id", "points"), "link_id", 1500.0).collect()}
        assert got.keys() == want.keys() and len(want) > 500 and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
        for r in local_traffic(s, l, 1500.0).collect():
            mine = {j: np.exp(-d / 1500.0) for (i, j), d in want.items() if i == r["station_id"]}
            assert r["nearby_traffic_segment_count"] == len(mine)
            assert r["local_score"] == pytest.approx(sum(w * (j % 100) for j, w in mine.items()) / sum(mine.values()))


def trees(monkeypatch, leaf, fan, top, rows):
    for name, value in {"LEAF": leaf, "FAN": fan, "TOP": top, "PART_ROWS": rows}.items():
        monkeypatch.setattr(spatial, name, value)


#: one leaf; leaves only; several levels in one part; many parts
TREES = [(32, 128, 4096, (4096, 1 << 20)), (3, 2, 4096, (4096, 1 << 20)), (2, 2, 3, (4096, 1 << 20)), (2, 3, 2, (9, 18))]


@pytest.mark.parametrize("shape", TREES)
def test_nearest_line_however_far(places, monkeypatch, shape):
    stations, lines, s, seg = places
    trees(monkeypatch, *shape)
    got = {r[0]: (r[1], r[2]) for r in nearest_line(s, "station_id", seg, "link_id").collect()}
    assert len(got) == len(stations)
    for i, a, b in stations:
        d, j = min((to_line(a, b, p), j) for j, p in lines)
        assert got[i] == (j, pytest.approx(d, abs=1e-6))


@pytest.mark.parametrize("shape", TREES[::2] + TREES[3:])
def test_nearest_point_on_the_globe(spark, monkeypatch, shape):
    trees(monkeypatch, *shape)
    rng = np.random.default_rng(6)
    at = [(i, float(rng.uniform(-89, 89)), float(rng.uniform(-180, 180))) for i in range(80)]
    to = [(i, float(rng.uniform(-89, 89)), float(rng.uniform(-180, 180))) for i in range(50)] + [(90, 10.0, 179.9), (91, 10.0, 179.9), (92, None, None)]
    got = {r[0]: r[1] for r in nearest_point(
        spark.createDataFrame(at, "p long, lat double, lon double"), "p", spark.createDataFrame(to, "q long, lat double, lon double"), "q").collect()}

    def hav(a, b, c, d):
        a, b, c, d = np.radians([a, b, c, d])
        return 2 * R * np.arcsin(np.sqrt(np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2))

    for i, a, b in at:
        assert got[i] == min((hav(a, b, x, y), j) for j, x, y in to if x is not None)[1]


def test_nearest_of_nothing(spark, places):
    _, _, s, seg = places
    assert nearest_line(s, "station_id", seg.limit(0), "link_id").count() == 0
    assert nearest_line(s.limit(0), "station_id", seg, "link_id").count() == 0
    assert nearest_point(s, "station_id", s.limit(0).withColumnRenamed("station_id", "t"), "t").columns == ["station_id", "t", "distance_m"]


def test_curve_takes_binary_digits_in_turn(spark):
    rng = np.random.default_rng(1)
    for axes, bits in ((2, 31), (3, 20)):
        x = rng.uniform(0, 1, (50, axes))
        df = spark.createDataFrame([tuple(map(float, r)) for r in x], [f"x{a}" for a in range(axes)])
        got = [r[0] for r in df.select(spatial.along_curve([spatial.F.col(f"x{a}") for a in range(axes)])).collect()]
        want = [sum((int(v * 2**bits) >> b & 1) << (b * axes + a) for a, v in enumerate(r) for b in range(bits)) for r in x]
        assert got == want


def test_few_candidates_for_each_place(spark):
    """A search reads a few leaves, wherever the query lies: also far from a dense crowd of targets."""
    rng = np.random.default_rng(4)
    to = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.normal(40, 0.01, 5000), rng.normal(-73, 0.01, 5000)))]
    at = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-60, 60, 100), rng.uniform(-170, 170, 100)))] + [(1000 + i, a, b) for i, a, b in to[:100]]
    targets = spark.createDataFrame(to, "t long, lat double, lon double").withColumn("_low", spatial.F.array("lat", "lon")).withColumn("_high", spatial.F.col("_low"))
    tree = spatial.Tree(targets, spatial.along_curve([(spatial.F.col("lat") + 90) / 180, (spatial.F.col("lon") + 180) / 360]), 2)
    found = tree.near(spark.createDataFrame(at, "q long, lat double, lon double"), [spatial.F.col("lat"), spatial.F.col("lon")], [spatial.F.lit(1.0)] * 2)
    assert found.count() < 10 * len(at)


def test_overlaps_against_all_pairs(spark):
    rng = np.random.default_rng(9)

    def table(n, scale):
        start = rng.uniform(-20, 100, n)
        return pd.DataFrame({"run_id": rng.integers(0, 3, n), "i": np.arange(n), "a": start, "b": start + rng.exponential(scale, n)})

    left, right = table(80, 3.0), pd.concat([table(60, 0.2), pd.DataFrame({"run_id": [0], "i": [99], "a": [-50.0], "b": [500.0]})])
    got = {(r["i"], r["r_i"]): r["overlap"] for r in overlaps(spark.createDataFrame(left), spark.createDataFrame(right), ["run_id"], "a", "b").collect()}
    want = {}
    for x in left.itertuples():
        for y in right.itertuples():
            o = min(x.b, y.b) - max(x.a, y.a)
            if x.run_id == y.run_id and o > 0:
                want[(x.i, y.i)] = o
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
