"""Grid operators against plain searches on small random maps."""

from __future__ import annotations

from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorlith.operators import grids as G
from sensorlith.plans import maps as MP


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(1)
    data = {m: rng.choice([-1, 0, 0, 0, 100], (9, 14)) for m in range(6)}
    data[6] = np.zeros((9, 14), dtype=int)
    data[6][1::2, :-1] = 100
    data[6][3::4, :] = 100
    data[6][3::4, 1:] = 100
    data[6][3::4, 0] = 0
    rows = [(m, 14, 9, 0.5, -1.0, -2.0, [int(v) for v in d.ravel()], 0.1, 0.1) for m, d in data.items()]
    rows.append((99, 3, 3, 0.5, 0.0, 0.0, [0, 0], 0.1, 0.1))
    df = spark.createDataFrame(
        rows, "map_id int, width int, height int, resolution double, origin_x double, origin_y double, data array<int>, robot_x double, robot_y double"
    )
    return data, df


def around(r, c, shape, steps):
    for dr, dc in steps:
        if 0 <= r + dr < shape[0] and 0 <= c + dc < shape[1]:
            yield r + dr, c + dc


def frontier(d):
    return {(r, c) for r, c in zip(*np.where(d == 0)) if any(d[n] == -1 for n in around(r, c, d.shape, G.FOUR))}


def components(cells, smallest):
    left, out = set(cells), []
    while left:
        group, queue = set(), [left.pop()]
        while queue:
            r, c = queue.pop()
            group.add((r, c))
            for n in [(r + a, c + b) for a, b in G.EIGHT]:
                if n in left:
                    left.remove(n)
                    queue.append(n)
        if len(group) >= smallest:
            out.append(frozenset(group))
    return set(out)


def hops(d, start):
    dist, queue = {start: 0}, deque([start])
    while queue:
        r, c = queue.popleft()
        for n in around(r, c, d.shape, G.FOUR):
            if d[n] == 0 and n not in dist:
                dist[n] = dist[(r, c)] + 1
                queue.append(n)
    return dist


def test_malformed_maps_are_left_out(world):
    data, df = world
    assert {r[0] for r in G.cells(df).select("map_id").distinct().collect()} == set(data)


def test_frontier_and_clusters(world):
    data, df = world
    grid = G.cells(df)
    got = {m: set() for m in data}
    for r in G.frontier(grid).collect():
        got[r["map_id"]].add((r["row"], r["col"]))
    groups = {}
    for r in G.clusters(G.frontier(grid), 4).collect():
        groups.setdefault((r["map_id"], r["label"]), set()).add((r["row"], r["col"]))
    for m, d in data.items():
        assert got[m] == frontier(d)
        assert {frozenset(v) for (k, _), v in groups.items() if k == m} == components(frontier(d), 4)


def test_distances_and_paths(world, spark):
    data, df = world
    starts = {m: tuple(int(v) for v in np.argwhere(d == 0)[0]) for m, d in data.items()}
    s = spark.createDataFrame([(m, *v) for m, v in starts.items()], "map_id int, start_row int, start_col int")
    dist = G.hop_distances(G.cells(df), s)
    got = {m: {} for m in data}
    for r in dist.collect():
        got[r["map_id"]][(r["row"], r["col"])] = r["steps"]
    goals = []
    for m, d in data.items():
        want = hops(d, starts[m])
        assert {k: v for k, v in got[m].items() if v is not None} == want
        goals.append((m, *max(want, key=want.get)))
    paths = {}
    for r in G.shortest_paths(dist, spark.createDataFrame([(m, int(a), int(b)) for m, a, b in goals], "map_id int, goal_row int, goal_col int")).collect():
        paths.setdefault(r["map_id"], {})[r["step"]] = (r["row"], r["col"])
    for m, a, b in goals:
        way, want = paths[m], hops(data[m], starts[m])
        assert sorted(way) == list(range(want[(a, b)] + 1))
        assert way[0] == starts[m] and way[len(way) - 1] == (a, b)
        assert all(abs(way[i][0] - way[i + 1][0]) + abs(way[i][1] - way[i + 1][1]) == 1 for i in range(len(way) - 1))


def test_inflation(world):
    data, df = world
    got = {(r["map_id"], r["row"], r["col"]): r["value"] for r in G.inflated(G.cells(df), F.lit(2)).collect()}
    for m, d in data.items():
        full = np.argwhere(d > 0)
        for r in range(9):
            for c in range(14):
                near = len(full) > 0 and (((full - [r, c]) ** 2).sum(axis=1) <= 4).any()
                assert got[(m, r, c)] == (100 if d[r, c] == 0 and near else d[r, c])


def test_exploration_job_has_a_row_per_map(world):
    data, df = world
    rows = MP.explore(df, min_cluster=3, clearance_m=-0.4).collect()
    assert {r["map_id"] for r in rows} >= set(data)
    assert any(r["goal_row"] is not None for r in rows)


def test_settled_maps_are_not_written_again(spark, monkeypatch):
    """One winding map takes many rounds, the open ones one or two; all rounds together write few rows."""
    size, grids = 15, []
    for m in range(60):
        grid = np.zeros((size, size), int)
        if m == 0:  # a way to and fro
            for r in range(1, size, 2):
                grid[r, :] = 100
                grid[r, size - 1 if r % 4 == 1 else 0] = 0
        grids += [(m, r, q, int(grid[r, q])) for r in range(size) for q in range(size)]
    cells = spark.createDataFrame(grids, "map_id long, row int, col int, value int")
    starts = spark.createDataFrame([(m, 0, 0) for m in range(60)], "map_id long, start_row int, start_col int")
    written, cut = [], G.cut

    def counted(df):
        out = cut(df)
        if "steps" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(G, "cut", counted)
    got = {(r.map_id, r.row, r.col): r.steps for r in G.hop_distances(cells, starts).collect()}
    assert got[1, 14, 14] == 28 and got[0, 14, 14] > 100 and len(got) == sum(v == 0 for *_, v in grids)
    print(f"rows written over {len(written)} rounds: {sum(written)} of {len(got)} cells")
    assert sum(written) <= 3 * len(got)


def test_maps_that_fit_a_task_give_the_rows_of_the_rounds(world, spark, monkeypatch):
    """Labels, steps and ways from blocks of maps and from rounds of joins, also where maps stand there twice, and where two maps
    are large and the others small; the small ones start no job for a round."""
    data, df = world
    twice = df.unionByName(df.filter("map_id = 4"))
    starts = spark.createDataFrame([(m, *map(int, np.argwhere(d == 0)[0])) for m, d in data.items()] + [(None, 0, 0)], "map_id int, start_row int, start_col int")
    goals = spark.createDataFrame([(m, *map(int, np.argwhere(d == 0)[-1])) for m, d in data.items()], "map_id int, goal_row int, goal_col int")
    calls, cut = [], G.cut
    monkeypatch.setattr(G, "cut", lambda x: (calls.append(1), cut(x))[1])

    def everything(grid, single):
        found = sorted(G.clusters(G.frontier(single), 3).collect())
        steps = G.hop_distances(grid, starts)
        return found, sorted(map(str, steps.collect())), sorted(map(str, G.shortest_paths(G.hop_distances(single, starts), goals).collect()))

    grid, single = G.cells(twice), G.cells(df)
    for maps in (grid, single):
        maps.count()
    whole = everything(grid, single)
    assert len(calls) <= 4  # one look at the sizes for each operator
    monkeypatch.setattr(G.B, "MAX_CELLS", 10)
    assert everything(grid, single) == whole and len(calls) > 20
    monkeypatch.setattr(G.B, "MAX_CELLS", 130)
    assert everything(grid, single) == whole


def test_clusters_of_repeated_cells_are_those_of_the_rounds(spark, monkeypatch):
    cells = [(m, 1, c) for m in (1, 2) for c in range(4)] + [(2, 1, 2)] + [(3, r, 7) for r in (5, 6, 7, 7)]
    found = spark.createDataFrame(cells, "map_id long, row int, col int")
    blocks = sorted(map(str, G.clusters(found, 4).collect()))
    monkeypatch.setattr(G.B, "MAX_CELLS", 1)
    assert sorted(map(str, G.clusters(found, 4).collect())) == blocks and len(blocks) > 8


def test_blocks_hold_whole_maps(monkeypatch):
    import pyarrow as pa

    from sensorlith.operators import map_blocks as B

    monkeypatch.setattr(B, "BLOCK", 10)
    ids = np.repeat(np.arange(12), [3, 1, 9, 14, 2, 2, 30, 1, 1, 5, 4, 6])
    batches = [pa.RecordBatch.from_pydict({"map_id": ids[i : i + 4], "x": np.arange(len(ids))[i : i + 4]}) for i in range(0, len(ids), 4)]
    got = [t for _, t in B.blocks(iter(batches))]
    assert [x for t in got for x in t["x"].to_pylist()] == list(range(len(ids)))
    assert sum(len(set(t["map_id"].to_pylist())) for t in got) == 12 and len(got) > 3
