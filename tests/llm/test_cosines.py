"""Tiled comparison of vectors against all products."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorlith.llm import cosines
from sensorlith.llm.queries import LLM_QUERIES

SCHEMA = "vec_id long, embedding array<double>, label string"


def all_pairs(rows, threshold=0.93):
    """Sorted (vec_id, n_links, component_id, kept) of rows (vec_id, vector or None, label)."""
    usable = [k for k, (i, v, c) in enumerate(rows) if i is not None and v and c is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    low, links = {k: k for k in range(len(rows))}, dict.fromkeys(range(len(rows)), 0)

    def root(k):
        while low[k] != k:
            k = low[k]
        return k

    for a in usable:
        for b in usable:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (cosines.unit(np.array([rows[k][1]], float))[0] for k in (a, b))
                if x @ y >= threshold:
                    links[a] += 1
                    links[b] += 1
                    low[root(a)] = root(b)
    smallest = {}
    for k, (i, *_) in enumerate(rows):
        if i is not None:
            smallest[root(k)] = min(smallest.get(root(k), i), i)
    out = [(i, links[k], smallest.get(root(k)), None if i is None else i == smallest[root(k)]) for k, (i, *_) in enumerate(rows)]
    return sorted(out, key=str)


def collected(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def clustered(seed, n, width):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(8, width))
    x = centres[r.integers(0, 8, n)] + r.normal(size=(n, width)) * r.choice([0.0, 0.15, 0.3, 0.6], (n, 1))
    return [(int(i), v.tolist(), r.choice(["a", "a", "a", "b"]).item()) for i, v in zip(r.permutation(3 * n)[:n], x)]


@pytest.mark.parametrize("tile_bytes", [1 << 20, 1 << 11])
def test_all_links(spark, tile_bytes):
    rows = clustered(1, 260, 24)
    got = collected(cosines.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), tile_bytes=tile_bytes))
    assert got == all_pairs(rows)
    assert sum(r[1] for r in got) > 500


def test_odd_vectors(spark):
    one, nan, inf = [1.0, 0.0], float("nan"), float("inf")
    rows = [(1, one, "a"), (2, [2.0, 0.0], "a"), (3, one, "b"), (4, None, "a"), (5, [], "a"), (6, [0.0, 0.0], "a"), (7, [nan, 1.0], "a"), (8, [inf, 1.0], "a"), (9, [None, 1.0], "a"), (10, one, None)]
    rows += [(None, one, "a"), (11, [1e300, 1e290], "a"), (12, [1e-300, 0.0], "a"), (13, [5e-324, 0.0], "a"), (14, [1.0, 0.0, 0.0], "a"), (15, [1.0, 0.1, 0.0], "a"), (16, [3.0], "a"), (1, one, "a"), (1, [0.0, 1.0], "a"), (20, [-1.0, -0.0], "a")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("clash")).withColumn("size", F.lit(3)).repartition(3)
    assert collected(cosines.near_duplicates(df)) == all_pairs(rows)
    assert cosines.near_duplicates(df.limit(0)).count() == 0
    assert collected(cosines.near_duplicates(df.where("embedding IS NULL"))) == [(4, 0, 4, True)]


def test_links_at_the_threshold():
    """Tiles decide by the cosine itself, however few components the bound has seen."""
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 40)) * np.linspace(2, 0.05, 40)
    x[150:] = x[:150] + 0.25 * r.normal(size=(150, 40)) * np.linspace(2, 0.05, 40)
    ids, sizes = np.arange(300), np.ones(300, np.int64)
    u = cosines.unit(x)
    for threshold in (0.5, 0.9, 0.93, float(u[3] @ u[153]), 1.0):
        tile = cosines.Tile(ids, sizes, x, cosines.principal_axes(u))
        i, j = cosines.links_between(tile, tile, threshold)
        exact = np.array([[float(np.einsum("i,i->", a, b)) for b in u] for a in u]) >= threshold
        assert {(a, b) for a, b in zip(i.tolist(), j.tolist())} == {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(exact))) if a < b}


def test_far_tiles_do_not_meet(spark):
    """Tiles of unlike vectors are never joined; the pairs that are found lie in few tile pairs."""
    r = np.random.default_rng(4)
    angle = np.sort(r.uniform(0, 2 * np.pi, 2000))
    rows = [(i, [float(np.cos(a)), float(np.sin(a))], "a") for i, a in enumerate(angle)]
    _, classes = cosines._classes(spark.createDataFrame(rows, SCHEMA))
    tiles = cosines._tiles(classes, None, 0.999, 1 << 9)
    n = tiles.count()
    assert n >= 50 and cosines._meeting(tiles, 0.999).count() < 6 * n


def test_query_on_the_given_table(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert collected(LLM_QUERIES["op13_embedding_dedup"](spark, "/root/testdata/sf0.001")) == all_pairs(rows)
