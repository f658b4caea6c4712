"""The permutation index against all products."""

from __future__ import annotations

import numpy as np

from sensorlith.llm import neighbours


def exact(ids, x, k, modulus):
    out = {}
    for i in np.flatnonzero(ids % modulus == 0):
        others = np.flatnonzero(ids != ids[i])
        s = x[others] @ x[i]
        best = np.lexsort((ids[others], -s))[:k]
        out[ids[i]] = [(int(ids[others][b]), float(s[b])) for b in best]
    return out


def test_small_index_is_exact(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 8)) * r.uniform(0.2, 3, (300, 1))
    x[7] = x[8]
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * 8), (1040, [1.0, None] + [0.0] * 6), (1060, [float("nan")] * 8), (1080, [float("inf")] + [1.0] * 7), (1100, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("rank", neighbours.F.lit("clash")).repartition(4)
    got = neighbours.Index(df).search(df.where("vec_id % 20 = 0"), 20).collect()
    found: dict = {}
    for row in sorted(got, key=lambda q: (q.query_id, q.rank)):
        found.setdefault(row.query_id, []).append((row.vec_id, row.score))
    true = exact(np.arange(300), x, 20, 20)
    assert found.keys() == true.keys()
    for q in true:
        assert [i for i, _ in found[q]] == [i for i, _ in true[q]]
        np.testing.assert_allclose([s for _, s in found[q]], [s for _, s in true[q]], rtol=1e-12)
    assert [r.rank for r in sorted(got, key=lambda q: (q.query_id, q.rank))] == list(range(1, 21)) * 15


def test_recall_beyond_the_reranked(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    pdf = rows.toPandas()
    ids, x = pdf.vec_id.to_numpy(), np.stack(pdf.embedding.to_list()).astype(float)
    true = exact(ids, x, 20, 20)
    got = neighbours.Index(rows, segment=700).search(rows.where("vec_id % 20 = 0"), 20, rerank=100).toPandas().groupby("query_id").vec_id.apply(set)
    recall = np.mean([len({i for i, _ in true[q]} & got[q]) / 20 for q in true])
    assert recall >= 0.9


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = neighbours.Index(few).search(few.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in got] == [(0, 1, 20, 0.5), (0, 2, 3, 0.0), (0, 3, 3, 0.0), (20, 1, 0, 0.5), (20, 2, 3, 0.5), (20, 3, 3, 0.5)]
    none = few.limit(0)
    assert neighbours.Index(none).search(none, 20).count() == 0
