"""Toxicity held out, its score recomputed sentence by sentence, and the pipeline from end to end."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from sensorlith.llm import toxicity
from sensorlith.llm.queries import LLM_QUERIES


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    scored = LLM_QUERIES["op1_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out AND toxic IS NOT NULL")
    n = scored.groupBy("toxic", "predicted").count().collect()
    count = {(r.toxic, r.predicted): r["count"] for r in n}
    recall = count[1, 1] / (count[1, 1] + count.get((1, 0), 0))
    precision = count[1, 1] / (count[1, 1] + count.get((0, 1), 0))
    print(f"toxicity, held out: recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.85 and precision >= 0.85


def test_score_is_the_calibrated_noisy_or(spark, messy):
    r = np.random.default_rng(8)
    model = toxicity.ToxicityModel(r.uniform(0, 0.4, 1 << toxicity.BUCKET_BITS).astype(np.float32), -3.0, 1.4, 0.6)
    texts = {k: x.text for k, x in enumerate(messy.collect())}
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    got = {x.doc_id: x for x in toxicity.score(df, model).collect()}
    for k, text in texts.items():
        clean, sentences = 1.0, toxicity.Features([(text or "").encode()])
        for s, (a, b) in enumerate(zip(*sentences.span)):
            one = toxicity.Features([(text or "").encode()[a:b]])
            z = model.bias + sum(float(model.weights[x]) for x in one.buckets.ravel())
            clean *= 1 - 1 / (1 + math.exp(-z))
        want = 0.0 if not len(sentences.span[0]) else 1 / (1 + math.exp(-(1.4 * min(60.0, math.log(max(1 - clean, 1e-300) / max(clean, 1e-300))) + 0.6)))
        assert abs(got[k].score - want) < 1e-4, (k, text)


def test_model_does_not_depend_on_order_or_repeated_ids(spark):
    docs = [(i, f"word{i % 7} plain text. " + ("vile thing" if i % 3 == 0 else "nice thing")) for i in range(120)]
    docs += [(5, "another text of the same id"), (9, "and one more")]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    models = [toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels) for rows, n in ((docs, 1), (docs[::-1], 6))]
    assert models[0].bias == models[1].bias and (models[0].weights == models[1].weights).all()


def test_calibration():
    odds = np.array([-5.0, -4, -3, -2, -1, 0, 1, 2])
    slope, shift = toxicity.calibration(odds, np.array([0.0, 0, 0, 0, 1, 1, 1, 1]))
    assert slope > 0 and abs(shift - 1.5 * slope) < 1e-9
    assert toxicity.calibration(odds, np.array([1.0, 1, 1, 0, 0, 0, 0, 0])) == (1.0, 0.0)


def test_pipeline_from_end_to_end(spark):
    """Every stage gets what its predecessor kept, decides on it as its operator does alone, and the shards hold the rest."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stored(stage(spark, kept, sf), f"test-{name}")
        assert after.columns == columns
        if name != "source_mixture":  # filters leave rows as they are
            assert after.exceptAll(kept).count() == 0
        else:
            assert after.select("doc_id").exceptAll(kept.select("doc_id")).count() == 0 or after.join(kept, "doc_id", "left_anti").count() == 0
        kept = after
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    final = corpus_pipeline.run(spark, sf)
    assert ids(final) == ids(kept)
    rows = final.orderBy("start").collect()
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]).tolist()
    flagged = ids(LLM_QUERIES["op1_toxicity"](spark, sf).where(F.col("predicted") == 1))
    assert not flagged & ids(final)
    assert not ids(LLM_QUERIES["op5_decontamination"](spark, sf)) & ids(final)
