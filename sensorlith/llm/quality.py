"""Quality by hierarchical empirical Bayes: what a document looks like, and what its site is like.

A classifier turns a document's text into a probability of good quality: the evidence. A site's quality is unknown too;
documents of a site (first level, such as a host) and of a part of it (second level, such as a path) tell of it. Each
level's mean is shrunk towards the level above, the more the fewer documents it has: a part towards its site,
a site towards the whole. How strong the pull is comes from the data: from how much the means of one level differ
beyond what chance explains. All of it are sums by group. The score weighs the evidence with its part's posterior.

Results in special cases: a null or empty text is evidence like any other (no words); null levels are a group of their
own; without labels of both kinds the evidence is the share of good labels, or 0.5; repeated rows are scored each
and count each; null ids are scored and never learned from; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlith.llm.frames import bounded_sample, bucket_of, stored
from sensorlith.llm.words import Words, pieces, texts_of

SAMPLE_DOCUMENTS = 12_000

_CLASS = np.full(256, 7, np.uint8)
_CLASS[0x61:0x7B] = 0
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[0x80:] = 3
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 4
_CLASS[0x0A] = 5
_CLASS[list(b".,")] = 6
_CLASS[list(b"|")] = 8
_CLASSES = 9


def features(texts: list[bytes]) -> np.ndarray:
    """Shares of neighbouring kinds of characters, and of repeated words, and lengths: a row for each text."""
    words = Words(texts, lower=True)
    kinds = _CLASS[np.frombuffer(words.data, np.uint8)]
    lengths = np.diff(words.offsets) - 1
    pair = kinds[:-1].astype(np.int64) * _CLASSES + kinds[1:]
    pairs = _CLASSES * _CLASSES
    owner = np.repeat(np.arange(len(texts)), lengths + 1)[: len(pair)]
    counts = np.bincount(owner * pairs + pair, minlength=len(texts) * pairs)[: len(texts) * pairs].reshape(len(texts), pairs)
    n = words.counts
    distinct = np.array([len(np.unique(words.hashes[a:b])) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())], float).reshape(-1)
    size = (words.ends - words.starts).astype(float)
    totals = np.concatenate([[0.0], np.cumsum(size)])
    mean = (totals[words.first[1:]] - totals[words.first[:-1]]) / np.maximum(n, 1)
    share = counts / np.maximum(lengths, 1)[:, None]
    return np.column_stack([np.sqrt(share), distinct / np.maximum(n, 1), np.log1p(n), np.log1p(n) ** 2, np.log1p(mean)])


@dataclass(frozen=True)
class QualityModel:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        z = ((features(texts) - self.centre) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def fit(texts: list[bytes], good: np.ndarray, rounds: int = 25, ridge: float = 1.0) -> QualityModel:
    """Logistic regression by Newton steps."""
    x = features(texts) if texts else np.zeros((1, _CLASSES * _CLASSES + 4))
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    weights = np.zeros(x.shape[1] + 1)
    share = float(good.mean()) if len(good) else 0.5
    if not len(good) or good.min() == good.max():
        return QualityModel(centre, scale, weights[:-1], float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    x = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    weights[-1] = np.log(share / (1 - share))
    pull = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -12, 12)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + pull, x.T @ (good - p) - pull @ weights)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return QualityModel(centre, scale, weights[:-1], float(weights[-1]))


def learn(docs: DataFrame, labels: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> QualityModel:
    """Fit on at most ``documents`` labelled documents outside the held-out fifth, in one task; the bound holds whatever
    the size of the corpus. A document with several labels counts as good only if all say so."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(bucket_of("doc_id", 5) != 0)
    known = bounded_sample(known.groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", documents)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, t, q) for b in batches for i, t, q in zip(b["doc_id"].to_pylist(), texts_of(b["text"]), b["quality"].to_pylist()))
        model = fit([t for _, t, _ in rows], np.array([q for *_, q in rows], float))
        yield pa.RecordBatch.from_pydict({k: [getattr(model, k).tolist()] for k in ("centre", "scale", "weights")} | {"bias": [model.bias]})

    for row in sample.coalesce(1).mapInArrow(train, "centre array<double>, scale array<double>, weights array<double>, bias double").collect():
        return QualityModel(np.array(row.centre), np.array(row.scale), np.array(row.weights), row.bias)
    return fit([], np.zeros(0))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(mean: Column, between: Column) -> Column:
    """How many documents the level above is worth: that of a beta distribution with this mean and variance."""
    return F.greatest(F.least(mean * (1 - mean) / F.greatest(between, F.lit(1e-9)) - 1, F.lit(1e6)), F.lit(1.0))


def _between(groups: DataFrame, above: Column) -> Column:
    """The variance of group means around the level above, beyond what differences within groups explain."""
    spread = F.sum(F.col("n") * (F.col("mean") - above) ** 2) - F.sum("within")
    return F.lit(groups.agg(F.greatest(spread / F.sum("n"), F.lit(0.0))).first()[0] or 0.0)


def posteriors(evidence: DataFrame) -> DataFrame:
    """site, part, site_posterior, part_posterior and prior (of the whole) from rows of (site, part, evidence)."""
    parts = evidence.groupBy("site", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") ** 2).alias("q"))
    parts = stored(parts, "parts")
    mean, within = F.col("s") / F.col("n"), F.greatest(F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2, F.lit(0.0))
    parts = parts.withColumn("mean", mean).withColumn("within", within)
    sites = parts.groupBy("site").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).withColumn("mean", mean).withColumn("within", within)
    whole = sites.agg(F.sum("s") / F.sum("n")).first()[0]
    prior = F.lit(min(max(whole if whole is not None else 0.5, 1e-6), 1 - 1e-6))
    pull = _strength(prior, _between(sites, prior))
    sites = sites.select(F.col("site").alias("_site"), ((F.col("s") + pull * prior) / (F.col("n") + pull)).alias("site_posterior"))
    parts = parts.join(sites, parts["site"].eqNullSafe(sites["_site"])).drop("_site").withColumn("prior", prior)
    pull = _strength(F.col("site_posterior"), _between(parts, F.col("site_posterior")))
    parts = parts.withColumn("pull", pull)
    return parts.select("site", "part", "prior", "site_posterior", ((F.col("s") + F.col("pull") * F.col("site_posterior")) / (F.col("n") + F.col("pull"))).alias("part_posterior"))


def score(docs: DataFrame, model: QualityModel, site: str = "source", part: str = "lang") -> DataFrame:
    """doc_id, evidence, site_posterior, part_posterior and score of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                yield pa.RecordBatch.from_arrays([piece["doc_id"], piece["site"], piece["part"], pa.array(sent.value.evidence(texts_of(piece["text"])))], ["doc_id", "site", "part", "evidence"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(site).cast("string").alias("site"), F.col(part).cast("string").alias("part"), "text")
    rows = stored(rows.mapInArrow(run, "doc_id long, site string, part string, evidence double"), "evidence")
    groups = posteriors(rows).select(F.col("site").alias("_site"), F.col("part").alias("_part"), "prior", "site_posterior", "part_posterior")
    rows = rows.join(groups, rows["site"].eqNullSafe(groups["_site"]) & rows["part"].eqNullSafe(groups["_part"]))
    odds = _logit(F.col("evidence")) + _logit(F.col("part_posterior")) - _logit(F.col("prior"))
    return rows.select("doc_id", "evidence", "site_posterior", "part_posterior", (1 / (1 + F.exp(-odds))).alias("score"))
