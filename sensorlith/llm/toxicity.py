"""Toxicity by multiple-instance learning: documents are bags of sentences.

A sentence's probability is logistic in hashed features of its words; a document's is the noisy-or
``1 - prod(1 - p)`` of its sentences. Only document labels are known: their likelihood trains the
sentence model, which then points at the sentences that offend.

Results in special cases: null and empty texts, and texts without words, score 0 and have no
offending sentence; null ids are scored like others and never learned from; repeated rows are
scored each; without labels of both kinds every score is 0. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlith.llm.frames import bounded_sample, bucket_of
from sensorlith.llm.words import Words, mix, pieces, texts_of

PREFIXES = (3, 4, 5, 6)
BUCKET_BITS = 20
SAMPLE_DOCUMENTS = 12_000
OFFENDING = "array<struct<sentence:int,start:int,end:int,score:double>>"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of hashed features and the bias of a sentence; slope and shift calibrate log-odds."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def sentences(self, features: Features) -> np.ndarray:
        z = self.bias + features.sums(self.weights[features.buckets].sum(axis=1, dtype=np.float64))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def calibrated(self, odds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * odds + self.shift, -700, 700)))


class Features:
    """Sentences of texts, and for each word the buckets of its whole form and of its prefixes."""

    def __init__(self, texts: list[bytes]) -> None:
        words = Words(texts)
        raw = np.frombuffer(words.data + bytes(16), np.uint8)
        solid = np.flatnonzero(_LETTER[raw])
        # the word without marks around it; a word of marks alone stays as it is
        first, last = np.searchsorted(solid, words.starts), np.searchsorted(solid, words.ends) - 1
        bare = first <= last
        start, end = words.starts.copy(), words.ends.copy()
        start[bare], end[bare] = solid[first[bare]], solid[last[bare]] + 1
        eight = np.ndarray((len(raw) - 7,), "<u8", _LOWER[raw].tobytes(), strides=(1,))
        length = (end - start).astype(np.uint64)
        head, tail = self._cut(eight[start], length), self._cut(eight[np.maximum(end - 8, start)], length)
        self.buckets = np.empty((len(words), 1 + len(PREFIXES)), np.int32)
        self.buckets[:, 0] = self._bucket(head ^ mix(tail + length))
        for i, k in enumerate(PREFIXES):
            self.buckets[:, 1 + i] = self._bucket(self._cut(head, np.minimum(length, np.uint64(k))) + np.uint64(k << 56))
        breaks = np.concatenate([[0], np.cumsum(raw == 0x0A)])
        new = np.ones(len(words), bool)
        new[1:] = _STOP[raw[words.ends[:-1] - 1]] | (breaks[words.starts[1:]] > breaks[words.ends[:-1]])
        opening = np.flatnonzero(new)
        #: number of the first sentence of each text, with one entry more than texts
        self.first = np.searchsorted(opening, words.first)
        self.span = (words.starts[opening], words.ends[np.append(opening[1:], len(words)) - 1] if len(words) else words.ends)
        self.offsets = words.offsets
        # each word counts once in its sentence, however often it is repeated
        key = (np.cumsum(new) - 1 << BUCKET_BITS) | self.buckets[:, 0]
        key, kept = np.unique(key, return_index=True)
        self.buckets, of = self.buckets[kept], key >> BUCKET_BITS
        self.starts = np.searchsorted(of, np.arange(len(opening)))
        self.first_word = np.searchsorted(of, self.first)

    @staticmethod
    def _cut(eight: np.ndarray, length: np.ndarray) -> np.ndarray:
        keep = np.minimum(length, np.uint64(8)) * np.uint64(8)
        return np.where(keep == 64, eight, eight & ((np.uint64(1) << (keep % np.uint64(64))) - np.uint64(1)))

    @staticmethod
    def _bucket(key: np.ndarray) -> np.ndarray:
        return (mix(key) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)

    def sums(self, by_word: np.ndarray) -> np.ndarray:
        return np.add.reduceat(by_word, self.starts) if len(self.starts) else np.zeros(0)

    def noisy_or(self, sentence: np.ndarray) -> np.ndarray:
        """Log of the probability that no sentence of a text offends."""
        return _clean(sentence, self.first)


class Sample:
    """Documents to learn from, as numbers of kinds of words: words with the same buckets are one kind. Texts are let go of at once."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.buckets: list[np.ndarray] = []
        self.kinds: list[np.ndarray] = []
        self.documents: list[tuple[int, int, int, np.ndarray]] = []  # piece, first and last word, first words of sentences

    def __len__(self) -> int:
        return len(self.documents)

    def add(self, texts: list[bytes]) -> None:
        features = Features(texts)
        b = features.buckets.astype(np.uint64)
        key = mix(b[:, 0] | b[:, 1] << np.uint64(BUCKET_BITS) | b[:, 2] << np.uint64(2 * BUCKET_BITS)) ^ mix(b[:, 3] + (b[:, 4] << np.uint64(32)))
        keys, at, kinds = np.unique(key, return_index=True, return_inverse=True)
        for name, value in (("keys", keys), ("buckets", features.buckets[at]), ("kinds", kinds.astype(np.int32))):
            getattr(self, name).append(value)
        word = np.append(features.starts, len(features.buckets))
        for a, b in zip(features.first[:-1].tolist(), features.first[1:].tolist()):
            self.documents.append((len(self.keys) - 1, int(word[a]), int(word[b]), (word[a:b] - word[a]).astype(np.int32)))

    def numbered(self) -> np.ndarray:
        """Number the kinds alike in all pieces; the buckets of each."""
        keys, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.keys]), return_index=True)
        self.kinds = [np.searchsorted(keys, k).astype(np.int32)[x] for k, x in zip(self.keys, self.kinds)]
        table = np.concatenate([np.zeros((0, 1 + len(PREFIXES)), np.int32), *self.buckets])[at]
        self.keys, self.buckets = [], []
        return table

    def batch(self, numbers: np.ndarray) -> Batch:
        kinds, sentences, first, words = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [0], 0
        for k in numbers.tolist():
            piece, a, b, starts = self.documents[k]
            kinds.append(self.kinds[piece][a:b])
            sentences.append(starts.astype(np.int64) + words)
            first.append(first[-1] + len(starts))
            words += b - a
        kind, of = np.unique(np.concatenate(kinds), return_inverse=True)
        return Batch(kind, of.astype(np.int32), np.concatenate(sentences), np.array(first))


@dataclass(frozen=True)
class Batch:
    """Some documents: the distinct kinds, the kind of each word, the first word of each sentence, the first sentence of each document."""

    kind: np.ndarray
    of: np.ndarray
    starts: np.ndarray
    first: np.ndarray

    def sentences(self, by_kind: np.ndarray) -> np.ndarray:
        return np.add.reduceat(by_kind[self.of], self.starts) if len(self.starts) else np.zeros(0)

    def documents_with(self, table: np.ndarray) -> np.ndarray:
        """How many of the documents have each bucket."""
        words = np.diff(np.append(self.starts, len(self.of)))
        document = np.repeat(np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)), words)
        pairs = np.unique(document.astype(np.int64) * max(len(self.kind), 1) + self.of)
        buckets = table[self.kind][pairs % max(len(self.kind), 1)]
        pairs = np.unique((pairs // max(len(self.kind), 1) << BUCKET_BITS)[:, None] | buckets)
        return np.bincount(pairs & (1 << BUCKET_BITS) - 1, minlength=1 << BUCKET_BITS)


def _clean(sentence: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log of the probability that no sentence of a document offends."""
    total = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(sentence, 1 - 1e-12)))])
    return total[first[1:]] - total[first[:-1]]


def _odds(none: np.ndarray) -> np.ndarray:
    """Log-odds of the noisy-or from the log of the probability that nothing offends."""
    return np.clip(np.log(np.maximum(-np.expm1(none), 1e-300)) - none, -60, 60)


def _descend(batches: list[tuple[Batch, np.ndarray]], columns: np.ndarray, width: int, epochs: int, rate: float, decay: float) -> tuple[np.ndarray, float]:
    """Adaptive gradient steps; ``columns`` gives each kind its weights, the last of ``width`` stands for rare buckets and stays 0."""
    weights, bias = np.zeros(width), -9.0
    seen, seen_bias = np.full(width, 1e-6), 1e-6
    for _ in range(epochs):
        for x, y in batches:
            z = bias + x.sentences(weights[columns[x.kind]].sum(axis=1))
            p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            none = _clean(p, x.first)
            whole = np.maximum(-np.expm1(none), 1e-9)
            share = np.where(y > 0, np.exp(none) / whole, -1.0)  # d log-likelihood / d logit is p times this
            step = p * np.repeat(share, np.diff(x.first))
            by_word = np.repeat(step, np.diff(np.append(x.starts, len(x.of))))
            by_kind = np.bincount(x.of, by_word, len(x.kind))
            grad = np.bincount(columns[x.kind].ravel(), np.repeat(by_kind, columns.shape[1]), width) / len(y)
            grad[-1] = 0
            seen += grad * grad
            weights += rate * (grad / np.sqrt(seen)) - decay * rate * weights
            np.maximum(weights, 0, out=weights)
            g = float(step.sum()) / len(y)
            seen_bias += g * g
            bias += rate * g / np.sqrt(seen_bias)
    return weights, float(bias)


def calibration(odds: np.ndarray, toxic: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift for the log-odds; (1, 0) if larger odds do not mean more toxic documents.

    The slope is that of a logistic fit. Its shift would leave out the few toxic documents of middling odds, so the shift puts 0.5 where
    precision and recall on these documents have their largest harmonic mean."""
    x = np.column_stack([odds, np.ones(len(odds))])
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -60, 60)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        change = np.linalg.solve(curve, x.T @ (toxic - p) - 1e-3 * beta)
        beta = beta + change / max(1.0, float(np.abs(change).max()))
        if np.abs(change).max() < 1e-9:
            break
    if beta[0] <= 0:
        return 1.0, 0.0
    order = np.argsort(-odds, kind="stable")
    down, hits = odds[order], np.cumsum(toxic[order])
    last = np.append(down[1:] < down[:-1], True)  # equal odds stay together
    best = int(np.argmax(np.where(last, 2 * hits / (np.arange(1, len(down) + 1) + toxic.sum()), 0)))
    cut = (down[best] + down[min(best + 1, len(down) - 1)]) / 2
    return float(beta[0]), float(-beta[0] * cut)


def train(sample: Sample, toxic: np.ndarray, epochs: int = 10, batch: int = 256, rate: float = 0.3, decay: float = 3e-4, least: int = 4, folds: int = 3) -> ToxicityModel:
    """Gradient steps on the likelihood of the document labels. Buckets of fewer than ``least``
    documents keep weight 0: they could only learn single documents by heart. Weights are not negative: a sentence
    doesn't get better by the words around what offends. The score of a document is calibrated on documents that
    the model of their fold has not learned from: rare labels leave the noisy-or itself far too low."""
    if not len(toxic) or toxic.min() == toxic.max():
        return ToxicityModel(np.zeros(1 << BUCKET_BITS, np.float32), -60.0)
    table = sample.numbered()
    order = np.random.default_rng(7).permutation(len(sample))
    parts = [(sample.batch(order[a : a + batch]), toxic[order[a : a + batch]]) for a in range(0, len(order), batch)]
    common = np.flatnonzero(sum(x.documents_with(table) for x, _ in parts) >= least)
    column = np.full(1 << BUCKET_BITS, len(common), np.int32)
    column[common] = np.arange(len(common))
    columns, width = column[table], len(common) + 1

    def fitted(some: list[tuple[Batch, np.ndarray]]) -> tuple[np.ndarray, float]:
        return _descend(some, columns, width, epochs, rate, decay)

    odds, labels = [], []
    for fold in range(folds if len(parts) >= folds else 0):
        weights, bias = fitted([x for k, x in enumerate(parts) if k % folds != fold])
        for x, y in parts[fold::folds]:
            p = 1 / (1 + np.exp(-np.clip(bias + x.sentences(weights[columns[x.kind]].sum(axis=1)), -60, 60)))
            some = np.diff(x.first) > 0
            odds.append(_odds(_clean(p, x.first))[some])
            labels.append(y[some])
    slope, shift = calibration(np.concatenate(odds), np.concatenate(labels)) if odds else (1.0, 0.0)
    weights, bias = fitted(parts)
    whole = np.zeros(1 << BUCKET_BITS, np.float32)
    whole[common] = weights[:-1]
    return ToxicityModel(whole, bias, slope, shift)


def learn(docs: DataFrame, labels: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> ToxicityModel:
    """Fit on at most ``documents`` labelled documents outside the held-out fifth, in one task; the bound holds
    whatever the size of the corpus. A document with several labels is toxic if one of them says so; of rows that repeat an id, the
    text with the smallest hash counts."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(bucket_of("doc_id", 5) != 0)
    known = bounded_sample(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", documents)
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "toxic")).alias("r")).select("doc_id", "r.text", "r.toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, ids, toxic = Sample(), [], []
        for batch in batches:
            for piece in pieces(batch, limit=1 << 20):
                sample.add(texts_of(piece["text"]))
                ids += piece["doc_id"].to_pylist()
                toxic += piece["toxic"].to_pylist()
        order = np.argsort(np.array(ids, np.int64), kind="stable")  # the same model in whatever order the rows come
        sample.documents = [sample.documents[k] for k in order.tolist()]
        model = train(sample, np.array(toxic, float)[order])
        yield pa.RecordBatch.from_pydict({"weights": pa.array([model.weights.tobytes()], pa.binary()), "bias": [model.bias], "slope": [model.slope], "shift": [model.shift]})

    for row in sample.coalesce(1).mapInArrow(run, "weights binary, bias double, slope double, shift double").collect():
        return ToxicityModel(np.frombuffer(row.weights, np.float32), row.bias, row.slope, row.shift)
    return train(Sample(), np.zeros(0))


def _scored(batch: pa.RecordBatch, model: ToxicityModel) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[list[dict]]]]:
    for piece in pieces(batch):
        features = Features(texts_of(piece["text"]))
        p = model.sentences(features)
        score = np.where(np.diff(features.first) > 0, model.calibrated(_odds(features.noisy_or(p))), 0.0)
        found: list[list[dict]] = [[] for _ in range(piece.num_rows)]
        p = model.calibrated(_odds(np.log1p(-np.minimum(p, 1 - 1e-12))))
        bad = np.flatnonzero(p >= 0.5)
        for s, doc in zip(bad, np.searchsorted(features.first, bad, "right") - 1):
            a, b = (int(x[s] - features.offsets[doc]) for x in features.span)
            found[doc].append({"sentence": int(s - features.first[doc]), "start": a, "end": b, "score": float(p[s])})
        yield piece, score, found


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, and the sentences of probability 0.5 or more: number, byte span in the UTF-8 text, probability."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, value, found in _scored(batch, sent.value):
                kind = pa.list_(pa.struct([("sentence", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([piece["doc_id"].cast(pa.int64()), pa.array(value), pa.array(found, kind)], ["doc_id", "score", "offending"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, score double, offending {OFFENDING}")


def keep_clean(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The documents that score under ``threshold``, with their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, value, _ in _scored(batch, sent.value):
                yield piece.filter(pa.array(value < threshold))

    return docs.mapInArrow(run, docs.schema)
