"""Language identification as a mixture: a document may hold several languages.

Each language has probabilities of three-byte sequences of its words. For a document, expectation-maximisation finds the
proportions of languages that make its words most likely. Languages then leave the set one by one, the smallest
first, while the likelihood less a penalty for each language (that of the Bayesian information criterion) doesn't fall.

Results in special cases: null and empty texts and those without a letter are ``und`` with score 0, as are all texts if
no document teaches a language; equal proportions go to the first language by code point; repeated rows give a
row each; null ids are classified like others; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlith.llm.words import pieces, texts_of

GRAM_BITS = 16
DOCUMENTS_PER_LANGUAGE = 3000
UNKNOWN = "und"

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x41:0x5B] = _FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


class Grams:
    """Words of letters in a batch of texts, and the number of the three-byte sequence around each of their bytes."""

    def __init__(self, texts: list[bytes]) -> None:
        data = b" " + b" ".join([*texts, b""]) + b" "
        raw = _FOLD[np.frombuffer(data, np.uint8)]
        solid = raw != 0x20
        edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        at = np.flatnonzero(solid)
        code = raw[at - 1].astype(np.uint32) << np.uint32(16) | raw[at].astype(np.uint32) << np.uint32(8) | raw[at + 1]
        self.grams = _number(code)
        self.first_gram = np.concatenate([[0], np.cumsum(self.ends - self.starts)])
        begins = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        #: number of the first word of each text, with one entry more than texts
        self.first = np.searchsorted(self.starts, begins)


def _number(code: np.ndarray) -> np.ndarray:
    mixed = code * np.uint32(0x9E3779B1)
    mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0x85EBCA77) >> np.uint32(32 - GRAM_BITS)).astype(np.int32)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # (sequence, language)

    def word_likelihoods(self, grams: Grams) -> np.ndarray:
        """(word, language): likelihood, scaled so that a word's best is 1."""
        log = np.empty((len(grams.starts), len(self.languages)))
        for k in range(len(self.languages)):
            log[:, k] = np.add.reduceat(self.log_p[:, k][grams.grams], grams.first_gram[:-1]) if len(log) else 0
        return np.exp(np.maximum(log - log.max(axis=1, keepdims=True), -40)) if len(log) else log

    def proportions(self, grams: Grams, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """For each text the proportions of languages, and which belong to the selected set."""
        p = self.word_likelihoods(grams)
        words, n = np.diff(grams.first), len(self.languages)
        share = np.zeros((len(words), n))
        active = np.ones((len(words), n), bool)
        some = np.flatnonzero(words)
        if not len(some):
            return share, active & False
        share[some], score = _mixture(p, grams.first[some], words[some], np.full((len(some), n), 1 / n), rounds)
        penalty = 0.5 * np.log(np.maximum(words, 2))
        # most texts lose less than one penalty if only one language is left, so no step of the selection would stop before;
        # the others give languages up one by one
        likely = p[np.arange(len(p)), np.repeat(share[some].argmax(axis=1), words[some])]
        clear = score - np.add.reduceat(np.log(likely + 1e-300), grams.first[some]) <= penalty[some]
        active[some[clear]] = share[some[clear]] == share[some[clear]].max(axis=1, keepdims=True)
        todo, best = some[~clear], score[~clear] - n * penalty[some[~clear]]
        for _ in range(n - 1):
            if not len(todo):
                break
            trial = active[todo].copy()
            trial[np.arange(len(todo)), np.where(trial, share[todo], np.inf).argmin(axis=1)] = False
            start = np.where(trial, share[todo] + 1e-3, 0)
            rows = np.concatenate([np.arange(grams.first[t], grams.first[t + 1]) for t in todo])
            at = np.concatenate([[0], np.cumsum(words[todo])[:-1]])
            found, score = _mixture(p[rows], at, words[todo], start / start.sum(axis=1, keepdims=True), rounds)
            score = score - trial.sum(axis=1) * penalty[todo]
            better = score >= best
            active[todo[better]], share[todo[better]] = trial[better], found[better]
            todo, best = todo[better], score[better]
        share = np.where(active, share, 0)
        return share / np.maximum(share.sum(axis=1, keepdims=True), 1e-300), active & (words > 0)[:, None]


def _mixture(p: np.ndarray, first: np.ndarray, words: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some rounds of expectation-maximisation, and the log-likelihood, of texts of ``words`` words."""
    for _ in range(rounds):
        joint = p * np.repeat(share, words, axis=0)
        joint /= joint.sum(axis=1, keepdims=True) + 1e-300
        share = np.add.reduceat(joint, first, axis=0) / words[:, None]
    total = (p * np.repeat(share, words, axis=0)).sum(axis=1)
    return share, np.add.reduceat(np.log(total + 1e-300), first)


def learn(docs: DataFrame, teach: Column, per_language: int = DOCUMENTS_PER_LANGUAGE, smoothing: float = 0.5) -> LanguageModel:
    """Count sequences in about ``per_language`` documents of each language (all, if it has fewer), chosen by hash among
    those where ``teach`` holds; the bound is the same for a corpus of any size."""
    known = docs.where(teach & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    sample = known.join(F.broadcast(counts), "lang").where(part * F.col("n") < per_language).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in pieces(batch):
                grams, names = Grams(texts_of(piece["text"])), np.array(piece["lang"].to_pylist(), object)
                gram_at = np.searchsorted(grams.first_gram, grams.first_gram[grams.first])
                of = np.repeat(np.arange(len(names)), np.diff(grams.first_gram[gram_at]))
                for name in set(names.tolist()):
                    table[name] = table.get(name, 0) + np.bincount(grams.grams[(names == name)[of]], minlength=1 << GRAM_BITS)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(table), pa.string()), "counts": pa.array([t.astype("<i8").tobytes() for t in table.values()], pa.binary())})

    total: dict[str, np.ndarray] = {}
    for row in sample.coalesce(8).mapInArrow(count, "lang string, counts binary").collect():
        total[row.lang] = total.get(row.lang, 0) + np.frombuffer(row.counts, "<i8")
    names = sorted(total, key=lambda x: x.encode())
    log_p = [np.log((total[k] + smoothing) / (total[k].sum() + smoothing * (1 << GRAM_BITS))) for k in names]
    return LanguageModel(names, np.stack(log_p, axis=1) if names else np.zeros((1 << GRAM_BITS, 0)))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (its proportion) and languages: the selected set with proportions, the largest first."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for piece in pieces(batch):
                texts = texts_of(piece["text"])
                share, active = model.proportions(Grams(texts)) if model.languages else (np.zeros((len(texts), 0)),) * 2
                names, scores, sets = [], [], []
                for text, s, a in zip(texts, share, active):
                    chosen = sorted(np.flatnonzero(a).tolist(), key=lambda k: -s[k])
                    if not chosen or not _has_letter(text):
                        chosen = []
                    names.append(model.languages[chosen[0]] if chosen else UNKNOWN)
                    scores.append(min(1.0, float(s[chosen[0]])) if chosen else 0.0)
                    sets.append([{"lang": model.languages[k], "share": float(s[k])} for k in chosen])
                yield pa.RecordBatch.from_arrays([piece["doc_id"].cast(pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, kind)], ["doc_id", "lang_pred", "score", "languages"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


_ASCII_LETTERS = bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)])


def _has_letter(text: bytes) -> bool:
    return len(text) > len(text.translate(None, _ASCII_LETTERS)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))
