"""Periodic runs of words: stretches that repeat a sequence of words at least four times over.

A run is a stretch of consecutive words with smallest period ``q`` and a length of at least ``max(6, 4 q)`` that no
neighbouring word extends keeping that period. They are found with string synchronising sets:

1. Regions of small periods (below ``BASE``) are found on their own: words are compared with the word ``q`` further.
2. For each scale ``t`` = ``BASE``, ``2 BASE``, ... every position gets a hash of the ``t`` words from it. Positions whose
   ``t`` words repeat a period of at most ``t / 4`` are highly periodic; the runs found at smaller scales say which.
   Position ``i`` is selected if the least hash of the others among ``i .. i + t`` stands at ``i`` or at ``i + t``. Whether it is
   depends on the ``2 t`` words from it only, and ``t`` successive positions hold a selected one unless
   all about them is highly periodic.
3. In a run with a period ``q`` of ``t`` to ``2 t - 1``, a selected position ``s`` and ``s + q`` have equal contexts of ``2 t`` words, and
   none between them has the same (else the run's period were smaller). So neighbours of equal context propose
   all those periods. A proposal is extended word by word in both directions, and is a run if it is long enough.

Words are numbered exactly, hashes only propose. Texts are searched together, with a word of its own between
any two, texts of like length in one array. A task holds the words of about 4 MB of text, or of one longer text.

Results in special cases: null and empty texts have no words and no run; rows with a null id are searched like others, and
rows that repeat an id each on their own; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sensorlith.llm.words import mix, pieces, texts_of

EXPONENT = 4
LEAST = 6
BASE = 8
PROBE = 1 << 20
_FAR = np.uint64(np.iinfo(np.uint64).max)
RUN = "struct<start:long,length:long,period:long>"

#: gives the order in which the words of a text are read, from its id and number of words; None: as they stand
Order = Callable[[int | None, int], np.ndarray | None]


def small_periods(w: np.ndarray, below: int) -> np.ndarray:
    """(start, end, period) of all stretches of at least ``EXPONENT`` times a period under ``below``."""
    found = [np.zeros((0, 3), np.int64)]
    for q in range(1, min(below, len(w))):
        same = np.zeros(len(w) - q + 2, bool)
        np.equal(w[:-q], w[q:], out=same[1:-1])
        edges = np.flatnonzero(same[1:] != same[:-1])
        a, b = edges[0::2], edges[1::2] + q
        long = b - a >= EXPONENT * q
        found.append(np.column_stack([a[long], b[long], np.full(long.sum(), q)]))
    return _smallest(np.concatenate(found))


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Each stretch with its smallest period: multiples of it have the same bounds."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[new]


def highly_periodic(runs: np.ndarray, size: int, scale: int) -> np.ndarray:
    """Which of the first ``size`` positions begin ``scale`` words with a period of at most a quarter of them."""
    chosen = runs[(runs[:, 2] * EXPONENT <= scale) & (runs[:, 1] - runs[:, 0] >= scale)]
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, chosen[:, 0], 1)
    np.add.at(step, chosen[:, 1] - scale + 1, -1)
    return np.cumsum(step[:size]) > 0


def synchronising_set(ids: np.ndarray, periodic: np.ndarray, scale: int) -> np.ndarray:
    """The selected positions; ``ids`` are hashes of the ``scale`` words from each position."""
    ids = np.where(periodic, _FAR, ids)
    if len(ids) <= scale:
        return np.zeros(0, np.int64)
    least, span = ids, 1
    while span < scale:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    first, last = ids[: len(ids) - scale], ids[scale:]
    least = np.minimum(least[: len(first)], last)
    return np.flatnonzero(((first == least) | (last == least)) & (least != _FAR))


def proposals(context: np.ndarray, selected: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) of neighbouring selected positions with equal contexts, at a distance of the scale;
    of those with one period that overlap only the first."""
    key = context[selected]
    order = np.argsort(key, kind="stable")
    at, key = selected[order], key[order]
    gap = np.diff(at)
    near = np.flatnonzero((key[1:] == key[:-1]) & (gap >= scale) & (gap < 2 * scale))
    s, d = at[near], gap[near]
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 2 * scale)
    return s[new], d[new]


def _matching(w: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``a`` and ``b`` on are equal, going forward or backward."""
    total, open_, width = np.zeros(len(a), np.int64), np.arange(len(a)), 16
    while len(open_):
        width = max(16, min(2 * width, PROBE // len(open_)))
        still = []
        for part in np.array_split(open_, -(-len(open_) * width // PROBE)):
            offset = step * (total[part][:, None] + np.arange(width))
            x, y = a[part][:, None] + offset, b[part][:, None] + offset
            within = (np.minimum(x, y) >= 0) & (np.maximum(x, y) < len(w))
            same = within & (w[np.clip(x, 0, len(w) - 1)] == w[np.clip(y, 0, len(w) - 1)])
            whole = same.all(axis=1)
            total[part] += np.where(whole, width, same.argmin(axis=1))
            still.append(part[whole])
        open_ = np.concatenate(still)
    return total


def find_runs(w: np.ndarray, longest: int) -> np.ndarray:
    """(start, end, period) of all runs in a sequence of numbers, of which no run is longer than ``longest``, by start and
    period. Stretches of fewer than ``LEAST`` words are left in, they count as highly periodic."""
    runs = small_periods(w, BASE)
    ids, scale = mix(w.astype(np.uint64) + np.uint64(1)), 1
    while EXPONENT * scale <= longest:
        if scale >= BASE:
            selected = synchronising_set(ids, highly_periodic(runs, len(ids), scale), scale)
        if len(ids) <= scale:
            break
        ids = mix(ids[:-scale] * np.uint64(0x9E3779B97F4A7C15) + ids[scale:])  # of twice as many words
        if scale >= BASE:
            s, d = proposals(ids, selected, scale)
            ends = s + d + _matching(w, s, s + d, 1)
            starts = s - _matching(w, s - 1, s + d - 1, -1)
            long = ends - starts >= EXPONENT * d
            runs = _smallest(np.concatenate([runs, np.column_stack([starts, ends, d])[long]]))
        scale *= 2
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _numbered(words: list[list[bytes]]) -> np.ndarray:
    """The words of all texts as numbers, equal for equal words of the batch."""
    flat = pa.array([w for text in words for w in text], pa.large_binary())
    return flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def runs_of(words: list[list[bytes]]) -> list[np.ndarray]:
    """(start, end, period) of the runs of each text, by start and period."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    first = np.concatenate([[0], np.cumsum(sizes)])
    numbers, found = _numbered(words), [np.zeros((0, 3), np.int64)] * len(words)
    kind = np.array([int(x).bit_length() for x in sizes])
    for size in np.unique(kind[sizes >= LEAST]):
        texts = np.flatnonzero((kind == size) & (sizes >= LEAST))
        # a number of its own after each text: no stretch goes on from one text to the next
        w = np.concatenate([x for k, t in enumerate(texts) for x in (numbers[first[t] : first[t + 1]], [-2 - k])])
        offsets = np.concatenate([[0], np.cumsum(sizes[texts] + 1)])
        runs = find_runs(w, int(sizes[texts].max()))
        runs = runs[runs[:, 1] - runs[:, 0] >= LEAST]
        bounds = np.searchsorted(runs[:, 0], offsets)
        for k, t in enumerate(texts):
            if bounds[k] < bounds[k + 1]:
                found[t] = runs[bounds[k] : bounds[k + 1]] - [offsets[k], offsets[k], 0]
    return found


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run repeats: all of it but its first period."""
    if not len(runs):
        return words
    step = np.zeros(len(words) + 1, np.int32)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)]


def _read(texts: list[bytes], ids: list[int | None], order: Order | None) -> list[list[bytes]]:
    words = [t.split() for t in texts]  # at the white space of ASCII: space and 0x09 to 0x0D
    if order:
        for k, (i, w) in enumerate(zip(ids, words)):
            places = order(i, len(w))
            if places is not None:
                words[k] = [w[j] for j in places.tolist()]
    return words


def _mapped(docs: DataFrame, schema: str, order: Order | None, row: Callable[[list[bytes], np.ndarray], dict]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                ids = piece["doc_id"].to_pylist()
                words = _read(texts_of(piece["text"]), ids, order)
                rows = [{"doc_id": i} | row(w, r) for i, w, r in zip(ids, words, runs_of(words))]
                yield pa.RecordBatch.from_pylist(rows, kind)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, schema)


def periodic_runs(docs: DataFrame, order: Order | None = None) -> DataFrame:
    """doc_id, runs (start, length and period in words, by start and period), and the text without the repeated words, joined by
    one space, for each row of ``docs``."""

    def row(words: list[bytes], runs: np.ndarray) -> dict:
        return {"runs": [{"start": a, "length": b - a, "period": q} for a, b, q in runs.tolist()], "collapsed": b" ".join(collapsed(words, runs)).decode("utf-8", "replace")}

    return _mapped(docs, f"doc_id long, runs array<{RUN}>, collapsed string", order, row)


def run_digests(docs: DataFrame, order: Order | None = None) -> DataFrame:
    """For each row of ``docs``: doc_id, n_runs, the run of greatest length / period (start, length, period, exponent_milli) and SHA-256
    digests of all runs and of the collapsed text, for comparing corpora without moving texts."""

    def row(words: list[bytes], runs: np.ndarray) -> dict:
        lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs.tolist())
        out = {"n_runs": len(runs), "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest()}
        best = None
        for a, b, q in runs.tolist():  # in order of start and period: a tie stays with the first
            if best is None or (b - a) * best[2] > (best[1] - best[0]) * q:
                best = a, b, q
        if best:
            a, b, q = best
            out |= {"start": a, "length": b - a, "period": q, "exponent_milli": 1000 * (b - a) // q}
        return out

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _mapped(docs, schema, order, row)
