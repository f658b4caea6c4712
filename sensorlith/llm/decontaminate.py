"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive words (A-Z in lower case): the hash of the words at its places,
whatever stands at the others. Seeds of the test items are joined with those of every document; each hit
fixes an alignment of item and document, which is then compared word by word. A document is contaminated by
an item if ``window`` aligned words (the whole item, if it has fewer) have at least ``percent`` of them equal, so
single replaced words do not hide a passage.

The seeds miss none of these: a width of words that may hold e unequal ones is cut into e + m blocks, of which m must
be equal whole, and there is a mask for every way in which m blocks can lie to each other (see ``masks``).

The test items come in blocks of bounded size, each sent to all tasks in turn; any number of items goes
through the same way, one pass over the documents for each block.

Results in special cases: null and empty texts and items match nothing; items of fewer words than ``LEAST_WORDS``
are not searched, as such short sequences occur by chance; repeated items are found each; repeated document rows give a row each; rows with a null id are
searched, and reported with a null id; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlith.llm.words import Words, mix, pieces, sequences, texts_of

LEAST_WORDS = 5
#: masks of so many words are rare enough in other texts; no width has more than so many masks
WEIGHT, MOST_MASKS = 6, 16
BLOCK_BYTES = 8 << 20


@cache
def masks(width: int, percent: int) -> tuple[tuple[int, tuple[int, ...]], ...]:
    """(length, places) of runs of ``length`` words at ``places``: wherever the unequal words that ``percent`` allows stand
    in ``width`` aligned words, one of these masks has a place in them where all of its words are equal."""
    unequal = min(width * (100 - percent) // 100, width - 1)
    best: tuple[int, list] = (0, [])
    for whole in range(1, width - unequal + 1):
        blocks = unequal + whole
        length, rest = width // blocks, range(1, blocks)
        chosen = [(length, (0, *(length * k for k in c))) for c in combinations(rest, whole - 1)] if comb(blocks - 1, whole - 1) <= MOST_MASKS else []
        if chosen and whole * length > best[0]:
            best = whole * length, chosen
        if best[0] >= WEIGHT:
            break
    return tuple(best[1])


class Seeds:
    """Hashes of masks from each word of a batch on; those of runs are made once."""

    def __init__(self, words: Words) -> None:
        self.words, self.runs = words, {}
        self.left = np.repeat(words.first[1:], words.counts) - np.arange(len(words))  # words of the text from each on

    def __call__(self, mask: tuple[int, tuple[int, ...]]) -> np.ndarray:
        """One hash for each word from which the mask ends within the batch; see ``left`` for the text."""
        length, places = mask
        if length not in self.runs:
            self.runs[length] = sequences(self.words.hashes, length)
        run = self.runs[length]
        n = max(0, len(run) - places[-1])
        total = np.zeros(n, np.uint64)
        for k, place in enumerate(places):
            total += run[place : place + n] * np.uint64(2 * (k + 1) * 0x9E3779B97F4A7C15 + 1 & (1 << 64) - 1)
        return mix(total)


@dataclass(frozen=True)
class Items:
    """A block of test items: their words, and for each mask sorted hashes with the words that they start at."""

    ids: list[int | None]
    hashes: np.ndarray
    first: np.ndarray
    seeds: dict[tuple[int, tuple[int, ...]], tuple[np.ndarray, np.ndarray]]
    filter: np.ndarray

    @staticmethod
    def of(ids: list[int | None], texts: list[bytes], window: int, percent: int) -> Items:
        words = Words(texts, lower=True)
        width = np.repeat(np.minimum(words.counts, window), words.counts)
        of_mask: dict[tuple[int, tuple[int, ...]], list[int]] = {}
        for w in np.unique(width[np.repeat(words.counts, words.counts) >= LEAST_WORDS]).tolist():
            for mask in masks(w, percent):
                of_mask.setdefault(mask, []).append(w)
        make, seeds, every = Seeds(words), {}, [np.zeros(0, np.uint64)]
        for mask, widths in of_mask.items():
            value = make(mask)
            at = np.flatnonzero(np.isin(width, widths)[: len(value)] & (make.left[: len(value)] >= mask[0] + mask[1][-1]))
            at = at[words.counts[np.searchsorted(words.first, at, "right") - 1] >= LEAST_WORDS]
            order = np.argsort(value[at], kind="stable")
            seeds[mask] = value[at][order], at[order]
            every.append(value[at])
        seen = np.zeros(1 << 22, bool)  # which low bits occur: most words of documents go no further
        seen[np.concatenate(every) & np.uint64(len(seen) - 1)] = True
        return Items(ids, words.hashes, words.first, seeds, np.packbits(seen))

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word of the documents, word of the items) of all equal seeds; an alignment may come several times."""
        seen = np.unpackbits(self.filter).view(bool)
        doc, item = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        make = Seeds(words)
        for mask, known in self.seeds.items():
            value = make(mask)
            at = np.flatnonzero(seen[value & np.uint64(len(seen) - 1)])
            at = at[make.left[at] >= mask[0] + mask[1][-1]]
            low, high = np.searchsorted(known[0], value[at], "left"), np.searchsorted(known[0], value[at], "right")
            times = high - low
            doc.append(np.repeat(at, times))
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
            item.append(known[1][place])
        return np.concatenate(doc), np.concatenate(item)

    def found(self, words: Words, window: int, percent: int) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, matched, compared, start in the text, start in the item): for each text and item the
        aligned stretch with the largest matched share, first in the text if equal."""
        at, of = self.hits(words)
        if not len(at):
            return []
        text = np.searchsorted(words.first, at, "right") - 1
        item = np.searchsorted(self.first, of, "right") - 1
        shift = (at - words.first[text]) - (of - self.first[item])
        best: dict[tuple[int, int], tuple] = {}
        # hits on the same alignment are compared once, over all words that both have there
        for t, i, s in np.unique(np.stack([text, item, shift], axis=1), axis=0).tolist():
            a, size = self.first[i], int(self.first[i + 1] - self.first[i])
            low, high = max(0, -s), min(size, int(words.counts[t]) - s)
            width = min(window, size)
            if high - low < width:
                continue
            equal = self.hashes[a + low : a + high] == words.hashes[words.first[t] + low + s : words.first[t] + high + s]
            sums = np.concatenate([[0], np.cumsum(equal)])
            matched = sums[width:] - sums[:-width]
            k = int(np.argmax(matched))
            if matched[k] * 100 >= percent * width:
                key = (-int(matched[k]), low + k + s, low + k)
                if (t, i) not in best or key < best[t, i]:
                    best[t, i] = key
        return [(t, i, -m, min(window, int(self.first[i + 1] - self.first[i])), d, b) for (t, i), (m, d, b) in sorted(best.items())]


def blocks(benchmark: DataFrame, window: int, percent: int) -> Iterator[Items]:
    """Items in blocks of about ``BLOCK_BYTES`` of text, or one longer item; one block is at the driver at a time."""
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    ids, texts, size = [], [], 0
    for row in items.toLocalIterator(prefetchPartitions=False):
        ids.append(row.item_id)
        texts.append(row.text.encode())
        size += len(texts[-1])
        if size >= BLOCK_BYTES:
            yield Items.of(ids, texts, window, percent)
            ids, texts, size = [], [], 0
    if ids:
        yield Items.of(ids, texts, window, percent)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 20, percent: int = 80) -> DataFrame:
    """doc_id, item_id, matched, compared, doc_start, item_start (words from 0): a row for each document and item
    that contaminates it."""
    out = None
    schema = "doc_id long, item_id long, matched int, compared int, doc_start int, item_start int"
    for block in blocks(benchmark, window, percent):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                for piece in pieces(batch):
                    rows = items.found(Words(texts_of(piece["text"]), lower=True), window, percent)
                    ids = piece["doc_id"].to_pylist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[t] for t, *_ in rows], pa.int64()), pa.array([items.ids[i] for _, i, *_ in rows], pa.int64())]
                        + [pa.array([r[k] for r in rows], pa.int32()) for k in range(2, 6)],
                        ["doc_id", "item_id", "matched", "compared", "doc_start", "item_start"],
                    )

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 20, percent: int = 80) -> DataFrame:
    """The documents that no item contaminates, with their columns."""
    for block in blocks(benchmark, window, percent):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in pieces(batch):
                    keep = np.ones(piece.num_rows, bool)
                    keep[[t for t, *_ in sent.value.found(Words(texts_of(piece["text"]), lower=True), window, percent)]] = False
                    yield piece.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
