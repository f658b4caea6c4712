"""Removing word sequences that occur earlier in the corpus (substring deduplication).

A window is ``length`` consecutive words of one document. A count-min sketch of all windows (see ``chunks``)
overestimates how often each occurs; only windows that it counts twice or more are grouped exactly, by a
hash of 96 bits, so that no repeated window is lost. Each word that some repeated window covers goes, where
the same words also start earlier: in a document of smaller id, or earlier in the same document.

Results in special cases: null and empty texts have no words and keep an empty text; texts of fewer words than
a window keep all; null ids come after all others; rows that repeat an id and hold a window at the same word
are equally early, so that neither loses it; extra columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlith.llm.chunks import Chunk, id_array, levels, read_chunk, sketch_counts, slice_bits, slices_of, write_chunks
from sensorlith.llm.frames import stored
from sensorlith.llm.words import Words, sequences, starts_within


class Windows:
    """All windows of a chunk: where each starts and its hash; ``distinct`` sorted hashes and their counts."""

    def __init__(self, chunk: Chunk, length: int) -> None:
        self.ids, self.texts = chunk
        self.words, self.length = Words(self.texts), length
        self.at = starts_within(self.words, length)
        self.hashes = sequences(self.words.hashes, length)[self.at]
        self.distinct, self.counts = np.unique(self.hashes, return_counts=True)

    def repeated(self, level: np.ndarray) -> Repeated:
        """Windows that the merged sketch counts twice or more, grouped by both hashes."""
        chosen = np.flatnonzero(level[np.searchsorted(self.distinct, self.hashes)] > 0)
        second = sequences(Words(self.texts, lane=1).hashes, self.length)[self.at[chosen]].astype(np.uint32)
        text = self.words.text_of[self.at[chosen]]
        return Repeated(self.at[chosen], self.hashes[chosen], second, self.ids[text], (self.at[chosen] - self.words.first[text]).astype(np.int32))


class Repeated:
    """Windows in groups of equal ones, each group by (id, start); ``first`` is where the groups begin."""

    def __init__(self, at: np.ndarray, *keys: np.ndarray) -> None:
        order = np.lexsort(keys[::-1])
        self.at, (self.one, self.two, self.id, self.start) = at[order], (k[order] for k in keys)
        new = np.ones(len(at), bool)
        new[1:] = (self.one[1:] != self.one[:-1]) | (self.two[1:] != self.two[:-1])
        self.first = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1

    def later(self, elsewhere: np.ndarray | None = None) -> np.ndarray:
        """Which windows have an earlier equal one; ``elsewhere``: whether a group's first one has."""
        head = self.first[self.group]
        out = (self.id > self.id[head]) | (self.start > self.start[head])
        return out if elsewhere is None else out | elsewhere[self.group]


def _planes(x: np.ndarray) -> bytes:
    """Bytes by place: the high ones, mostly equal, stand together and shrink in the shuffle."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(x: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(width, -1).T).view(kind).ravel()


def without_repeats(docs: DataFrame, length: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) for each row of ``docs``."""
    chunks = write_chunks(docs)
    bits = slice_bits(chunks)

    def keys(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        w = Windows(chunk, length)
        return w.distinct, w.counts

    marks = stored(sketch_counts(chunks, keys, bits), "levels")

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: dict[str, list] = {k: [] for k in ("slice", "one", "two", "id", "start")}
        level = levels(right)
        if left.num_rows and level.any():
            r = Windows(read_chunk(left["docs"][0].as_py()), length).repeated(level)
            number, first = slices_of(r.one[r.first], bits)
            for n, a, b in zip(number, first, first[1:]):
                head = r.first[a:b]
                for name, value in (("slice", int(n)), ("one", _planes(r.one[head])), ("two", _planes(r.two[head])), ("id", _planes(r.id[head])), ("start", _planes(r.start[head]))):
                    rows[name].append(value)
        chunk = left["chunk"][0].as_py() if left.num_rows else 0
        return pa.table({"slice": pa.array(rows["slice"], pa.int32()), "chunk": pa.array([chunk] * len(rows["slice"]), pa.int64())} | {k: pa.array(rows[k], pa.binary()) for k in ("one", "two", "id", "start")})

    def group(rows: pa.Table) -> pa.Table:
        kinds = (("one", np.uint64), ("two", np.uint32), ("id", np.int64), ("start", np.int32))
        parts = [[_from_planes(x, kind) for x in rows[name].to_pylist()] for name, kind in kinds]
        sizes = [len(x) for x in parts[0]]
        r = Repeated(np.arange(sum(sizes)), *(np.concatenate(p) for p in parts))
        later = np.empty(sum(sizes), np.uint8)
        later[r.at] = r.later()
        ends = np.cumsum(sizes)
        return pa.table({"chunk": rows["chunk"], "slice": rows["slice"], "later": pa.array([later[e - n : e].tobytes() for n, e in zip(sizes, ends)], pa.binary())})

    sent = chunks.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(send, "slice int, chunk long, one binary, two binary, id binary, start binary")
    grouped = sent.groupBy("slice").applyInArrow(group, "chunk long, slice int, later binary")
    none = F.lit(None).cast("binary")
    both = marks.withColumn("later", none).unionByName(grouped.withColumn("level", none))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows:
            w = Windows(read_chunk(left["docs"][0].as_py()), length)
            level = levels(right.filter(pc.is_valid(right["level"])))
            cover = np.zeros(len(w.words) + 1, np.int64)
            if level.any():
                r = w.repeated(level)
                gone = r.at[r.later(levels(right.filter(pc.is_valid(right["later"])), "later").astype(bool))]
                cover[gone] += 1
                np.subtract.at(cover, gone + length, 1)
            keep = np.cumsum(cover)[:-1] == 0
            out = list(_kept(w, keep))
        columns = list(zip(*out)) or [[], [], [], []]
        ids = id_array(np.array(columns[0], np.int64))
        return pa.table({"doc_id": ids, "n_words": pa.array(columns[1], pa.int64()), "n_removed": pa.array(columns[2], pa.int64()), "kept": pa.array(columns[3], pa.binary()).cast(pa.string())})

    return chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept string")


def _kept(w: Windows, keep: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    for i, text in enumerate(w.texts):
        mask = keep[w.words.first[i] : w.words.first[i + 1]]
        left = int(mask.sum())
        words = text.split()
        yield int(w.ids[i]), len(mask), len(mask) - left, b" ".join(words if left == len(mask) else compress(words, mask.tolist()))
