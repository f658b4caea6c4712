"""Documents in numbered chunks, and a count-min sketch of what the chunks hold, sliced by hash.

Chunks are written once, so that several passes see the same ones whatever tasks are run again. The sketch
has one row of counters. It is never in one place: each chunk sends the counters that it touches, as gaps
between their numbers, to the task of a slice, which adds them up and returns to every chunk the merged
counts of that chunk's own keys. Width grows with the input (``CELLS`` counters for about two million words),
so the share of keys that share a counter by accident is the same at every size. Counts are never too small,
but for one chunk's share of a count, which stops at 255.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlith.llm.frames import bucketed
from sensorlith.llm.words import pieces
from sensorlith.session import work_path

CHUNK_BYTES = 4 << 20
CELL_BITS = 26
#: steps of a level in which a count doubles
LEVELS = 10
_JUMP = 0xFFFF
_NO_ID = np.iinfo(np.int64).max

Chunk = tuple[np.ndarray, list[bytes]]


def write_chunks(docs: DataFrame, in_buckets: bool = False) -> DataFrame:
    """(chunk, docs): about ``CHUNK_BYTES`` of text or one longer document each, compressed. In buckets of their number,
    chunks stay where they are when counts are brought to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, limit=CHUNK_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, piece.schema, options=options) as out:
                    out.write_batch(piece)
                yield pa.RecordBatch.from_pydict({"chunk": [number], "docs": [sink.getvalue().to_pybytes()]})
                number += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "chunk long, docs binary")
    if in_buckets:
        return bucketed(rows, "chunks", "chunk", "uncompressed")
    path = work_path(docs.sparkSession, "chunks")
    rows.write.option("compression", "uncompressed").parquet(path)
    return docs.sparkSession.read.parquet(path)


def read_chunk(docs: bytes) -> Chunk:
    """Ids and texts (null: empty). A null id is the largest number."""
    table = pa.ipc.open_stream(docs).read_all()
    ids = table["doc_id"].fill_null(_NO_ID).to_numpy().astype(np.int64)
    return ids, [x or b"" for x in table["text"].cast(pa.large_binary()).to_pylist()]


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == _NO_ID)


def slice_bits(chunks: DataFrame) -> int:
    """Slices of about two million words; at least eight."""
    return max(3, int(chunks.count() * CHUNK_BYTES // 12_000_000).bit_length())


def slices_of(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the slices that sorted keys fall in, and where each begins, with the end."""
    number = (keys >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(number, prepend=-1))
    return number[first], np.append(first, len(keys))


def _gaps(cells: np.ndarray) -> bytes:
    gap = np.diff(cells.astype(np.int64), prepend=0)
    jumps, rest = gap // _JUMP, gap % _JUMP
    out = np.full(len(gap) + int(jumps.sum()), _JUMP, np.uint16)
    out[np.cumsum(jumps + 1) - 1] = rest
    return out.tobytes()


def _cells(gaps: bytes) -> np.ndarray:
    raw = np.frombuffer(gaps, np.uint16)
    return np.cumsum(raw, dtype=np.int64)[raw != _JUMP]


def sketch_counts(chunks: DataFrame, keys: Callable[[Chunk], tuple[np.ndarray, np.ndarray]], bits: int) -> DataFrame:
    """For each chunk and slice the merged counts of the chunk's keys, one byte each: ``LEVELS`` times its binary logarithm,
    rounded down.

    ``keys`` gives a chunk's distinct keys in ascending order and how often each occurs in it."""

    def touch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, docs in zip(batch["chunk"].to_pylist(), batch["docs"]):
                key, count = keys(read_chunk(docs.as_py()))
                cell = (key >> np.uint64(64 - bits - CELL_BITS)) & np.uint64((1 << CELL_BITS) - 1)
                count = np.minimum(count, 255).astype(np.uint8)
                number, first = slices_of(key, bits)
                spans = list(zip(first[:-1], first[1:]))
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array(number, pa.int32()), "chunk": pa.array([chunk] * len(number), pa.int64()),
                    "cells": pa.array([_gaps(cell[a:b]) for a, b in spans], pa.binary()), "counts": pa.array([count[a:b].tobytes() for a, b in spans], pa.binary()),
                })

    def merge(rows: pa.Table) -> pa.Table:
        cells = [_cells(x) for x in rows["cells"].to_pylist()]
        cell, count = np.concatenate(cells), np.concatenate([np.frombuffer(x, np.uint8) for x in rows["counts"].to_pylist()])
        order = np.argsort(cell)
        cell = cell[order]
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        total = np.add.reduceat(count[order], first, dtype=np.int64)
        level = np.empty(len(cell), np.uint8)
        level[order] = np.repeat(np.minimum(LEVELS * np.log2(total), 255).astype(np.uint8), np.diff(np.append(first, len(cell))))
        ends = np.cumsum([len(x) for x in cells])
        return pa.table({"chunk": rows["chunk"], "slice": rows["slice"], "level": pa.array([level[e - len(x) : e].tobytes() for x, e in zip(cells, ends)], pa.binary())})

    touched = chunks.mapInArrow(touch, "slice int, chunk long, cells binary, counts binary")
    return touched.groupBy("slice").applyInArrow(merge, "chunk long, slice int, level binary")


def levels(rows: pa.Table, column: str = "level") -> np.ndarray:
    """A chunk's bytes of all slices, in the order of its keys."""
    parts = sorted(zip(rows["slice"].to_pylist(), rows[column].to_pylist()))
    return np.frombuffer(b"".join(x for _, x in parts), np.uint8)
