"""Approximate nearest neighbours with a permutation index.

A vector is known by its nearest pivots, in order. A pivot's inverted file has the place of the pivot in the order of each
vector of a segment; a pivot beyond the nearest counts as the place after the last. A search reads the files of
the query's pivots, ranks all by the footrule distance of the two orders, and compares the best ranked exactly.
Each segment gives ``RERANK`` candidates, so the recall doesn't fall as the index grows.

The largest inner product is found as the nearest point: vectors get one more component that makes all lengths
equal, queries get 0 there. Pivots are a bounded sample; every vector is in the index. The index is written in
segments of bounded size, each with inverted files of its own; queries come in blocks of bounded size.

Results in special cases: vectors that are null, zero, hold null or non-finite components or have not the most
frequent dimension take no part, nor do rows with a null id; rows that repeat an id are candidates each, but never
for a query of that id; equal products go by smaller id; extra columns are not read; with fewer candidates than
asked for, all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorlith.llm.frames import bounded_sample, stored

PIVOTS = 128
NEAREST = 128
SEGMENT = 16_384
RERANK = 800
QUERY_BLOCK = 8192


def usable(embedding: Column) -> Column:
    whole = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & whole & F.exists(embedding, lambda x: x != 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


class Pivots:
    def __init__(self, points: np.ndarray, radius: float) -> None:
        self.radius = radius
        self.points = self.lifted(points)

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.radius**2 - (x * x).sum(axis=1), 0))
        return np.column_stack([x, rest])

    def order(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Numbers of the nearest pivots of each row, the nearest first."""
        x = self.lifted(x, query)
        far = (self.points**2).sum(axis=1) - 2 * x @ self.points.T
        if query:  # only directions count for a query: its length doesn't change the order of products
            length = np.sqrt((x * x).sum(axis=1, keepdims=True))
            far = (self.points**2).sum(axis=1) - 2 * (x / length * self.radius) @ self.points.T
        n = min(NEAREST, len(self.points))
        near = np.argpartition(far, n - 1, axis=1)[:, :n]
        rows = np.arange(len(x))[:, None]
        return near[rows, np.lexsort((near, far[rows, near]), axis=1)]


class Index:
    """Pivots and the segments of inverted files."""

    def __init__(self, vectors: DataFrame, pivots: int = PIVOTS, segment: int = SEGMENT) -> None:
        rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        widths = rows.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("most"))
        widest = widths.orderBy(F.desc("n"), "width").first()
        self.spark = vectors.sparkSession
        self.width = widest.width if widest else 0
        self.rows = rows.where(F.size("embedding") == self.width)
        chosen = bounded_sample(self.rows.select("vec_id").distinct(), "vec_id", pivots)
        points = self.rows.join(F.broadcast(chosen), "vec_id").dropDuplicates(["vec_id"]).orderBy("vec_id").collect()
        self.pivots = Pivots(np.array([r.embedding for r in points], float).reshape(len(points), self.width), float(widest.most) ** 0.5 if widest else 1.0)
        self.segments = stored(self._written(segment), "pivot-files") if points else None

    def _written(self, size: int) -> DataFrame:
        sent, width = self.spark.sparkContext.broadcast(self.pivots), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, number = sent.value, TaskContext.get().partitionId() << 32
            for batch in batches:
                for a in range(0, batch.num_rows, size):
                    piece = batch.slice(a, size)
                    x = _matrix(piece["embedding"], width)
                    order = pivots.order(x)
                    places = np.full((len(x), len(pivots.points)), NEAREST, np.uint8)
                    np.put_along_axis(places, order, np.arange(order.shape[1], dtype=np.uint8)[None, :], axis=1)
                    files = np.ascontiguousarray(places.T)  # one for each pivot
                    row = {"segment": number, "ids": piece["vec_id"].to_numpy().tobytes(), "vectors": x.tobytes(), "files": files.tobytes()}
                    yield pa.RecordBatch.from_pylist([row], pa.schema([("segment", pa.int64()), *((k, pa.binary()) for k in ("ids", "vectors", "files"))]))
                    number += 1

        return self.rows.mapInArrow(run, "segment long, ids binary, vectors binary, files binary")

    def search(self, queries: DataFrame, k: int, rerank: int = RERANK) -> DataFrame:
        """query_id, rank, vec_id, score: the ``k`` nearest found for each usable row of ``queries``."""
        schema = "query_id long, vec_id long, score double"
        rows = queries.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")) & (F.size("embedding") == self.width))
        rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        out, block = self.spark.createDataFrame([], schema), []
        for row in rows.toLocalIterator(prefetchPartitions=False) if self.segments is not None else ():
            block.append(row)
            if len(block) == QUERY_BLOCK:
                out, block = out.unionByName(self._block(block, k, rerank, schema)), []
        if block:
            out = out.unionByName(self._block(block, k, rerank, schema))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def _block(self, block: list, k: int, rerank: int, schema: str) -> DataFrame:
        ids, x = np.array([r.vec_id for r in block], np.int64), np.array([r.embedding for r in block], float)
        sent = self.spark.sparkContext.broadcast((ids, x, self.pivots.order(x, query=True)))
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, queries, orders = sent.value
            for batch in batches:
                for row in batch.to_pylist():
                    vec_ids = np.frombuffer(row["ids"], np.int64)
                    vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, width)
                    files = np.frombuffer(row["files"], np.uint8).reshape(-1, len(vec_ids))
                    found = [_nearest(q, query, order, vec_ids, vectors, files, k, rerank) for q, query, order in zip(query_ids.tolist(), queries, orders)]
                    sizes = [len(i) for i, _ in found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, sizes)), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([s for _, s in found]))], ["query_id", "vec_id", "score"])

        return self.segments.mapInArrow(run, schema)


def _nearest(q: int, query: np.ndarray, order: np.ndarray, ids: np.ndarray, vectors: np.ndarray, files: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and products of the best of one segment."""
    footrule = np.zeros(len(ids), np.int32)
    for place, pivot in enumerate(order.tolist()):
        there = files[pivot]
        footrule += np.maximum(there, np.uint8(place)) - np.minimum(there, np.uint8(place))
    footrule[ids == q] = np.iinfo(np.int32).max
    n = min(rerank, len(ids))
    chosen = np.argpartition(footrule, n - 1)[:n]
    chosen = chosen[ids[chosen] != q]
    score = vectors[chosen] @ query
    best = np.lexsort((ids[chosen], -score))[:k]
    return ids[chosen][best], score[best]
