"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlith.llm.frames import stored


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that the links (a, b) reach, for every id in them.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its smallest one,
    then its smaller neighbours. Each is one grouping by node; a node's neighbours are never gathered."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = stored(links, "edges"), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        larger = both.join(low, "a").select("a", "b", F.least("a", "low").alias("low")).where("b > a")
        edges = larger.select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = edges.groupBy("a").agg(F.min("b").alias("low"))
        smaller = edges.join(low, "a")
        smaller = smaller.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        edges = stored(smaller.distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
