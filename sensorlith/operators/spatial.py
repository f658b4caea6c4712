"""Distance joins without all pairs: cells for a radius, a tree packed along a curve for the nearest.

For the nearest target, targets are sorted along a space-filling curve over range partitions and cut into leaves of
``LEAF`` neighbours. ``FAN`` leaves in a row have a box around them, as many boxes a larger one, until few are left: these
are a bounded table that every task holds. A search starts there. Of the boxes below those that are left, only the ones stay that can
hold something nearer than what the best one holds for sure. So the answer is exact, a
row stays with few candidates, and every join key is a box of bounded content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import cos, radians

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlith.functions.geo import EARTH_RADIUS_M, haversine_m, local_xy_m, origin_to_segment_m
from sensorlith.session import ship, work_path

LEAF = 32
FAN = 128
#: boxes that every task may hold
TOP = 4096
#: targets that a task sorts, at least and at most
PART_ROWS = (4096, LEAF * FAN * FAN)
_PART = 33  # bits of the row number within a partition, as monotonically_increasing_id has it


def along_curve(unit: Sequence[Column]) -> Column:
    """Place of values within 0 to 1 on a curve that takes their binary digits in turn."""
    bits, masks = {
        2: (31, ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))),
        3: (20, ((32, 0x001F00000000FFFF), (16, 0x001F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))),
    }[len(unit)]
    place = F.lit(0).cast("long")
    for axis, value in enumerate(unit):
        x = F.least(F.greatest(F.floor(value * float(1 << bits)), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")
        for shift, mask in masks:
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        place = place.bitwiseOR(F.shiftleft(x, axis))
    return place


class Tree:
    """Targets (with ``_low`` and ``_high``: arrays of their ends per axis) in leaves, and the boxes above the leaves."""

    def __init__(self, targets: DataFrame, curve: Column, axes: int) -> None:
        spark = targets.sparkSession
        self.axes = axes
        targets = targets.withColumn("_curve", curve)
        path = work_path(spark, "spatial-targets")
        targets.write.parquet(path)
        targets = spark.read.schema(targets.schema).parquet(path)
        n = targets.count()
        few, many = PART_ROWS
        parts = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // few)), -(-n // many), 1)
        path = work_path(spark, "spatial-leaves")
        number = F.monotonically_increasing_id()
        leaf = F.shiftright(number, _PART) * (1 << _PART) + F.floor(number.bitwiseAND(F.lit((1 << _PART) - 1)) / LEAF)
        dealt = targets.repartitionByRange(parts, "_curve").sortWithinPartitions("_curve").withColumn("_box", leaf.cast("long")).drop("_curve")
        dealt.write.parquet(path)
        self.targets = spark.read.schema(dealt.schema).parquet(path)
        self.levels: list[DataFrame] = []
        boxes, step = self._around(self.targets, F.col("_box")), FAN
        # a box of the next level holds FAN in a row of one partition, and in the end partitions in a row
        while True:
            size = boxes.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("_box").bitwiseAND(F.lit((1 << _PART) - 1))).alias("last")).first()
            if size.n <= TOP:
                break
            if size.last:
                above = F.shiftright("_box", _PART) * (1 << _PART) + F.floor(F.col("_box").bitwiseAND(F.lit((1 << _PART) - 1)) / step)
            else:
                above = F.floor(F.shiftright("_box", _PART) / step) * (1 << _PART)
            path = work_path(spark, "spatial-boxes")
            boxes.groupBy(above.cast("long").alias("_box")).agg(F.collect_list(F.struct("_box", "_low", "_high")).alias("_below")).write.parquet(path)
            packed = spark.read.parquet(path)
            self.levels.append(packed)
            boxes = self._around(packed.select("_box", F.explode("_below").alias("b")).select("_box", "b._low", "b._high"), F.col("_box"))
        rows = boxes.collect()  # TOP at most
        self.top = (np.array([r["_box"] for r in rows], np.int64), *(np.array([r[c] for r in rows], float).reshape(-1, axes) for c in ("_low", "_high")))

    def _around(self, rows: DataFrame, box: Column) -> DataFrame:
        ends = [f(F.col(c)[a]).alias(f"{c}{a}") for a in range(self.axes) for c, f in (("_low", F.min), ("_high", F.max))]
        return rows.groupBy(box.alias("_box")).agg(*ends).select("_box", *(F.array(*[F.col(f"{c}{a}") for a in range(self.axes)]).alias(c) for c in ("_low", "_high")))

    def near(self, queries: DataFrame, place: Sequence[Column], scale: Sequence[Column]) -> DataFrame:
        """(query row, ``_box``) of the leaves that may hold a query's nearest target. ``place`` and, in metres a unit, ``scale`` are a
        query's values per axis."""
        ship(queries.sparkSession)
        asked = queries.withColumns({"_at": F.array(*place), "_scale": F.array(*scale), "_best": F.lit(float("inf"))})
        top = queries.sparkSession.sparkContext.broadcast(self.top)
        # a query is compared with thousands of boxes: few bytes of queries are not one task's work
        asked = asked.repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        found = asked.mapInArrow(_narrowing(top, self.axes), _ddl(asked) + ", _box long")
        for packed in reversed(self.levels):
            joined = found.join(packed, "_box").drop("_box")
            found = joined.mapInArrow(_narrowing(None, self.axes), _ddl(asked) + ", _box long")
        return found.drop("_at", "_scale", "_best")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _narrowing(top: Broadcast | None, axes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each row's boxes those that can hold something nearer than what the best one holds for sure. The boxes are
    ``top``'s for every row, or the row's own ``_below``."""

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                batch = whole.slice(a, 512)
                n = batch.num_rows
                if top is not None:
                    box, low, high = top.value
                    counts = np.full(n, len(box))
                    box, low, high = np.tile(box, n), np.tile(low, (n, 1)), np.tile(high, (n, 1))
                else:
                    below = batch["_below"]
                    counts = np.diff(below.offsets.to_numpy())
                    inner = below.flatten()
                    box, low, high = inner.field("_box").to_numpy(), matrix(inner.field("_low")), matrix(inner.field("_high"))
                row = np.repeat(np.arange(n), counts)
                if not len(row):
                    continue
                at, scale = matrix(batch["_at"])[row], matrix(batch["_scale"])[row]
                gap = np.maximum(np.maximum(low - at, at - high), 0) * scale
                one, two = (np.abs(at - low) * scale) ** 2, (np.abs(high - at) * scale) ** 2
                # something touches each side of a box: on the nearer side of one axis it lies within the other axes' farther ones
                sides, reach = np.minimum(one, two), np.maximum(one, two)
                nearest, farthest = (gap * gap).sum(axis=1), reach.sum(axis=1) + (sides - reach).min(axis=1)
                best = np.minimum(batch["_best"].to_numpy(), np.minimum.reduceat(farthest, np.concatenate([[0], np.cumsum(counts)[:-1]])))
                keep = np.flatnonzero(nearest <= best[row] * (1 + 1e-9) + 1e-9)
                kept = batch.take(pa.array(row[keep]))
                columns = {c: kept[c] for c in kept.schema.names if c != "_below"} | {"_best": pa.array(best[row[keep]]), "_box": pa.array(box[keep])}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def segments_of(lines: DataFrame, line_id: str, points: str) -> DataFrame:
    """Consecutive point pairs; a single point is a segment without length."""
    return lines.select(
        line_id,
        F.posexplode(F.slice(F.col(points), F.lit(1), F.greatest(F.size(points) - 1, F.lit(1)))).alias("_i", "_a"),
        F.col(points).alias("_p"),
    ).select(
        line_id,
        F.col("_i").alias("segment"),
        F.col("_a.lat").alias("a_lat"),
        F.col("_a.lon").alias("a_lon"),
        F.coalesce(F.try_element_at("_p", F.col("_i") + 2), F.col("_a"))["lat"].alias("b_lat"),
        F.coalesce(F.try_element_at("_p", F.col("_i") + 2), F.col("_a"))["lon"].alias("b_lon"),
    )


def _pieces(segments: DataFrame, lat_size: float, lon_size: float) -> DataFrame:
    """Points along each segment, closer than a cell apart; a straight line stays straight in local metres."""
    n = F.greatest(
        F.ceil(F.abs(F.col("b_lat") - F.col("a_lat")) / lat_size), F.ceil(F.abs(F.col("b_lon") - F.col("a_lon")) / lon_size), F.lit(1)
    ).cast("int")
    return segments.withColumn("_step", F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: i / n))).withColumns(
        {
            "_lat": F.col("a_lat") + (F.col("b_lat") - F.col("a_lat")) * F.col("_step"),
            "_lon": F.col("a_lon") + (F.col("b_lon") - F.col("a_lon")) * F.col("_step"),
        }
    )


def _distance() -> Column:
    ax, ay = local_xy_m(F.col("a_lat"), F.col("a_lon"), F.col("lat"), F.col("lon"))
    bx, by = local_xy_m(F.col("b_lat"), F.col("b_lon"), F.col("lat"), F.col("lon"))
    return origin_to_segment_m(ax, ay, bx, by)


def _cell_sizes(lines_extent: tuple[float, float], cell_m: float) -> tuple[float, float]:
    """Degrees that span ``cell_m`` metres, by the latitude farthest from the equator."""
    per_degree = EARTH_RADIUS_M * 3.141592653589793 / 180.0
    widest = max(abs(lines_extent[0]), abs(lines_extent[1]))
    return cell_m / per_degree, cell_m / (per_degree * max(cos(radians(min(widest, 89.0))), 1e-3))


def _extent(points: DataFrame, lat: str) -> tuple[float, float] | None:
    row = points.agg(F.min(lat).alias("a"), F.max(lat).alias("b")).first()
    return None if row["a"] is None else (row["a"], row["b"])


def lines_within(points: DataFrame, point_id: str, segments: DataFrame, line_id: str, radius_m: float) -> DataFrame:
    """(point, line, distance_m) for every line within the radius of a point (columns lat, lon)."""
    close = lines_around(points, segments, line_id, radius_m)
    return points.select(point_id, "lat", "lon").join(close, ["lat", "lon"]).select(point_id, line_id, "distance_m")


def lines_around(points: DataFrame, segments: DataFrame, line_id: str, radius_m: float) -> DataFrame:
    """(lat, lon, line, distance_m) for every line within the radius of a place of ``points``; equal places are searched once.

    Segments are laid into cells of 0.6 radii and places look into the 5×5 cells around them: a piece of a segment within the
    radius has a point laid at most a quarter of a cell farther. What lies outside the radius on one axis is dropped before distances
    are computed. The pairs of few rows may be many, so the cells keep their tasks, however few bytes they hold.
    """
    extent = _extent(points, "lat")
    if extent is None:
        return points.select("lat", "lon").join(segments.select(line_id), F.lit(False)).withColumn("distance_m", F.lit(0.0))
    reach_m = max(radius_m, 1.0)  # cells of some size, also for a radius of nothing
    lat_size, lon_size = _cell_sizes(extent, 0.6 * reach_m)
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c, side = F.col, F.sequence(F.lit(-2), F.lit(2))
    asked = points.select("lat", "lon").distinct().withColumn("_dy", F.explode(side)).withColumn("_dx", F.explode(side))
    asked = asked.select(
        "lat", "lon", F.radians("lat").alias("_lat0"), F.radians("lon").alias("_lon0"), F.cos(F.radians("lat")).alias("_shrink"),
        (F.floor(c("lat") / lat_size) + c("_dy")).alias("_y"), (F.floor(c("lon") / lon_size) + c("_dx")).alias("_x"),
    ).repartition(tasks, "_y", "_x")
    ends = ["a_lat", "a_lon", "b_lat", "b_lon"]
    laid = _pieces(segments, lat_size / 2, lon_size / 2)
    laid = laid.select(line_id, *[F.radians(e).alias(f"_{e}") for e in ends], F.floor(c("_lat") / lat_size).alias("_y"), F.floor(c("_lon") / lon_size).alias("_x"))
    laid = laid.distinct().repartition(tasks, "_y", "_x")
    lat_room, lon_room = (radians(size / 0.6) * (1 + 1e-6) for size in (lat_size, lon_size))
    near = (
        (c("_lat0") >= F.least("_a_lat", "_b_lat") - lat_room) & (c("_lat0") <= F.greatest("_a_lat", "_b_lat") + lat_room)
        & (c("_lon0") >= F.least("_a_lon", "_b_lon") - lon_room) & (c("_lon0") <= F.greatest("_a_lon", "_b_lon") + lon_room)
    )
    x, y = lambda e: EARTH_RADIUS_M * (c(f"_{e}_lon") - c("_lon0")) * c("_shrink"), lambda e: EARTH_RADIUS_M * (c(f"_{e}_lat") - c("_lat0"))
    return (
        asked.join(laid, ["_y", "_x"])
        .filter(near)
        .withColumn("distance_m", origin_to_segment_m(x("a"), y("a"), x("b"), y("b")))
        .filter(c("distance_m") <= radius_m)
        .groupBy("lat", "lon", line_id)
        .agg(F.min("distance_m").alias("distance_m"))
    )


def _nothing(points: DataFrame, point_id: str, targets: DataFrame, target_id: str) -> DataFrame:
    return points.select(point_id).join(targets.select(target_id), F.lit(False)).withColumn("distance_m", F.lit(0.0))


def nearest_line(points: DataFrame, point_id: str, segments: DataFrame, line_id: str) -> DataFrame:
    """(point, nearest line, distance_m), however far; equal distances go to the smaller line id. Points without a place have no line."""
    ends = ["a_lat", "a_lon", "b_lat", "b_lon"]
    known = segments.select(line_id, *ends).dropna().withColumns({
        "_low": F.array(F.least("a_lat", "b_lat"), F.least("a_lon", "b_lon")), "_high": F.array(F.greatest("a_lat", "b_lat"), F.greatest("a_lon", "b_lon")),
    })
    middle = [(F.col(f"a_{x}") + F.col(f"b_{x}")) / (4 * half) + 0.5 for x, half in (("lat", 90.0), ("lon", 180.0))]
    tree = Tree(known, along_curve(middle), 2)
    if not len(tree.top[0]):
        return _nothing(points, point_id, segments, line_id)
    degree = F.radians(F.lit(1.0)) * EARTH_RADIUS_M
    places = points.select("lat", "lon").dropna().distinct()
    found = tree.near(places, [F.col("lat"), F.col("lon")], [degree, degree * F.cos(F.radians("lat"))])
    best = (
        found.join(tree.targets.drop("_low", "_high"), "_box")
        .withColumn("distance_m", _distance())
        .groupBy("lat", "lon")
        .agg(F.min(F.struct("distance_m", line_id)).alias("_best"))
        .select("lat", "lon", "_best.*")
    )
    return points.select(point_id, "lat", "lon").join(best, ["lat", "lon"]).select(point_id, line_id, "distance_m")


def nearest_point(points: DataFrame, point_id: str, targets: DataFrame, target_id: str) -> DataFrame:
    """(point, nearest target, distance_m) on the globe; equal distances go to the smaller target id.

    The search runs on the unit sphere in three axes, where the chord grows with the arc.
    """
    la, lo = F.radians("lat"), F.radians("lon")
    axes = {"_x": F.cos(la) * F.cos(lo), "_y": F.cos(la) * F.sin(lo), "_z": F.sin(la)}
    known = targets.select(F.col(target_id).alias("_t"), "lat", "lon").dropna().groupBy("lat", "lon").agg(F.min("_t").alias(target_id))
    known = known.withColumns(axes).withColumn("_low", F.array(*axes)).drop(*axes)
    known = known.withColumnsRenamed({"lat": "_tlat", "lon": "_tlon"}).withColumn("_high", F.col("_low"))
    tree = Tree(known, along_curve([(F.col("_low")[a] + 1.0) / 2.0 for a in range(3)]), 3)
    if not len(tree.top[0]):
        return _nothing(points, point_id, targets, target_id)
    places = points.select("lat", "lon").dropna().distinct().withColumns(axes)
    found = tree.near(places, [F.col(a) for a in axes], [F.lit(1.0)] * 3)
    best = (
        found.join(tree.targets.drop("_low", "_high"), "_box")
        .withColumn("distance_m", haversine_m(F.col("lat"), F.col("lon"), F.col("_tlat"), F.col("_tlon")))
        .groupBy("lat", "lon")
        .agg(F.min(F.struct("distance_m", target_id)).alias("_best"))
        .select("lat", "lon", "_best.*")
    )
    return points.select(point_id, "lat", "lon").join(best, ["lat", "lon"]).select(point_id, target_id, "distance_m")
