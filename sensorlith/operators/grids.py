"""Occupancy grids as cell rows of many maps: −1 unknown, 0 free, above 0 occupied.

Neighbours are found by equi-joins on (map, row, col), so a large map is spread over many
tasks. What has to be repeated (components, distances, ways) runs in a number of rounds that
grows with the logarithm of a cluster's size, or with the turns of a path. Maps that fit a
task go through all rounds there (``map_blocks``); a larger map's rounds are joins, and each
round's table is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from sensorlith.functions.grids import squared_distance
from sensorlith.operators import map_blocks as B
from sensorlith.operators.series import row_limit
from sensorlith.session import cut, written

FOUR = ((-1, 0), (1, 0), (0, -1), (0, 1))
EIGHT = (*FOUR, (-1, -1), (-1, 1), (1, -1), (1, 1))
MIN_CLUSTER = 5
CELL = ["map_id", "row", "col"]


def well_formed() -> Column:
    """Positive sizes and as many values as cells."""
    return F.coalesce((F.col("width") > 0) & (F.col("height") > 0) & (F.size("data") == F.col("width") * F.col("height")), F.lit(False))


def cells(maps: DataFrame) -> DataFrame:
    """One row per cell of the well-formed maps."""
    return (
        maps.filter(well_formed())
        .select("map_id", "width", F.posexplode("data").alias("_i", "value"))
        .select("map_id", F.floor(F.col("_i") / F.col("width")).cast("int").alias("row"), (F.col("_i") % F.col("width")).cast("int").alias("col"), "value")
    )


def shifted(df: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    """Each row once per offset, with its cell moved."""
    moves = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offsets])
    return (
        df.withColumn("_m", F.explode(moves))
        .withColumns({"row": F.col("row") + F.col("_m.r"), "col": F.col("col") + F.col("_m.c")})
        .drop("_m")
    )


def frontier(grid: DataFrame) -> DataFrame:
    """Free cells with an unknown cell above, below or beside them."""
    beside_unknown = shifted(grid.filter("value = -1").select(*CELL), FOUR)
    return grid.filter("value = 0").select(*CELL).join(beside_unknown, CELL, "left_semi")


def clusters(found: DataFrame, min_size: int = MIN_CLUSTER) -> DataFrame:
    """Cells that touch, also at corners, with a common cluster label (its smallest cell); small clusters left out.

    Labels sink to the smallest among the neighbours and then to that label's own label, so
    distances halve from round to round.
    """
    if min_size <= 0:
        raise ValueError("the smallest cluster size must be positive")
    base = written(found.select(*CELL), "clustered")
    small, large = _by_size(base)
    place = [base.schema["row"], base.schema["col"]]
    fields = [*place, StructField("label", StructType(place)), StructField("size", LongType()), StructField("times", LongType())]
    labelled = B.over_maps(small, B.cluster_cells(EIGHT, min_size), fields)
    labelled = labelled.withColumn("_i", F.explode(F.sequence(F.lit(1), "times"))).drop("_i", "times")
    if large is None:
        return labelled
    labels = _labels_in_rounds(large)
    sizes = labels.groupBy("map_id", "label").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_size)
    return labelled.unionByName(labels.join(sizes, ["map_id", "label"]).select("map_id", "node.row", "node.col", "label", "size"))


def _by_size(table: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows of the maps that fit a task, and those of larger maps, or None; without the rows that name no map."""
    limit = min(row_limit(table), B.MAX_CELLS)
    large = table.filter("map_id is not null").groupBy("map_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    large = cut(large.select("map_id"))
    if large.isEmpty():
        return table.filter("map_id is not null"), None
    return table.filter("map_id is not null").join(large, "map_id", "left_anti"), table.join(large, "map_id", "left_semi")


def _labels_in_rounds(base: DataFrame) -> DataFrame:
    """(map_id, node, label): each cell's smallest cell of its cluster, in rounds over all of them."""
    node = F.struct("row", "col")
    links = shifted(base.withColumn("a", node), EIGHT).join(base, CELL).select("map_id", "a", node.alias("b"))
    links = cut(links)
    labels, done = base.select("map_id", node.alias("node"), node.alias("label")), None
    while True:
        near = (
            links.join(labels.select("map_id", F.col("node").alias("b"), "label"), ["map_id", "b"])
            .groupBy("map_id", F.col("a").alias("node"))
            .agg(F.min("label").alias("_near"))
        )
        sunk = labels.join(near, ["map_id", "node"], "left").select(
            "map_id", "node", F.col("label").alias("_old"), F.least("label", "_near").alias("label")
        )
        above = sunk.select("map_id", F.col("node").alias("label"), F.col("label").alias("_up"))
        step = cut(sunk.join(above, ["map_id", "label"]).select("map_id", "node", F.col("_up").alias("label"), (F.col("_up") != F.col("_old")).alias("_changed")))
        settled, labels = _settled(step)
        done = settled if done is None else done.unionByName(settled)
        if labels is None:
            return done


def _settled(step: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows of the maps of which none is ``_changed``, and the others, or None: a map that a round leaves as it was is done,
    and no later round writes it again."""
    changed = cut(step.filter("_changed").select("map_id").distinct())
    rows = step.drop("_changed")
    if changed.isEmpty():
        return rows, None
    return rows.join(changed, "map_id", "left_anti"), rows.join(changed, "map_id", "left_semi")


def cluster_summary(labelled: DataFrame) -> DataFrame:
    """Mean row and column of each cluster, and the member nearest to them (ties by row, column)."""
    keys = ["map_id", "label"]
    centre = labelled.groupBy(*keys).agg(F.avg("row").alias("centroid_row"), F.avg("col").alias("centroid_col"), F.count(F.lit(1)).alias("size"))
    members = labelled.select(*keys, "row", "col").join(centre, keys)
    away = squared_distance(F.col("row"), F.col("col"), F.col("centroid_row"), F.col("centroid_col"))
    return members.groupBy(*keys, "centroid_row", "centroid_col", "size").agg(
        F.min(F.struct(away.alias("d"), "row", "col")).alias("_r")
    ).select(*keys, "centroid_row", "centroid_col", "size", F.col("_r.row").alias("rep_row"), F.col("_r.col").alias("rep_col"))


def candidates(summary: DataFrame, robots: DataFrame) -> DataFrame:
    """Per map the representative nearest to the robot's cell; a map without a robot cell has none."""
    placed = robots.filter("robot_row is not null and robot_col is not null").select("map_id", "robot_row", "robot_col")
    away = squared_distance(F.col("rep_row"), F.col("rep_col"), F.col("robot_row"), F.col("robot_col"))
    best = summary.join(placed, "map_id").groupBy("map_id").agg(
        F.min(F.struct(away.alias("d"), F.col("rep_row").alias("r"), F.col("rep_col").alias("c"))).alias("_b")
    )
    return best.select("map_id", F.col("_b.r").alias("goal_row"), F.col("_b.c").alias("goal_col"))


def inflated(grid: DataFrame, radius: int | Column) -> DataFrame:
    """Free cells within ``radius`` cells of an occupied one become 100; unknown and occupied cells stay."""
    reach = radius if isinstance(radius, Column) else F.lit(radius)
    span = F.sequence(-reach, reach)
    hit = (
        grid.filter("value > 0")
        .withColumns({"_dr": F.explode(span)})
        .withColumn("_dc", F.explode(span))
        .filter(F.col("_dr") * F.col("_dr") + F.col("_dc") * F.col("_dc") <= reach * reach)
        .select("map_id", (F.col("row") + F.col("_dr")).alias("row"), (F.col("col") + F.col("_dc")).alias("col"))
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    near = grid.join(hit, CELL, "left")
    return near.withColumn("value", F.when((F.col("value") == 0) & F.col("_hit"), 100).otherwise(F.col("value"))).drop("_hit")


def traversable(grid: DataFrame) -> DataFrame:
    """(cell, neighbour) for every free cell and the free cells above, below and beside it."""
    free = grid.filter("value = 0").select(*CELL)
    moved = shifted(free.withColumns({"from_row": F.col("row"), "from_col": F.col("col")}), FOUR)
    return moved.join(free, CELL).select(
        "map_id", F.col("from_row").alias("row"), F.col("from_col").alias("col"), F.col("row").alias("next_row"), F.col("col").alias("next_col")
    )


def _lane(across: str, along: str) -> Column:
    """Number that stays the same over an unbroken stretch of free cells along one axis."""
    return F.col(along) - F.row_number().over(Window.partitionBy("map_id", across).orderBy(along))


def hop_distances(grid: DataFrame, starts: DataFrame) -> DataFrame:
    """Steps from the start cell to every free cell, null where there is no way.

    Each round carries distances twice along whole unbroken rows and then columns (running minima
    both ways), so it takes half as many rounds as the shortest ways have turns, and only over the maps that still change.
    """
    free = written(grid.filter("value = 0").select(*CELL), "free")
    begin = starts.select("map_id", *[F.col(f"start_{x}").cast(free.schema[x].dataType).alias(x) for x in ("row", "col")])
    small, large = _by_size(free)
    marked = small.withColumn("start", F.lit(False)).unionByName(begin.dropna().withColumn("start", F.lit(True)))
    steps = StructField("steps", IntegerType())
    found = B.over_maps(marked, B.hop_steps, [free.schema["row"], free.schema["col"], steps])
    found = found.unionByName(free.filter("map_id is null").withColumn("steps", F.lit(None).cast("int")))
    return found if large is None else found.unionByName(_hops_in_rounds(large, begin))


def _hops_in_rounds(free: DataFrame, begin: DataFrame) -> DataFrame:
    table = free.withColumns({"_rl": _lane("row", "col"), "_cl": _lane("col", "row")})
    table = cut(table.join(begin.withColumn("steps", F.lit(0)), CELL, "left"))

    def sweep(df: DataFrame, across: str, along: str, lane: str) -> DataFrame:
        w = Window.partitionBy("map_id", across, lane).orderBy(along)
        back = F.min(F.col("steps") - F.col(along)).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col(along)
        ahead = F.min(F.col("steps") + F.col(along)).over(w.rowsBetween(0, Window.unboundedFollowing)) - F.col(along)
        return df.withColumn("steps", F.least(back, ahead))

    def both(df: DataFrame) -> DataFrame:
        return sweep(sweep(df, "row", "col", "_rl"), "col", "row", "_cl")

    done = None
    while True:  # a map is done when the second of two goes over it changes nothing
        twice = both(both(table).withColumn("_old", F.col("steps")))
        step = cut(twice.withColumn("_changed", ~F.col("steps").eqNullSafe(F.col("_old"))).drop("_old"))
        settled, table = _settled(step)
        done = settled if done is None else done.unionByName(settled)
        if table is None:
            return done.select(*CELL, "steps")


def shortest_paths(distances: DataFrame, goals: DataFrame) -> DataFrame:
    """Cells of one shortest way from start to goal; among equal steps back the smaller (row, col).

    Steps back are followed in doubling strides: after k rounds 2^k cells of each way are known.
    """
    reached = written(distances.filter("steps is not null").select(*CELL, "steps"), "reached")
    ends = goals.select("map_id", *[F.col(f"goal_{x}").cast(reached.schema[x].dataType).alias(x) for x in ("row", "col")])
    small, large = _by_size(reached)
    marked = small.withColumn("goal", F.lit(False)).unionByName(ends.dropna().withColumns({"steps": F.lit(None).cast(reached.schema["steps"].dataType), "goal": F.lit(True)}))
    found = B.over_maps(marked, B.ways_back(FOUR), [reached.schema[name] for name in ("row", "col", "steps")])
    found = found.withColumnRenamed("steps", "step")
    return found if large is None else found.unionByName(_ways_in_strides(large, ends))


def _ways_in_strides(reached: DataFrame, ends: DataFrame) -> DataFrame:
    back = shifted(reached.select(*CELL, F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("steps").alias("_s")), FOUR)
    parent = (
        back.join(reached, CELL)
        .filter(F.col("steps") == F.col("_s") - 1)
        .groupBy("map_id", F.col("_r").alias("row"), F.col("_c").alias("col"))
        .agg(F.min(F.struct(F.col("row").alias("r"), F.col("col").alias("c"))).alias("up"))
    )
    jump = cut(parent.select("map_id", F.struct(F.col("row").alias("r"), F.col("col").alias("c")).alias("at"), "up"))
    goal = ends.join(reached, CELL)
    path = cut(goal.select("map_id", F.struct(F.col("row").alias("r"), F.col("col").alias("c")).alias("at")))
    while True:
        more = path.join(jump, ["map_id", "at"]).select("map_id", F.col("up").alias("at"))
        grown = cut(path.unionByName(more).distinct())
        if grown.count() == path.count():
            break
        path = grown
        far = jump.select("map_id", F.col("at").alias("up"), F.col("up").alias("_far"))
        jump = cut(jump.join(far, ["map_id", "up"]).select("map_id", "at", F.col("_far").alias("up")))
    cells_on = path.select("map_id", F.col("at.r").alias("row"), F.col("at.c").alias("col"))
    return cells_on.join(reached, CELL).withColumnRenamed("steps", "step")
