"""Rover queries: embeddings as range scans, paths and small maps; events as commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlith.functions.numbers import settled, wrap_angle
from sensorlith.functions.grids import manhattan
from sensorlith.functions.rotation import yaw_of
from sensorlith.functions.times import micros
from sensorlith.operators import grids as G
from sensorlith.plans import maps as MP
from sensorlith.plans import rovers as RV
from sensorlith.queries.city_tables import EVENTS, events
from sensorlith.queries.imu import EPOCH_US, D, out, sql_out
from sensorlith.queries.speeds import settle
from sensorlith.queries.trip_tables import table
from sensorlith.registry import query
from sensorlith.session import cut

c = F.col
TIMEOUT_S = 600.0
STEP = 6.283185307179586 / 64


def scans(spark, sf):
    e = table(spark, sf, "embeddings")
    ranges = F.transform("embedding", lambda x: F.when(x > 0.25, float("inf")).when(x < -0.25, float("nan")).otherwise(F.abs(x.cast("double")) * 4.0 + 0.05))
    return e.select(
        c("label").alias("robot_id"), (c("vec_id") * 60.0).alias("ts"), ranges.alias("ranges"), F.lit(-3.141592653589793).alias("angle_min"),
        F.lit(STEP).alias("angle_increment"), F.lit(0.1).alias("range_min"), F.lit(10.0).alias("range_max"),
    )


def distances(spark, sf):
    return RV.sector_distances(scans(spark, sf), 0.35, 1.0, 0.4)


def commands(spark, sf):
    return events(spark, sf).select(
        (c("user_id") % 10).cast("int").alias("robot_id"), ((micros(c("ts")) - EPOCH_US) / F.lit(1e8)).alias("ts"), "event_id",
        (c("k") / 100.0 - 0.3).alias("linear_x"), (c("k") % 7 / 10.0).alias("angular_z"),
    )


def _near(centre, half):
    return f"""min(d) FILTER (WHERE a >= {D(centre)} - {D(half)} AND a <= {D(centre)} + {D(half)} AND d >= {D(0.1)} AND d <= 10)"""


SCANS = f"""
pt AS (SELECT label AS robot_id, vec_id * 60.0::DOUBLE AS ts, {D(-3.141592653589793)} + (i - 1) * {D(STEP)} AS a,
  CASE WHEN embedding[i] > {D(0.25)} THEN 10.0 WHEN embedding[i] < {D(-0.25)} THEN NULL ELSE abs(CAST(embedding[i] AS DOUBLE)) * 4 + {D(0.05)} END AS d
  FROM embeddings, LATERAL (SELECT unnest(range(1, 65)) AS i)),
dist AS (SELECT robot_id, ts, {_near(0.0, 0.35)} AS front, {_near(1.0, 0.4)} AS left_, {_near(-1.0, 0.4)} AS right_ FROM pt GROUP BY ALL),
dec AS (SELECT *, CASE WHEN front IS NULL OR front <= {D(0.2)} THEN true WHEN front >= {D(0.3)} THEN false END AS decided FROM dist),
blk AS (SELECT *, coalesce(last_value(decided IGNORE NULLS) OVER (PARTITION BY robot_id ORDER BY ts ROWS UNBOUNDED PRECEDING), true) AS blocked FROM dec),
cmd AS (SELECT CAST(user_id % 10 AS INTEGER) AS robot_id, (epoch_us(ts) - {EPOCH_US}) / 1e8 AS ts, event_id, k / {D(100)} - {D(0.3)} AS linear_x, k % 7 / {D(10)} AS angular_z FROM ev),
seen AS (SELECT cmd.*, blk.ts AS sts, blk.blocked FROM cmd ASOF LEFT JOIN blk ON cmd.robot_id = blk.robot_id AND cmd.ts >= blk.ts)"""
SQL = f"WITH {EVENTS}, {SCANS}"
SIDES = ["front", "left", "right"]


@query("rover_sector_distances", f"{SQL} SELECT robot_id, ts, {sql_out({'front': 'front', 'left': 'left_', 'right': 'right_'})} FROM dist")
def rover_sector_distances(spark, sf):
    return out(distances(spark, sf), SIDES, "robot_id", "ts")


@query("rover_nearest_per_window", f"{SQL} SELECT robot_id, CAST(floor(ts / 3600) AS BIGINT) AS hour, {sql_out({'front': 'min(front)', 'left': 'min(left_)', 'right': 'min(right_)'})} FROM dist GROUP BY ALL")
def rover_nearest_per_window(spark, sf):
    hourly = distances(spark, sf).groupBy("robot_id", F.floor(c("ts") / 3600).alias("hour")).agg(*[F.min(s).alias(s) for s in SIDES])
    return out(hourly, SIDES, "robot_id", "hour")


def blocked(spark, sf):
    return RV.blocked_states(distances(spark, sf).select("robot_id", "ts", "front"), 0.2, 0.3)


@query(
    "rover_blocked_states",
    f"{SQL} SELECT robot_id, ts, blocked, blocked AND NOT coalesce(lag(blocked) OVER (PARTITION BY robot_id ORDER BY ts), true) AS stop_sent FROM blk",
)
def rover_blocked_states(spark, sf):
    return blocked(spark, sf).select("robot_id", "ts", "blocked", "stop_sent")


@query(
    "rover_stale_periods",
    f"""{SQL} SELECT robot_id, ts + {TIMEOUT_S} AS stale_from, coalesce(n, -1) AS stale_until FROM (SELECT *, lead(ts) OVER (PARTITION BY robot_id ORDER BY ts) AS n FROM dist) WHERE n IS NULL OR n - ts > {TIMEOUT_S}""",
)
def rover_stale_periods(spark, sf):
    return RV.stale_periods(scans(spark, sf), TIMEOUT_S).withColumn("stale_until", F.coalesce("stale_until", F.lit(-1.0)))


@query(
    "rover_guarded_commands",
    f"""{SQL}, g AS (SELECT *, sts IS NULL OR ts - sts > {TIMEOUT_S} AS stale, coalesce(blocked, true) AS fb FROM seen)
        SELECT event_id, robot_id, stale AS scan_is_stale, fb AS front_blocked, {settle('CASE WHEN (stale OR fb) AND linear_x > 0 THEN 0 ELSE linear_x END', 6)} AS safe_linear_x,
        {settle('angular_z', 6)} AS safe_angular_z FROM g""",
)
def rover_guarded_commands(spark, sf):
    g = RV.guarded(commands(spark, sf), blocked(spark, sf).select("robot_id", "ts", "blocked"), TIMEOUT_S)
    return out(g, ["safe_linear_x", "safe_angular_z"], "event_id", "robot_id", "scan_is_stale", "front_blocked")


@query(
    "rover_path_gated_commands",
    f"""{SQL}, ps AS (SELECT label AS robot_id, vec_id * 60.0::DOUBLE AS ts, vec_id % 5 AS n_points FROM embeddings),
        q AS (SELECT cmd.*, coalesce(n_points > 0 AND cmd.ts - ps.ts <= {TIMEOUT_S}, false) AS u FROM cmd ASOF LEFT JOIN ps ON cmd.robot_id = ps.robot_id AND cmd.ts >= ps.ts)
        SELECT event_id, u AS path_is_usable, {settle('CASE WHEN u THEN linear_x ELSE 0 END', 6)} AS out_linear_x, {settle('CASE WHEN u THEN angular_z ELSE 0 END', 6)} AS out_angular_z FROM q""",
)
def rover_path_gated_commands(spark, sf):
    paths = table(spark, sf, "embeddings").select(c("label").alias("robot_id"), (c("vec_id") * 60.0).alias("ts"), (c("vec_id") % 5).alias("n_points"))
    return out(RV.path_gated(commands(spark, sf), paths, TIMEOUT_S), ["out_linear_x", "out_angular_z"], "event_id", "path_is_usable")


TURNS = SCANS.replace("pt AS (", "pt AS MATERIALIZED (", 1).replace("dist AS (", "dist AS MATERIALIZED (", 1)


@query(
    "rover_turn_states",
    f"""WITH RECURSIVE {EVENTS}, {TURNS}, tk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY robot_id ORDER BY ts) AS i FROM dist),
        side AS (SELECT *, CASE WHEN left_ IS NULL AND right_ IS NULL THEN 0.0 WHEN right_ IS NULL THEN 1.0 WHEN left_ IS NULL THEN -1.0 WHEN left_ >= right_ THEN 1.0 ELSE -1.0 END AS s FROM tk),
        tr AS (
          SELECT robot_id, i, ts, CAST(CASE WHEN front IS NULL OR front > {D(0.2)} THEN 0 ELSE s END AS DOUBLE) AS turn, coalesce(front > {D(0.2)}, false) AS forward FROM side WHERE i = 1
          UNION ALL
          SELECT n.robot_id, n.i, n.ts, CAST(CASE WHEN front IS NULL THEN turn WHEN turn <> 0 THEN CASE WHEN front <= {D(0.3)} THEN turn ELSE 0 END WHEN front > {D(0.2)} THEN 0 ELSE s END AS DOUBLE),
            CASE WHEN front IS NULL THEN false WHEN turn <> 0 THEN front > {D(0.3)} ELSE front > {D(0.2)} END FROM tr JOIN side n ON n.robot_id = tr.robot_id AND n.i = tr.i + 1)
        SELECT robot_id, ts, turn, forward FROM tr""",
)
def rover_turn_states(spark, sf):
    return RV.turn_states(distances(spark, sf), 0.2, 0.3)


def _path_ticks(spark, sf):
    """Each embedding as a path of 32 points; the tick stands at the mean of two of them."""
    e = table(spark, sf, "embeddings")
    pts = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(
        (i * 0.05 + F.get("embedding", i).cast("double") / 2.0).alias("x"), (F.get("embedding", i + 32).cast("double") / 2.0).alias("y")))
    return e.select("vec_id", pts.alias("path"), (F.col("label") * 0.15).alias("x"), F.lit(0.0).alias("y"))


@query(
    "rover_lookahead",
    f"""WITH p AS (SELECT vec_id, i - 1 AS i, (i - 1) * {D(0.05)} + CAST(embedding[i] AS DOUBLE) / 2 AS x, CAST(embedding[i + 32] AS DOUBLE) / 2 AS y, label * {D(0.15)} AS rx
          FROM embeddings, LATERAL (SELECT unnest(range(1, 33)) AS i)),
        n AS (SELECT vec_id, arg_min(i, (x - rx) * (x - rx) + y * y) AS ci FROM p GROUP BY vec_id),
        a AS (SELECT p.*, ci, sum(CASE WHEN i > ci THEN sqrt(pow(x - px, 2) + pow(y - py, 2)) ELSE 0 END) OVER (PARTITION BY p.vec_id ORDER BY i) AS run
          FROM (SELECT *, lag(x) OVER (PARTITION BY vec_id ORDER BY i) AS px, lag(y) OVER (PARTITION BY vec_id ORDER BY i) AS py FROM p) p JOIN n USING (vec_id)),
        h AS (SELECT vec_id, any_value(ci) AS ci, coalesce(min(i) FILTER (WHERE i > ci AND run >= 0.3), 31) AS hi FROM a GROUP BY vec_id)
        SELECT vec_id, CAST(ci AS INTEGER) AS closest_index, {sql_out({'ahead_x': 'x', 'ahead_y': 'y'})} FROM h JOIN p ON p.vec_id = h.vec_id AND i = hi""".replace("SELECT vec_id, CAST(ci", "SELECT h.vec_id, CAST(ci"),
)
def rover_lookahead(spark, sf):
    return out(RV.lookahead(_path_ticks(spark, sf)), ["ahead_x", "ahead_y"], "vec_id", "closest_index")


@query(
    "rover_angles",
    f"""WITH {EVENTS} SELECT event_id, {sql_out({'wrapped': '(value / 10 - 2 * pi() * floor((value / 10 + pi()) / (2 * pi())))', 'yaw': 'atan2(sin(2 * (k - 50) / 40.0), cos(2 * (k - 50) / 40.0))'})} FROM ev""",
)
def rover_angles(spark, sf):
    half = (c("k") - 50) / 40.0
    q = (F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half))
    return events(spark, sf).select("event_id", settled(wrap_angle(c("value") / 10.0), 6).alias("wrapped"), settled(yaw_of(q), 6).alias("yaw"))


# --- maps: every embedding is an 8×8 grid ---------------------------------------------------


def maps(spark, sf):
    e = table(spark, sf, "embeddings")
    data = F.transform("embedding", lambda x: F.when(x < -0.12, -1).when(x > 0.14, 100).otherwise(0))
    return e.select(
        c("vec_id").alias("map_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(0.5).alias("resolution"), F.lit(-1.0).alias("origin_x"),
        F.lit(-2.0).alias("origin_y"), data.alias("data"), (c("label") * 0.5 - 1.0).alias("robot_x"), (c("vec_id") % 9 * 0.5 - 1.9).alias("robot_y"),
    )


GRID = f"""
cell AS MATERIALIZED (SELECT vec_id AS map_id, CAST((i - 1) // 8 AS INTEGER) AS r, CAST((i - 1) % 8 AS INTEGER) AS c,
  CASE WHEN embedding[i] < {D(-0.12)} THEN -1 WHEN embedding[i] > {D(0.14)} THEN 100 ELSE 0 END AS v FROM embeddings, LATERAL (SELECT unnest(range(1, 65)) AS i)),
o4 AS (SELECT * FROM (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) t(dr, dc)),
fr AS MATERIALIZED (SELECT DISTINCT f.map_id, f.r, f.c FROM cell f JOIN o4 ON true JOIN cell u ON u.map_id = f.map_id AND u.r = f.r + dr AND u.c = f.c + dc WHERE f.v = 0 AND u.v = -1),
reach AS (SELECT map_id, r, c, r AS lr, c AS lc FROM fr UNION SELECT b.map_id, b.r, b.c, a.lr, a.lc FROM reach a JOIN fr b ON a.map_id = b.map_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
lab AS (SELECT map_id, r, c, min(lr * 8 + lc) AS l FROM reach GROUP BY ALL),
cl AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY map_id, l) AS size FROM lab QUALIFY count(*) OVER (PARTITION BY map_id, l) >= 5),
cen AS (SELECT map_id, l, avg(r) AS cr, avg(c) AS cc, count(*) AS size FROM cl GROUP BY ALL),
rep AS MATERIALIZED (SELECT cl.map_id, cl.l, cr, cc, cen.size, r AS rr, c AS rc FROM cl JOIN cen USING (map_id, l)
  QUALIFY row_number() OVER (PARTITION BY cl.map_id, cl.l ORDER BY (r - cr) * (r - cr) + (c - cc) * (c - cc), r, c) = 1),
rob AS (SELECT map_id, CASE WHEN rr BETWEEN 0 AND 7 AND rc BETWEEN 0 AND 7 THEN rr END AS robot_row, CASE WHEN rr BETWEEN 0 AND 7 AND rc BETWEEN 0 AND 7 THEN rc END AS robot_col
  FROM (SELECT vec_id AS map_id, CAST(floor((vec_id % 9 * {D(0.5)} - {D(1.9)} + 2) / 0.5) AS INTEGER) AS rr, CAST(label AS INTEGER) AS rc FROM embeddings)),
goal AS MATERIALIZED (SELECT rep.map_id, rr AS goal_row, rc AS goal_col FROM rep JOIN rob USING (map_id) WHERE robot_row IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY rep.map_id ORDER BY (rr - robot_row) * (rr - robot_row) + (rc - robot_col) * (rc - robot_col), rr, rc) = 1)"""


def grid(spark, sf):
    return G.cells(maps(spark, sf))


@query("map_cells", f"WITH RECURSIVE {GRID} SELECT map_id, r AS row, c AS col, v AS value FROM cell")
def map_cells(spark, sf):
    return grid(spark, sf)


@query("map_frontier", f"WITH RECURSIVE {GRID} SELECT map_id, r AS row, c AS col FROM fr")
def map_frontier(spark, sf):
    return G.frontier(grid(spark, sf))


def labelled(spark, sf):
    return G.clusters(G.frontier(grid(spark, sf)))


@query("map_clusters", f"WITH RECURSIVE {GRID} SELECT map_id, r AS row, c AS col, CAST(l AS INTEGER) AS label, size FROM cl")
def map_clusters(spark, sf):
    return labelled(spark, sf).select("map_id", "row", "col", (c("label.row") * 8 + c("label.col")).alias("label"), "size")


@query("map_cluster_summary", f"WITH RECURSIVE {GRID} SELECT map_id, CAST(l AS INTEGER) AS label, size, rr AS rep_row, rc AS rep_col, {sql_out({'centroid_row': 'cr', 'centroid_col': 'cc'})} FROM rep")
def map_cluster_summary(spark, sf):
    s = G.cluster_summary(labelled(spark, sf)).withColumn("label", c("label.row") * 8 + c("label.col"))
    return out(s, ["centroid_row", "centroid_col"], "map_id", "label", "size", "rep_row", "rep_col")


@query("map_robot_cells", f"WITH RECURSIVE {GRID} SELECT map_id, coalesce(robot_row, -1) AS robot_row, coalesce(robot_col, -1) AS robot_col FROM rob")
def map_robot_cells(spark, sf):
    return MP.robot_cells(maps(spark, sf)).fillna(-1)


@query("map_candidates", f"WITH RECURSIVE {GRID} SELECT * FROM goal")
def map_candidates(spark, sf):
    return G.candidates(G.cluster_summary(labelled(spark, sf)), MP.robot_cells(maps(spark, sf)))


INFLATED = "inf_ AS MATERIALIZED (SELECT a.map_id, a.r, a.c, CASE WHEN a.v = 0 AND EXISTS (SELECT 1 FROM cell b WHERE b.map_id = a.map_id AND b.v > 0 AND (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= {0}) THEN 100 ELSE a.v END AS v FROM cell a)"


@query("map_inflated", f"WITH RECURSIVE {GRID}, {INFLATED.format(1)} SELECT map_id, r AS row, c AS col, v AS value FROM inf_")
def map_inflated(spark, sf):
    return G.inflated(grid(spark, sf), 1)


@query("map_traversable", f"WITH {GRID.split('fr AS')[0].rstrip().rstrip(',')}, p AS (SELECT map_id, r, c, r + dr AS nr, c + dc AS nc FROM cell, o4 WHERE v = 0) SELECT p.map_id, p.r AS row, p.c AS col, b.r AS next_row, b.c AS next_col FROM p JOIN cell b ON b.map_id = p.map_id AND b.r = p.nr AND b.c = p.nc WHERE b.v = 0")
def map_traversable(spark, sf):
    return G.traversable(grid(spark, sf))


HOPS = """
hop AS (SELECT f.map_id, f.r, f.c, 0 AS s FROM {0} f JOIN rob ON rob.map_id = f.map_id AND r = robot_row AND c = robot_col WHERE v = 0
  UNION SELECT b.map_id, b.r, b.c, s + 1 FROM hop a JOIN {0} b ON a.map_id = b.map_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1 WHERE b.v = 0 AND s < 40),
steps AS MATERIALIZED (SELECT map_id, r, c, min(s) AS steps FROM hop GROUP BY ALL)"""


def hops(spark, sf):
    robots = MP.robot_cells(maps(spark, sf)).filter("robot_row is not null")
    return G.hop_distances(grid(spark, sf), robots.select("map_id", c("robot_row").alias("start_row"), c("robot_col").alias("start_col")))


@query("map_hop_distances", f"WITH RECURSIVE {GRID}, {HOPS.format('cell')} SELECT map_id, r AS row, c AS col, coalesce(steps, -1) AS steps FROM cell LEFT JOIN steps USING (map_id, r, c) WHERE v = 0")
def map_hop_distances(spark, sf):
    return hops(spark, sf).withColumn("steps", F.coalesce("steps", F.lit(-1)))


@query(
    "map_exploration",
    f"""WITH RECURSIVE {GRID}, {INFLATED.format(0)}, {HOPS.format('inf_')} SELECT rob.map_id, coalesce(robot_row, -1) AS robot_row, coalesce(robot_col, -1) AS robot_col,
        coalesce(goal_row, -1) AS goal_row, coalesce(goal_col, -1) AS goal_col, coalesce(steps, -1) AS steps
        FROM rob LEFT JOIN goal USING (map_id) LEFT JOIN steps ON steps.map_id = rob.map_id AND r = goal_row AND c = goal_col""",
)
def map_exploration(spark, sf):
    """Robot radius and clearance below half a cell leave the grid as it is."""
    from sensorlith.functions.grids import inflation_radius

    m = maps(spark, sf)
    g, robots = cut(G.cells(m)), cut(MP.robot_cells(m))
    goals = G.candidates(G.cluster_summary(G.clusters(G.frontier(g))), robots)
    radius = m.select("map_id", (inflation_radius(0.3, 0.3, 0.05, c("resolution")) - 1).alias("_radius"))
    grown = G.inflated(g.join(radius, "map_id"), c("_radius")).drop("_radius")
    starts = robots.filter("robot_row is not null").select("map_id", c("robot_row").alias("start_row"), c("robot_col").alias("start_col"))
    steps = G.hop_distances(grown, starts).withColumnsRenamed({"row": "goal_row", "col": "goal_col"})
    return robots.join(goals.join(steps, ["map_id", "goal_row", "goal_col"], "left"), "map_id", "left").fillna(-1)


@query("map_exploration_job")
def map_exploration_job(spark, sf):
    """The whole map job with the robot's real size."""
    return MP.explore(maps(spark, sf)).fillna(-1)


PATHS = """
wk AS (
  SELECT g.map_id, s.r, s.c, s.steps FROM goal g JOIN steps s ON s.map_id = g.map_id AND s.r = goal_row AND s.c = goal_col
  UNION ALL
  SELECT map_id, r, c, steps FROM (SELECT w.map_id, s.r, s.c, s.steps, row_number() OVER (PARTITION BY w.map_id ORDER BY s.r, s.c) AS i FROM wk w
    JOIN steps s ON s.map_id = w.map_id AND s.steps = w.steps - 1 AND abs(s.r - w.r) + abs(s.c - w.c) = 1) WHERE i = 1)"""


@query("map_paths", f"WITH RECURSIVE {GRID}, {HOPS.format('cell')}, {PATHS} SELECT map_id, r AS row, c AS col, steps AS step, {sql_out({'x': '(-1 + (c + 0.5) * 0.5)', 'y': '(-2 + (r + 0.5) * 0.5)'})} FROM wk")
def map_paths(spark, sf):
    m = maps(spark, sf)
    goals = G.candidates(G.cluster_summary(labelled(spark, sf)), MP.robot_cells(m))
    return out(MP.world_path(G.shortest_paths(hops(spark, sf), goals), m), ["x", "y"], "map_id", "row", "col", "step")


@query("map_goal_manhattan", f"WITH RECURSIVE {GRID} SELECT map_id, abs(goal_row - robot_row) + abs(goal_col - robot_col) AS hops FROM goal JOIN rob USING (map_id)")
def map_goal_manhattan(spark, sf):
    robots = MP.robot_cells(maps(spark, sf))
    goals = G.candidates(G.cluster_summary(labelled(spark, sf)), robots)
    return goals.join(robots, "map_id").select("map_id", manhattan(c("goal_row"), c("goal_col"), c("robot_row"), c("robot_col")).alias("hops"))
