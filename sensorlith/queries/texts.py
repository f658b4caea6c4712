"""Text and naming functions, report lines, guards and the readers of single runs, over the event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlith.functions import rotation
from sensorlith.functions.numbers import file_safe, percent_text, settled, truthy
from sensorlith.functions.times import slug
from sensorlith.plans import fusion as FU
from sensorlith.plans import imu as I
from sensorlith.plans import missions as M
from sensorlith.queries import missions as MI
from sensorlith.queries.city_tables import EVENTS, events
from sensorlith.queries.imu import D, sql_out
from sensorlith.queries.speeds import settle
from sensorlith.queries.trip_tables import ZONES, zones
from sensorlith.registry import ORACLES, query
from sensorlith.session import work_path
from sensorlith.sources import landing as L
from sensorlith.sources import reports as RP
from sensorlith.sources import runlogs as RL
from sensorlith.sources import sensors as SE

c = F.col
#: texts of a yes-or-no field as feeds write them
FLAGS = ("TRUE", "1", "Yes", "y", "no", "0", "true ", "")


@query(
    "event_truthy_flags",
    f"""WITH {EVENTS}, f AS (SELECT event_type, CASE WHEN k % 9 < 8 THEN [{', '.join(repr(x) for x in FLAGS)}][k % 9 + 1] END AS flag FROM ev)
        SELECT event_type, coalesce(lower(flag) IN ('true', '1', 'yes', 'y'), false) AS is_true, count(*) AS n FROM f GROUP BY ALL""",
)
def event_truthy_flags(spark, sf):
    flag = F.get(F.array(*[F.lit(x) for x in FLAGS]), c("k") % 9)
    return events(spark, sf).select("event_type", truthy(flag).alias("is_true")).groupBy("event_type", "is_true").agg(F.count(F.lit(1)).alias("n"))


@query("snapshot_slugs", "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS slug FROM events")
def snapshot_slugs(spark, sf):
    """Times as snapshot files are named by them."""
    return events(spark, sf).select("event_id", slug(c("ts")).alias("slug"))


@query(
    "report_text_cells",
    f"""WITH {EVENTS} SELECT event_id, format('{{:.0f}}%', 100.0 * (k / 128.0)) AS share,
        replace(replace(replace(replace(event_type || ' / run (' || k || ')', ' ', '_'), '/', '_'), '(', ''), ')', '') AS file_name FROM ev WHERE k % 16 <> 0""",
)
def report_text_cells(spark, sf):
    """Shares as whole percents and names as files take them."""
    named = F.concat("event_type", F.lit(" / run ("), c("k").cast("string"), F.lit(")"))
    return events(spark, sf).where("k % 16 <> 0").select("event_id", percent_text(c("k") / 128.0).alias("share"), file_safe(named).alias("file_name"))


@query(
    "imu_canonical_columns",
    f"""WITH {EVENTS} SELECT user_id AS run_id, {settle('sum(k / 10.0)', 4)} AS gyro_x, {settle('sum(value)', 4)} AS gyro_y, count(*) AS gyro_z, {settle('sum(-value)', 4)} AS acc_x, {settle('sum(k * 2.0)', 4)} AS acc_y,
        {settle('sum(k * k * 1.0)', 4)} AS acc_z FROM ev GROUP BY user_id""",
)
def imu_canonical_columns(spark, sf):
    """Sensor columns found by a part of their names, in any case, and called by one."""
    k, v = c("k"), c("value")
    raw = {"Gyroscope x (rad/s)": k / 10.0, "gyroscope Y (rad/s)": v, "GYROSCOPE Z (rad/s)": F.lit(1.0), "Linear Accelerometer x (m/s^2)": -v, "Linear accelerometer y (m/s^2)": k * 2.0, "linear accelerometer z (m/s^2)": k * k * 1.0}
    df = I.canonical_axes(events(spark, sf).select(c("user_id").alias("run_id"), *[x.alias(n) for n, x in raw.items()]), {"Gyroscope": "gyro", "Linear Accelerometer": "acc"})
    total = lambda n: settled(F.sum(n), 4).alias(n)
    return df.groupBy("run_id").agg(*[total(f"{s}_{a}") for s in ("gyro", "acc") for a in "xyz"]).withColumn("gyro_z", c("gyro_z").cast("long"))


_TURN = {
    "m00": "cos(y) * cos(p)", "m01": "cos(y) * sin(p) * sin(r) - sin(y) * cos(r)", "m02": "cos(y) * sin(p) * cos(r) + sin(y) * sin(r)",
    "m10": "sin(y) * cos(p)", "m11": "sin(y) * sin(p) * sin(r) + cos(y) * cos(r)", "m12": "sin(y) * sin(p) * cos(r) - cos(y) * sin(r)",
    "m20": "-sin(p)", "m21": "cos(p) * sin(r)", "m22": "cos(p) * cos(r)",
}


@query("rotation_matrices", f"WITH {EVENTS}, a AS (SELECT event_id, (k - 50) / {D(40)} AS r, (value - 100) / {D(400)} AS p, (k % 17 - 8) / {D(3)} AS y FROM ev) SELECT event_id, {sql_out(_TURN)} FROM a")
def rotation_matrices(spark, sf):
    """Matrices of rotations given by three angles."""
    names = ("qw", "qx", "qy", "qz")
    q = rotation.from_euler((c("k") - 50) / 40.0, (c("value") - 100.0) / 400.0, (c("k") % 17 - 8) / 3.0)
    turned = events(spark, sf).select("event_id", *[x.alias(n) for x, n in zip(q, names)])
    m = turned.select("event_id", rotation.rotation_matrix(tuple(c(n) for n in names)).alias("m"))
    return m.select("event_id", *[settled(c("m")[i][j], 6).alias(f"m{i}{j}") for i in range(3) for j in range(3)])


@query("mission_comparison_lines", f"SELECT '| ' || concat_ws(' | ', scenario, version, runs, success, mean_waypoints, mean_completion_time_s, localization_rmse_m, cross_track_rmse_m, path_efficiency) || ' |' AS value FROM ({ORACLES['mission_comparison_text']})")
def mission_comparison_lines(spark, sf):
    """The comparison as lines of a text file, read back."""
    path = work_path(spark, "comparison")
    RP.markdown_rows(M.comparison_text(M.scenario_summary(MI.results(spark, sf)))).write.text(path)
    return spark.read.text(path)


@query("source_zone_parquet", f"WITH {ZONES} SELECT location_id, zone, borough, service_zone FROM zones")
def source_zone_parquet(spark, sf):
    """Zones from a Parquet file that names its columns in its own way."""
    path = work_path(spark, "zones")
    zones(spark, sf).select(c("location_id").alias("LocationID"), c("zone").alias("ZONE"), c("borough").alias("Borough"), c("service_zone").alias("ServiceZone")).write.parquet(path)
    return L.read_zones_parquet(spark, path)


@query(
    "report_guards",
    f"WITH {EVENTS} SELECT event_type AS what, CASE WHEN event_type = 'error' THEN 'error lacks columns: [''value'']' WHEN count(*) FILTER (WHERE k >= 0) = 0 THEN event_type || ' has no rows' ELSE 'rows' END AS found FROM ev GROUP BY event_type "
    "UNION ALL SELECT 'nobody', 'nobody has no rows'",
)
def report_guards(spark, sf):
    """What the guards say to each kind of event: one lacks a column, one that nobody sends has no rows."""
    e = events(spark, sf)
    said = []
    for what in [r[0] for r in e.select("event_type").distinct().collect()] + ["nobody"]:
        rows = e.where(c("event_type") == what)
        try:
            FU.require_rows(FU.require_columns(rows.drop("value") if what == "error" else rows, ("event_id", "value"), what), what)
            said.append((what, "rows"))
        except ValueError as error:
            said.append((what, str(error)))
    return spark.createDataFrame(said, "what string, found string")


@query("source_run_states", f"WITH {EVENTS} SELECT user_id AS run_id, count(*) AS n, count(*) FILTER (WHERE k % 5 <> 0) AS with_heading, {settle('sum(k / 10.0)', 4)} AS x_sum FROM ev GROUP BY user_id")
def source_run_states(spark, sf):
    """State lines of runs, some without a heading, read with their schema."""
    path = work_path(spark, "states")
    state = F.struct(c("user_id").alias("run_id"), (c("k") / 10.0).alias("x_m"), F.when(c("k") % 5 != 0, c("value")).alias("yaw_rad"))
    events(spark, sf).select(F.to_json(state).alias("value")).write.text(path)
    states = RL.read_states(spark, path, "run_id long, x_m double, yaw_rad double")
    return states.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count("yaw_rad").alias("with_heading"), settled(F.sum("x_m"), 4).alias("x_sum"))


@query("source_long_store_runs", f"WITH {EVENTS} SELECT CAST(user_id AS VARCHAR) AS run_id, event_id, ts AS time FROM ev WHERE user_id IN (SELECT DISTINCT user_id FROM ev ORDER BY user_id LIMIT 3)")
def source_long_store_runs(spark, sf):
    """The rows of three named runs of the long store."""
    store = events(spark, sf).select(c("user_id").cast("string").alias("run_id"), "event_id", c("ts").alias("time"), "user_id")
    names = [r[0] for r in store.select("run_id", "user_id").distinct().orderBy("user_id").limit(3).collect()]
    return SE.read_run(store, names).drop("user_id")


@query(
    "source_three_sensor_runs",
    f"""WITH {EVENTS}, s AS (SELECT *, ['accelerometer', 'gravity', 'gyroscope'][event_id % 3 + 1] AS sensor FROM ev),
        w AS (SELECT user_id FROM s GROUP BY user_id HAVING count(DISTINCT sensor) = 3)
        SELECT CAST(user_id AS VARCHAR) AS run_id, sensor, count(*) AS n, {settle('sum(k / 10.0)', 4)} AS x_sum, {settle('sum(value)', 4)} AS y_sum FROM s JOIN w USING (user_id) GROUP BY ALL""",
)
def source_three_sensor_runs(spark, sf):
    """Runs with all three sensors, a file of each, read by their names."""
    sensor = F.element_at(F.array(*[F.lit(x) for x in sorted(SE.SENSORS)]), (c("event_id") % 3 + 1).cast("int"))
    rows = events(spark, sf).select(c("user_id").cast("string").alias("run"), sensor.alias("sensor"), (c("event_id") / 100.0).alias("time_sec"), (c("k") / 10.0).alias("x"), c("value").alias("y"), F.lit(0.0).alias("z"))
    whole = rows.groupBy("run").agg(F.count_distinct("sensor").alias("sensors")).where(F.col("sensors") == len(SE.SENSORS)).select("run")
    path = work_path(spark, "sensor-files")
    SE.write_three_sensor_runs(rows.join(whole, "run").withColumnRenamed("run", "run_id"), path)
    out = None
    for short, frame in SE.read_three_sensor_runs(spark, path).items():
        name = next(s for s, v in SE.SENSORS.items() if v == short)
        counted = frame.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), settled(F.sum(f"{short}_x"), 4).alias("x_sum"), settled(F.sum(f"{short}_y"), 4).alias("y_sum")).withColumn("sensor", F.lit(name))
        out = counted if out is None else out.unionByName(counted)
    return out
