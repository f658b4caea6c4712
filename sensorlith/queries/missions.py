"""Run-log queries: events as robot log records, each user one run."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlith.functions.numbers import settled
from sensorlith.functions.times import micros
from sensorlith.plans import missions as M
from sensorlith.queries.city_tables import EVENTS, events
from sensorlith.queries.imu import EPOCH_US, D, out, sql_out
from sensorlith.registry import query

c = F.col
KIND = {"signup": "mission.event", "error": "fault.injection"}


def run_log(spark, sf):
    k, v, kind = c("k"), c("value"), c("event_type")
    telemetry = kind.isin("view", "click", "purchase")
    e = events(spark, sf)
    name = F.when(
        kind == "signup", F.when(k % 3 == 0, "mission_completed").when(k % 3 == 1, "waypoint_reached").otherwise("mission_failed")
    ).when(kind == "error", F.when(k % 2 == 0, M.FAULT).otherwise("gps_dropout"))
    payload = F.struct(
        F.when(telemetry, F.struct((k / 10.0).alias("x_m"), ((v - 35.0) / 100.0).alias("y_m"))).alias("truth"),
        F.when(
            telemetry, F.struct((v / 100.0).alias("pose_error_m"), F.when(kind != "click", v / 200.0).alias("gps_innovation_m"))
        ).alias("localization"),
        F.when(telemetry, F.struct((k % 3).cast("double").alias("target_x_m"), (k % 2).cast("double").alias("target_y_m"))).alias("mission"),
        name.alias("name"),
        F.when(kind == "signup", (k % 4).cast("long")).alias("waypoints_reached"),
        F.when(kind == "error", k % 4 == 0).alias("active"),
    )
    return e.select(
        c("event_id").cast("string").alias("event_id"),
        c("user_id").alias("run_id"),
        F.concat(F.lit("v"), (F.floor(c("user_id") / 4) % 2 + 1).cast("string")).alias("software_version"),
        F.when(kind == "signup", "mission.event").when(kind == "error", "fault.injection").otherwise("robot.telemetry").alias("event_type"),
        c("event_id").alias("sequence"),
        ((micros(c("ts")) - EPOCH_US) / F.lit(1e6)).alias("event_time_s"),
        payload.alias("payload"),
    )


LOG = (
    EVENTS
    + f""",
lg AS (
  SELECT user_id AS run_id, 'v' || CAST(user_id // 4 % 2 + 1 AS VARCHAR) AS software_version, event_id AS seq, (epoch_us(ts) - {EPOCH_US}) / 1e6 AS t,
    CASE event_type WHEN 'signup' THEN 'mission.event' WHEN 'error' THEN 'fault.injection' ELSE 'robot.telemetry' END AS kind,
    k / {D(10)} AS x, (value - 35) / {D(100)} AS y, value / {D(100)} AS err, CASE WHEN event_type <> 'click' THEN value / {D(200)} END AS inn, k % 3 AS tx, k % 2 AS ty,
    CASE WHEN event_type = 'signup' THEN CASE k % 3 WHEN 0 THEN 'mission_completed' WHEN 1 THEN 'waypoint_reached' ELSE 'mission_failed' END
         WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 'left_wheel_slip' ELSE 'gps_dropout' END END AS name,
    k % 4 AS wp, k % 4 = 0 AS active FROM ev
),
tl AS (SELECT * FROM lg WHERE kind = 'robot.telemetry'),
ft AS (SELECT run_id, min(t) FILTER (WHERE active) AS fs, min(t) FILTER (WHERE NOT active) AS fe FROM lg WHERE kind = 'fault.injection' AND name = 'left_wheel_slip' GROUP BY run_id),
isl AS (SELECT *, sum(CASE WHEN inn < 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY t, seq ROWS UNBOUNDED PRECEDING) AS g FROM tl WHERE inn IS NOT NULL),
alert AS (SELECT run_id, t, seq FROM (SELECT *, row_number() OVER (PARTITION BY run_id, g ORDER BY t, seq) AS p FROM isl WHERE inn >= 0.2) WHERE p = 2),
det AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE fs IS NULL OR t < fs) AS fp, min(t - fs) FILTER (WHERE t >= fs) AS lat FROM alert LEFT JOIN ft USING (run_id) GROUP BY run_id),
gap AS (SELECT run_id, sum(greatest(0, seq - p - 1)) AS gaps FROM (SELECT run_id, seq, lag(seq) OVER (PARTITION BY run_id ORDER BY seq) AS p FROM lg) WHERE p IS NOT NULL GROUP BY run_id),
pth AS (SELECT run_id, sum(sqrt(pow(x - px, 2) + pow(y - py, 2))) AS len, arg_max(sqrt(x * x + y * y), struct_pack(t := t, s := seq)) AS disp, sqrt(avg(y * y)) AS ct, max(abs(y)) AS cm,
    count(*) AS n, sqrt(avg(err * err)) AS le, max(err) AS lm
  FROM (SELECT *, lag(x, 1, 0) OVER w AS px, lag(y, 1, 0) OVER w AS py FROM tl WINDOW w AS (PARTITION BY run_id ORDER BY t, seq)) GROUP BY run_id),
fin AS (SELECT run_id, arg_max(name, struct_pack(t := t, s := seq)) AS name, arg_max(wp, struct_pack(t := t, s := seq)) AS wp FROM lg WHERE kind = 'mission.event' GROUP BY run_id),
rn AS (SELECT run_id, any_value(software_version) AS software_version, max(t) AS duration_s FROM lg GROUP BY run_id),
met AS (
  SELECT run_id, software_version, coalesce(name = 'mission_completed', false) AS mission_success, wp AS waypoints_reached, duration_s,
    CASE WHEN name = 'mission_completed' THEN duration_s END AS completion_time_s, coalesce(pth.n, 0) AS telemetry_samples, le AS localization_rmse_m, lm AS localization_max_error_m,
    coalesce(det.n, 0) AS detector_alerts, coalesce(fp, 0) AS detector_false_positives, lat AS detection_latency_s, CAST(coalesce(gaps, 0) AS BIGINT) AS log_sequence_gaps,
    len AS path_length_m, CASE WHEN name = 'mission_completed' AND len > 0 THEN disp / len END AS path_efficiency, ct AS cross_track_rmse_m, cm AS cross_track_max_error_m
  FROM rn LEFT JOIN fin USING (run_id) LEFT JOIN pth USING (run_id) LEFT JOIN det USING (run_id) LEFT JOIN gap USING (run_id)
)"""
)
MET_INT = ["waypoints_reached", "telemetry_samples", "detector_alerts", "detector_false_positives", "log_sequence_gaps"]
MET_NUM = ["duration_s", "completion_time_s", "localization_rmse_m", "localization_max_error_m", "detection_latency_s", "path_length_m", "path_efficiency", "cross_track_rmse_m", "cross_track_max_error_m"]


@query("mission_run_metrics", f"WITH {LOG} SELECT run_id, software_version, mission_success, {', '.join(MET_INT)}, {sql_out({n: n for n in MET_NUM}, 5)} FROM met")
def mission_run_metrics(spark, sf):
    return out(M.run_metrics(run_log(spark, sf)), MET_NUM, "run_id", "software_version", "mission_success", *MET_INT, digits=5)


@query("mission_alerts", f"WITH {LOG} SELECT run_id, t AS event_time_s, seq AS sequence FROM alert")
def mission_alerts(spark, sf):
    log = run_log(spark, sf)
    return M.alerts(log.filter(c("event_type") == "robot.telemetry"))


@query("mission_fault_times", f"WITH {LOG} SELECT run_id, fs AS fault_start_s, fe AS fault_end_s FROM ft")
def mission_fault_times(spark, sf):
    return M.fault_times(run_log(spark, sf))


@query("mission_sequence_gaps", f"WITH {LOG} SELECT run_id, CAST(coalesce(gaps, 0) AS BIGINT) AS log_sequence_gaps FROM rn LEFT JOIN gap USING (run_id)")
def mission_sequence_gaps(spark, sf):
    return M.sequence_gaps(run_log(spark, sf))


@query("mission_replay_order", f"WITH {LOG} SELECT run_id, seq AS sequence, row_number() OVER (PARTITION BY run_id ORDER BY t, seq) AS position FROM lg")
def mission_replay_order(spark, sf):
    from sensorlith.operators.series import number

    return number(M.replay(run_log(spark, sf)), "position").result().select("run_id", "sequence", "position")


@query("mission_selected_events", f"WITH {LOG} SELECT run_id, kind AS event_type, count(*) AS n FROM lg WHERE kind IN ('mission.event', 'fault.injection') GROUP BY ALL")
def mission_selected_events(spark, sf):
    return M.selected(run_log(spark, sf)).groupBy("run_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("mission_waypoints", f"WITH {LOG}, f AS (SELECT run_id, tx, ty, min(struct_pack(t := t, s := seq)) AS m FROM tl GROUP BY ALL) SELECT run_id, CAST(tx AS DOUBLE) AS x, CAST(ty AS DOUBLE) AS y, m.t AS first_seen_s, row_number() OVER (PARTITION BY run_id ORDER BY m) AS position FROM f")
def mission_waypoints(spark, sf):
    return M.waypoints(run_log(spark, sf))


@query("mission_thinned_frames", f"WITH {LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY t, seq) AS i, count(*) OVER (PARTITION BY run_id) AS c FROM tl) SELECT run_id, t AS event_time_s, seq AS sequence FROM n WHERE i % 2 = 1 OR i = c")
def mission_thinned_frames(spark, sf):
    return M.thinned_frames(run_log(spark, sf))


SCENARIO_SQL = """sc AS (SELECT * FROM (VALUES ('nominal', 38.0, 1.0, 0.06, 0.35, NULL, NULL, 1.0), ('mild_slip', 38.0, 1.0, 0.06, 0.35, 5.0, 9.0, 0.65),
  ('severe_slip', 38.0, 1.0, 0.06, 0.35, 5.0, 9.0, 0.10), ('noisy_gps', 38.0, 1.0, 0.12, 0.35, NULL, NULL, 1.0))
  AS t(scenario_name, max_time_s, gps_period_s, gps_noise_std_m, waypoint_tolerance_m, slip_start_s, slip_end_s, left_wheel_traction)),
res AS (SELECT *, CASE run_id % 4 WHEN 0 THEN 'nominal' WHEN 1 THEN 'mild_slip' WHEN 2 THEN 'severe_slip' ELSE 'noisy_gps' END AS scenario_name, run_id % 5 AS seed FROM met)"""


def results(spark, sf):
    log = run_log(spark, sf)
    kinds = F.array(*[F.lit(n) for n in ("nominal", "mild_slip", "severe_slip", "noisy_gps")])
    runs = log.select("run_id").distinct().select(
        "run_id", F.element_at(kinds, (c("run_id") % 4 + 1).cast("int")).alias("scenario_name"), (c("run_id") % 5).alias("seed"),
        F.concat(F.lit("runs/"), c("run_id").cast("string"), F.lit(".jsonl")).alias("log_path"),
    )
    # One row per scenario that occurs, with the parameters the runs were made with.
    scenarios = runs.select("scenario_name").distinct().select(
        "scenario_name",
        F.lit(38.0).alias("max_time_s"),
        F.lit(1.0).alias("gps_period_s"),
        F.when(c("scenario_name") == "noisy_gps", 0.12).otherwise(0.06).alias("gps_noise_std_m"),
        F.lit(0.35).alias("waypoint_tolerance_m"),
        F.when(c("scenario_name").endswith("slip"), 5.0).alias("slip_start_s"),
        F.when(c("scenario_name").endswith("slip"), 9.0).alias("slip_end_s"),
        F.when(c("scenario_name") == "mild_slip", 0.65).when(c("scenario_name") == "severe_slip", 0.10).otherwise(1.0).alias("left_wheel_traction"),
    )
    return M.result_rows(M.run_metrics(log), runs, scenarios)


PARAMS = ["max_time_s", "gps_period_s", "gps_noise_std_m", "waypoint_tolerance_m", "slip_start_s", "slip_end_s", "left_wheel_traction"]


@query(
    "mission_result_rows",
    f"""WITH {LOG}, {SCENARIO_SQL} SELECT run_id, scenario_name, software_version, seed, 'runs/' || CAST(run_id AS VARCHAR) || '.jsonl' AS log_path, mission_success,
        {', '.join(MET_INT)}, {', '.join(f'CAST({p} AS DOUBLE) AS {p}' for p in PARAMS)}, {sql_out({n: n for n in MET_NUM}, 5)} FROM res JOIN sc USING (scenario_name)""",
)
def mission_result_rows(spark, sf):
    df = results(spark, sf)
    return df.withColumns({n: settled(c(n), 5) for n in MET_NUM})


SUM_NUM = {
    "success_rate": "avg(CASE WHEN mission_success THEN 1.0 ELSE 0.0 END)", "mean_waypoints_reached": "avg(waypoints_reached)", "mean_completion_time_s": "avg(completion_time_s)",
    "mean_localization_rmse_m": "avg(localization_rmse_m)", "mean_cross_track_rmse_m": "avg(cross_track_rmse_m)", "mean_path_efficiency": "avg(path_efficiency)",
}


@query("mission_scenario_summary", f"WITH {LOG}, {SCENARIO_SQL} SELECT scenario_name, software_version, count(*) AS run_count, count(*) FILTER (WHERE mission_success) AS successful_runs, {sql_out(SUM_NUM, 5)} FROM res GROUP BY ALL")
def mission_scenario_summary(spark, sf):
    return out(M.scenario_summary(results(spark, sf)), SUM_NUM, "scenario_name", "software_version", "run_count", "successful_runs", digits=5)


@query(
    "mission_comparison_text",
    f"""WITH {LOG}, {SCENARIO_SQL}, s AS (SELECT scenario_name, software_version, count(*) AS n, count(*) FILTER (WHERE mission_success) AS k, {', '.join(f'{e} AS {n}' for n, e in SUM_NUM.items())} FROM res GROUP BY ALL)
        SELECT scenario_name AS scenario, software_version AS version, CAST(n AS VARCHAR) AS runs, format('{{}}/{{}} ({{:.0f}}%)', k, n, 100.0 * success_rate) AS success,
        format('{{:.1f}}', mean_waypoints_reached) AS mean_waypoints, coalesce(format('{{:.2f}}', mean_completion_time_s), '—') AS mean_completion_time_s,
        format('{{:.3f}}', mean_localization_rmse_m) AS localization_rmse_m, format('{{:.3f}}', mean_cross_track_rmse_m) AS cross_track_rmse_m,
        coalesce(format('{{:.3f}}', mean_path_efficiency), '—') AS path_efficiency FROM s""",
)
def mission_comparison_text(spark, sf):
    return M.comparison_text(M.scenario_summary(results(spark, sf)))


@query(
    "mission_versions_side_by_side",
    f"""WITH {LOG}, {SCENARIO_SQL}, s AS (SELECT scenario_name, software_version, avg(CASE WHEN mission_success THEN 1.0 ELSE 0.0 END) AS r FROM res GROUP BY ALL)
        SELECT scenario_name, {sql_out({'v1': "(max(r) FILTER (WHERE software_version = 'v1'))", 'v2': "(max(r) FILTER (WHERE software_version = 'v2'))"})}, count(*) = 2 AS is_complete FROM s GROUP BY scenario_name""",
)
def mission_versions_side_by_side(spark, sf):
    return out(M.versions_side_by_side(M.scenario_summary(results(spark, sf)), "success_rate"), ["v1", "v2"], "scenario_name", "is_complete")


def raw_records(spark, sf):
    """Log records as text fields, some of them broken in each way the contract names."""
    k = c("k")
    e = events(spark, sf)
    fixed = {n: F.lit("x") for n in ("robot_id", "recorded_at", "schema_version", "software_version")}
    return e.select(
        c("event_id").cast("string").alias("event_id"),
        c("user_id").cast("string").alias("run_id"),
        F.when(k % 13 != 0, "m1").alias("mission_id"),
        F.when((k % 5 == 0) & (c("event_type") == "click"), "other").otherwise("robot.telemetry").alias("event_type"),
        F.when(k % 7 == 0, F.concat(k.cast("string"), F.lit(".5"))).otherwise(c("event_id").cast("string")).alias("sequence"),
        F.when(k % 17 == 0, "soon").otherwise(k.cast("string")).alias("event_time_s"),
        F.when(k % 11 == 0, "[1]").when(k % 19 != 0, c("props")).alias("payload"),
        *[v.alias(n) for n, v in fixed.items()],
    )


@query(
    "mission_contract_errors",
    f"""WITH {EVENTS}, m AS (SELECT event_id, k, event_type, CASE WHEN k % 13 = 0 AND k % 19 = 0 AND k % 11 <> 0 THEN '[''mission_id'', ''payload'']' WHEN k % 13 = 0 THEN '[''mission_id'']'
          WHEN k % 19 = 0 AND k % 11 <> 0 THEN '[''payload'']' END AS miss FROM ev)
        SELECT CAST(event_id AS VARCHAR) AS event_id, array_to_string(list_filter([CASE WHEN miss IS NOT NULL THEN 'missing fields: ' || miss END,
          CASE WHEN k % 7 = 0 THEN 'sequence must be an integer' END, CASE WHEN k % 17 = 0 THEN 'event_time_s must be numeric' END,
          CASE WHEN k % 11 = 0 OR k % 19 = 0 THEN 'payload must be an object' END,
          CASE WHEN k % 5 = 0 AND event_type = 'click' THEN 'event_type is unknown' END], lambda x: x IS NOT NULL), '; ') AS errors FROM m""",
)
def mission_contract_errors(spark, sf):
    return raw_records(spark, sf).select("event_id", F.array_join(M.contract_errors(), "; ").alias("errors"))


@query("mission_valid_split", f"WITH {EVENTS} SELECT CASE WHEN k % 13 = 0 OR k % 7 = 0 OR k % 17 = 0 OR k % 11 = 0 OR k % 19 = 0 OR (k % 5 = 0 AND event_type = 'click') THEN 'rejected' ELSE 'valid' END AS part, count(*) AS n FROM ev GROUP BY 1")
def mission_valid_split(spark, sf):
    good, bad = M.split_valid(raw_records(spark, sf))
    return good.select(F.lit("valid").alias("part")).unionByName(bad.select(F.lit("rejected").alias("part"))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def _wrap(a: str) -> str:
    """An angle within −π to π, as SQL."""
    return f"(({a}) + pi() - 2 * pi() * floor((({a}) + pi()) / (2 * pi())) - pi())"


@query(
    "mission_gps_replay",
    f"""WITH RECURSIVE {EVENTS},
    n AS (SELECT user_id AS run_id, event_id, row_number() OVER w AS rn, k / 100.0 AS l, (k + 7) % 100 / 100.0 AS r,
        CASE WHEN event_type = 'click' THEN value / 50.0 END AS gx, CASE WHEN event_type = 'click' THEN k / 50.0 END AS gy
        FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, (l + r) / 2.0 * 0.1 AS ahead, (r - l) / 0.42 * 0.1 AS turn FROM n),
    p AS (
      SELECT run_id, CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS rn, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS yaw, NULL::DOUBLE AS lx, NULL::DOUBLE AS ly FROM s WHERE rn = 1
      UNION ALL
      SELECT run_id, event_id, rn, x, y, CASE WHEN course IS NULL THEN yaw ELSE {_wrap(f"yaw + 0.45 * {_wrap('course - yaw')}")} END, lx, ly FROM (
        SELECT run_id, event_id, rn, CASE WHEN gx IS NULL THEN x ELSE x + 0.55 * (gx - x) END AS x, CASE WHEN gx IS NULL THEN y ELSE y + 0.55 * (gy - y) END AS y, yaw,
          CASE WHEN gx IS NOT NULL AND lx IS NOT NULL AND sqrt((gx - lx) * (gx - lx) + (gy - ly) * (gy - ly)) >= 0.18 THEN atan2(gy - ly, gx - lx) END AS course,
          coalesce(gx, lx) AS lx, CASE WHEN gx IS NULL THEN ly ELSE gy END AS ly FROM (
            SELECT s.run_id, s.event_id, s.rn, p.x + s.ahead * cos(p.yaw + s.turn / 2.0) AS x, p.y + s.ahead * sin(p.yaw + s.turn / 2.0) AS y,
              {_wrap("p.yaw + s.turn")} AS yaw, p.lx, p.ly, s.gx, s.gy FROM p JOIN s ON s.run_id = p.run_id AND s.rn = p.rn + 1)))
    SELECT run_id, event_id, {sql_out({'corrected_x': 'x', 'corrected_y': 'y', 'corrected_yaw': 'yaw'})} FROM p WHERE rn > 0""",
)
def mission_gps_replay(spark, sf):
    """Wheel commands replayed with gain corrections towards GPS."""
    from sensorlith.operators.series import arrange
    from sensorlith.plans.filters import gps_correction

    e = events(spark, sf)
    rows = e.select(
        c("user_id").alias("run_id"),
        c("event_id"),
        ((micros(c("ts")) - EPOCH_US) / F.lit(1e6)).alias("time_sec"),
        (c("k") / 100.0).alias("left_mps"),
        ((c("k") + 7) % 100 / 100.0).alias("right_mps"),
        F.when(c("event_type") == "click", c("value") / 50.0).alias("gps_x"),
        F.when(c("event_type") == "click", c("k") / 50.0).alias("gps_y"),
    )
    corrected = gps_correction(arrange(rows, ["run_id"], ["time_sec", "event_id"]), ["event_id"])
    return out(corrected, ["corrected_x", "corrected_y", "corrected_yaw"], "run_id", "event_id")
