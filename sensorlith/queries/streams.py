"""Streaming queries: events arrive as files in two halves; results are compared with the batch answer in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlith.functions.numbers import settled
from sensorlith.functions.times import from_micros, micros
from sensorlith.plans import stations as ST
from sensorlith.queries.city_tables import EVENTS, MAX_GAP_MIN, STATUS, station_status
from sensorlith.queries.imu import sql_out
from sensorlith.queries.missions import LOG, run_log
from sensorlith.queries.rovers import SCANS, TIMEOUT_S, commands, distances
from sensorlith.queries.signals import CFG, DETECT, blocks
from sensorlith.queries.speeds import settle
from sensorlith.registry import query
from sensorlith.session import work_path, written
from sensorlith.streaming import stateful as SF
from sensorlith.streaming.runs import closing_row, drain_with_budget, folder_stream, replay, started

c = F.col
DAY = 86_400
#: a time after all others, for rows that close a stream
LAST = "2200-01-01 00:00:00"
#: rows of a piece of a stream's input, and of rows of a few numbers, where the start of a stream costs more than a million of them
PIECE_ROWS, NARROW_ROWS = 1_000_000, 2_000_000
#: partitions of a state whose batches have no more than ``NARROW_ROWS``
NARROW_PARTITIONS = 32


def halves(df, time, most=None):
    """Everything up to the middle of the time range, then everything after it; of many rows as many pieces as hold ``most`` (``PIECE_ROWS``)
    each, by time, so that no batch of the stream grows with the input. Rows are computed once."""
    rows = written(df.filter(c(time).isNotNull()), "rows-by-time")
    n, first, last = rows.agg(F.count(F.lit(1)), F.min(time), F.max(time)).first()
    count = -(-n // (most or PIECE_ROWS))
    if count <= 1:
        middle = F.lit(None if first is None else (first + last) / 2).cast("double")
        return [rows.filter(c(time) <= middle), rows.filter(c(time) > middle)]
    ends = sorted(set(rows.approxQuantile(time, [i / count for i in range(1, count)], 0.1 / count)))
    piece = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < c(time)))
    path = work_path(df.sparkSession, "pieces")
    rows.withColumn("_piece", piece).write.partitionBy("_piece").parquet(path)
    back = df.sparkSession.read.parquet(path)
    return [back.filter(c("_piece") == i).drop("_piece") for i in range(len(ends) + 1)]


@query("stream_station_intervals", f"WITH {STATUS} SELECT station_id, interval_start_utc, interval_end_utc, duration_sec, status_class FROM intervals")
def stream_station_intervals(spark, sf):
    status = ST.classified(station_status(spark, sf)).select("station_id", micros(c("source_last_updated_utc")).alias("micros"), "status_class")
    out = replay(halves(status, "micros", NARROW_ROWS), lambda s: SF.intervals(s, MAX_GAP_MIN * 60), "intervals", partitions=NARROW_PARTITIONS)
    return out.select(
        "station_id", from_micros(c("start_micros")).alias("interval_start_utc"), from_micros(c("end_micros")).alias("interval_end_utc"), "duration_sec", "status_class"
    )


@query("stream_slip_alerts", f"WITH {LOG} SELECT run_id, t AS event_time_s, seq AS sequence FROM alert")
def stream_slip_alerts(spark, sf):
    log = run_log(spark, sf).filter(c("event_type") == "robot.telemetry")
    rows = log.select("run_id", "event_time_s", "sequence", c("payload.localization.gps_innovation_m").alias("innovation"))
    return replay(halves(rows, "event_time_s", NARROW_ROWS), SF.slip_alerts, "slip", partitions=NARROW_PARTITIONS)


@query(
    "stream_guarded_commands",
    f"""WITH {EVENTS}, {SCANS}, g AS (SELECT *, sts IS NULL OR ts - sts > {TIMEOUT_S} AS stale, coalesce(blocked, true) AS fb FROM seen),
        nx AS (SELECT robot_id, ts, blocked, lag(blocked, 1, true) OVER w AS was, lead(ts) OVER w AS n FROM blk WINDOW w AS (PARTITION BY robot_id ORDER BY ts)),
        st AS (SELECT robot_id, ts FROM nx WHERE blocked AND NOT was UNION ALL SELECT robot_id, ts + {TIMEOUT_S} FROM nx WHERE n IS NULL OR n - ts > {TIMEOUT_S}),
        o AS (SELECT robot_id, 'command' AS kind, ts, CASE WHEN (stale OR fb) AND linear_x > 0 THEN 0 ELSE linear_x END AS x, angular_z AS z FROM g
              UNION ALL SELECT CAST(robot_id AS INTEGER), 'stop', ts, 0, 0 FROM st)
        SELECT robot_id, kind, {settle('ts', 6)} AS ts, {settle('x', 6)} AS linear_x, {settle('z', 6)} AS angular_z FROM o""",
)
def stream_guarded_commands(spark, sf):
    scans = distances(spark, sf).select(c("robot_id").cast("int").alias("robot_id"), "ts", F.lit("scan").alias("kind"), "front", F.lit(0.0).alias("linear_x"), F.lit(0.0).alias("angular_z"))
    orders = commands(spark, sf).select("robot_id", "ts", F.lit("command").alias("kind"), F.lit(None).cast("double").alias("front"), "linear_x", "angular_z")
    # the clock of the robots starts at 0, where Spark takes rows as late: a day later it is
    messages = scans.unionByName(orders).withColumn("ts", c("ts") + DAY).withColumn("at", F.timestamp_seconds("ts"))
    end = closing_row(messages, ts=F.lit(7e9), kind=F.lit("command"), linear_x=F.lit(0.0), angular_z=F.lit(0.0), at=F.timestamp_seconds(F.lit(7e9)))
    out = replay(halves(messages, "ts", NARROW_ROWS), lambda s: SF.guard(s, "at", "1 hour", 0.2, 0.3, TIMEOUT_S), "guard", closing=end, partitions=NARROW_PARTITIONS)
    out = out.filter("robot_id IS NOT NULL").withColumn("ts", c("ts") - DAY)
    return out.select("robot_id", "kind", *[settled(c(n), 6).alias(n) for n in ("ts", "linear_x", "angular_z")])


@query(
    "stream_signal_events",
    f"""WITH {DETECT}
        SELECT source, trig AS trigger_sample, {sql_out({'score': 'score', 'peak': 'peak', 'threshold_high': 'hi'}, 7)}, greatest(trig - 32, 0) AS clip_start_sample,
        ce AS clip_end_sample, 0 AS lost_samples FROM ev""",
)
def stream_signal_events(spark, sf):
    return live_events(spark, sf).select(
        "source", "trigger_sample", *[settled(c(n), 7).alias(n) for n in ("score", "peak", "threshold_high")], "clip_start_sample", "clip_end_sample", "lost_samples"
    )


def live_events(spark, sf):
    """Blocks that come in two files and an end mark for each source."""
    rows = blocks(spark, sf)
    ends = rows.groupBy("source").agg((F.max("block_idx") + 1).cast(rows.schema["block_idx"].dataType).alias("block_idx"))
    ends = ends.select("source", "block_idx", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name not in ("source", "block_idx")])
    return replay(halves(rows, "block_idx"), lambda s: SF.detector(s, CFG), "signal", closing=ends)


@query(
    "stream_clip_samples",
    f"""WITH {DETECT}, cl AS (SELECT ev.source, trig, n, x, n - min(n) OVER w AS i, avg(x) OVER w AS m FROM ev JOIN sp ON sp.source = ev.source AND n >= cs AND n < ce WINDOW w AS (PARTITION BY ev.source, event_id)),
        q AS (SELECT *, CAST(trunc(greatest(-1.0, least(1.0, x - m)) * 32767.0) AS BIGINT) AS s FROM cl)
        SELECT source, trig AS trigger_sample, count(*) AS n_samples, CAST(sum(s) AS BIGINT) AS sample_sum, CAST(sum(s * (i % 97)) AS BIGINT) AS weighted_sum FROM q GROUP BY ALL""",
)
def stream_clip_samples(spark, sf):
    """The samples of live events, as many and the same as those of the stored signal."""
    one = live_events(spark, sf).select("source", "trigger_sample", F.posexplode("pcm").alias("i", "s"))
    s = c("s").cast("long")
    return one.groupBy("source", "trigger_sample").agg(F.count(F.lit(1)).alias("n_samples"), F.sum(s).alias("sample_sum"), F.sum(s * (c("i") % 97)).alias("weighted_sum"))


@query("stream_once_per_version", f"WITH {STATUS} SELECT station_id, count(DISTINCT date_trunc('hour', source_last_updated_utc)) AS versions FROM status GROUP BY station_id")
def stream_once_per_version(spark, sf):
    """Rows of one station within one hour count as one source version."""
    status = station_status(spark, sf)
    rows = status.select(
        "station_id", F.date_trunc("hour", "source_last_updated_utc").alias("source_last_updated_utc"), c("source_last_updated_utc").cast("timestamp").alias("observed_at_utc")
    )
    out = replay(halves(rows.withColumn("u", micros(c("observed_at_utc"))), "u"), lambda s: SF.once_per_version(s, "2 hours"), "versions")
    return out.groupBy("station_id").agg(F.count(F.lit(1)).alias("versions"))


@query(
    "stream_sliding_report",
    f"""WITH {STATUS}, w AS (SELECT status_class, duration_sec, interval_end_utc, unnest(range(4)) AS i FROM intervals),
        b AS (SELECT *, time_bucket(INTERVAL 6 HOUR, interval_end_utc) - to_hours(6 * i) AS s FROM w)
        SELECT s AS start, s + INTERVAL 24 HOUR AS end, status_class, CAST(sum(duration_sec) AS BIGINT) AS seconds, count(*) AS interval_count FROM b GROUP BY ALL""",
)
def stream_sliding_report(spark, sf):
    done = ST.status_intervals(ST.classified(station_status(spark, sf)), MAX_GAP_MIN, ("snapshot_id",))
    rows = done.select("status_class", c("duration_sec").cast("long").alias("duration_sec"), c("interval_end_utc").cast("timestamp").alias("interval_end_utc"))
    end = closing_row(rows, interval_end_utc=F.lit(LAST).cast("timestamp"))
    out = replay([rows], lambda s: SF.sliding_report(s, "24 hours", "6 hours", "1 hour"), "sliding", closing=end)
    return out.select(c("start").cast("timestamp_ntz").alias("start"), c("end").cast("timestamp_ntz").alias("end"), "status_class", "seconds", "interval_count")


@query(
    "stream_collection_spans",
    f"""WITH {STATUS}, g AS (SELECT station_id, source_last_updated_utc AS t,
          coalesce(source_last_updated_utc - lag(source_last_updated_utc) OVER w > INTERVAL 24 HOUR, true) AS opens FROM status WINDOW w AS (PARTITION BY station_id ORDER BY source_last_updated_utc)),
        n AS (SELECT station_id, t, sum(opens::INT) OVER (PARTITION BY station_id ORDER BY t, opens DESC ROWS UNBOUNDED PRECEDING) AS i FROM g)
        SELECT station_id, min(t) AS start, max(t) + INTERVAL 24 HOUR AS end, count(*) AS snapshots FROM n GROUP BY station_id, i""",
)
def stream_collection_spans(spark, sf):
    """Stretches without a gap of a day; a last row of a far time closes all of them."""
    rows = station_status(spark, sf).select("station_id", c("source_last_updated_utc").cast("timestamp").alias("source_last_updated_utc"))
    end = closing_row(rows, source_last_updated_utc=F.lit(LAST).cast("timestamp"))
    out = replay([rows], lambda s: SF.collection_spans(s, "24 hours", "1 hour"), "spans", closing=end)
    return out.select("station_id", c("start").cast("timestamp_ntz").alias("start"), c("end").cast("timestamp_ntz").alias("end"), "snapshots")


@query(
    "stream_replay_order",
    f"""WITH {LOG}, o AS (SELECT run_id, seq, t, row_number() OVER (PARTITION BY run_id, seq ORDER BY t) > 1 AS again, max(seq) OVER (PARTITION BY run_id ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM lg)
        SELECT run_id, t AS event_time_s, seq AS sequence, again AS is_duplicate, CASE WHEN again OR h IS NULL THEN 0 ELSE greatest(seq - h - 1, 0) END AS missing_before FROM o""",
)
def stream_replay_order(spark, sf):
    """Events released in order once the watermark has passed them; a last row of a far time lets all of them out."""
    log = run_log(spark, sf).select("run_id", "sequence", "event_time_s", F.timestamp_seconds("event_time_s").alias("at"))
    end = closing_row(log, sequence=F.lit(0), event_time_s=F.lit(7e9), at=F.timestamp_seconds(F.lit(7e9)))
    return replay(halves(log, "event_time_s", NARROW_ROWS), lambda s: SF.in_order(s, "at", "1 hour"), "order", closing=end, partitions=NARROW_PARTITIONS)


@query(
    "stream_block_budget",
    """SELECT CAST(event_id % 6 // 2 AS BIGINT) AS batch_id, count(*) AS input_rows, true AS is_timed FROM events GROUP BY 1""",
)
def stream_block_budget(spark, sf):
    """Blocks that arrive in six files and are taken two files at a time: a full source waits, no batch grows with it."""
    root = work_path(spark, "budget")
    blocks = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    for number in range(6):  # files are taken in the order of their times
        blocks.where(c("event_id") % 6 == number).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = folder_stream(spark, f"{root}/in", blocks.schema, files_per_trigger=2)
    rows = drain_with_budget(spark, lambda: started(stream, f"{root}/out", f"{root}/checkpoint"))
    return rows.select("batch_id", "input_rows", (c("batch_ms") > 0).alias("is_timed"))
