"""Signal queries: each embedding is a block of samples, each label a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensorlith.functions.numbers import settled
from sensorlith.operators.series import arrange, number
from sensorlith.plans import signals as S
from sensorlith.queries.imu import D, out, sql_out
from sensorlith.queries.speeds import settle
from sensorlith.queries.trip_tables import table
from sensorlith.registry import query
from sensorlith.session import cut, work_path
from sensorlith.sources.waveforms import read_files, write_files

c = F.col
CFG = S.Detector(rate_hz=64.0, block=64, envelope_ms=125.0, cutoff_hz=8.0, threshold_sigmas=5.0)


def blocks(spark, sf):
    e = table(spark, sf, "embeddings").select(c("label").alias("source"), "vec_id", c("embedding").alias("samples"))
    s = number(arrange(e, ["source"], ["vec_id"], probe=e.select("source")), "_n")
    return s.result().select("source", (c("_n") - 1).alias("block_idx"), "samples")


def features(spark, sf):
    energy = arrange(S.squared(blocks(spark, sf)), ["source"], ["block_idx"])
    return S.block_features(S.envelope(energy, CFG.envelope_samples).result(), CFG)


SIGNAL = f"""
blk AS MATERIALIZED (SELECT label AS source, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS block_idx, embedding FROM embeddings),
sp AS MATERIALIZED (SELECT source, block_idx, i - 1 AS p, block_idx * 64 + i - 1 AS n, CAST(embedding[i] AS DOUBLE) AS x FROM blk, LATERAL (SELECT unnest(range(1, 65)) AS i)),
env AS MATERIALIZED (SELECT source, block_idx, p, n, x, sum(x * x) OVER (PARTITION BY source ORDER BY n ROWS 7 PRECEDING) / 8 AS e FROM sp),
md AS (SELECT source, block_idx, median(e) AS med FROM env GROUP BY ALL),
sl AS (SELECT source, block_idx, e - lag(e) OVER (PARTITION BY source, block_idx ORDER BY p) AS d FROM env),
smd AS (SELECT source, block_idx, median(d) AS sm, max(d) AS sp FROM sl WHERE d IS NOT NULL GROUP BY ALL),
ssd AS (SELECT source, block_idx, greatest({D(1.4826)} * median(abs(d - sm)), 1e-12) AS ss FROM sl JOIN smd USING (source, block_idx) WHERE d IS NOT NULL GROUP BY ALL),
feat AS MATERIALIZED (
  SELECT source, block_idx, max(e) AS peak, min(p) FILTER (WHERE e = mx) AS peak_idx, quantile_cont(e, 0.95) AS score, any_value(med) AS median,
    greatest({D(1.4826)} * median(abs(e - med)), 1e-12) AS sigma, any_value(sp) AS slope_peak, any_value(sm + 4 * ss) AS slope_limit
  FROM (SELECT *, max(e) OVER (PARTITION BY source, block_idx) AS mx FROM env) JOIN md USING (source, block_idx) JOIN smd USING (source, block_idx) JOIN ssd USING (source, block_idx)
  GROUP BY source, block_idx
)"""
FEAT = ["peak", "score", "median", "sigma", "slope_peak", "slope_limit"]


@query("signal_block_features", f"WITH {SIGNAL} SELECT source, block_idx, {sql_out({n: n for n in FEAT}, 7)} FROM feat")
def signal_block_features(spark, sf):
    return out(features(spark, sf), FEAT, "source", "block_idx", digits=7)


@query("signal_slope_gate", f"WITH {SIGNAL} SELECT source, block_idx, slope_peak > slope_limit AS is_open FROM feat")
def signal_slope_gate(spark, sf):
    return features(spark, sf).select("source", "block_idx", S.slope_gate().alias("is_open"))


DETECT = "RECURSIVE " + SIGNAL + f""",
st AS (
  SELECT source, block_idx, m AS mu, s AS sg, m + 5 * s AS hi, m + 3 * s AS lo, m AS rmu, s AS rsg, false AS was_armed, 64 >= 192 AS armed, false AS ins, CAST(-1e18 AS DOUBLE) AS last, CAST(NULL AS BIGINT) AS trig, score, peak
  FROM (SELECT *, {D(0.05)} * median AS m, greatest({D(0.95)} * 1e-12 + {D(0.05)} * sigma, 1e-12) AS s FROM feat WHERE block_idx = 0)
  UNION ALL
  SELECT source, block_idx, CASE WHEN NOT armed0 THEN lmu WHEN ins0 OR fire THEN mu0 ELSE lmu END, CASE WHEN NOT armed0 THEN lsg WHEN ins0 OR fire THEN sg0 ELSE lsg END,
    hi, lo, CASE WHEN armed0 THEN mu0 ELSE lmu END, CASE WHEN armed0 THEN sg0 ELSE lsg END, armed0, armed0 OR (block_idx + 1) * 64 >= 192,
    CASE WHEN armed0 AND ins0 THEN score >= lo ELSE fire END, CASE WHEN fire THEN CAST(block_idx * 64 + peak_idx AS DOUBLE) ELSE last0 END,
    CASE WHEN fire THEN block_idx * 64 + peak_idx END, score, peak
  FROM (SELECT *, armed0 AND NOT ins0 AND score > hi AND (block_idx + 1) * 64 - last0 > 48 AS fire FROM (
    SELECT *, CASE WHEN armed0 THEN mu0 + 5 * sg0 ELSE lmu + 5 * lsg END AS hi, CASE WHEN armed0 THEN mu0 + 3 * sg0 ELSE lmu + 3 * lsg END AS lo FROM (
      SELECT f.*, st.mu AS mu0, st.sg AS sg0, st.armed AS armed0, st.ins AS ins0, st.last AS last0,
        {D(0.95)} * st.mu + {D(0.05)} * f.median AS lmu, greatest({D(0.95)} * st.sg + {D(0.05)} * f.sigma, 1e-12) AS lsg
      FROM st JOIN feat f ON f.source = st.source AND f.block_idx = st.block_idx + 1)))
),
ev AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY trig) AS event_id, greatest(trig - 32, 0) AS cs, least(trig + 96, total) AS ce
  FROM st JOIN (SELECT source, count(*) * 64 AS total FROM blk GROUP BY source) USING (source) WHERE trig IS NOT NULL)"""


@query(
    "signal_threshold_trace",
    f"""WITH {DETECT} SELECT source, block_idx, {sql_out({'threshold_high': 'hi', 'threshold_low': 'lo', 'noise_mu': 'rmu', 'noise_sigma': 'rsg'}, 7)},
        was_armed AS armed, ins AS in_event, CAST(coalesce(trig, -1) AS BIGINT) AS trigger_sample FROM st""",
)
def signal_threshold_trace(spark, sf):
    trace = S.detect(features(spark, sf), CFG)
    return out(
        trace, ["threshold_high", "threshold_low", "noise_mu", "noise_sigma"], "source", "block_idx", "armed", "in_event",
        F.coalesce("trigger_sample", F.lit(-1)).alias("trigger_sample"), digits=7,
    )


def records(spark, sf):
    lengths = blocks(spark, sf).groupBy("source").agg(F.sum(F.size("samples")).alias("n_samples"))
    return S.event_records(S.detect(features(spark, sf), CFG), lengths, CFG)


@query(
    "signal_event_records",
    f"""WITH {DETECT} SELECT source, event_id, trig AS trigger_sample, {sql_out({'score': 'score', 'peak': 'peak', 'threshold_high': 'hi', 'threshold_low': 'lo', 'noise_mu': 'rmu', 'noise_sigma': 'rsg'}, 7)},
        trig / 64.0 AS trigger_time_sec, cs AS clip_start_sample, ce AS clip_end_sample, cs / 64.0 AS clip_start_time_sec, ce / 64.0 AS clip_end_time_sec FROM ev""",
)
def signal_event_records(spark, sf):
    plain = ["source", "event_id", "trigger_sample", "trigger_time_sec", "clip_start_sample", "clip_end_sample", "clip_start_time_sec", "clip_end_time_sec"]
    return out(records(spark, sf), ["score", "peak", "threshold_high", "threshold_low", "noise_mu", "noise_sigma"], *plain, digits=7)


@query(
    "signal_event_clips",
    f"""WITH {DETECT}, cl AS (SELECT ev.source, event_id, count(*) AS n, avg(x) AS m FROM ev JOIN sp ON sp.source = ev.source AND n >= cs AND n < ce GROUP BY ALL)
        SELECT source, event_id, cl.n AS n_samples, {settle('m', 4)} AS removed_mean FROM cl""",
)
def signal_event_clips(spark, sf):
    """Length of each cut clip, and the mean that was removed, read back from the integers."""
    ev, b = cut(records(spark, sf)), blocks(spark, sf)
    pcm = S.clips(ev, b, CFG)
    # The mean that went missing is the raw mean of the same samples.
    rows = S.sample_rows(b, "samples", CFG.block)
    spans = ev.select("source", "event_id", "clip_start_sample", "clip_end_sample", F.explode(F.sequence(c("clip_start_sample"), c("clip_end_sample") - 1)).alias("sample"))
    means = spans.join(rows, ["source", "sample"]).groupBy("source", "event_id").agg(F.avg(c("x").cast("double")).alias("m"))
    return pcm.join(means, ["source", "event_id"]).select("source", "event_id", F.size("pcm").cast("long").alias("n_samples"), settled(c("m"), 4).alias("removed_mean"))


@query(
    "signal_clip_files",
    f"""WITH {DETECT}, cl AS (SELECT ev.source, event_id, n, x, n - min(n) OVER w AS i, avg(x) OVER w AS m FROM ev JOIN sp ON sp.source = ev.source AND n >= cs AND n < ce WINDOW w AS (PARTITION BY ev.source, event_id)),
        q AS (SELECT *, CAST(trunc(greatest(-1.0, least(1.0, x - m)) * 32767.0) AS BIGINT) AS s FROM cl)
        SELECT source, event_id, count(*) AS n_samples, CAST(sum(s) AS BIGINT) AS sample_sum, CAST(sum(s * (i % 97)) AS BIGINT) AS weighted_sum, CAST(min(s) AS BIGINT) AS lowest, CAST(max(s) AS BIGINT) AS highest FROM q GROUP BY ALL""",
)
def signal_clip_files(spark, sf):
    """Clips as 16-bit files, written by tasks and read back: every sample counts."""
    pcm = S.clips(cut(records(spark, sf)), blocks(spark, sf), CFG)
    name = F.concat(c("source").cast("string"), F.lit("-"), c("event_id").cast("string"))
    path = work_path(spark, "clips")
    write_files(pcm.select(name.alias("name"), F.lit(int(CFG.rate_hz)).alias("rate_hz"), F.lit(1).alias("channels"), F.lit(2).alias("width"), c("pcm").cast("array<bigint>").alias("pcm")), path)
    back = read_files(spark, path, block=CFG.block).select(F.regexp_extract("source", r"([^/]+)-(\d+)\.wav$", 1).cast(dict(pcm.dtypes)["source"]).alias("source"), F.regexp_extract("source", r"-(\d+)\.wav$", 1).cast("long").alias("event_id"), "block_idx", F.posexplode("samples").alias("at", "x"))
    s, i = F.rint(c("x") * 32768.0).cast("long"), c("block_idx") * CFG.block + c("at")
    return back.groupBy("source", "event_id").agg(F.count(F.lit(1)).alias("n_samples"), F.sum(s).alias("sample_sum"), F.sum(s * (i % 97)).alias("weighted_sum"), F.min(s).alias("lowest"), F.max(s).alias("highest"))


@query("signal_trailing_mean", f"WITH {SIGNAL} SELECT source, n AS sample, {settle('e', 7)} AS envelope FROM env")
def signal_trailing_mean(spark, sf):
    rows = S.sample_rows(blocks(spark, sf), "samples", CFG.block).withColumn("e", c("x").cast("double") * c("x").cast("double"))
    return out(S.trailing_mean(arrange(rows, ["source"], ["sample"]), "e", 8, "envelope").result(), ["envelope"], "source", "sample", digits=7)


@query(
    "signal_centred_mean",
    f"WITH {SIGNAL} SELECT source, n AS sample, {settle('(sum(x * x) OVER (PARTITION BY source ORDER BY n ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10)', 7)} AS envelope FROM sp",
)
def signal_centred_mean(spark, sf):
    rows = S.sample_rows(blocks(spark, sf), "samples", CFG.block).withColumn("e", c("x").cast("double") * c("x").cast("double"))
    return out(S.centred_mean(arrange(rows, ["source"], ["sample"]), "e", 10, "envelope").result(), ["envelope"], "source", "sample", digits=7)


WHOLE = {"threshold": "th", "score": "mx", "start_time_sec": "(a / 64.0)", "end_time_sec": "(b / 64.0)", "duration_sec": "((b - a) / 64.0)", "confidence": "least(1.0, mx / (th + 1e-12) / 3.0)"}


@query(
    "signal_whole_event",
    f"""WITH {SIGNAL}, w AS (SELECT source, n, sum(x * x) OVER (PARTITION BY source ORDER BY n ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10 AS e FROM sp),
        m AS (SELECT source, median(e) AS md FROM w GROUP BY source), t AS (SELECT source, any_value(md) + 3 * {D(1.4826)} * median(abs(e - md)) AS th FROM w JOIN m USING (source) GROUP BY source),
        o AS (SELECT source, any_value(th) AS th, min(n) AS a, max(n) AS b, max(e) AS mx FROM w JOIN t USING (source) WHERE e > th GROUP BY source)
        SELECT source, a AS start_sample, b AS end_sample, {sql_out(WHOLE)} FROM o""",
)
def signal_whole_event(spark, sf):
    rows = S.sample_rows(blocks(spark, sf), "samples", CFG.block).withColumn("x", c("x").cast("double"))
    return out(S.whole_signal_event(rows, 10, CFG.rate_hz, 3.0), WHOLE, "source", "start_sample", "end_sample")


@query("signal_highpass_energy")
def signal_highpass_energy(spark, sf):
    """High-passed energy per block; checked against a sample-by-sample filter in the tests."""
    b, a = S.highpass_coefficients(CFG.order, CFG.cutoff_hz, CFG.rate_hz)
    energy = S.highpass_energy(arrange(blocks(spark, sf), ["source"], ["block_idx"]), b, a)
    total = F.aggregate("energy", F.lit(0.0), lambda acc, x: acc + x)
    return energy.select("source", "block_idx", F.size("energy").alias("n_samples"), settled(total, 7).alias("energy_sum"))


@query("signal_detector_pipeline")
def signal_detector_pipeline(spark, sf):
    """High-pass, envelope, features, thresholds and event records in one job."""
    src = blocks(spark, sf)
    b, a = S.highpass_coefficients(CFG.order, CFG.cutoff_hz, CFG.rate_hz)
    energy = S.highpass_energy(arrange(src, ["source"], ["block_idx"]), b, a)
    env = S.envelope(arrange(energy, ["source"], ["block_idx"], probe=src.select("source")), CFG.envelope_samples).result()
    lengths = src.groupBy("source").agg(F.sum(F.size("samples")).alias("n_samples"))
    return S.event_records(S.detect(cut(S.block_features(env, CFG)), CFG), lengths, CFG)
