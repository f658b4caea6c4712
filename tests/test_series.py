"""Ordered operators give the same rows whether or not a key is cut into parts."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sensorlith.operators import series as S
from sensorlith.operators.quantiles import percentiles


@pytest.fixture(scope="module")
def skewed(spark):
    """One key has most of the rows."""
    rng = np.random.default_rng(5)
    n = 300
    key = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    pdf = pd.DataFrame({"k": key, "t": rng.permutation(n), "v": rng.integers(0, 9, n).astype(float), "e": rng.choice(["x", "y"], n)})
    pdf.loc[rng.random(n) < 0.3, "v"] = np.nan
    pdf["v"] = pdf["v"].astype(object).where(pdf["v"].notna(), None)
    return spark.createDataFrame(pdf.to_dict("records"), "k string, t long, v double, e string")


def ordered_results(df):
    s = S.arrange(df, ["k"], ["t"])
    s = S.shift(s, {"before": F.col("v")})
    s = S.shift(s, {"after": F.col("v")}, by=-1)
    s = S.running_sum(s, {"total": F.coalesce("v", F.lit(0.0))})
    s = S.number(s, "n")
    s = S.fill(s, {"last": F.col("v")})
    s = S.fill(s, {"next": F.col("v")}, ahead=True)
    s = S.fill(s, {"earlier": F.col("v")}, inclusive=False)
    s = S.rolling(s, 5, 4, {"largest": lambda w: F.max("v").over(w), "rows": lambda w: F.count(F.lit(1)).over(w)})
    s = S.islands(s, F.col("e"), "island")
    s = S.first_of(s, {"first": F.col("t")})
    return s.cut_up, s.result().orderBy("k", "t").toPandas()


def test_cut_series_give_the_same_rows(skewed, cut_series):
    cut_up, got = ordered_results(skewed)
    assert cut_up
    skewed.sparkSession.conf.unset(S.MAX_ROWS_CONF)
    whole, want = ordered_results(skewed)
    assert not whole
    pd.testing.assert_frame_equal(got, want[got.columns])


def test_parts_are_bounded(skewed, cut_series):
    s = S.arrange(skewed, ["k"], ["t"])
    largest = s.df.groupBy(S.PART).count().agg(F.max("count")).first()[0]
    assert largest <= 2 * cut_series


def test_plain_results_against_pandas(skewed):
    _, got = ordered_results(skewed)
    pdf = skewed.toPandas().sort_values(["k", "t"]).reset_index(drop=True)
    g = pdf.groupby("k")
    np.testing.assert_array_equal(got["before"], g["v"].shift(1))
    np.testing.assert_array_equal(got["last"], g["v"].ffill())
    np.testing.assert_array_equal(got["n"], g.cumcount() + 1)
    centred = g["v"].rolling(10, center=True, min_periods=1).max().reset_index(drop=True)
    np.testing.assert_array_equal(got["largest"], centred)


@pytest.mark.parametrize("cut", [False, True])
def test_percentiles_are_exact(skewed, cut):
    spark = skewed.sparkSession
    if cut:
        spark.conf.set(S.MAX_ROWS_CONF, "60")
    try:
        got = percentiles(skewed, ["k"], {"p50": ("v", 0.5), "p90": ("v", 0.9), "t25": ("t", 0.25)}).orderBy("k").toPandas().set_index("k")
    finally:
        spark.conf.unset(S.MAX_ROWS_CONF)
    pdf = skewed.toPandas()
    for k, g in pdf.groupby("k"):
        assert got.loc[k, "p50"] == pytest.approx(np.nanpercentile(g["v"].astype(float), 50))
        assert got.loc[k, "p90"] == pytest.approx(np.nanpercentile(g["v"].astype(float), 90))
        assert got.loc[k, "t25"] == pytest.approx(np.percentile(g["t"], 25))


def test_latest_prefers_known_and_newest(spark):
    df = spark.createDataFrame([("a", 1, 5, "old"), ("a", None, 9, "unknown"), ("a", 1, 6, "new"), ("b", None, 1, "only")], "k string, t int, i int, x string")
    got = {r["k"]: r["x"] for r in S.latest(df, ["k"], [F.col("t"), F.col("i")]).collect()}
    assert got == {"a": "new", "b": "only"}


@pytest.mark.parametrize("sent", [2, 50_000])
def test_percentiles_of_odd_values_and_keys(spark, monkeypatch, sent):
    """Null keys, infinities, NaN, values a last bit apart, and ranges in tables instead of the plan."""
    from sensorlith.operators import quantiles

    monkeypatch.setattr(quantiles, "SENT_ROWS", sent)
    rng = np.random.default_rng(3)
    odd = [1.0, 1.0 + 2**-52, 2.5, 1e300, -1e300, float("inf"), float("nan"), 5e-324, 0.0, -0.0]
    rows = [(None if k == 3 else int(k), None if x > 2 else float(x), float(rng.choice(odd))) for k, x in zip(rng.integers(0, 4, 600), rng.normal(size=600))]
    rows += [(9, None, 1.0), (10, 5.0, None)]
    df = spark.createDataFrame(rows, "k long, x double, y double").repartition(3)
    wanted = {"a": ("x", 0.5), "b": ("x", 0.9), "c": ("y", 0.5), "d": ("y", 0.0), "e": ("x", 1.0)}
    got = sorted(map(str, percentiles(df, ["k"], wanted).collect()))
    assert got == sorted(map(str, df.groupBy("k").agg(*[F.percentile(c, p).alias(n) for n, (c, p) in wanted.items()]).collect()))
    assert [tuple(r) for r in percentiles(df.limit(0), [], {"m": ("x", 0.5)}).collect()] == [(None,)]


def test_percentiles_of_few_rows_take_no_rounds(spark, monkeypatch):
    """Short keys need no rounds, long ones do; the answers are the same."""
    from sensorlith.operators import quantiles

    df = spark.sql("SELECT CASE WHEN id < 300 THEN 1 WHEN id < 305 THEN NULL ELSE id END AS k, pmod(id * 37, 101) / 7 AS v, IF(id = 302, NULL, id) AS w FROM range(340)")
    wanted = {"m": ("v", 0.5), "p": ("w", 0.9)}
    found, rounds = {}, []
    real = quantiles._in_rounds
    monkeypatch.setattr(quantiles, "_in_rounds", lambda base, *a: rounds.append(base.select("_k0").distinct().count()) or real(base, *a))
    for few in (0, 10, 1000):
        monkeypatch.setattr(quantiles, "FEW", few)
        found[few] = sorted(map(str, percentiles(df, ["k"], wanted).collect()))
    assert len(found[0]) == 37 and found[0] == found[10] == found[1000]
    assert rounds == [37, 1]
