"""Kernels against pandas or direct recomputation on small inputs."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeline.functions import chunks
from tapeline.functions.mathx import norm_cdf
from tapeline.functions.ranks import conformal_width
from tapeline.operators import evaluation as ev
from tapeline.operators import indicators as ind
from tapeline.operators import risk as rk


def by_symbol(df, sym):
    return df.where(F.col("symbol") == sym).orderBy("ts").toPandas()


def test_ema_matches_pandas(bars):
    df, pdf = bars
    got = by_symbol(ind.with_ema(df, (5, 50, 200)), "AAA")
    c = pdf[pdf.symbol == "AAA"]["close"].reset_index(drop=True)
    for n in (5, 50, 200):
        want = c.ewm(span=n, adjust=False, min_periods=n).mean()
        assert np.allclose(got[f"ema_{n}"].astype(float), want, rtol=1e-12, equal_nan=True)


def test_rsi_and_macd_match_pandas(bars):
    df, pdf = bars
    got = by_symbol(ind.with_macd(ind.with_rsi(df, (14,))), "BBB")
    c = pdf[pdf.symbol == "BBB"]["close"].reset_index(drop=True)
    d = c.diff()
    g = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    l = (-d.clip(upper=0)).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    assert np.allclose(got["rsi_14"].astype(float), 100 - 100 / (1 + g / l), equal_nan=True)
    m = c.ewm(span=12, adjust=False, min_periods=12).mean() - c.ewm(span=26, adjust=False, min_periods=26).mean()
    assert np.allclose(got["macd_signal"].astype(float), m.ewm(span=9, adjust=False, min_periods=9).mean(), equal_nan=True)


def test_rsi_special_cases(spark):
    rows = [("UP", i, float(i + 1)) for i in range(20)] + [("DOWN", i, float(40 - i)) for i in range(20)] + [("FLAT", i, 5.0) for i in range(20)]
    df = spark.createDataFrame(rows, "symbol string, ts int, close double")
    last = {r.symbol: r.rsi_14 for r in ind.with_rsi(df).where("ts = 19").collect()}
    assert last == {"UP": 100.0, "DOWN": 0.0, "FLAT": 50.0}


def test_no_lookahead(bars):
    df, _ = bars
    cut = df.where(F.col("ts") < F.lit("2020-04-01").cast("date"))
    cols = ["symbol", "ts", "rsi_14", "macd_signal", "sma_20", "ema_20"]
    full = ind.core_panel(df).where(F.col("ts") < F.lit("2020-04-01").cast("date")).select(cols)
    part = ind.core_panel(cut).select(cols)
    a, b = (x.orderBy("symbol", "ts").toPandas() for x in (full, part))
    assert np.allclose(a.iloc[:, 2:].astype(float), b.iloc[:, 2:].astype(float), rtol=1e-9, equal_nan=True)


def test_norm_cdf(spark):
    xs = [-8.5, -3.0, -0.5, 0.0, 0.1, 2.5, 7.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(norm_cdf(F.col("x")).alias("p")).collect()
    for x, r in zip(xs, got):
        assert abs(r.p - 0.5 * math.erfc(-x / math.sqrt(2))) < 1e-12


FILLS = [("A", "2020-01-01", 1, "BUY", 10.0, 100.0), ("A", "2020-01-02", 2, "BUY", 10.0, 120.0), ("A", "2020-01-03", 3, "SELL", 15.0, 130.0), ("A", "2020-01-04", 4, "SELL", 10.0, 140.0),
         ("A", "2020-01-05", 5, "BUY", 4.0, 90.0), ("A", "2020-01-06", 6, "SELL", 4.0, 95.0)]


def fills(spark):
    df = spark.createDataFrame(FILLS, "symbol string, d string, orderkey long, side string, shares double, price double")
    return df.select("symbol", F.col("d").cast("timestamp").alias("ts"), "orderkey", "side", "shares", "price")


def test_fifo_with_oversold(spark):
    got = rk.fifo_realized_gains(fills(spark), ["symbol"], ["ts", "orderkey"], F.col("ts")).orderBy("ts").collect()
    assert [(r.shares_closed, r.cost_basis, r.unmatched_shares) for r in got] == [(15.0, 1600.0, 0.0), (5.0, 600.0, 5.0), (4.0, 360.0, 0.0)]


@pytest.mark.parametrize("small", [0, 1000])
def test_average_cost_rejects_oversell(spark, small):
    r = rk.average_cost_positions(fills(spark), ["symbol"], ["ts", "orderkey"], F.col("ts"), small).collect()[0]
    # The 10-share sell exceeds the 5 left and is rejected; 5@110 + 4@90, then 4 sold.
    assert r.accepted == 5 and r.quantity == 5.0
    assert abs(r.average_price - (5 * 110 + 4 * 90) / 9) < 1e-9


def test_greedy_anchors_across_chunks(spark):
    rng = np.random.default_rng(3)
    t = np.sort(rng.integers(0, 4 * 86400, 400))
    df = spark.createDataFrame([("k", int(x)) for x in t], "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    got = sorted({int(r.anchor.timestamp()) for r in chunks.greedy_anchors(df, ["k"], "ts", 3600.0).select("anchor").collect()})
    want, a = [], None
    for x in t:
        if a is None or x - a > 3600:
            a = int(x)
            want.append(a)
    assert got == want


def test_running_and_previous(spark):
    df = spark.range(200).select((F.col("id") % 2).alias("k"), "id", (F.col("id") * 1.0).alias("v"))
    r = chunks.running(df, ["k"], F.floor(F.col("id") / 17), ["id"], {"s": ("sum", F.col("v"))})
    r = chunks.previous(r, ["k"], F.floor(F.col("id") / 13), ["id"], {"p": "v"}).toPandas().sort_values("id")
    for k, g in r.groupby("k"):
        assert np.allclose(g.s, g.v.cumsum())
        assert np.allclose(g.p.astype(float), g.v.shift(1), equal_nan=True)


def test_conformal_width_ties_and_ranks(spark):
    vals = [1.0] * 50 + [2.0] * 30 + [float(i) for i in range(20)]
    df = spark.createDataFrame([("g", v) for v in vals] + [("h", 3.0)], "g string, v double")
    got = {r.g: r.half_width for r in conformal_width(df, ["g"], "v", 0.8).collect()}
    assert got == {"g": sorted(vals)[math.ceil(101 * 0.8) - 1], "h": 3.0}


def test_adaptive_conformal(spark):
    rng = np.random.default_rng(5)
    r = rng.normal(size=80)
    df = spark.createDataFrame([("A", i, float(x)) for i, x in enumerate(r)], "symbol string, ts int, residual double")
    got = ev.adaptive_conformal(df, 0.8).collect()[0]
    gamma, width = 0.0, 0.0
    a = np.abs(r)
    for i in range(len(a)):
        lv = min(0.99, max(0.5, 0.8 - gamma))
        s = np.sort(a[: i + 1])
        rank = math.ceil((i + 2) * lv)
        width = a[0] if i == 0 else s[-1] if rank >= i + 1 else s[rank - 1]
        gamma += ev.ONLINE_STEP * (float(a[i] <= width) - 0.8)
    assert abs(got.half_width - width) < 1e-12 and abs(got.gamma - gamma) < 1e-12
