"""Kernels for keys of any size against plain computations: distributions, lags, as-of joins, replays."""

import bisect
import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeline.functions import chunks
from tapeline.functions.orderstat import OrderTree
from tapeline.functions.ranks import ecdf, percentiles
from tapeline.operators import evaluation as ev
from tapeline.operators import ledger as lg
from tapeline.operators import replay as rp


def test_distribution_and_percentiles_of_uneven_groups(spark):
    rng = np.random.default_rng(1)
    pdf = pd.concat([pd.DataFrame({"g": "hot", "v": np.round(rng.normal(0, 1, 5000), 2)}), pd.DataFrame({"g": "one", "v": [3.5]}), pd.DataFrame({"g": "same", "v": [2.0] * 40}),
                     pd.DataFrame({"g": "tail", "v": np.append(np.zeros(500), rng.exponential(1, 200))})])
    df = spark.createDataFrame(pdf).unionByName(spark.createDataFrame([("one", None), ("none", None)], "g string, v double"))
    got = {r["g"]: r for r in percentiles(df, ["g"], "v", {"a": 0.5, "b": 0.8, "c": 0.95, "d": 0.0, "e": 1.0}).collect()}
    assert set(got) == {"hot", "one", "same", "tail"}
    for g, part in pdf.groupby("g"):
        want = np.percentile(part["v"], [50, 80, 95, 0, 100])
        assert np.allclose([got[g][c] for c in "abcde"], want, atol=1e-12)
    for r in ecdf(df, ["g"], "v", parts=8).where("g = 'tail'").collect():
        v = pdf[pdf["g"] == "tail"]["v"]
        assert (r["c"], r["below"], r["n"]) == ((v == r["v"]).sum(), (v < r["v"]).sum(), 700)


def test_order_tree_against_a_sorted_list():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 40, 300).astype(float)
    tree, seen = OrderTree(values), sorted(values[:100].tolist())
    tree.fill(values[:100])
    for v, place in zip(values[100:].tolist(), tree.places(values[100:]), strict=True):
        tree.insert(place)
        bisect.insort(seen, v)
        for k in (1, len(seen) // 3 + 1, len(seen)):
            assert tree.select(k) == seen[k - 1]


def test_online_conformal_resumes_where_it_stopped(spark):
    rng = np.random.default_rng(3)
    pdf = pd.concat([pd.DataFrame({"symbol": s, "ts": pd.date_range("2024-01-01", periods=n).date, "residual": rng.normal(0, 1, n)}) for s, n in (("A", 80), ("B", 9))])
    pdf["residual"] = pdf["residual"].round(1)
    df, cut = spark.createDataFrame(pdf), dt.date(2024, 1, 31)
    whole = sorted(map(tuple, ev.adaptive_conformal(df, 0.8).collect()))
    half = ev.adaptive_state(df.where(F.col("ts") < cut), 0.8)
    rest = sorted(map(tuple, ev.adaptive_conformal(df.where(F.col("ts") >= cut), 0.8, half).collect()))
    assert rest == whole and len(whole) == 2


def test_lags_across_many_chunks(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": rng.choice(["hot"] * 8 + ["b"], 400), "t": rng.integers(0, 60, 400), "i": np.arange(400), "v": rng.normal(0, 1, 400)})
    pdf.loc[rng.choice(400, 30), "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = chunks.lags(df, ["k"], F.col("t"), ["t", "i"], {"a": ("v", 1), "b": ("v", 2), "c": ("i", 5)}).toPandas().sort_values(["k", "t", "i"]).reset_index(drop=True)
    want = pdf.sort_values(["k", "t", "i"]).reset_index(drop=True)
    for name, (c, n) in {"a": ("v", 1), "b": ("v", 2), "c": ("i", 5)}.items():
        w = want.groupby("k")[c].shift(n)
        assert ((got[name] == w) | (got[name].isna() & w.isna())).all()


def test_forward_asof_against_a_search(spark):
    rng, day = np.random.default_rng(5), dt.date(2024, 1, 1)
    bar_days = sorted(set(rng.integers(0, 120, 25).tolist()))
    bars = spark.createDataFrame([("A", day + dt.timedelta(d), float(d), "unknown" if d % 7 == 0 else "main", d % 11 == 0, False) for d in bar_days],
                                 "symbol string, ts date, close double, provider string, is_stale boolean, is_demo boolean")
    targets = [(("A", "B")[i % 9 == 0], ("1D", "1W", "1m")[i % 3], i, day + dt.timedelta(int(d))) for i, d in enumerate(rng.integers(0, 130, 200))]
    pending = spark.createDataFrame(targets, "symbol string, timeframe string, id int, target_date date")
    now = day + dt.timedelta(125)
    got = {r["id"]: r for r in lg.settle_forward_asof(pending, bars, F.lit(now)).collect()}
    for symbol, frame, i, target in targets:
        if target > now:
            assert i not in got
            continue
        k = bisect.bisect_left(bar_days, (target - day).days)
        near = symbol == "A" and k < len(bar_days) and bar_days[k] - (target - day).days <= {"1D": 10, "1W": 14}.get(frame, 4)
        d = bar_days[k] if near else None
        reason = "target_data_absent" if not near else "stale_market_data" if d % 11 == 0 else "unverified_provider" if d % 7 == 0 else None
        status = "settled" if reason is None else "deferred" if reason == "target_data_absent" and target == now else "unverifiable"
        assert (got[i]["status"], got[i]["reason"], got[i]["settled_price"]) == (status, reason, float(d) if reason is None else None)


def plain_replay(symbol, pdf, fn, horizon, most):
    """One symbol, origin by origin."""
    allowed = list(range(rp.MIN_TRAIN, len(pdf) - horizon))
    at = allowed[:: max(1, math.ceil(len(allowed) / most))]
    at += [allowed[-1]] if at[-1] != allowed[-1] else []
    o, h, lo, c = (pdf[x].to_numpy() for x in ("open", "high", "low", "close"))
    cost, equity, returns, hits, errors, base = (rp.SPREAD_BPS / 2 + rp.SLIPPAGE_BPS) / 1e4, [], [], [], [], []
    for i in at:
        base.append(abs(c[i + horizon] - c[i]))
        try:
            got = fn(symbol, pdf.iloc[: i + 1])
        except ValueError:
            got = None
        if got is None or not got[2] > got[0]:
            continue
        low, mid, high = got
        errors.append(abs(c[i + horizon] - mid))
        hits.append((low <= c[i + horizon] <= high, lo[i + 1 : i + horizon + 1].min() >= low and h[i + 1 : i + horizon + 1].max() <= high))
        side = np.sign(mid - c[i])
        if side:
            net = side * (c[i + horizon] * (1 - side * cost) - o[i + 1] * (1 + side * cost))
            equity.append(net + (equity[-1] if equity else 0))
            returns.append(net / o[i + 1] * 100)
    peak, worst = None, 0.0
    for v in equity:
        peak = v if peak is None or v > peak else peak
        worst = min(worst, (v - peak) / peak * 100) if peak > 0 else worst
    return {"origins": len(at), "usable": len(errors), "abstained": len(at) - len(errors), "coverage": np.mean([a for a, _ in hits]), "path_containment": np.mean([b for _, b in hits]), "mae": np.mean(errors), "naive_mae": np.mean(base),
            "trades": len(returns), "net_pnl": equity[-1], "sharpe": np.mean(returns) / np.std(returns) * math.sqrt(len(returns)), "max_drawdown_pct": worst}


def forecaster():
    def forecast(symbol, history):  # local, so that workers get it by value
        c = history["close"]
        if len(history) % 7 == 0:
            raise ValueError("no fit")
        if len(history) % 5 == 0:
            return None if len(history) % 2 else (5.0, 4.0, 3.0)
        m = c.iloc[-3:].mean() + (c.iloc[-1] - c.iloc[-20:].mean())
        return m * 0.96, m, m * 1.04
    return forecast


@pytest.mark.parametrize("most, block", [(24, 64), (1000, 10)])
def test_replay_of_a_plugin_equals_a_plain_loop(spark, bars, most, block):
    (df, pdf), forecast = bars, forecaster()
    records = rp.replay_records(df, rp.plugin_forecasts(df, forecast, rp.origins(df, 5, most=most), block), 5)
    got = {r["symbol"]: r.asDict() for r in rp.replay_summary(records).collect()}
    reasons = {r["reason"] for r in records.collect()}
    assert reasons >= {None, "forecaster_error:ValueError", "range_missing"} or most == 24
    for symbol, part in pdf.groupby("symbol"):
        want = plain_replay(symbol, part.reset_index(drop=True), forecast, 5, most)
        assert {k: pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in want.items()} == {k: got[symbol][k] for k in want}
