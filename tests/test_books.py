"""Books of fills and legs against plain loops: average cost, FIFO matching, payoffs, evidence, redaction."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.operators import evaluation as ev
from tapeline.operators import options as op
from tapeline.operators import quality, risk

ORDER = ["ts", "orderkey"]


def fills(spark, seed, n=300, keys=("hot", "hot", "hot", "b", "c")):
    rng = np.random.default_rng(seed)
    rows = [(str(rng.choice(keys)), int(i // 7), int(i), float(rng.integers(1, 9)), float(rng.integers(1, 50)), "BUY" if rng.random() < 0.5 else "SELL") for i in range(n)]
    return rows, spark.createDataFrame(rows, "symbol string, ts int, orderkey int, shares double, price double, side string")


@pytest.mark.parametrize("limit", [1, 7, 60, 100_000])
def test_average_cost_is_one_path_for_all_sizes(spark, limit):
    rows, df = fills(spark, 1)
    want = {}
    for key, _, _, shares, price, side in rows:
        q, cost, n, ok = want.get(key, (0.0, 0.0, 0, 0))
        if side == "BUY":
            q, cost, ok = q + shares, cost + shares * price, ok + 1
        elif q + 1e-9 >= shares:
            left = q - shares
            q, cost, ok = (0.0, 0.0, ok + 1) if left <= 1e-9 else (left, cost * left / q, ok + 1)
        want[key] = (q, cost, n + 1, ok)
    got = {r["symbol"]: r for r in risk.average_cost_positions(df, ["symbol"], ORDER, F.col("ts"), limit).collect()}
    assert set(got) == set(want)
    for key, (q, cost, n, ok) in want.items():
        r = got[key]
        assert (r["fills"], r["accepted"]) == (n, ok) and abs(r["quantity"] - q) < 1e-9 and abs(r["average_price"] - (cost / q if q else 0)) < 1e-9


def test_average_cost_shuffles_its_fills_once(spark):
    plan = risk.average_cost_positions(fills(spark, 1)[1], ["symbol"], ORDER, F.col("ts"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


@pytest.mark.parametrize("parts", [1, 2, 64])
def test_fifo_against_a_queue(spark, parts):
    rows, df = fills(spark, 2, 400)
    rows.append(("big", 0, 9000, 100000.0, 3.0, "BUY"))
    rows += [("big", 1, 9001 + i, 7.0, 4.0, "SELL") for i in range(50)]
    df = spark.createDataFrame(rows, df.schema)
    lots, want = {}, {}
    for key, ts, order, shares, price, side in rows:
        queue = lots.setdefault(key, [])
        if side == "BUY":
            queue.append([shares, price, ts])
            continue
        left, matched, cost, first = shares, 0.0, 0.0, None
        while left > 1e-12 and queue:
            take = min(left, queue[0][0])
            first = queue[0][2] if first is None else first
            matched, cost, left = matched + take, cost + take * queue[0][1], left - take
            queue[0][0] -= take
            if queue[0][0] <= 1e-12:
                queue.pop(0)
        if matched:
            want[key, order] = (matched, cost, first, left)
    m = risk.fifo_matches(df, ["symbol"], ORDER, F.floor(F.col("ts") / 5), parts)
    assert parts < 64 or m.count() <= len(rows) * 2
    g = m.groupBy("symbol", "orderkey").agg(F.sum("matched").alias("q"), F.sum(F.col("matched") * F.col("buy_price")).alias("c"), F.min("buy_ts").alias("t"), F.first("unmatched").alias("u"))
    got = {(r["symbol"], r["orderkey"]): (r["q"], r["c"], r["t"], r["u"]) for r in g.collect()}
    assert set(got) == set(want)
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def plain_payoff(legs, x):
    total = 0.0
    for kind, side, strike, premium, contracts in legs:
        v = max(0, x - strike) - premium if kind == "call" else max(0, strike - x) - premium if kind == "put" else x - strike
        total += (1 if side == "buy" else -1) * v * contracts
    return total


def test_payoff_sweep_against_a_fine_grid(spark):
    rng, books = np.random.default_rng(5), {}
    for b in range(30):
        books[b] = [(str(rng.choice(["call", "put", "future"])), str(rng.choice(["buy", "sell"])), float(rng.integers(5, 20) * 10 + 0.5), float(rng.integers(1, 30)) + 0.25, int(rng.integers(1, 4))) for _ in range(rng.integers(1, 6))]
    books[99] = [("call", "buy", 100.5, 5.0, 1), ("call", "sell", 120.5, 2.0, 1)]  # bounded on both sides
    df = spark.createDataFrame([(b, *leg) for b, legs in books.items() for leg in legs], "book_id int, type string, side string, strike double, premium double, contracts int")
    got = {r["book_id"]: r for r in op.payoff_grid(df).collect()}
    for b, legs in books.items():
        r, centre = got[b], np.mean([leg[2] for leg in legs])
        grid = np.unique(np.concatenate([[0.0], np.linspace(centre * 0.5, centre * 1.5, 4001), [leg[2] for leg in legs if leg[0] != "future"], [1000.0]]))
        v = np.array([plain_payoff(legs, x) for x in grid])
        slope = v[-1] - plain_payoff(legs, 999.0)
        assert abs(r["up_slope"] - slope) < 1e-6
        assert (r["max_profit"] is None) == (slope > 1e-6) and (r["max_loss"] is None) == (slope < -1e-6)
        inside = (grid >= centre * 0.5 - 1e-9) & (grid <= centre * 1.5 + 1e-9)
        if r["max_profit"] is not None:
            assert abs(r["max_profit"] - v.max()) < 1e-6
        if r["max_loss"] is not None:
            assert abs(r["max_loss"] - v.min()) < 1e-6
        x, y = grid[inside], v[inside]
        assert r["breakevens"] == int((y[:-1] * y[1:] < 0).sum() + (y == 0).sum())
    assert (got[99]["max_profit"], got[99]["max_loss"], got[99]["breakevens"]) == (17.0, -3.0, 1)


def test_evidence_grades(spark):
    schema = "underlying string, strike string, option_type string, open_interest string, bid double, ask double, last double, volume double, quote_ts timestamp"
    import datetime as dt
    at, old = dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 9)
    good = [("100", t, "5", 1.0, 1.1, 1.05, 3.0, at) for t in ("call", "PUT ")]
    chains = {"good": good, "stale": [(*good[0][:-1], old), good[1]], "wide": [good[0], ("100", "put", "5", 1.0, 2.0, 1.5, 1.0, at)], "crossed": [good[0], ("100", "put", "5", 2.0, 1.0, None, 1.0, at)],
              "text": [*good, ("x", "call", "5", 1.0, 1.1, 1.05, 3.0, at)], "empty": [("100", t, "0", 1.0, 1.1, 1.05, 3.0, at) for t in ("call", "put")], "one": good[:1], "bare": [("100", t, "5", None, None, None, None, None) for t in ("call", "put")]}
    raw = spark.createDataFrame([(u, *r) for u, rows in chains.items() for r in rows], schema)
    got = {r["underlying"]: r for r in op.chain_evidence(raw, F.lit(at)).collect()}
    assert {u: r["evidence_quality"] for u, r in got.items()} == {"good": "moderate", "stale": "low", "wide": "limited", "crossed": "low", "text": "low", "empty": "low", "one": "moderate", "bare": "moderate"}
    assert {u for u, r in got.items() if r["oi_data_valid"]} == {"good", "stale", "wide", "crossed", "bare"}
    assert got["crossed"]["market_data_valid"] is False and got["bare"]["market_data_valid"] is None and got["stale"]["is_stale"] and got["empty"]["errors"] == "INSUFFICIENT_OI_EVIDENCE"


def test_redaction_with_and_without_the_first_look(spark):
    texts = ["nothing here", None, "", "Bearer abcdefgh1234", "BEARER  xxxxxxxxxx and token=abc", 'a "Password": "p w" b', "my_session=abcdefghij", "eyJabcdefghi.abcdefghi.abcdefghi", "GOCSPX-abcdefghijk", "API_KEY: 'zz'", "secret", '"jwt" : "x"', "Ktoken=1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    plain = df
    for name, (pattern, repl) in quality.REDACTIONS.items():
        plain = plain.withColumn(f"n_{name}", F.regexp_count("text", F.lit(pattern))).withColumn("text", F.regexp_replace("text", pattern, repl))
    assert sorted(map(tuple, quality.redact_text(df, "text").select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))


def test_consensus_falls_back_to_all_models(spark):
    scores = spark.createDataFrame([("A", "base", 1.0), ("A", "x", 2.0), ("A", "y", 4.0), ("B", "base", 3.0), ("B", "x", 2.0), ("B", "y", 4.0)], "symbol string, model string, rmse double")
    scores = scores.withColumns({c: F.lit(0) for c in ("mae", "direction", "r2")})
    got = {(r["symbol"], r["model"]): round(r["weight"], 9) for r in ev.model_ranking(scores, "base").collect()}
    assert got == {("A", "base"): 0, ("A", "x"): round(2 / 3, 9), ("A", "y"): round(1 / 3, 9), ("B", "base"): 0, ("B", "x"): 1, ("B", "y"): 0}


def test_grid_points_and_scenarios_stay_in_one_row(spark):
    legs = spark.createDataFrame([(1, "near", "call", "sell", 100.0, 4.0, 2), (1, "far", "call", "buy", 110.0, 5.0, 1), (1, "far", "call", "buy", 110.0, 6.0, 1), (2, "near", "put", "buy", 90.0, 3.0, 1)],
                                 "book_id int, leg string, type string, side string, strike double, premium double, contracts int")
    spread = op.calendar_spread_grid(legs, 30, 60, 0.3)
    margin = op.scenario_margin(legs, legs.groupBy("book_id").agg(F.avg("strike").alias("spot")), 0.3, 30)
    for d in (spread, margin):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "explode(" not in plan.replace("posexplode(", "")
    got = {r["book_id"]: r for r in spread.collect()}
    value = lambda x, k, days: op.price(F.lit(x), F.lit(k), F.lit(days), F.lit(0.3), F.lit(True))
    centre = (100 + 110 + 110) / 3
    xs = [centre * (0.8 + 0.4 * i / 40) for i in range(41)]
    far = spark.range(1).select(*[value(x, 110.0, 30).alias(f"v{i}") for i, x in enumerate(xs)]).first()
    want = [2 * v - 2 * max(0.0, x - 100) + 8 - 11 for x, v in zip(xs, far, strict=True)]
    assert abs(got[1]["max_profit"] - max(want)) < 1e-9 and abs(got[1]["max_loss"] - min(want)) < 1e-9
    assert got[1]["breakevens"] == sum(a * b < 0 for a, b in zip(want, want[1:]))
    assert abs(got[2]["max_profit"] - (18 - 3)) < 1e-9 and got[2]["max_loss"] == -3
    scan = {r["book_id"]: r for r in margin.collect()}
    base = spark.range(1).select((2 * value(centre, 110.0, 30) - 2 * value(centre, 100.0, 30) - 3).alias("v")).first()["v"]
    assert abs(scan[1]["base_value"] - base) < 1e-9 and scan[1]["short_premium"] == 8 and scan[1]["worst"] <= base
