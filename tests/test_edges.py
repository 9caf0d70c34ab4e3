"""Edge cases of operators and helpers: missing values, ties, whole results, batches that run again."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from check import text
from tapeline.functions import chunks
from tapeline.operators import context, evaluation, patterns, quality, risk, sessions
from tapeline.session import cut, release, shared_path
from tapeline.streaming import health, ticks

BAR = "symbol string, ts date, open double, high double, low double, close double, volume double"
DAY = dt.date(2020, 1, 1)


def bars_of(spark, closes, symbol="A", volume=100.0):
    return spark.createDataFrame([(symbol, DAY + dt.timedelta(i), c, c * 1.01, c * 0.99, c, volume) for i, c in enumerate(closes)], BAR)


def test_checker_tells_null_from_empty():
    assert text(None) != text("") and text(None) == text(float("nan"))


def test_universe_samples_are_empty_text_when_in_sync(spark):
    e = spark.createDataFrame([("X", "a"), ("X", "b"), ("Y", "c")], "exchange string, symbol string")
    r = spark.createDataFrame([("X", "a", "k"), ("X", "z", None), ("Y", "c", "k")], "exchange string, symbol string, instrument_key string")
    got = {x["exchange"]: x for x in quality.universe_reconcile(e, r).collect()}
    assert (got["X"]["missing_sample"], got["X"]["extra_sample"]) == ("b", "z")
    assert (got["Y"]["missing_sample"], got["Y"]["extra_sample"], got["Y"]["action"]) == ("", "", "in_sync")


def test_all_gaps_suspects_origins_and_expiries_are_returned(spark):
    up = bars_of(spark, [100 * 1.1**i for i in range(40)])
    gaps = patterns.fair_value_gaps(up).collect()
    assert len(gaps) == 38 and sorted(g["rank"] for g in gaps) == list(range(1, 39))
    halves = bars_of(spark, [2.0 ** (10 - i) for i in range(12)])
    assert [r["rank"] for r in quality.split_suspects(halves).orderBy("ts").collect()] == list(range(1, 12))
    flat = bars_of(spark, [100.0] * 90)
    assert evaluation.walk_forward_origins(flat, 5).count() == 90 - 5 - 40
    assert evaluation.walk_forward_origins(flat, 5, step=10).count() == 6
    c = spark.createDataFrame([("U", DAY + dt.timedelta(i)) for i in range(20)] + [("U", None)], "underlying string, expiry date")
    assert len(sessions.expiry_list(c, F.lit(DAY)).first()["expiries"].split(",")) == 20


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), -1.0, None])
def test_bad_prices_are_dropped(spark, bad):
    rows = [("A", DAY + dt.timedelta(i), 10.0, 11.0, 9.0, 10.0, 1.0) for i in range(12)] + [("A", DAY + dt.timedelta(50), bad, bad, bad, bad, 1.0)]
    assert quality.bar_clean(spark.createDataFrame(rows, BAR)).count() == 12


def test_short_and_empty_input(spark):
    none = spark.createDataFrame([], BAR)
    assert quality.split_suspects(none).count() == patterns.breakout(none).count() == evaluation.walk_forward_origins(none, 5).count() == 0
    assert evaluation.walk_forward_origins(bars_of(spark, [100.0] * 30), 5).count() == 0


def test_mask_and_regime_labels(spark):
    d = spark.createDataFrame([("password=hunter2 and fine", )], "t string")
    got = quality.redact_text(d, "t").first()
    assert got["t"] == "password=[REDACTED] and fine" and got["n_assignment"] == 1
    w = context.regime_weights(spark.createDataFrame([("bull_trend_high_vol", 1.0)], "regime string, probability double"), ["volatility_model", "regime_adaptive", "per_stock_cqr"]).first()
    assert abs(w["w_volatility_model"] - 1.3 / 3.5) < 1e-9 and abs(w["w_regime_adaptive"] - 1.2 / 3.5) < 1e-9


def test_last_value_stands_where_the_regression_has_too_few_rows(spark):
    closes = [100 * 1.01 ** ((i * 7) % 5) for i in range(280)]  # 279 returns: 16 rows with all three means
    got = risk.har_rv(bars_of(spark, closes)).first()["har_rv"]
    import math
    last = math.log(closes[-1] / closes[-2]) ** 2
    assert abs(got - last * math.sqrt(252) * 100) < 1e-9


def test_stream_batches_replace_their_rows_and_late_ticks_keep_the_silence(spark):
    path = shared_path(spark, "events")
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    for k, minutes in enumerate([[0, 10], [200, 5], [210]]):  # the second file also brings a late tick
        rows = [(10 * k + i, at(m), 1, "click", 5.0, "{}") for i, m in enumerate(minutes)]
        spark.createDataFrame(rows, ticks.EVENTS).coalesce(1).write.mode("append").parquet(path)
    stale = ticks.drain(health.stale_symbols(ticks.tick_source(spark, path, 1), 3600, "1 day"), "stale")
    assert sorted(r["silent_seconds"] for r in stale.where("state = 'resumed'").collect()) in ([190 * 60.0], [195 * 60.0], [200 * 60.0])
    out = ticks.drain(ticks.latest_quote(ticks.tick_source(spark, path, 1)), "quote", "update")
    assert out.select("batch_id").distinct().count() == 3


def test_cut_tables_are_released(spark):
    d = cut(spark.range(10).withColumn("x", F.col("id") * 2))
    assert d.agg(F.sum("x")).first()[0] == 90
    release(spark)
    with pytest.raises(Exception):
        spark.read.parquet(d.inputFiles()[0]).count()


def test_lowest_level_in_one_carry(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    rows = [(int(k), i, float(rng.integers(-5, 6))) for i, k in enumerate(rng.choice([0, 0, 0, 0, 1, 2], 500))]
    d = spark.createDataFrame(rows, "k int, i int, x double")
    got = {(r["k"], r["i"]): (r["level"], r["low"], r["low_before"]) for r in chunks.lowest_level(d, ["k"], F.floor(F.col("i") / 7), ["i"], F.col("x")).collect()}
    for k in range(3):
        level, low, before = 0.0, None, None
        for kk, i, x in rows:
            if kk == k:
                level += x
                before, low = low, level if low is None else min(low, level)
                assert got[k, i] == (level, low, before)
