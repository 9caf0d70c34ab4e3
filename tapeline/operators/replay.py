"""Walk-forward replay of range forecasts: forecasts from columns or from a user's callable, scored against what followed."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.span import BARS as S
from ..functions.span import UP, ratio

C = F.col
# Sessions before the first origin, and costs in basis points.
MIN_TRAIN, SPREAD_BPS, SLIPPAGE_BPS = 40, 5.0, 2.0
FIELDS = ("open", "high", "low", "close", "volume")
FORECASTS = "symbol string, i long, low double, median double, high double, reason string"


def origins(bars: DataFrame, horizon: int, step: int = 1, min_train: int = MIN_TRAIN, most: int | None = None) -> DataFrame:
    """(symbol, ts, close, i, n): every `step`-th bar that has `min_train` bars before it and `horizon` after, the last one always.

    With `most`, the step of a symbol is the smallest that leaves about so many.
    """
    d = bars.select("symbol", "ts", "close", (S.rn() - 1).alias("i"), S.size().alias("n")).where((C("i") >= min_train) & (C("i") < C("n") - horizon))
    every = F.lit(step) if most is None else F.greatest(F.lit(1), F.ceil((C("n") - horizon - min_train) / most))
    return d.where(((C("i") - min_train) % every == 0) | (C("i") == C("n") - horizon - 1))


def plugin_forecasts(bars: DataFrame, fn: Callable[[str, pd.DataFrame], tuple | None], at: DataFrame, block: int = 64) -> DataFrame:
    """(symbol, ts, low, median, high, reason) of fn(symbol, history) at each origin; history is all bars up to the origin.

    A symbol's origins are taken in blocks. A block gets the bars up to its last origin once and each call a slice of
    them, so the history is copied per block and not per origin. None, a missing or non-finite value or high <= low is an
    abstention; an exception is one too, named by its type. A symbol's bars are bounded by the calendar.
    """
    part = F.floor((S.rn() - 1) / block).cast("int")
    numbered = at.select("symbol", "ts", "i", part.alias("block"))
    blocks = numbered.groupBy("symbol", "block").agg(F.array_sort(F.collect_list("i")).alias("at"))  # at most `block` numbers
    rows = bars.select("symbol", "ts", *FIELDS, (S.rn() - 1).alias("i"))
    rows = rows.join(blocks, "symbol").where(C("i") <= F.element_at("at", -1))

    def call(key, pdf):
        symbol, wanted = key[0], pdf["at"].iloc[0]
        history = pdf.sort_values("i")[["ts", *FIELDS]].reset_index(drop=True)
        out = []
        for i in wanted:
            low = median = high = reason = None
            try:
                got = fn(symbol, history.iloc[: i + 1])
                if got is None or any(x is None for x in got):
                    reason = "range_missing"
                else:
                    low, median, high = map(float, got)
                    if not all(map(math.isfinite, (low, median, high))) or high <= low:
                        reason = "range_invalid"
            except Exception as e:  # the user's code: its failure is a result of the replay
                reason = f"forecaster_error:{type(e).__name__}"
            out.append((symbol, int(i), *((low, median, high) if reason is None else (None,) * 3), reason))
        return pd.DataFrame(out, columns=[c.split()[0] for c in FORECASTS.split(", ")])

    made = rows.groupBy("symbol", "block").applyInPandas(call, FORECASTS)
    return at.select("symbol", "ts", "i").join(made, ["symbol", "i"]).drop("i")


def fill_price(price: Column, buys: Column, cost: float) -> Column:
    """Buy above and sell below the reference by the cost."""
    return price * F.when(buys, 1 + cost).otherwise(1 - cost)


def replay_records(bars: DataFrame, forecasts: DataFrame, horizon: int, spread_bps: float = SPREAD_BPS, slippage_bps: float = SLIPPAGE_BPS, charges_bps: float = 0.0) -> DataFrame:
    """One row per forecast (symbol, ts, low, median, high, optionally reason) with its score and its trade.

    The trade of one share opens at the next bar's open in the direction of the median and closes at the horizon's close.
    An abstained origin has its naive error, no score and no trade.
    """
    cost = (spread_bps / 2 + slippage_bps + charges_bps) / 10_000
    ahead = S.rows(1, horizon)
    prior = F.coalesce(S.lag("close", horizon), F.first("close").over(S.w.rowsBetween(UP, 0)))
    b = bars.select("symbol", "ts", "close", S.lead("close", horizon).alias("target_close"), F.max("high").over(ahead).alias("max_high"), F.min("low").over(ahead).alias("min_low"), S.lead("open").alias("entry_open"), prior.alias("prior_close"))
    f = forecasts if "reason" in forecasts.columns else forecasts.withColumn("reason", F.lit(None).cast("string"))
    d = f.select("symbol", "ts", "low", "median", "high", "reason").join(b, ["symbol", "ts"])
    bad = F.coalesce(F.isnan("low") | F.isnan("median") | F.isnan("high") | (C("high") <= C("low")), F.lit(False))
    missing = C("low").isNull() | C("median").isNull() | C("high").isNull()
    d = d.withColumn("reason", F.when(C("reason").isNotNull(), C("reason")).when(missing, "range_missing").when(bad, "range_invalid"))
    ok = C("reason").isNull()
    side = F.when(ok, F.signum(C("median") - C("close")).cast("int"))
    moved = F.signum(C("target_close") - C("close")).cast("int")
    drift = F.signum(C("close") - C("prior_close")).cast("int")
    d = d.withColumns({"usable": ok, "direction": side, "naive_error": F.abs(C("target_close") - C("close")), "model_error": F.when(ok, F.abs(C("target_close") - C("median"))),
                       "coverage_hit": F.when(ok, C("target_close").between(C("low"), C("high"))), "containment_hit": F.when(ok, (C("min_low") >= C("low")) & (C("max_high") <= C("high"))),
                       "direction_hit": F.when(side != 0, moved == side), "naive_direction_hit": F.when(drift != 0, (moved == drift) & (moved != 0))})
    trades, long = C("direction") != 0, C("direction") >= 0
    d = d.withColumn("entry_fill", F.when(trades, fill_price(C("entry_open"), long, cost))).withColumn("exit_fill", F.when(trades, fill_price(C("target_close"), ~long, cost)))
    return d.withColumns({"net_pnl": C("direction") * (C("exit_fill") - C("entry_fill")), "gross_pnl": F.when(trades, F.abs(C("target_close") - C("entry_open")))}).withColumn(
        "net_return_pct", C("net_pnl") / F.greatest(C("entry_open"), F.lit(1e-9)) * 100)


def replay_summary(records: DataFrame) -> DataFrame:
    """Per symbol: origins, usable and abstained ones, accuracy against persistence, trades, Sharpe ratio and drawdown of the running result."""
    at = Window.partitionBy("symbol").orderBy("ts").rowsBetween(UP, 0)  # origins are bars, so bounded by the calendar
    d = records.withColumn("equity", F.when(C("net_pnl").isNotNull(), F.sum("net_pnl").over(at)))
    d = d.withColumn("peak", F.max("equity").over(at))
    fall = F.when((C("peak") > 0) & C("equity").isNotNull(), (C("equity") - C("peak")) / C("peak") * 100)
    rate = lambda c: F.avg(C(c).cast("double"))
    g = d.groupBy("symbol").agg(
        F.count("*").alias("origins"), F.count_if("usable").alias("usable"), F.count_if(~C("usable")).alias("abstained"), rate("coverage_hit").alias("coverage"), rate("containment_hit").alias("path_containment"),
        rate("direction_hit").alias("direction"), rate("naive_direction_hit").alias("naive_direction"), F.avg("model_error").alias("mae"), F.avg("naive_error").alias("naive_mae"), F.count("net_pnl").alias("trades"),
        F.count_if(C("net_pnl") > 0).alias("wins"), F.coalesce(F.sum("gross_pnl"), F.lit(0.0)).alias("gross_pnl"), F.coalesce(F.sum("net_pnl"), F.lit(0.0)).alias("net_pnl"), F.avg("net_return_pct").alias("mean_return_pct"),
        F.stddev_pop("net_return_pct").alias("_sd"), F.when(F.count("equity") > 0, F.least(F.lit(0.0), F.coalesce(F.min(fall), F.lit(0.0)))).alias("max_drawdown_pct"))
    return g.withColumns({"mase": ratio("mae", "naive_mae"), "costs": C("gross_pnl") - C("net_pnl"),
                          "sharpe": F.when((C("trades") > 1) & (C("_sd") > 0), C("mean_return_pct") / C("_sd") * F.sqrt(C("trades").cast("double")))}).drop("_sd")
