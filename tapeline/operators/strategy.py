"""Screens, rule strategies and backtests over the whole universe."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chunks
from ..functions.ewm import ewm, span_alpha
from ..functions.pricing import price as option_price
from ..functions.span import BARS as S
from ..functions.span import Span, ratio
from ..session import cut
from .indicators import change, true_range, with_macd

C = F.col
MIN_SESSIONS = 60


def _wilder(df: DataFrame, warm: int) -> DataFrame:
    d = C("close") - S.lag("close")
    g, l = F.when(d > 0, d).when(d.isNotNull(), 0.0), F.when(d < 0, -d).when(d.isNotNull(), 0.0)
    return ewm(df.select("*", g.alias("_g"), l.alias("_l")), {"_ag": ("_g", 1 / 14, warm), "_al": ("_l", 1 / 14, warm)})


# ---- screens -------------------------------------------------------------------------

def screen_metrics(bars: DataFrame) -> DataFrame:
    """Metrics of each symbol's last bar; each is null below its own history need, <60 sessions is unavailable."""
    n = C("sessions")

    def pct(a, b):
        return F.round(ratio(a - b, F.abs(b)) * 100, 2)

    def at(k, x):
        return F.when(n >= k, x)

    d = _wilder(bars, 1)
    hi, lo = F.max("close").over(S.trailing(250)), F.min("close").over(S.trailing(250))
    d = d.select("*", S.size().alias("sessions"), S.rn_desc().alias("_d"), *[S.lag("close", k).alias(f"_c{k}") for k in (1, 5, 20)], hi.alias("_hi"), lo.alias("_lo"),
                 *[F.avg("close").over(S.trailing(k)).alias(f"_m{k}") for k in (14, 20, 50, 200)], F.avg("volume").over(S.trailing(20)).alias("_v20"),
                 F.avg(C("high") - C("low")).over(S.trailing(14)).alias("_r14")).where("_d = 1 and sessions >= 60")
    c = C("close")
    rsi = F.when(C("_al") == 0, F.when(C("_ag") > 0, 100.0).otherwise(50.0)).otherwise(F.round(100 - 100 / (1 + ratio("_ag", "_al")), 2))
    d = d.select("symbol", "ts", "sessions", F.round(c, 2).alias("last_close"), at(2, pct(c, C("_c1"))).alias("change_pct_1d"), at(6, pct(c, C("_c5"))).alias("change_pct_5d"),
                 at(21, pct(c, C("_c20"))).alias("change_pct_20d"), at(15, rsi).alias("rsi_14"), *[at(k, F.round(f"_m{k}", 2)).alias(f"sma_{k}") for k in (20, 50, 200)],
                 pct(c, C("_hi")).alias("distance_from_52w_high_pct"), pct(c, C("_lo")).alias("distance_from_52w_low_pct"), F.round("volume", 0).alias("volume"),
                 F.when(C("_v20") > 0, F.round(C("volume") / C("_v20"), 3)).alias("volume_vs_20d_avg"), F.round(ratio("_r14", "_m14") * 100, 2).alias("realized_range_pct_14d"),
                 pct(C("open"), C("_c1")).alias("gap_pct"), c.alias("_close"))
    return d.select("*", *[pct(C("_close"), C(f"sma_{k}")).alias(f"close_vs_sma{k}_pct") for k in (20, 50, 200)]).drop("_close")


OPERATORS = ("gt", "gte", "lt", "lte", "eq", "between")


def passes(value: Column, op: Column | str, threshold: Column, low: Column, high: Column) -> Column:
    """Three-valued rule check: null when the metric is missing."""
    op = F.lit(op) if isinstance(op, str) else op
    tol = F.greatest(F.lit(1e-9), 1e-9 * F.greatest(F.abs(value), F.abs(threshold)))
    hit = (F.when(op == "gt", value > threshold).when(op == "gte", value >= threshold).when(op == "lt", value < threshold).when(op == "lte", value <= threshold)
           .when(op == "eq", F.abs(value - threshold) <= tol).when(op == "between", value.between(low, high)))
    return F.when(value.isNotNull(), hit)


def rule_column(rule: dict) -> Column:
    if rule["op"] not in OPERATORS:
        raise ValueError(f"unknown operator {rule['op']}")
    num = {k: F.lit(float(rule[k])) if rule.get(k) is not None else F.lit(None).cast("double") for k in ("value", "low", "high")}
    return passes(C(rule["field"]), rule["op"], num["value"], num["low"], num["high"])


def screen_status(metrics: DataFrame, rules: list[dict]) -> DataFrame:
    """Adds `missing` (fields without a value) and `matched`."""
    if not 1 <= len(rules) <= 12:
        raise ValueError("between 1 and 12 rules")
    checks = [rule_column(r) for r in rules]
    fields = sorted({r["field"] for r in rules})
    missing = F.array_compact(F.array(*[F.when(C(f).isNull(), F.lit(f)) for f in fields]))
    ok = reduce(lambda a, b: a & b, checks)
    return metrics.withColumn("missing", missing).withColumn("matched", F.when(F.size("missing") == 0, ok))


def run_screen(bars: DataFrame, rules: list[dict], sort_by: str | None, descending: bool, limit: int) -> tuple[DataFrame, DataFrame]:
    """(matches, exclusions). Sorting takes the top rows per partition first (TakeOrderedAndProject)."""
    m = cut(screen_status(screen_metrics(bars), rules))  # a row for each symbol, read for matches and exclusions
    hits = m.where("matched")
    if sort_by:
        order = [F.desc_nulls_first(sort_by) if descending else F.asc_nulls_last(sort_by), C("symbol")]
    else:
        order = [C("symbol")]
    short = bars.groupBy("symbol").agg(F.count("*").alias("sessions")).where(C("sessions") < MIN_SESSIONS)
    excluded = m.where(F.size("missing") > 0).select("symbol", F.lit("metric_unavailable").alias("reason"), F.concat_ws(",", "missing").alias("fields")).unionByName(
        short.select("symbol", F.lit("insufficient_history").alias("reason"), F.lit("").alias("fields")))
    return hits.orderBy(*order).limit(limit), excluded


def saved_screen_run(metrics: DataFrame, rules: DataFrame, fields: list[str]) -> DataFrame:
    """Every stored screen against every symbol: long metrics join rules on the field, then all rules must hold."""
    long = metrics.select("symbol", *[C(f).cast("double").alias(f) for f in fields]).unpivot(["symbol"], fields, "field", "metric")
    total = rules.groupBy("screen_id").agg(F.count("*").alias("rules"))
    j = long.join(rules, "field").withColumn("hit", passes(C("metric"), C("op"), C("value"), C("low"), C("high")))
    g = j.groupBy("screen_id", "symbol").agg(F.count_if("hit").alias("hits"), F.count("hit").alias("known"))
    return g.join(total, "screen_id").select("screen_id", "symbol", (C("hits") == C("rules")).alias("matched"), (C("known") < C("rules")).alias("incomplete"))


# ---- rule strategies -----------------------------------------------------------------

def strategy_metrics(bars: DataFrame) -> DataFrame:
    d = with_macd(_wilder(bars, 14)).withColumn("_tr", true_range())
    prev = S.lag("close")
    c = C("close")
    hi = F.when(F.count("close").over(S.trailing(252)) >= 60, F.max("close").over(S.trailing(252)))
    rsi = F.when(C("_al").isNotNull(), F.when(C("_al") == 0, 100.0).otherwise(100 - 100 / (1 + ratio("_ag", "_al"))))
    vavg = S.mean("volume", 20)
    return d.select("symbol", "ts", "open", "close", "volume", *[(change(k) * 100).alias(f"change_pct_{k}d") for k in (1, 5, 20)], ((ratio(C("open"), prev) - 1) * 100).alias("gap_pct"),
                    *[S.mean("close", k).alias(f"sma_{k}") for k in (20, 50, 200)], *[((ratio(c, S.mean("close", k)) - 1) * 100).alias(f"close_vs_sma{k}_pct") for k in (20, 50, 200)],
                    rsi.alias("rsi_14"), (ratio(S.mean("_tr", 14), c) * 100).alias("atr_pct_14"), ratio(C("volume"), vavg).alias("volume_vs_20d_avg"),
                    C("macd_histogram").alias("macd_hist"), ((ratio(c, hi) - 1) * 100).alias("distance_from_52w_high_pct"))


def condition(cond: dict, span: Span = S) -> Column:
    """One rule on a metric frame; a missing operand is false."""
    left = C(cond["metric"])
    op = cond["operator"]
    if op == "between":
        low, high = cond["values"]
        return F.coalesce(left.between(float(low), float(high)), F.lit(False))
    other = cond.get("compare_metric")
    right = C(other) if other else F.lit(float(cond["value"]))
    if op in ("cross_above", "cross_below"):
        pl, pr = span.lag(cond["metric"]), span.lag(other) if other else right
        hit = ((pl <= pr) & (left > right)) if op == "cross_above" else ((pl >= pr) & (left < right))
    else:
        hit = {"gt": left > right, "gte": left >= right, "lt": left < right, "lte": left <= right, "eq": F.abs(left - right) <= 1e-9}[op]
    return F.coalesce(hit, F.lit(False))


def side(groups: dict | None) -> Column:
    """Conditions joined inside groups, groups joined in a side."""
    if not groups:
        return F.lit(False)

    def join(kind, cols):
        return reduce((lambda a, b: a | b) if kind == "or" else (lambda a, b: a & b), cols)

    return join(groups.get("join", "and"), [join(g.get("join", "and"), [condition(c) for c in g["conditions"]]) for g in groups["groups"]])


def signals(metrics: DataFrame, strategy: dict) -> DataFrame:
    """BUY/SELL events, one position at a time; exits by rule, then stop, then target.

    Without stop or target the position is a running composition of two-state maps (hold,
    set, toggle) and needs only windows; with them each symbol's bars fold in one pass.
    """
    d = metrics.select("symbol", "ts", C("close").alias("price"), side(strategy["entry"]).alias("en"), side(strategy.get("exit")).alias("ex"))
    stop, target = strategy.get("stop_loss_pct"), strategy.get("target_pct")
    if not stop and not target:
        const = F.when(C("en") & ~C("ex"), 1).when(~C("en") & C("ex"), 0)
        toggle = (C("en") & C("ex")).cast("int")
        d = d.select("*", F.last(F.struct(const.alias("v"), F.lit(1).alias("k")), True).over(S.running).alias("_x"), const.alias("_c"), toggle.alias("_t"))
        d = d.withColumn("_n", F.sum("_t").over(S.running))
        last = F.last(F.when(C("_c").isNotNull(), F.struct(C("_c").alias("v"), C("_n").alias("n"))), True).over(S.running)
        d = d.withColumn("_l", last)
        d = d.withColumn("_p", (F.coalesce(C("_l.v"), F.lit(0)) + C("_n") - F.coalesce(C("_l.n"), F.lit(0))) % 2)
        d = d.withColumn("_q", F.coalesce(S.lag("_p"), F.lit(0))).where("_p <> _q")
        buy = C("_p") == 1
        return d.select("symbol", "ts", F.when(buy, "BUY").otherwise("SELL").alias("action"), "price", F.when(buy, "entry_rules_matched").otherwise("exit_rules_matched").alias("reason"))

    def walk(pdf):
        pdf = pdf.sort_values("ts")
        out, held = [], None
        for ts, p, en, ex in zip(pdf["ts"], pdf["price"].to_numpy(), pdf["en"].to_numpy(), pdf["ex"].to_numpy()):
            if held is not None:
                why = ("exit_rules_matched" if ex else "stop_loss" if stop and p <= held * (1 - stop / 100) else "target" if target and p >= held * (1 + target / 100) else None)
                if why:
                    out.append((ts, "SELL", p, why))
                    held = None
                    continue
            if held is None and en:
                out.append((ts, "BUY", p, "entry_rules_matched"))
                held = p
        return pd.DataFrame(out, columns=["ts", "action", "price", "reason"]).assign(symbol=pdf["symbol"].iloc[0])

    return d.groupBy("symbol").applyInPandas(walk, f"ts {metrics.schema['ts'].dataType.simpleString()}, action string, price double, reason string, symbol string")


def run_strategy_universe(bars: DataFrame, strategy: dict, required: int) -> tuple[DataFrame, DataFrame]:
    n = bars.groupBy("symbol").agg(F.count("*").alias("sessions"))
    enough = bars.join(n.where(C("sessions") >= required).select("symbol"), "symbol", "left_semi")
    return signals(strategy_metrics(enough), strategy), n.where(C("sessions") < required).withColumn("reason", F.lit("insufficient_history"))


def pair_signals(sig: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Each BUY with the next event (its SELL, if any)."""
    s = Span(keys, ("ts",))
    d = sig.select("*", s.lead("ts").alias("exit_at"), s.lead("price").alias("exit_price"), s.lead("reason").alias("exit_reason"))
    return d.where("action = 'BUY'").withColumnRenamed("ts", "entry_at").withColumnRenamed("price", "entry_price")


def backtest_trades(sig: DataFrame, quantity: float, spread_bps: float, slippage_bps: float) -> DataFrame:
    pen = (spread_bps / 2 + slippage_bps) / 10_000
    d = pair_signals(sig).where("exit_at is not null").select("symbol", "entry_at", "entry_price", "exit_at", "exit_price", "exit_reason",
                                                             (C("entry_price") * (1 + pen)).alias("entry_fill"), (C("exit_price") * (1 - pen)).alias("exit_fill"))
    d = d.withColumn("gross", (C("exit_price") - C("entry_price")) * quantity).withColumn("net", (C("exit_fill") - C("entry_fill")) * quantity)
    return d.withColumn("costs", C("gross") - C("net")).withColumn("return_pct", (C("exit_fill") / C("entry_fill") - 1) * 100)


def backtest_summary(trades: DataFrame) -> DataFrame:
    s = Span(("symbol",), ("entry_at",))
    d = trades.withColumn("run", F.sum("net").over(s.running))
    d = d.withColumn("peak", F.max("run").over(s.running)).withColumn("dd", F.when(C("peak") > 0, (C("run") - C("peak")) / C("peak") * 100).otherwise(0.0))
    return d.groupBy("symbol").agg(
        F.count("*").alias("trades"), F.count_if(C("net") > 0).alias("wins"), (F.count_if(C("net") > 0) / F.count("*") * 100).alias("win_rate_pct"), F.sum("gross").alias("gross_pnl"),
        F.sum("costs").alias("costs"), F.sum("net").alias("net_pnl"), F.avg("return_pct").alias("avg_return_pct"), F.max("net").alias("best"), F.min("net").alias("worst"), F.min("dd").alias("max_drawdown_pct"))


# ---- position backtests --------------------------------------------------------------

def ma_crossover(bars: DataFrame, fast: int = 20, slow: int = 50) -> DataFrame:
    sig = F.coalesce((S.mean("close", fast) > S.mean("close", slow)).cast("double"), F.lit(0.0))
    return bars.withColumn("signal", sig).withColumn("position", S.lag("signal", 1, 0.0))


def rsi_reversion(bars: DataFrame, entry: float = 35.0, exit: float = 65.0) -> DataFrame:
    d = _wilder(bars, 14)
    rsi = F.coalesce(100 - 100 / (1 + ratio("_ag", "_al")), F.lit(50.0))
    d = d.withColumn("rsi", rsi)
    flag = F.when(C("rsi") <= entry, 1.0).when(C("rsi") >= exit, 0.0)
    d = d.withColumn("signal", F.coalesce(F.last(flag, True).over(S.running), F.lit(0.0))).withColumn("position", S.lag("signal", 1, 0.0))
    return d.drop("_ag", "_al", "_g", "_l")


def compounded(r: Column, frame) -> Column:
    """Running product of (1 + r); signs and zeros are tracked so losses beyond -100% stay exact."""
    g = 1.0 + r
    neg, zero = F.sum(F.when(g < 0, 1).otherwise(0)).over(frame), F.sum(F.when(g == 0, 1).otherwise(0)).over(frame)
    mag = F.exp(F.sum(F.when(g != 0, F.log(F.abs(g))).otherwise(0.0)).over(frame))
    return F.when(zero > 0, 0.0).otherwise(mag * F.when(neg % 2 == 1, -1.0).otherwise(1.0))


def equity_curve(positions: DataFrame, capital: float = 100_000.0, cost_bps: float = 10.0) -> DataFrame:
    """Strategy, gross and benchmark equity for `position` per bar."""
    d = positions.withColumn("ret", F.coalesce(change(), F.lit(0.0))).withColumn("turnover", F.abs(C("position") - F.coalesce(S.lag("position"), F.lit(0.0))))
    d = d.withColumn("cost", C("turnover") * (cost_bps / 10_000)).withColumn("net_ret", C("position") * C("ret") - C("cost"))
    d = d.select("*", (capital * compounded(C("net_ret"), S.running)).alias("strategy_equity"), (capital * compounded(C("position") * C("ret"), S.running)).alias("gross_equity"),
                 (capital * compounded(C("ret"), S.running)).alias("benchmark_equity"))
    return d.withColumn("cost_paid", C("cost") * F.coalesce(S.lag("strategy_equity"), F.lit(capital)))


def trade_log(positions: DataFrame) -> DataFrame:
    """Entries on a rise, exits on a fall; an open trade is marked at the last bar."""
    d = positions.withColumn("_ch", C("position") - F.coalesce(S.lag("position"), F.lit(0.0)))
    last = positions.groupBy("symbol").agg(F.max("ts").alias("last_ts"), F.max_by("close", "ts").alias("last_close"))
    ev = d.where("_ch <> 0").select("symbol", "ts", "close", "_ch")
    ev = ev.select("*", S.lead("ts").alias("exit_ts"), S.lead("close").alias("exit_price")).where("_ch > 0").join(last, "symbol")
    ev = ev.withColumn("open_at_end", C("exit_ts").isNull())
    return ev.select("symbol", C("ts").alias("entry_ts"), C("close").alias("entry_price"), F.coalesce("exit_ts", "last_ts").alias("exit_ts"), F.coalesce("exit_price", "last_close").alias("exit_price"), "open_at_end").withColumn(
        "return", C("exit_price") / C("entry_price") - 1)


def rank_strategies(metrics: DataFrame) -> DataFrame:
    """metrics(symbol, strategy, sharpe, total_return): best first within each symbol."""
    return metrics.withColumn("rank", F.rank().over(Window.partitionBy("symbol").orderBy(F.desc("sharpe"), F.desc("total_return"))))


def forward_events(sig: DataFrame, tests: DataFrame, existing: DataFrame) -> DataFrame:
    """Signals on or after each test's start that are not recorded yet."""
    new = sig.join(tests, "symbol").where(C("ts") >= C("started"))
    return new.join(existing.select("test_id", "symbol", "ts", "action"), ["test_id", "symbol", "ts", "action"], "left_anti")


def forward_scorecard(events: DataFrame) -> DataFrame:
    """Closed trades, win rate, compounded return and drawdown per forward test."""
    t = pair_signals(events, ("test_id", "symbol")).withColumn("ret", C("exit_price") / C("entry_price") - 1)
    closed = t.where("exit_at is not null")
    d = chunks.lowest_level(closed, ["test_id"], C("symbol"), ["symbol", "entry_at"], -F.log1p("ret"))  # the equity upside down: its low is the peak
    d = d.withColumn("logeq", -C("level")).withColumn("peak", F.greatest(-C("low"), F.lit(0.0)))
    g = d.groupBy("test_id").agg(
        F.count("*").alias("closed_trades"), F.count_if(C("ret") > 0).alias("wins"), (F.count_if(C("ret") > 0) / F.count("*") * 100).alias("win_rate_pct"), (F.avg("ret") * 100).alias("avg_return_pct"),
        (F.max("ret") * 100).alias("best_return_pct"), (F.min("ret") * 100).alias("worst_return_pct"), (F.min(F.exp(C("logeq") - C("peak")) - 1) * 100).alias("max_drawdown_pct"), F.sum(F.log1p("ret")).alias("log_compounded"))
    opened = t.where("exit_at is null").groupBy("test_id").agg(F.count("*").alias("open_positions"))
    return g.join(opened, "test_id", "left").withColumn("open_positions", F.coalesce("open_positions", F.lit(0)))


def expiry_cycle_rollup(bars: DataFrame, legs: DataFrame, days: int, step: int, vol: float, cost: float) -> DataFrame:
    """Open the leg template every `step` sessions at model premium, settle at intrinsic `days` sessions later.

    `legs` is the small template a user supplies; it is cross-joined to the cycles, then summed back per cycle.
    """
    d = bars.select("symbol", "ts", "close", (S.rn() - 1).alias("k"), S.lead("close", days).alias("exit_spot"), S.lead("ts", days).alias("exit_ts"))
    d = d.where((C("k") % step == 0) & C("exit_spot").isNotNull()).crossJoin(F.broadcast(legs))
    k = F.round(C("close") * (1 + C("offset_pct") / 100) + 1e-7, 2)  # the nudge settles exact halves upwards
    d = d.withColumn("strike", k)
    call = C("type") == "call"
    prem = F.when(C("type") == "future", C("close")).otherwise(option_price(C("close"), C("strike"), F.lit(days), F.lit(vol), call))
    intrinsic = F.when(C("type") == "future", C("exit_spot")).otherwise(F.greatest(F.lit(0.0), F.when(call, C("exit_spot") - C("strike")).otherwise(C("strike") - C("exit_spot"))))
    pnl = F.when(C("side") == "buy", 1.0).otherwise(-1.0) * (intrinsic - prem) * C("contracts")
    return d.groupBy("symbol", "ts", "exit_ts", "close", "exit_spot").agg(F.sum(pnl).alias("gross")).withColumn("net", C("gross") - cost)
