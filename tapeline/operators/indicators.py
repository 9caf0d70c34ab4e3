"""Technical indicators over bars(symbol, ts, open, high, low, close, volume).

Frame indicators are plain column expressions on the shared BARS span; smoothed ones go
through the blocked `ewm` kernel. A whole panel therefore costs one shuffle by symbol.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ewm import ewm, span_alpha
from ..functions.span import BARS as S
from ..functions.span import UP, ratio

C = F.col

# Bar-spacing bounds in minutes and the periods per year they stand for.
ANNUAL_PERIODS = ((2, 252.0 * 375), (7, 252.0 * 75), (20, 252.0 * 25), (90, 252.0 * 6.25), (300, 252.0 * 1.55), (1800, 252.0))
WEEKLY_PERIODS = 52.0


def sma(n: int, x: str = "close") -> Column:
    return S.mean(x, n)


def roc(n: int, x: str = "close") -> Column:
    """Percent change against n bars ago."""
    return ratio(C(x) - S.lag(x, n), S.lag(x, n)) * 100


def change(n: int = 1, x: str = "close") -> Column:
    """Relative change against n bars ago, null on a zero base."""
    return ratio(C(x), S.lag(x, n)) - 1


def true_range() -> Column:
    prev = S.lag("close")
    return F.greatest(C("high") - C("low"), F.abs(C("high") - prev), F.abs(C("low") - prev))


def bollinger(n: int = 20, k: float = 2.0) -> dict[str, Column]:
    mid, sd = S.mean("close", n), S.full(n, F.stddev_pop("close"), "close")
    return {"bb_upper": mid + k * sd, "bb_middle": mid, "bb_lower": mid - k * sd}


def obv() -> Column:
    return F.sum("_obv_step").over(S.running)


def with_obv(df: DataFrame) -> DataFrame:
    step = F.coalesce(F.signum(C("close") - S.lag("close")), F.lit(0.0)) * F.coalesce(C("volume"), F.lit(0.0))
    return df.withColumn("_obv_step", step).withColumn("obv", obv()).drop("_obv_step")


def with_stochastic(df: DataFrame, n: int = 14, d: int = 3) -> DataFrame:
    lo, hi = S.full(n, F.min("low"), "low"), S.full(n, F.max("high"), "high")
    return (df.select("*", lo.alias("_lo"), hi.alias("_hi"))
            .withColumn("stoch_k", F.when(C("_hi") == C("_lo"), 50.0)
                        .otherwise(ratio(C("close") - C("_lo"), C("_hi") - C("_lo")) * 100))
            .withColumn("stoch_d", S.mean("stoch_k", d)).drop("_lo", "_hi"))


def donchian(n: int = 20) -> dict[str, Column]:
    hi, lo = S.full(n, F.max("high"), "high"), S.full(n, F.min("low"), "low")
    return {"donchian_upper": hi, "donchian_middle": (hi + lo) / 2, "donchian_lower": lo}


def williams_r(n: int = 14) -> Column:
    hi, lo = S.full(n, F.max("high"), "high"), S.full(n, F.min("low"), "low")
    return -100 * ratio(hi - C("close"), hi - lo)


def typical() -> Column:
    return (C("high") + C("low") + C("close")) / 3.0


def has_volume() -> Column:
    return F.coalesce(F.bool_or(C("volume") > 0).over(S.whole), F.lit(False))


def traded_volume_flag(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.coalesce(F.bool_or(C("volume") > 0), F.lit(False)).alias("has_volume"))


def annualisation(bars: DataFrame) -> DataFrame:
    """Periods per year of each symbol from its median bar spacing."""
    gaps = bars.select("symbol", ((C("ts").cast("timestamp").cast("double")
                                   - S.lag("ts").cast("timestamp").cast("double")) / 60).alias("gap"))
    g = gaps.groupBy("symbol").agg(F.expr("percentile(gap, 0.5)").alias("median_gap"), F.count(F.lit(1)).alias("n"))
    factor = F.lit(WEEKLY_PERIODS)
    for bound, periods in reversed(ANNUAL_PERIODS):
        factor = F.when(C("median_gap") <= bound, periods).otherwise(factor)
    return g.select("symbol", "median_gap", F.when((C("n") < 3) | C("median_gap").isNull(), 252.0).otherwise(factor).alias("periods"))


def with_annualisation(df: DataFrame) -> DataFrame:
    """The factor as a column, from the same symbol partitioning (no join)."""
    gap = (C("ts").cast("timestamp").cast("double") - S.lag("ts").cast("timestamp").cast("double")) / 60
    med = F.percentile("_gap", F.lit(0.5)).over(S.whole)
    factor = F.lit(WEEKLY_PERIODS)
    for bound, periods in reversed(ANNUAL_PERIODS):
        factor = F.when(C("_med") <= bound, periods).otherwise(factor)
    return (df.withColumn("_gap", gap).withColumn("_med", med)
            .withColumn("periods", F.when((S.size() < 3) | C("_med").isNull(), 252.0).otherwise(factor)).drop("_gap", "_med"))


def with_volatility(df: DataFrame, periods: tuple[int, ...] = (20,)) -> DataFrame:
    """Population std of returns over n bars, annualised, in percent."""
    df = with_annualisation(df.withColumn("ret", change()))
    return df.select("*", *[(S.full(n, F.stddev_pop("ret"), "ret") * F.sqrt("periods") * 100).alias(f"volatility_{n}") for n in periods])


def with_vwap(df: DataFrame) -> DataFrame:
    """Running volume-weighted price; restarts each day when a day holds several bars."""
    df = df.select("*", F.to_date("ts").alias("_day"), has_volume().alias("_hv"), typical().alias("_tp"))
    df = df.withColumn("_wt", F.when(C("_hv"), F.coalesce("volume", F.lit(0.0))).otherwise(1.0))
    df = df.withColumn("_rep", F.coalesce(S.lag("_day") == C("_day"), F.lit(False)))
    df = df.withColumn("_intra", F.bool_or("_rep").over(S.whole) & (S.size() > 2))
    day = S.w.partitionBy("symbol", F.when(C("_intra"), C("_day"))).orderBy("ts").rowsBetween(UP, 0)
    return df.withColumn("vwap", ratio(F.sum(C("_tp") * C("_wt")).over(day), F.sum("_wt").over(day))).drop(
        "_day", "_hv", "_tp", "_wt", "_rep", "_intra")


def with_cmf(df: DataFrame, n: int = 20) -> DataFrame:
    mult = F.coalesce(ratio((C("close") - C("low")) - (C("high") - C("close")), C("high") - C("low")), F.lit(0.0))
    wt = F.when(has_volume(), F.coalesce("volume", F.lit(0.0))).otherwise(1.0)
    df = df.select("*", wt.alias("_wt"), mult.alias("_mult"))
    return df.withColumn("cmf", ratio(S.full(n, F.sum(C("_mult") * C("_wt")), "close"), F.sum("_wt").over(S.trailing(n)))).drop("_wt", "_mult")


def with_mfi(df: DataFrame, n: int = 14) -> DataFrame:
    df = df.select("*", typical().alias("_tp")).withColumn("_dir", C("_tp") - S.lag("_tp"))
    flow = C("_tp") * C("volume")
    df = df.select("*", F.when(C("_dir") > 0, flow).otherwise(0.0).alias("_pos"), F.when(C("_dir") < 0, flow).otherwise(0.0).alias("_neg"))
    df = df.select("*", S.full(n, F.sum("_pos"), "_pos").alias("_ps"), S.full(n, F.sum("_neg"), "_neg").alias("_ns"))
    value = (F.when(C("_ps") == 0, 0.0).when(C("_ns") == 0, 100.0)
             .otherwise(100 - 100 / (1 + ratio("_ps", "_ns"))))
    return df.withColumn("mfi", F.when(C("_ps").isNotNull(), value)).drop("_tp", "_dir", "_pos", "_neg", "_ps", "_ns")


def with_cci(df: DataFrame, n: int = 20) -> DataFrame:
    df = df.select("*", typical().alias("_tp"))
    df = df.select("*", S.mean("_tp", n).alias("_avg"), F.collect_list("_tp").over(S.trailing(n)).alias("_win"))
    dev = F.aggregate("_win", F.lit(0.0), lambda a, v: a + F.abs(v - C("_avg"))) / n
    return df.withColumn("cci", ratio(C("_tp") - C("_avg"), 0.015 * dev)).drop("_tp", "_avg", "_win")


# ---- smoothed indicators -------------------------------------------------------------

def with_ema(df: DataFrame, periods: tuple[int, ...]) -> DataFrame:
    return ewm(df, {f"ema_{n}": ("close", span_alpha(n), n) for n in periods})


def _gains_losses(df: DataFrame) -> DataFrame:
    d = C("close") - S.lag("close")
    return df.select("*", F.greatest(d, F.lit(0.0) + d * 0).alias("_gain"), F.greatest(-d, F.lit(0.0) + d * 0).alias("_loss"))


def _rsi_value(n: int) -> Column:
    g, l = C(f"_g_{n}"), C(f"_s_{n}")
    return F.when(g.isNull() | l.isNull(), None).when((g == 0) & (l == 0), 50.0).when(g == 0, 0.0).when(l == 0, 100.0).otherwise(
        100 - 100 / (1 + ratio(g, l)))


def with_rsi(df: DataFrame, periods: tuple[int, ...] = (14,)) -> DataFrame:
    keep = df.columns
    specs = {}
    for n in periods:
        specs |= {f"_g_{n}": ("_gain", 1 / n, n), f"_s_{n}": ("_loss", 1 / n, n)}
    return ewm(_gains_losses(df), specs).select(*keep, *[_rsi_value(n).alias(f"rsi_{n}") for n in periods])


def with_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    keep = df.columns
    d = ewm(df, {"_f": ("close", span_alpha(fast), fast), "_sl": ("close", span_alpha(slow), slow)})
    d = d.select(*keep, (C("_f") - C("_sl")).alias("macd"))
    d = ewm(d, {"macd_signal": ("macd", span_alpha(signal), signal)})
    return d.withColumn("macd_histogram", C("macd") - C("macd_signal"))


def with_atr(df: DataFrame, n: int = 14) -> DataFrame:
    return ewm(df.withColumn("_tr", true_range()), {"atr": ("_tr", 1 / n, n)}).drop("_tr")


def _dm(df: DataFrame) -> DataFrame:
    up, dn = C("high") - S.lag("high"), S.lag("low") - C("low")
    return df.select("*", true_range().alias("_tr"), F.when((up > dn) & (up > 0), up).otherwise(0.0).alias("_pdm"),
                     F.when((dn > up) & (dn > 0), dn).otherwise(0.0).alias("_mdm"))


def _di(df: DataFrame) -> DataFrame:
    p, m = 100 * ratio("_p", "_t"), 100 * ratio("_m", "_t")
    return df.select("*", p.alias("plus_di"), m.alias("minus_di"), (100 * ratio(F.abs(p - m), p + m)).alias("_dx"))


def with_adx(df: DataFrame, n: int = 14) -> DataFrame:
    keep = df.columns
    d = ewm(_dm(df), {"_t": ("_tr", 1 / n, n), "_p": ("_pdm", 1 / n, n), "_m": ("_mdm", 1 / n, n)})
    return ewm(_di(d), {"adx": ("_dx", 1 / n, n)}).select(*keep, "adx", "plus_di", "minus_di")


# ---- the full panel ------------------------------------------------------------------

def panel(bars: DataFrame) -> DataFrame:
    """Every indicator and derived feature per bar; all windows share one symbol partitioning."""
    keep = ["symbol", "ts", "open", "high", "low", "close", "volume"]
    d = _dm(_gains_losses(bars.select(*keep)))
    specs = {f"ema_{n}": ("close", span_alpha(n), n) for n in (10, 20, 50, 100)}
    for n in (7, 14, 21):
        specs |= {f"_g_{n}": ("_gain", 1 / n, n), f"_s_{n}": ("_loss", 1 / n, n)}
    specs |= {"_f": ("close", span_alpha(12), 12), "_sl": ("close", span_alpha(26), 26),
              "_t": ("_tr", 1 / 14, 14), "_p": ("_pdm", 1 / 14, 14), "_m": ("_mdm", 1 / 14, 14)}
    d = _di(ewm(d, specs)).withColumn("macd", C("_f") - C("_sl"))
    d = ewm(d, {"macd_signal": ("macd", span_alpha(9), 9), "adx": ("_dx", 1 / 14, 14)})
    emas = [f"ema_{n}" for n in (10, 20, 50, 100)]
    d = d.select(*keep, *emas, *[_rsi_value(n).alias(f"rsi_{n}") for n in (7, 14, 21)], "macd", "macd_signal",
                 (C("macd") - C("macd_signal")).alias("macd_histogram"), C("_t").alias("atr"), "adx", "plus_di", "minus_di")
    d = with_cci(with_mfi(with_cmf(with_vwap(with_stochastic(with_obv(d))))))
    d = with_volatility(d, (5, 10, 20, 30, 60))
    d = d.select("*", *[sma(n).alias(f"sma_{n}") for n in (10, 20, 50, 100, 200)],
                 *[c.alias(k) for k, c in {**bollinger(), **donchian()}.items()],
                 S.mean("volume", 20).alias("volume_sma_20"), S.full(20, F.stddev_pop("volume"), "volume").alias("_vsd"),
                 F.count("ret").over(S.trailing(20)).alias("_nr"), F.skewness("ret").over(S.trailing(20)).alias("_g1"),
                 F.kurtosis("ret").over(S.trailing(20)).alias("_g2"), has_volume().alias("has_volume"))
    prev_v = S.lag("volume")
    n = 20.0
    rng = C("high") - C("low")
    out = {
        "bb_width": ratio(C("bb_upper") - C("bb_lower"), "bb_middle") * 100, "roc_12": roc(12), "daily_return": C("ret") * 100,
        **{f"return_{k}": change(k) * 100 for k in (2, 5, 10, 20, 60)},
        **{f"momentum_{k}": C("close") - S.lag("close", k) for k in (5, 10, 20)},
        "williams_r": williams_r(), "atr_pct": ratio("atr", "close") * 100,
        "volume_change": F.when(~C("has_volume") | (prev_v == 0), 0.0).otherwise((ratio(C("volume"), prev_v) - 1) * 100),
        "volume_ratio_20": F.when(~C("has_volume"), 1.0).otherwise(ratio("volume", "volume_sma_20")),
        "volume_zscore_20": F.when(~C("has_volume"), 0.0).otherwise(ratio(C("volume") - C("volume_sma_20"), "_vsd")),
        "range_pct": ratio(rng, "close") * 100, "gap_pct": (ratio(C("open"), S.lag("close")) - 1) * 100,
        "close_to_sma20_pct": (ratio("close", "sma_20") - 1) * 100, "close_to_sma50_pct": (ratio("close", "sma_50") - 1) * 100,
        "close_location": F.when(rng == 0, 0.5).otherwise(ratio(C("close") - C("low"), rng)),
        "return_skew_20": F.when(C("_nr") == 20, C("_g1") * math.sqrt(n * (n - 1)) / (n - 2)),
        "return_kurt_20": F.when(C("_nr") == 20, ((n + 1) * C("_g2") + 6) * (n - 1) / ((n - 2) * (n - 3))),
        "drawdown_20": ratio(C("close"), S.full(20, F.max("close"), "close")) - 1,
        "drawdown_60": ratio(C("close"), S.full(60, F.max("close"), "close")) - 1,
        "close_to_vwap_pct": (ratio("close", "vwap") - 1) * 100,
        "donchian_position": ratio(C("close") - C("donchian_lower"), C("donchian_upper") - C("donchian_lower")),
        "above_sma20": F.coalesce(C("close") > C("sma_20"), F.lit(False)),
        "above_sma50": F.coalesce(C("close") > C("sma_50"), F.lit(False)),
        "golden_cross": F.coalesce(C("sma_50") > C("sma_200"), F.lit(False)),
    }
    return d.select("*", *[c.alias(k) for k, c in out.items()]).drop("_vsd", "_nr", "_g1", "_g2")


def regime_inputs(bars: DataFrame) -> DataFrame:
    """What a regime label reads: EMA 20/50, SMA 20/50, RSI 14, MACD histogram, ATR percent and ADX, with two smoothing passes in all."""
    d = _dm(_gains_losses(bars.select("symbol", "ts", "open", "high", "low", "close", "volume")))
    specs = {f"ema_{n}": ("close", span_alpha(n), n) for n in (20, 50)} | {"_g_14": ("_gain", 1 / 14, 14), "_s_14": ("_loss", 1 / 14, 14), "_f": ("close", span_alpha(12), 12), "_sl": ("close", span_alpha(26), 26),
                                                                          "_t": ("_tr", 1 / 14, 14), "_p": ("_pdm", 1 / 14, 14), "_m": ("_mdm", 1 / 14, 14)}
    d = _di(ewm(d, specs)).withColumn("macd", C("_f") - C("_sl"))
    d = ewm(d, {"macd_signal": ("macd", span_alpha(9), 9), "adx": ("_dx", 1 / 14, 14)})
    return d.select("symbol", "ts", "close", "ema_20", "ema_50", _rsi_value(14).alias("rsi_14"), (C("macd") - C("macd_signal")).alias("macd_histogram"), "adx",
                    (ratio("_t", "close") * 100).alias("atr_pct"), sma(20).alias("sma_20"), sma(50).alias("sma_50"))


def core_panel(bars: DataFrame) -> DataFrame:
    """The subset read by the last-bar signals: SMA 20/50, EMA 20, RSI 14, MACD."""
    d = with_macd(with_rsi(with_ema(bars, (20,)), (14,)))
    return d.select("*", sma(20).alias("sma_20"), sma(50).alias("sma_50"))


def last_bar(df: DataFrame) -> DataFrame:
    return df.withColumn("_d", S.rn_desc()).where("_d = 1").drop("_d")


def technical_signal(bars: DataFrame) -> DataFrame:
    d = last_bar(core_panel(bars))

    def vote(cond, known):
        return F.when(known, F.when(cond, 1).otherwise(-1)).otherwise(0)

    r = C("rsi_14")
    rsi_vote = F.when(r.isNull(), 0).when((r <= 30) | ((r >= 50) & (r < 70)), 1).otherwise(-1)
    score = (vote(C("close") > C("sma_20"), C("sma_20").isNotNull()) + vote(C("sma_20") > C("sma_50"), C("sma_50").isNotNull())
             + rsi_vote + vote(C("macd") > C("macd_signal"), C("macd_signal").isNotNull()))
    d = d.withColumn("score", score)
    s = C("score")
    return d.withColumn("signal", F.when(s >= 3, "STRONG BUY").when(s >= 1, "BUY").when(s <= -3, "STRONG SELL")
                        .when(s <= -1, "SELL").otherwise("NEUTRAL"))


# Status labels shown for the last bar.
NO_DATA = "Insufficient Data ⚪"
STATUS = {"oversold": "Oversold 🟢", "overbought": "Overbought 🔴", "neutral": "Neutral 🟡", "bull": "Bullish 🟢",
          "bear": "Bearish 🔴", "above": "Above EMA 🟢", "below": "Below EMA 🔴", "buy": "BUY 🟢", "hold": "HOLD 🟡", "sell": "SELL 🔴"}


def indicator_status(bars: DataFrame) -> DataFrame:
    d = last_bar(core_panel(bars))
    r = C("rsi_14")

    def label(known, cond, yes, no):
        return F.when(~known, NO_DATA).when(cond, STATUS[yes]).otherwise(STATUS[no])

    def points(cond):
        return F.when(cond, 25).otherwise(0)

    d = d.select(
        "*", F.when(r.isNull(), NO_DATA).when(r < 30, STATUS["oversold"]).when(r > 70, STATUS["overbought"]).otherwise(STATUS["neutral"]).alias("rsi_status"),
        label(C("macd_signal").isNotNull(), C("macd") > C("macd_signal"), "bull", "bear").alias("macd_status"),
        label(C("sma_50").isNotNull(), C("sma_20") > C("sma_50"), "bull", "bear").alias("sma_status"),
        label(C("ema_20").isNotNull(), C("close") > C("ema_20"), "above", "below").alias("ema_status"),
        (F.when(r < 30, 25).when(r <= 60, 15).otherwise(0) + points(C("macd") > C("macd_signal"))
         + points(C("sma_20") > C("sma_50")) + points(C("close") > C("ema_20"))).alias("score"))
    return d.withColumn("overall", F.when(C("score") >= 75, STATUS["buy"]).when(C("score") >= 50, STATUS["hold"]).otherwise(STATUS["sell"]))


def quote_snapshot(bars: DataFrame) -> DataFrame:
    d = with_volatility(with_vwap(core_panel(bars)), (20,))
    d = last_bar(d.withColumn("previous_close", F.coalesce(S.lag("close"), C("close"))))
    return d.select("symbol", "ts", "close", "previous_close", (C("close") - C("previous_close")).alias("change"),
                    F.coalesce(ratio(C("close") - C("previous_close"), "previous_close") * 100, F.lit(0.0)).alias("change_pct"),
                    "rsi_14", "macd", "macd_signal", "sma_20", "sma_50", "vwap", "volatility_20")
