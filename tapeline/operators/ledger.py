"""Forecast ledger: settlement, quality, drift, decay controls and sentiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chunks
from ..functions.span import Span, ratio

C = F.col

# Days a later bar may settle a target, and days a quote stays usable.
HISTORY_TOLERANCE = {"1D": 10, "1W": 14}
HISTORY_DEFAULT = 4
QUOTE_TOLERANCE_HOURS = {"1D": 48, "1W": 192}
GRACE_SECONDS = 21600


def pending_due(ledger: DataFrame, now: Column) -> DataFrame:
    state = F.when(C("target_date").isNull(), "missing_target").when(C("target_date") > now, "not_due").otherwise("due")
    return ledger.where("actual_price is null").withColumn("state", state)


def by_timeframe(table: dict, default: int) -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, C("timeframe")), F.lit(default))


def settle_forward_asof(pending: DataFrame, bars: DataFrame, now: Column) -> DataFrame:
    """Settle each due target on the first trusted bar at or after it, else defer inside grace, else give a reason.

    A bar stands for the days back to its predecessor, as far as the tolerance reaches, so the forward as-of is an equal
    join on symbol and day and the ledger of a symbol is never ordered or held in one place. Bars are one per symbol and
    day: bars(symbol, ts, close, provider, is_stale, is_demo).
    """
    due = pending.where(C("target_date").isNotNull() & (C("target_date") <= now))
    b = bars.select("symbol", "ts", F.struct("ts", "close", "provider", "is_stale", "is_demo").alias("_n"), Span().lag("ts").alias("_p"))
    since = F.greatest(F.date_add("_p", 1), F.date_sub("ts", max(HISTORY_DEFAULT, *HISTORY_TOLERANCE.values())))
    days = b.where("_p is null or _p < ts").select("symbol", "_n", F.explode(F.sequence(since, C("ts"), F.expr("INTERVAL 1 DAY"))).alias("target_date"))
    d = due.join(days, ["symbol", "target_date"], "left")
    gap = F.datediff("_n.ts", "target_date")
    near = C("_n").isNotNull() & (gap <= by_timeframe(HISTORY_TOLERANCE, HISTORY_DEFAULT))
    bad_price = ~(C("_n.close") > 0) | F.isnan("_n.close")
    reason = (F.when(~near | C("_n").isNull(), "target_data_absent").when(C("_n.is_stale"), "stale_market_data").when(C("_n.is_demo"), "demo_market_data")
              .when(F.lower(F.trim("_n.provider")).isin("", "unknown"), "unverified_provider").when(bad_price, "invalid_target_price"))
    d = d.withColumn("reason", reason)
    age = now.cast("timestamp").cast("double") - C("target_date").cast("timestamp").cast("double")
    status = F.when(C("reason").isNull(), "settled").when((C("reason") == "target_data_absent") & (age < GRACE_SECONDS), "deferred").otherwise("unverifiable")
    ok = C("reason").isNull()
    return d.select(*pending.columns, status.alias("status"), "reason", F.when(ok, C("_n.close")).alias("settled_price"), F.when(ok, C("_n.ts")).alias("observed_at"))


def settle_quote_fallback(settled: DataFrame, quotes: DataFrame, now: Column) -> DataFrame:
    """For absent targets, a trusted fresh quote after the target settles instead: the newest one of all providers, the later name on a tie."""
    trusted = ~C("is_stale") & ~C("is_demo") & ~F.lower(F.trim("provider")).isin("", "unknown") & (C("price") > 0)
    q = quotes.where(F.coalesce(trusted, F.lit(False))).groupBy("symbol").agg(F.max_by(F.struct(C("price").alias("_p"), C("ts").alias("_qt")), F.struct("ts", "provider")).alias("q")).select("symbol", "q.*")
    d = settled.join(q, "symbol", "left")
    tol = by_timeframe(QUOTE_TOLERANCE_HOURS, 1) * 3600.0
    n, tgt, qt = now.cast("timestamp").cast("double"), C("target_date").cast("timestamp").cast("double"), C("_qt").cast("timestamp").cast("double")
    ok = ((C("reason") == "target_data_absent") & (n - tgt <= tol) & (qt >= tgt) & (n - qt <= tol))
    ok = F.coalesce(ok, F.lit(False))
    return d.select(*[c for c in settled.columns if c not in ("status", "reason", "settled_price", "observed_at")], F.when(ok, "settled").otherwise(C("status")).alias("status"),
                    F.when(~ok, C("reason")).alias("reason"), F.when(ok, C("_p")).otherwise(C("settled_price")).alias("settled_price"), F.when(ok, "quote").when(C("status") == "settled", "history").alias("method"))


def winkler(actual: Column, low: Column, high: Column, confidence: Column) -> Column:
    k = 2 / F.greatest(F.lit(1e-6), 1 - confidence)
    return high - low + F.when(actual < low, k * (low - actual)).when(actual > high, k * (actual - high)).otherwise(0.0)


def score_outcome(rows: DataFrame, already: DataFrame | None = None) -> DataFrame:
    """Coverage hit and interval score, write-once: ids already settled are left out."""
    d = rows if already is None else rows.join(already.select("symbol", "id"), ["symbol", "id"], "left_anti")
    a, lo, hi = C("actual_price"), C("forecast_low"), C("forecast_high")
    return d.where(a.isNotNull() & (a > 0)).select("*", a.between(lo, hi).alias("hit"), winkler(a, lo, hi, C("confidence_level")).alias("score"))


def official_rows(rows: DataFrame) -> DataFrame:
    return rows.where((C("settlement_source") == "automatic") & C("official") & ~C("is_stale") & ~C("is_demo") & C("forecast_status").isin("published", "limited"))


def outcome_counts(rows: DataFrame, statuses: list[str]) -> DataFrame:
    return rows.groupBy("user_id").agg(*[F.count_if(C("status") == s).alias(s) for s in statuses], F.count("*").alias("total"))


def quality_state(gap: Column, tol: float = 0.05) -> Column:
    return F.when(gap < -tol, "under_coverage").when(gap > tol, "over_coverage").otherwise("stable")


def interval_quality(settled: DataFrame, tol: float = 0.05) -> DataFrame:
    """Overall, by (window, timeframe) and by horizon in one pass of grouping sets."""
    d = settled.groupingSets([[], ["window_name", "timeframe"], ["horizon"]], "window_name", "timeframe", "horizon").agg(
        F.count("*").alias("settled_forecasts"), F.avg(C("coverage_hit").cast("double")).alias("empirical_coverage"), F.avg("confidence_level").alias("nominal_coverage"), F.avg("winkler").alias("mean_winkler"))
    return d.withColumn("coverage_gap", C("empirical_coverage") - C("nominal_coverage")).withColumn("state", quality_state(C("coverage_gap"), tol))


MIN_SETTLED, GAP_LIMIT, MASE_LIMIT, DIRECTION_LIMIT = 6, 0.10, 1.0, 0.45


def with_earlier(rows: DataFrame, keys: list[str], names: dict[str, int]) -> DataFrame:
    """Add the actual price so many outcomes earlier; the outcomes of a key are ordered day by day, not as a whole."""
    return chunks.lags(rows, keys, C("target_date"), ["target_date", "id"], {o: ("actual_price", k) for o, k in names.items()})


def group_drift(settled: DataFrame, window: int = 20) -> DataFrame:
    """Rolling coverage gap, MASE and direction per (symbol, timeframe, horizon) with drift rules."""
    keys, order = ["symbol", "timeframe", "horizon"], ["target_date", "id"]
    d = with_earlier(settled, keys, {"p1": 1, "p2": 2})
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])  # Spark keeps the first rows of each key before it shuffles
    last = settled.select(*keys, *order, "coverage_hit", "confidence_level").withColumn("_d", F.row_number().over(newest)).where(C("_d") <= window)
    last = last.groupBy(*keys).agg(F.avg(C("coverage_hit").cast("double")).alias("rolling_coverage"), F.avg("confidence_level").alias("nominal_coverage"))
    a, m = C("actual_price"), C("forecast_median")
    side = F.signum(a - C("p1"))
    model = F.when(C("forecast_high") > C("forecast_low"), F.signum(m - (C("forecast_low") + C("forecast_high")) / 2))
    prior = F.signum(C("p1") - C("p2"))
    known = (side != 0) & (model != 0)
    nknown = (side != 0) & (prior != 0)
    g = d.groupBy(*keys).agg(
        F.count("*").alias("settled_samples"), F.sum(F.abs(a - m)).alias("me"), F.sum(F.abs(a - C("p1"))).alias("ne"), F.avg(F.when(known, (side == model).cast("double"))).alias("directional_accuracy"),
        F.avg(F.when(nknown, (side == prior).cast("double"))).alias("naive_directional_accuracy"))
    g = g.join(last, keys).withColumn("coverage_gap", C("rolling_coverage") - C("nominal_coverage")).withColumn("mase", F.when(C("ne") > 0, C("me") / C("ne")))
    enough = C("settled_samples") >= MIN_SETTLED
    r1, r2 = enough & (C("coverage_gap") < -GAP_LIMIT), enough & F.coalesce(C("mase") >= MASE_LIMIT, F.lit(False))
    r3 = enough & F.coalesce(C("directional_accuracy") < DIRECTION_LIMIT, F.lit(False)) & (C("settled_samples") >= 10)
    return g.select(*keys, "settled_samples", "rolling_coverage", "coverage_gap", "mase", "directional_accuracy", "naive_directional_accuracy", (r1 | r2 | r3).alias("drift_detected"),
                    F.when(r1 | r2, "high").when(r3, "low").alias("severity"), F.concat_ws(",", F.when(r1, "coverage"), F.when(r2, "mase"), F.when(r3, "direction")).alias("reasons"))


def residual_drift(residuals: DataFrame, span: Span) -> DataFrame:
    """Recent mean |residual| against history + 2 sigma and x1.35; needs 40."""
    d = residuals.select("symbol", F.abs("residual").alias("r"), span.rn_desc().alias("_d"), span.size().alias("n"))
    k = F.least(F.lit(20), F.greatest(F.lit(10), F.floor(C("n") / 4)))
    old, new = F.when(C("_d") > k, C("r")), F.when(C("_d") <= k, C("r"))
    g = d.groupBy("symbol").agg(F.max("n").alias("n"), F.avg(old).alias("hist_mean"), F.stddev_pop(old).alias("hist_std"), F.avg(new).alias("recent_mean"))
    g = g.withColumn("threshold", C("hist_mean") + 2 * C("hist_std"))
    return g.withColumn("status", F.when(C("n") < 40, "insufficient_history").when(C("recent_mean") > F.greatest("threshold", C("hist_mean") * 1.35), "drift").otherwise("stable"))


def latest_health(health: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in health.columns if c not in keys]
    return health.groupBy(*keys).agg(F.max_by(F.struct(*rest), "id").alias("r")).select(*keys, "r.*")


def public_scorecard(rows: DataFrame, min_regime: int = 5) -> DataFrame:
    """Tier and regime come from the payload JSON; tier metrics with the coverage per regime beside them."""
    d = rows.select("*", F.coalesce(F.get_json_object("payload", "$.tier"), F.get_json_object("payload", "$.data_sufficiency.tier"), F.lit("unknown")).alias("p_tier"), F.get_json_object("payload", "$.regime").alias("p_regime"))
    a, m = C("actual_price"), C("forecast_median")
    agg = [F.count("*").alias("n"), F.avg(C("coverage_hit").cast("double")).alias("coverage"), F.avg("winkler").alias("mean_winkler"), F.avg(F.abs(a - m)).alias("mae"),
           F.avg(F.when((F.signum(a - C("origin_price")) != 0) & (F.signum(m - C("origin_price")) != 0), (F.signum(a - C("origin_price")) == F.signum(m - C("origin_price"))).cast("double"))).alias("direction")]
    both = d.rollup("p_tier", "p_regime").agg(*agg, F.grouping("p_tier").alias("gt"), F.grouping("p_regime").alias("gr"))
    return both.where(~((C("gr") == 0) & (C("n") < min_regime))).select(
        F.when(C("gt") == 1, "overall").otherwise(C("p_tier")).alias("tier"), F.when(C("gr") == 1, "all").otherwise(C("p_regime")).alias("regime"), "n", "coverage", "mean_winkler", "mae", "direction")


def pinball(y: Column, q: Column, level: float) -> Column:
    e = y - q
    return F.greatest(level * e, (level - 1) * e)


def next_day_summary(settled: DataFrame) -> DataFrame:
    d = with_earlier(settled.where((C("horizon") == 1) & (C("timeframe") == "1D")), ["symbol"], {"p1": 1})
    a = C("actual_price")
    pb = (pinball(a, C("forecast_low"), 0.1) + pinball(a, C("forecast_median"), 0.5) + pinball(a, C("forecast_high"), 0.9)) / 3
    return d.groupBy("symbol").agg(F.count("*").alias("n"), F.avg(C("coverage_hit").cast("double")).alias("coverage"), F.avg("winkler").alias("mean_winkler"), F.avg(pb).alias("mean_pinball"),
                                   ratio(F.sum(F.when(C("p1").isNotNull(), F.abs(a - C("forecast_median")))), F.sum(F.abs(a - C("p1")))).alias("mase"), F.count_distinct("tier").alias("tiers"))


def _score(df: DataFrame, prefix: str) -> DataFrame:
    d = with_earlier(df, ["symbol"], {"p1": 1})
    return d.groupBy("symbol").agg(F.count("*").alias(f"{prefix}_n"), F.avg(C("coverage_hit").cast("double")).alias(f"{prefix}_cov"), F.avg("winkler").alias(f"{prefix}_wink"),
                                   (F.avg(F.abs(C("actual_price") - C("forecast_median"))) / F.avg(F.abs(C("actual_price") - C("p1")))).alias(f"{prefix}_mase"))


def live_gap(live: DataFrame, backtest: DataFrame, min_live: int = 20) -> DataFrame:
    """Live against backtest quality per symbol: flags, severity, status and the widening factor."""
    d = _score(live, "l").join(_score(backtest, "b"), "symbol")
    gap = C("l_cov") - C("b_cov")
    f1, f2, f3 = F.abs(gap) > 0.10, ratio("l_wink", "b_wink") > 1.2, ratio("l_mase", "b_mase") > 1.2
    flags = f1.cast("int") + F.coalesce(f2.cast("int"), F.lit(0)) + F.coalesce(f3.cast("int"), F.lit(0))
    enough = (C("l_n") >= min_live) & (C("b_n") >= 2)
    d = d.withColumn("flags", F.when(enough, flags).otherwise(0)).withColumn("gap", gap)
    status = F.when(~enough, "insufficient_evidence").when(C("flags") == 0, "healthy").when(C("flags") >= 2, "degraded").otherwise("watch")
    return d.select("symbol", C("l_cov").alias("live_coverage"), C("b_cov").alias("backtest_coverage"), ratio("l_wink", "b_wink").alias("winkler_ratio"), ratio("l_mase", "b_mase").alias("mase_ratio"), "flags",
                    status.alias("status"), F.when(enough & (-C("gap") > 0.15), 1.0 - 2 * C("gap")).otherwise(1.0).alias("widen_factor"))


def tier_decay_streak(rows: DataFrame, expected: DataFrame, size: int = 20) -> DataFrame:
    """Disjoint windows of `size` outcomes per (tier, horizon, nominal); three bad windows in a row latch the factor.

    Ordinals come from a chunked count; a run of three is found by counting shifted bad windows, so no
    tier is ever ordered inside one task.
    """
    g = ["tier", "horizon", "confidence_level"]
    first = rows.groupBy("symbol", "target_date", "timeframe", *g).agg(F.min_by(F.struct("id", "coverage_hit"), "id").alias("r"))
    d = first.select(*g, "symbol", "target_date", C("r.coverage_hit").alias("hit"))
    d = chunks.running(d, g, F.trunc("target_date", "month"), ["target_date", "symbol"], {"k": ("sum", F.lit(1).cast("bigint"))})
    b = d.groupBy(*g, F.floor((C("k") - 1) / size).alias("b")).agg(F.avg(C("hit").cast("double")).alias("coverage"), F.count("*").alias("n")).where(C("n") == size)
    b = b.join(F.broadcast(expected), "tier").withColumn("bad", C("coverage") < C("expected") - 0.10)
    run = b.where("bad").select(*g, F.explode(F.array(C("b"), C("b") + 1, C("b") + 2)).alias("b")).groupBy(*g, "b").agg(F.count("*").alias("c")).where("c = 3").groupBy(*g).agg(F.min("b").alias("latched_at"))
    s = b.groupBy(*g).agg(F.count("*").alias("windows"), F.count_if("bad").alias("bad_windows"), F.max("b").alias("last"), F.max(F.when(~C("bad"), C("b"))).alias("good"))
    # A run may end beyond the last complete window; only windows that exist count.
    d = s.join(run, g, "left").withColumn("latched_at", F.when(C("latched_at") <= C("last"), C("latched_at")))
    return d.select(*g, "windows", "bad_windows", (C("last") - F.coalesce("good", F.lit(-1))).alias("streak"), "latched_at", F.when(C("latched_at").isNotNull(), 1.5).otherwise(1.0).alias("widen_factor"))


def apply_tier_controls(forecasts: DataFrame, controls: DataFrame) -> DataFrame:
    """Publication step: paused tiers abstain; a matching latched factor widens about the median, never twice."""
    paused = controls.groupBy("tier").agg(F.bool_or("paused").alias("_paused"))
    f = controls.groupBy("tier", "horizon", "confidence_level").agg(F.max("widen_factor").alias("_f"))
    d = forecasts.join(F.broadcast(paused), "tier", "left").join(F.broadcast(f), ["tier", "horizon", "confidence_level"], "left")
    r = F.when(C("_f") > 1, F.greatest(F.lit(1.0), C("_f") / C("applied_factor"))).otherwise(1.0)
    off = F.coalesce("_paused", F.lit(False))
    m = C("forecast_median")
    return d.select("symbol", "id", "tier", off.alias("abstained"), F.when(~off, m - (m - C("forecast_low")) * r).alias("low"), F.when(~off, m + (C("forecast_high") - m) * r).alias("high"),
                    F.greatest(F.coalesce("_f", F.lit(1.0)), C("applied_factor")).alias("factor"))


# Usable-day bounds of the tiers.
TIER_DAYS = ((30, "T0"), (120, "T1"), (500, "T2"), (2500, "T3"))


def tier_assign(stats: DataFrame) -> DataFrame:
    """stats(symbol, usable_days, validation_samples, median_turnover, zero_volume_ratio, surveillance)."""
    n, v = C("usable_days"), C("validation_samples")
    tier = F.when(F.lit(False), "")
    for bound, name in TIER_DAYS:
        tier = tier.when(n < bound, name)
    d = stats.withColumn("tier", tier.otherwise("T4"))
    t = C("tier")
    grade = (F.when(t == "T0", "none").when((t == "T1") & (v >= 5), "C").when(t == "T1", "none").when(t.isin("T3", "T4") & (v >= 100), "A").when(v >= 36, "B").when(v >= 18, "C").otherwise("none"))
    hz = (F.when(t == "T0", "").when(t == "T1", F.when(v >= 5, "1").otherwise("")).when(t == "T2", F.when(v >= 18, "1,5").otherwise("1")).when(t == "T3", F.when(v >= 36, "1,5,10,20").otherwise("1,5,10"))
          .otherwise(F.when(v >= 100, "1,5,10,20,60").otherwise("1,5,10,20")))
    mt, z = C("median_turnover"), C("zero_volume_ratio")
    liq = F.when(mt.isNull(), "unknown").when((mt >= 5e7) & (z < 0.01), "high").when((mt >= 1e7) & (z < 0.05), "normal").otherwise("low")
    flag = F.coalesce(F.upper("surveillance").rlike("ASM|GSM|SURVEILLANCE|GRADED"), F.lit(False))
    return d.select("symbol", "usable_days", "tier", grade.alias("evidence_grade"), hz.alias("horizons"), liq.alias("liquidity"), flag.alias("surveillance_flag"))


def alert_hit(cond: Column, threshold: Column, price: Column, low: Column, high: Column) -> Column:
    """Inclusive comparisons; forecast conditions read the published band."""
    return (F.when(cond == "ABOVE", price >= threshold).when(cond == "BELOW", price <= threshold).when(cond == "FORECAST_HIGH_ABOVE", high >= threshold)
            .when(cond == "FORECAST_LOW_BELOW", low <= threshold))


def alert_eval(alerts: DataFrame, prices: DataFrame, forecasts: DataFrame, now: Column, cooldown: int = 900) -> DataFrame:
    """Active alerts against the latest price and band; an alert inside its cooldown stays silent."""
    d = alerts.join(prices.select("symbol", "price"), "symbol", "left").join(forecasts.select("symbol", C("forecast_low").alias("lo"), C("forecast_high").alias("hi")), "symbol", "left")
    hit = F.coalesce(alert_hit(C("condition"), C("threshold"), C("price"), C("lo"), C("hi")), F.lit(False))
    cool = C("last_triggered").isNotNull() & (now.cast("double") - C("last_triggered").cast("timestamp").cast("double") < max(60, cooldown))
    return d.select("alert_id", "symbol", "condition", "threshold", hit.alias("hit"), (hit & ~cool).alias("triggered"))


# ---- sentiment -----------------------------------------------------------------------

# Token pattern and word lists of the lexicon scorer, and the label threshold.
TOKENS = r"[A-Za-z][A-Za-z'-]*"
POSITIVE_WORDS = ("advance", "advances", "beat", "beats", "benefit", "boom", "boost", "bullish", "buy", "confidence", "expands", "gain", "gains", "growth",
                  "high", "higher", "improve", "improves", "jump", "jumps", "outperform", "profit", "profits", "rally", "record", "rebound", "rise", "rises",
                  "strong", "success", "surge", "surges", "upgrade", "upside", "wins")
NEGATIVE_WORDS = ("bearish", "crash", "cut", "cuts", "decline", "declines", "downgrade", "drop", "drops", "fall", "falls", "fraud", "investigation", "loss",
                  "losses", "miss", "misses", "plunge", "recall", "risk", "risks", "sell", "slump", "weak", "warning", "warnings", "worse", "downside")
NEGATIONS = ("not", "no", "never", "without", "hardly")
INTENSIFIERS = ("very", "strongly", "sharply", "significantly", "massive")
LABEL_AT = 0.12


def sentiment_label(score: Column) -> Column:
    return F.when(score >= LABEL_AT, "Positive").when(score <= -LABEL_AT, "Negative").otherwise("Neutral")


def headline_sentiment(df: DataFrame, text: str) -> DataFrame:
    """Adds tokens count, score in [-1, 1] and label, with higher-order functions over the token array.

    A token is looked up once among all scored words; only those few are weighed with the two tokens before them.
    """
    low = lambda i: F.lower(F.try_element_at("_t", i))
    d = df.withColumn("_t", F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0)))
    d = d.withColumn("_at", F.filter(F.transform("_t", lambda tok, i: F.when(F.lower(tok).isin(*POSITIVE_WORDS, *NEGATIVE_WORDS), i + 1)), lambda i: i.isNotNull()))

    def value(i):
        base = F.when(low(i).isin(*POSITIVE_WORDS), 1.0).otherwise(-1.0)
        one, two = (F.when(i > k, low(F.greatest(i - k, F.lit(1)))) for k in (1, 2))
        no = F.coalesce(one.isin(*NEGATIONS), F.lit(False)) | F.coalesce(two.isin(*NEGATIONS), F.lit(False))
        return base * F.when(no, -1.0).otherwise(1.0) * F.when(one.isin(*INTENSIFIERS), 1.5).otherwise(1.0)

    raw = F.aggregate(F.transform("_at", value), F.lit(0.0), lambda a, v: a + v)
    n = F.size("_t")
    d = d.withColumn("tokens", n).withColumn("score", F.when(n > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw / F.sqrt(n.cast("double"))))).otherwise(0.0)).drop("_t", "_at")
    return d.withColumn("label", sentiment_label(C("score")))


def headline_rollup(scored: DataFrame, universe: DataFrame, k: int) -> DataFrame:
    """First k headlines per symbol with the mean over all of them; symbols without news are listed as failed."""
    w = Window.partitionBy("symbol").orderBy("doc_id")
    top = scored.withColumn("_r", F.row_number().over(w)).where(C("_r") <= k).groupBy("symbol").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string"))).alias("first_ids"))
    avg = scored.groupBy("symbol").agg(F.count("*").alias("headlines"), F.avg("score").alias("average_score"))
    d = universe.select("symbol").join(avg, "symbol", "left").join(top, "symbol", "left")
    return d.withColumn("failed", C("headlines").isNull())


def sentiment_history(snapshots: DataFrame, now: Column, lookback_days: int, stale_days: int = 7) -> DataFrame:
    d = snapshots.where(C("snapshot_at") >= now - F.expr(f"INTERVAL {lookback_days} DAYS"))
    last = d.groupBy("symbol").agg(F.max("snapshot_at").alias("_m"))
    return d.join(last, "symbol").select("symbol", "snapshot_at", "avg_score", sentiment_label(C("avg_score")).alias("label"), (C("_m") < now - F.expr(f"INTERVAL {stale_days} DAYS")).alias("stale"))


def horizon_consistency(runs: DataFrame, tol: float = 0.25) -> DataFrame:
    """runs(key, horizon, median, width_pct, price): direction, path and width conflicts across released horizons."""
    s = Span(("key",), ("horizon",))
    d = runs.where(C("price") > 0).withColumn("ret", (C("median") / C("price") - 1) * 100)
    sign = lambda x: F.when(x > tol, 1).when(x < -tol, -1).otherwise(0)
    d = d.select("*", sign(C("ret")).alias("sg"), s.lag("ret").alias("pr"), s.lag("width_pct").alias("pw"), F.last("ret").over(s.w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("far"))
    want = sign(C("far"))
    rev = ((want > 0) & (C("ret") < C("pr") - tol)) | ((want < 0) & (C("ret") > C("pr") + tol))
    g = d.groupBy("key").agg(F.count("*").alias("horizons"), F.max((C("sg") == 1).cast("int")).alias("up"), F.max((C("sg") == -1).cast("int")).alias("dn"), F.count_if(rev).alias("path_reversals"), F.count_if(C("width_pct") < C("pw") * 0.95).alias("narrowings")).where("horizons >= 2")
    g = g.withColumn("direction_conflict", C("up") + C("dn") > 1)
    score = F.greatest(F.lit(0), 100 - F.when(C("direction_conflict"), 40).otherwise(0) - F.least(F.lit(30), 15 * C("path_reversals")) - F.least(F.lit(20), 10 * C("narrowings")))
    return g.withColumn("score", score).withColumn("level", F.when(C("score") >= 80, "high").when(C("score") >= 55, "moderate").otherwise("low"))


# Weights of the confidence score.
CONFIDENCE = {"evidence": 40.0, "calibration": 25.0, "skill": 15.0, "agreement": 10.0, "data_quality": 10.0}
GRADE_POINTS = {"A": 40.0, "B": 28.0, "C": 22.0, "none": 0.0}


def confidence_score(rows: DataFrame) -> DataFrame:
    """rows(..., evidence_grade, coverage, nominal, improvement_pct, members array, reference, expected_vol_pct, drift, data_quality, blocked, skill)."""
    v = F.array_sort(F.filter("members", lambda x: x.isNotNull() & ~F.isnan(x)))

    def median(a):
        n = F.size(a)
        return (F.try_element_at(a, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(a, F.ceil((n + 1) / 2).cast("int"))) / 2

    d = rows.withColumn("_v", v).withColumn("_m", median(C("_v")))
    d = d.withColumn("_mad", median(F.array_sort(F.transform("_v", lambda x: F.abs(x - C("_m"))))))
    disp = C("_mad") / C("reference") * 100
    agree = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - disp / F.greatest(3 * C("expected_vol_pct"), F.lit(0.05))))
    up = F.size(F.filter("_v", lambda x: x > C("reference"))) / F.size("_v")
    factor = F.greatest(F.lit(0.1), 1 + 2 * F.greatest(F.lit(-0.5), F.least(F.lit(0.5), C("skill"))))
    prob = F.greatest(F.lit(0.05), F.least(F.lit(0.95), 0.5 + (up - 0.5) * factor))
    ev = F.lit(0.0)
    for g, p in GRADE_POINTS.items():
        ev = F.when(C("evidence_grade") == g, p).otherwise(ev)
    cal = F.greatest(F.lit(0.0), CONFIDENCE["calibration"] - 500 * F.abs(C("coverage") - C("nominal")))
    skill = F.when(C("improvement_pct") > 0, CONFIDENCE["skill"] * F.least(F.lit(1.0), C("improvement_pct") / 10)).otherwise(4.0)
    score = ev + cal + skill + CONFIDENCE["agreement"] * agree + CONFIDENCE["data_quality"] * C("data_quality")
    score = F.when(C("drift"), F.least(score, F.lit(30.0))).otherwise(score)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when(C("blocked"), F.least(score, F.lit(20.0))).otherwise(score)))
    d = d.withColumn("agreement", agree).withColumn("up_probability", prob).withColumn("score", score)
    return d.withColumn("level", F.when(C("score") >= 70, "high").when(C("score") >= 45, "moderate").otherwise("low")).drop("_v", "_m", "_mad")
