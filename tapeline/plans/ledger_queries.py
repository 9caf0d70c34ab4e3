"""Ledger, quality, decay and sentiment queries."""

from pyspark.sql import functions as F

from ..functions.span import BARS
from ..operators import ledger as lg
from .indicator_queries import W, full
from .registry import query

C = F.col
NOW = "2001-11-08"


def now():
    return F.lit(NOW).cast("date")


PEND = "pend AS (SELECT symbol, timeframe, horizon, id, origin_date, CASE WHEN id % 50 = 0 THEN NULL ELSE origin_date + 9 END AS target_date, forecast_low, forecast_median, forecast_high, confidence_level FROM ledger)"


def pending(t):
    return t.ledger.withColumn("target_date", F.when(C("id") % 50 != 0, F.date_add("origin_date", 9))).withColumn("actual_price", F.lit(None).cast("double"))


@query("pending_due", "symbol:s state:s rows:i oldest:d", f"WITH {PEND} SELECT symbol, CASE WHEN target_date IS NULL THEN 'missing_target' WHEN target_date > DATE '{NOW}' THEN 'not_due' ELSE 'due' END AS state, count(*) AS rows, min(target_date) AS oldest FROM pend GROUP BY ALL", "ledger")
def _(t):
    return lg.pending_due(pending(t), now()).groupBy("symbol", "state").agg(F.count("*").alias("rows"), F.min("target_date").alias("oldest"))


SET = f"""{PEND}, tb AS (SELECT symbol, ts, close, CASE WHEN dayofyear(ts) % 40 = 1 THEN 'unknown' ELSE 'main' END AS provider, dayofyear(ts) % 60 = 2 OR (month(ts) = 7 AND day(ts) BETWEEN 5 AND 28) AS stale FROM bars),
  st0 AS (SELECT p.*, b.ts AS bts, b.close AS bc, b.provider, b.stale, b.ts - p.target_date AS gap FROM (SELECT * FROM pend WHERE target_date <= DATE '{NOW}') p ASOF LEFT JOIN tb b ON p.symbol = b.symbol AND p.target_date <= b.ts),
  st AS (SELECT *, CASE WHEN bts IS NULL OR gap > 10 THEN 'target_data_absent' WHEN stale THEN 'stale_market_data' WHEN provider = 'unknown' THEN 'unverified_provider' END AS reason FROM st0),
  sx AS (SELECT *, CASE WHEN reason IS NULL THEN 'settled' WHEN reason = 'target_data_absent' AND DATE '{NOW}' - target_date < 0.25 THEN 'deferred' ELSE 'unverifiable' END AS status FROM st)"""


def trusted_bars(t):
    d = F.dayofyear("ts")
    stale = (d % 60 == 2) | ((F.month("ts") == 7) & F.dayofmonth("ts").between(5, 28))
    return t.bars.select("symbol", "ts", "close", F.when(d % 40 == 1, "unknown").otherwise("main").alias("provider"), stale.alias("is_stale"), F.lit(False).alias("is_demo"))


@query("settle_forward_asof", "symbol:s id:i status:s reason:s settled_price:f observed_at:d", f"WITH {SET} SELECT symbol, id, status, reason, CASE WHEN reason IS NULL THEN bc END AS settled_price, CASE WHEN reason IS NULL THEN bts END AS observed_at FROM sx", "ledger")
def _(t):
    return lg.settle_forward_asof(pending(t), trusted_bars(t), now())


@query("settle_quote_fallback", "symbol:s id:i status:s reason:s settled_price:f method:s",
       f"""WITH {SET}, q AS (SELECT symbol, arg_max(price, (qd, provider)) AS p, max(qd) AS qd FROM (SELECT symbol, provider, price, CASE provider WHEN 'S2' THEN DATE '2001-11-06' ELSE DATE '2001-11-07' END AS qd FROM quotes WHERE provider <> 'S0' AND NOT (provider = 'S1' AND symbol LIKE '%3')) GROUP BY symbol),
       z AS (SELECT sx.*, coalesce(reason = 'target_data_absent' AND DATE '{NOW}' - target_date <= 2 AND qd >= target_date AND DATE '{NOW}' - qd <= 2 AND p > 0, false) AS ok, p FROM sx LEFT JOIN q USING (symbol))
       SELECT symbol, id, CASE WHEN ok THEN 'settled' ELSE status END AS status, CASE WHEN NOT ok THEN reason END AS reason, CASE WHEN ok THEN p WHEN reason IS NULL THEN bc END AS settled_price, CASE WHEN ok THEN 'quote' WHEN status = 'settled' THEN 'history' END AS method FROM z""", "ledger quotes")
def _(t):
    """All providers: S0 delivers stale quotes, S1 demo ones for some symbols, S2 a day earlier."""
    p = C("provider")
    q = t.quotes.select("symbol", "price", F.when(p == "S2", "2001-11-06").otherwise("2001-11-07").cast("date").alias("ts"), "provider", (p == "S0").alias("is_stale"), ((p == "S1") & C("symbol").endswith("3")).alias("is_demo"))
    return lg.settle_quote_fallback(lg.settle_forward_asof(pending(t), trusted_bars(t), now()), q, now())


@query("score_outcome", "symbol:s id:i hit:b score:f2", "SELECT symbol, id, coverage_hit AS hit, winkler AS score FROM settled WHERE year(target_date) > 1996", "settled")
def _(t):
    return lg.score_outcome(t.ledger, t.ledger.where(F.year("target_date") <= 1996))


@query("official_rows", "symbol:s rows:i", "SELECT symbol, count(*) AS rows FROM settled WHERE id % 3 <> 0 AND id % 4 <> 1 AND id % 7 <> 2 AND id % 6 NOT IN (0, 5) GROUP BY symbol", "settled")
def _(t):
    i = C("id")
    r = t.settled.select("*", F.when(i % 3 != 0, "automatic").otherwise("manual").alias("settlement_source"), (i % 4 != 1).alias("official"), (i % 7 == 2).alias("is_stale"), F.lit(False).alias("is_demo"),
                         F.when(i % 6 == 0, "abstained").when(i % 6 == 5, "draft").when(i % 2 == 0, "published").otherwise("limited").alias("forecast_status"))
    return lg.official_rows(r).groupBy("symbol").agg(F.count("*").alias("rows"))


@query("outcome_counts", "user_id:i settled:i pending:i unverifiable:i total:i",
       "SELECT id % 20 AS user_id, count(*) FILTER (WHERE id % 3 = 0) AS settled, count(*) FILTER (WHERE id % 3 = 1) AS pending, count(*) FILTER (WHERE id % 3 = 2) AS unverifiable, count(*) AS total FROM ledger GROUP BY 1", "ledger")
def _(t):
    i = C("id")
    return lg.outcome_counts(t.ledger.select((i % 20).alias("user_id"), F.when(i % 3 == 0, "settled").when(i % 3 == 1, "pending").otherwise("unverifiable").alias("status")), ["settled", "pending", "unverifiable"])


@query("interval_quality", "window_name:s timeframe:s horizon:i settled_forecasts:i empirical_coverage:f6 nominal_coverage:f mean_winkler:f2 coverage_gap:f6 state:s",
       """WITH s AS (SELECT * REPLACE (1 + id % 3 AS horizon), CASE WHEN id % 2 = 0 THEN '1y' ELSE '5y' END AS window_name FROM settled), g AS (SELECT window_name, timeframe, horizon, count(*) AS settled_forecasts, avg(CAST(coverage_hit AS DOUBLE)) AS empirical_coverage, avg(confidence_level) AS nominal_coverage, avg(winkler) AS mean_winkler FROM s GROUP BY GROUPING SETS ((), (window_name, timeframe), (horizon)))
       SELECT *, empirical_coverage - nominal_coverage AS coverage_gap, CASE WHEN empirical_coverage - nominal_coverage < -0.05 THEN 'under_coverage' WHEN empirical_coverage - nominal_coverage > 0.05 THEN 'over_coverage' ELSE 'stable' END AS state FROM g""", "settled")
def _(t):
    return lg.interval_quality(t.settled.withColumn("horizon", 1 + C("id") % 3).withColumn("window_name", F.when(C("id") % 2 == 0, "1y").otherwise("5y")))


@query("group_drift", "symbol:s settled_samples:i rolling_coverage:f6 coverage_gap:f6 mase:f6 directional_accuracy:f6 naive_directional_accuracy:f6 drift_detected:b severity:s reasons:s",
       """WITH s AS (SELECT *, lag(actual_price) OVER w AS p1, lag(actual_price, 2) OVER w AS p2, row_number() OVER (PARTITION BY symbol ORDER BY target_date DESC) AS d FROM settled WINDOW w AS (PARTITION BY symbol ORDER BY target_date)),
       x AS (SELECT *, sign(actual_price - p1) AS sd, sign(forecast_median - (forecast_low + forecast_high) / 2) AS md, sign(p1 - p2) AS nd FROM s),
       g AS (SELECT symbol, count(*) AS settled_samples, avg(CAST(coverage_hit AS DOUBLE)) FILTER (WHERE d <= 20) AS rolling_coverage, avg(CAST(coverage_hit AS DOUBLE)) FILTER (WHERE d <= 20) - 0.8 AS coverage_gap, sum(abs(actual_price - forecast_median)) / sum(abs(actual_price - p1)) AS mase,
         avg(CAST(sd = md AS DOUBLE)) FILTER (WHERE sd <> 0 AND md <> 0) AS directional_accuracy, avg(CAST(sd = nd AS DOUBLE)) FILTER (WHERE sd <> 0 AND nd <> 0) AS naive_directional_accuracy FROM x GROUP BY symbol)
       SELECT *, coverage_gap < -0.1 OR mase >= 1 OR directional_accuracy < 0.45 AS drift_detected, CASE WHEN coverage_gap < -0.1 OR mase >= 1 THEN 'high' WHEN directional_accuracy < 0.45 THEN 'low' END AS severity,
       concat_ws(',', CASE WHEN coverage_gap < -0.1 THEN 'coverage' END, CASE WHEN mase >= 1 THEN 'mase' END, CASE WHEN directional_accuracy < 0.45 THEN 'direction' END) AS reasons FROM g""", "settled")
def _(t):
    # The shifted medians sit exactly on the midpoint for one id in eleven; take those apart from float noise.
    return lg.group_drift(t.settled)


@query("residual_drift", "symbol:s hist_mean:f hist_std:f recent_mean:f threshold:f status:s",
       """WITH r AS (SELECT symbol, abs(actual_price - forecast_median) AS r, row_number() OVER (PARTITION BY symbol ORDER BY target_date DESC) AS d FROM settled), g AS (SELECT symbol, avg(r) FILTER (WHERE d > 20) AS hist_mean, stddev_pop(r) FILTER (WHERE d > 20) AS hist_std, avg(r) FILTER (WHERE d <= 20) AS recent_mean FROM r GROUP BY symbol)
       SELECT *, hist_mean + 2 * hist_std AS threshold, CASE WHEN recent_mean > greatest(hist_mean + 2 * hist_std, hist_mean * 1.35) THEN 'drift' ELSE 'stable' END AS status FROM g""", "settled")
def _(t):
    from ..functions.span import Span
    return lg.residual_drift(t.settled.withColumn("residual", C("actual_price") - C("forecast_median")), Span(("symbol",), ("target_date",)))


@query("latest_health", "symbol:s tier:s id:i winkler:f2 coverage_hit:b", "SELECT symbol, tier, max(id) AS id, arg_max(winkler, id) AS winkler, arg_max(coverage_hit, id) AS coverage_hit FROM settled GROUP BY symbol, tier", "settled")
def _(t):
    return lg.latest_health(t.settled.select("symbol", "tier", "id", "winkler", "coverage_hit"), ["symbol", "tier"])


@query("public_scorecard", "tier:s regime:s n:i coverage:f6 mean_winkler:f2 mae:f2 direction:f6",
       """WITH s AS (SELECT *, forecast_low / 0.6e0 AS op FROM settled), x AS (SELECT *, sign(actual_price - op) AS a, CASE id % 11 WHEN 5 THEN 0 ELSE sign(id % 11 - 5) END AS m FROM s)
       SELECT coalesce(tier, 'overall') AS tier, coalesce(regime, 'all') AS regime, count(*) AS n, avg(CAST(coverage_hit AS DOUBLE)) AS coverage, avg(winkler) AS mean_winkler, avg(abs(actual_price - forecast_median)) AS mae, avg(CAST(a = m AS DOUBLE)) FILTER (WHERE a <> 0 AND m <> 0) AS direction FROM x GROUP BY ROLLUP (tier, regime)""", "settled")
def _(t):
    # The origin price is rebuilt from the band; the exact-median rows are pinned to it so that signs are not float noise.
    s = t.settled.withColumn("origin_price", F.when(C("id") % 11 == 5, C("forecast_median")).otherwise(C("forecast_low") / 0.6))
    s = s.withColumn("payload", F.to_json(F.struct(F.when(C("id") % 2 == 0, C("tier")).alias("tier"), F.struct("tier").alias("data_sufficiency"), "regime")))
    return lg.public_scorecard(s)


@query("next_day_summary", "symbol:s n:i coverage:f6 mean_winkler:f2 mean_pinball:f mase:f6 tiers:i",
       """WITH s AS (SELECT *, lag(actual_price) OVER (PARTITION BY symbol ORDER BY target_date) AS p1 FROM settled) SELECT symbol, count(*) AS n, avg(CAST(coverage_hit AS DOUBLE)) AS coverage, avg(winkler) AS mean_winkler,
       avg((greatest(0.1 * (actual_price - forecast_low), -0.9 * (actual_price - forecast_low)) + greatest(0.5 * (actual_price - forecast_median), -0.5 * (actual_price - forecast_median)) + greatest(0.9 * (actual_price - forecast_high), -0.1 * (actual_price - forecast_high))) / 3) AS mean_pinball,
       sum(abs(actual_price - forecast_median)) FILTER (WHERE p1 IS NOT NULL) / sum(abs(actual_price - p1)) AS mase, count(DISTINCT tier) AS tiers FROM s GROUP BY symbol""", "settled")
def _(t):
    return lg.next_day_summary(t.settled)


def sc(cond, p):
    return f"{p} AS (SELECT symbol, count(*) AS n, avg(CAST(coverage_hit AS DOUBLE)) AS cov, avg(winkler) AS wk, avg(abs(actual_price - forecast_median)) / avg(abs(actual_price - p1)) AS ms FROM (SELECT *, lag(actual_price) OVER (PARTITION BY symbol ORDER BY target_date) AS p1 FROM settled WHERE {cond}) GROUP BY symbol)"


@query("live_gap", "symbol:s live_coverage:f6 backtest_coverage:f6 winkler_ratio:f6 mase_ratio:f6 flags:i status:s widen_factor:f6",
       f"""WITH {sc('year(target_date) >= 2001', 'l')}, {sc('year(target_date) < 2001', 'b')}, j AS (SELECT symbol, l.cov AS live_coverage, b.cov AS backtest_coverage, l.wk / b.wk AS winkler_ratio, l.ms / b.ms AS mase_ratio, CAST(abs(l.cov - b.cov) > 0.1 AS INT) + CAST(l.wk / b.wk > 1.2 AS INT) + CAST(l.ms / b.ms > 1.2 AS INT) AS flags FROM l JOIN b USING (symbol))
       SELECT *, CASE WHEN flags = 0 THEN 'healthy' WHEN flags >= 2 THEN 'degraded' ELSE 'watch' END AS status, CASE WHEN backtest_coverage - live_coverage > 0.15 THEN 1 + 2 * (backtest_coverage - live_coverage) ELSE 1 END AS widen_factor FROM j""", "settled")
def _(t):
    return lg.live_gap(t.settled.where(F.year("target_date") >= 2001), t.settled.where(F.year("target_date") < 2001))


EXPECT = [("T0", 0.35), ("T1", 0.30), ("T2", 0.45), ("T3", 0.40), ("T4", 0.20)]
DEC = """dd AS (SELECT tier, horizon, confidence_level, CAST(coverage_hit AS DOUBLE) AS h, (row_number() OVER (PARTITION BY tier ORDER BY target_date, symbol) - 1) // 20 AS b FROM settled), db AS (SELECT tier, horizon, confidence_level, b, avg(h) AS c FROM dd GROUP BY ALL HAVING count(*) = 20),
  de AS (SELECT db.*, c < e - 0.1e0 AS bad FROM db JOIN (VALUES ('T0', 0.35e0), ('T1', 0.3e0), ('T2', 0.45e0), ('T3', 0.4e0), ('T4', 0.2e0)) v(tier, e) USING (tier)), df AS (SELECT *, bad AND lag(bad) OVER w AND lag(bad, 2) OVER w AS r3 FROM de WINDOW w AS (PARTITION BY tier ORDER BY b)),
  dg AS (SELECT tier, horizon, confidence_level, count(*) AS windows, count(*) FILTER (WHERE bad) AS bad_windows, max(b) - coalesce(max(b) FILTER (WHERE NOT bad), -1) AS streak, min(b) FILTER (WHERE r3) AS latched_at FROM df GROUP BY ALL)"""


@query("tier_decay_streak", "tier:s horizon:i confidence_level:f windows:i bad_windows:i streak:i latched_at:i widen_factor:f", f"WITH {DEC} SELECT *, CASE WHEN latched_at IS NULL THEN 1 ELSE 1.5 END AS widen_factor FROM dg", "settled")
def _(t):
    return lg.tier_decay_streak(t.settled, t.spark.createDataFrame(EXPECT, "tier string, expected double"))


@query("apply_tier_controls", "symbol:s id:i tier:s abstained:b low:f high:f factor:f",
       f"""WITH {DEC}, x AS (SELECT s.symbol, s.id, s.tier, s.forecast_low, s.forecast_median AS m, s.forecast_high, CASE WHEN s.id % 4 = 0 THEN 1.2e0 ELSE 1e0 END AS ap, CASE WHEN latched_at IS NULL THEN 1e0 ELSE 1.5e0 END AS f, s.tier = 'T3' AS pz FROM settled s JOIN dg USING (tier))
       SELECT symbol, id, tier, pz AS abstained, CASE WHEN NOT pz THEN m - (m - forecast_low) * CASE WHEN f > 1 THEN greatest(1, f / ap) ELSE 1 END END AS low, CASE WHEN NOT pz THEN m + (forecast_high - m) * CASE WHEN f > 1 THEN greatest(1, f / ap) ELSE 1 END END AS high, greatest(f, ap) AS factor FROM x""", "settled")
def _(t):
    c = lg.tier_decay_streak(t.settled, t.spark.createDataFrame(EXPECT, "tier string, expected double")).withColumn("paused", C("tier") == "T3")
    return lg.apply_tier_controls(t.settled.withColumn("applied_factor", F.when(C("id") % 4 == 0, 1.2).otherwise(1.0)), c)


@query("tier_assign", "symbol:s usable_days:i tier:s evidence_grade:s horizons:s liquidity:s surveillance_flag:b",
       """WITH s AS (SELECT symbol, count(*) AS n, count(*) // 12 AS v, quantile_cont(close * volume, 0.5) AS mt, avg(CASE WHEN volume = 0 THEN 1e0 ELSE 0 END) AS z FROM bars GROUP BY symbol)
       SELECT symbol, n AS usable_days, CASE WHEN n < 500 THEN 'T2' WHEN n < 2500 THEN 'T3' ELSE 'T4' END AS tier, CASE WHEN v >= 100 THEN 'A' WHEN v >= 36 THEN 'B' WHEN v >= 18 THEN 'C' ELSE 'none' END AS evidence_grade, CASE WHEN v >= 36 THEN '1,5,10,20' ELSE '1,5,10' END AS horizons,
       CASE WHEN mt >= 5e7 AND z < 0.01 THEN 'high' WHEN mt >= 1e7 AND z < 0.05 THEN 'normal' ELSE 'low' END AS liquidity, symbol LIKE '%1' AS surveillance_flag FROM s""")
def _(t):
    s = t.bars.groupBy("symbol").agg(F.count("*").alias("usable_days"), F.floor(F.count("*") / 12).alias("validation_samples"), F.percentile(C("close") * C("volume"), F.lit(0.5)).alias("median_turnover"), F.avg((C("volume") == 0).cast("double")).alias("zero_volume_ratio"))
    return lg.tier_assign(s.withColumn("surveillance", F.when(C("symbol").endswith("1"), "stage asm")))


@query("alert_eval", "alert_id:i symbol:s condition:s hit:b triggered:b",
       """WITH l AS (SELECT symbol, arg_max(close, ts) AS p FROM bars GROUP BY symbol), a AS (SELECT o_orderkey AS alert_id, 'Brand#' || (o_custkey % 25 + 1) AS symbol, ['ABOVE','BELOW','FORECAST_HIGH_ABOVE','FORECAST_LOW_BELOW'][o_orderkey % 4 + 1] AS condition, o_totalprice / 50 AS threshold, o_orderkey % 3 = 0 AS cool FROM orders)
       SELECT alert_id, symbol, condition, h AS hit, h AND NOT cool AS triggered FROM (SELECT a.*, CASE condition WHEN 'ABOVE' THEN p >= threshold WHEN 'BELOW' THEN p <= threshold WHEN 'FORECAST_HIGH_ABOVE' THEN p * 1.4e0 >= threshold ELSE p * 0.6e0 <= threshold END AS h FROM a JOIN l USING (symbol))""", "bars orders")
def _(t):
    k = C("o_orderkey")
    cond = F.element_at(F.array(*[F.lit(x) for x in ("ABOVE", "BELOW", "FORECAST_HIGH_ABOVE", "FORECAST_LOW_BELOW")]), (k % 4 + 1).cast("int"))
    at = F.lit("2001-11-01 10:00:00").cast("timestamp")
    a = t.raw("orders").select(k.alias("alert_id"), F.concat(F.lit("Brand#"), (C("o_custkey") % 25 + 1).cast("string")).alias("symbol"), cond.alias("condition"), (C("o_totalprice") / 50).alias("threshold"),
                               F.when(k % 3 == 0, at - F.expr("INTERVAL 5 MINUTES")).when(k % 3 == 1, at - F.expr("INTERVAL 1 HOUR")).alias("last_triggered"))
    last = t.bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))
    return lg.alert_eval(a, last, last.select("symbol", (C("price") * 0.6).alias("forecast_low"), (C("price") * 1.4).alias("forecast_high")), at)


def words(ws):
    return "[" + ",".join(f"'{w}'" for w in ws) + "]"


SENT = f"""tk AS (SELECT doc_id, symbol, publisher, regexp_extract_all(title, '{lg.TOKENS.replace("'", "''")}') AS tt FROM headlines), tl AS (SELECT doc_id, symbol, publisher, list_transform(tt, lambda x: lower(x)) AS t FROM tk),
  tu AS (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM tl), tw AS (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS p1, lag(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS p2 FROM tu),
  tv AS (SELECT doc_id, sum(CASE WHEN list_contains({words(lg.POSITIVE_WORDS)}, w) THEN 1 WHEN list_contains({words(lg.NEGATIVE_WORDS)}, w) THEN -1 ELSE 0 END * CASE WHEN coalesce(list_contains({words(lg.NEGATIONS)}, p1), false) OR coalesce(list_contains({words(lg.NEGATIONS)}, p2), false) THEN -1 ELSE 1 END * CASE WHEN coalesce(list_contains({words(lg.INTENSIFIERS)}, p1), false) THEN 1.5e0 ELSE 1 END) AS raw, count(*) AS n FROM tw GROUP BY doc_id),
  snt AS (SELECT doc_id, symbol, publisher, coalesce(n, 0) AS tokens, CASE WHEN n > 0 THEN greatest(-1, least(1, raw / sqrt(n))) ELSE 0 END AS score FROM tl LEFT JOIN tv USING (doc_id))"""


@query("headline_sentiment", "doc_id:i symbol:s tokens:i score:f6 label:s", f"WITH {SENT} SELECT *, CASE WHEN score >= 0.12 THEN 'Positive' WHEN score <= -0.12 THEN 'Negative' ELSE 'Neutral' END AS label FROM snt", "headlines")
def _(t):
    return lg.headline_sentiment(t.headlines, "title")


@query("headline_rollup", "symbol:s headlines:i average_score:f6 first_ids:s failed:b",
       f"WITH {SENT}, u AS (SELECT symbol FROM instruments UNION ALL SELECT 'NONE'), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY doc_id) AS k FROM snt), g AS (SELECT symbol, count(*) AS headlines, avg(score) AS average_score, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (WHERE k <= 5) AS first_ids FROM r GROUP BY symbol) SELECT symbol, headlines, average_score, first_ids, headlines IS NULL AS failed FROM u LEFT JOIN g USING (symbol)", "headlines instruments")
def _(t):
    u = t.instruments.select("symbol").unionByName(t.raw("region").where("r_regionkey = 0").select(F.lit("NONE").alias("symbol")))
    return lg.headline_rollup(lg.headline_sentiment(t.headlines, "title"), u, 5)


@query("sentiment_history", "symbol:s snapshot_at:t avg_score:f6 label:s stale:b",
       f"""WITH {SENT}, s AS (SELECT symbol, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (doc_id % 90) AS snapshot_at, avg(score) AS avg_score FROM snt GROUP BY ALL), f AS (SELECT * FROM s WHERE snapshot_at >= TIMESTAMP '2024-03-30' - INTERVAL 60 DAY)
       SELECT symbol, snapshot_at, avg_score, CASE WHEN avg_score >= 0.12 THEN 'Positive' WHEN avg_score <= -0.12 THEN 'Negative' ELSE 'Neutral' END AS label, max(snapshot_at) OVER (PARTITION BY symbol) < TIMESTAMP '2024-03-30' - INTERVAL 7 DAY AS stale FROM f""", "headlines")
def _(t):
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((C("doc_id") % 90).cast("int"))
    s = lg.headline_sentiment(t.headlines, "title").groupBy("symbol", at.alias("snapshot_at")).agg(F.avg("score").alias("avg_score"))
    return lg.sentiment_history(s, F.lit("2024-03-30").cast("timestamp"), 60)


@query("confidence_score", "symbol:s ts:d agreement:f6 up_probability:f6 score:f level:s",
       f"""WITH x AS (SELECT symbol, ts, close, [close * 1.01e0, {full(5, 'avg(close)')}, {full(10, 'avg(close)')}] AS mm, day(ts) AS d FROM bars), y AS (SELECT *, list_filter(mm, lambda v: v IS NOT NULL) AS m FROM x), z AS (SELECT *, list_median(list_transform(m, lambda v: abs(v - list_median(m)))) / close * 100 AS disp, len(list_filter(m, lambda v: v > close)) / len(m) AS up FROM y),
       c AS (SELECT *, greatest(0, least(1, 1 - disp / 60)) AS agreement, greatest(0.05, least(0.95, 0.5 + (up - 0.5) * (1 + 2 * (d - 15) / 100e0))) AS up_probability FROM z),
       e AS (SELECT *, CASE d % 4 WHEN 0 THEN 40 WHEN 1 THEN 28 WHEN 2 THEN 22 ELSE 0 END + greatest(0, 25 - 500 * abs(0.8e0 + d / 1000e0 - 0.8e0)) + CASE WHEN d - 10 > 0 THEN 15 * least(1, (d - 10) / 10e0) ELSE 4 END + 10 * agreement + 9e0 AS s FROM c),
       f AS (SELECT *, CASE WHEN d % 9 = 0 THEN least(CASE WHEN d % 7 = 0 THEN least(s, 30) ELSE s END, 20) WHEN d % 7 = 0 THEN least(s, 30) ELSE s END AS score FROM e) SELECT symbol, ts, agreement, up_probability, greatest(0, least(100, score)) AS score, CASE WHEN score >= 70 THEN 'high' WHEN score >= 45 THEN 'moderate' ELSE 'low' END AS level FROM f""")
def _(t):
    d = F.dayofmonth("ts")
    r = t.bars.select("symbol", "ts", C("close").alias("reference"), F.array(C("close") * 1.01, BARS.mean("close", 5), BARS.mean("close", 10)).alias("members"), F.when(d % 4 == 0, "A").when(d % 4 == 1, "B").when(d % 4 == 2, "C").otherwise("none").alias("evidence_grade"),
                      (0.8 + d / 1000.0).alias("coverage"), F.lit(0.8).alias("nominal"), (d - 10).cast("double").alias("improvement_pct"), F.lit(20.0).alias("expected_vol_pct"), (d % 7 == 0).alias("drift"), F.lit(0.9).alias("data_quality"), (d % 9 == 0).alias("blocked"), ((d - 15) / 100.0).alias("skill"))
    return lg.confidence_score(r)


@query("horizon_consistency", "key:s horizons:i direction_conflict:b path_reversals:i narrowings:i score:i level:s",
       f"""WITH b AS (SELECT symbol || '@' || CAST(ts AS VARCHAR) AS key, close AS price, {full(5, 'avg(close)')} AS m1, {full(10, 'avg(close)')} AS m2, {full(20, 'avg(close)')} AS m3, {full(5, 'stddev_pop(close)')} AS s1, {full(10, 'stddev_pop(close)')} AS s2, {full(20, 'stddev_pop(close)')} AS s3 FROM bars),
       u AS (SELECT key, price, unnest([1, 5, 20]) AS h, unnest([m1, m2, m3]) AS m, unnest([s1, s2, s3]) AS s FROM b WHERE m3 IS NOT NULL), r AS (SELECT *, (m / price - 1) * 100 AS ret, s / price * 100 AS wd FROM u),
       x AS (SELECT *, lag(ret) OVER w AS pr, lag(wd) OVER w AS pw, max(CASE WHEN h = 20 THEN ret END) OVER (PARTITION BY key) AS far FROM r WINDOW w AS (PARTITION BY key ORDER BY h)),
       g AS (SELECT key, count(*) AS horizons, max(CAST(ret > 0.25 AS INT)) + max(CAST(ret < -0.25 AS INT)) > 1 AS direction_conflict, count(*) FILTER (WHERE (far > 0.25 AND ret < pr - 0.25) OR (far < -0.25 AND ret > pr + 0.25)) AS path_reversals, count(*) FILTER (WHERE wd < pw * 0.95) AS narrowings FROM x GROUP BY key),
       z AS (SELECT *, greatest(0, 100 - CASE WHEN direction_conflict THEN 40 ELSE 0 END - least(30, 15 * path_reversals) - least(20, 10 * narrowings)) AS score FROM g) SELECT *, CASE WHEN score >= 80 THEN 'high' WHEN score >= 55 THEN 'moderate' ELSE 'low' END AS level FROM z""")
def _(t):
    B = BARS
    d = t.bars.select(F.concat_ws("@", "symbol", C("ts").cast("string")).alias("key"), C("close").alias("price"), *[B.mean("close", n).alias(f"m{n}") for n in (5, 10, 20)], *[B.full(n, F.stddev_pop("close"), "close").alias(f"s{n}") for n in (5, 10, 20)]).where("m20 is not null")
    r = d.withColumn("x", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), C(f"m{n}").alias("median"), (C(f"s{n}") / C("price") * 100).alias("width_pct")) for h, n in ((1, 5), (5, 10), (20, 20))])))
    return lg.horizon_consistency(r.select("key", "price", "x.*"))
