"""Market-context queries."""

from pyspark.sql import functions as F

from ..operators import context as cx
from ..operators.indicators import with_ema, with_rsi, change
from .indicator_queries import ATR_CTES, ADX_CTES, MACD_CTES, W, ewm_sql, fr, full, rsi_ctes
from .registry import query

C = F.col
P20 = fr(20)
BM = """mk AS (SELECT ts, close / lag(close) OVER (ORDER BY ts) - 1 AS mret FROM index_bars), bm AS (SELECT * FROM (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS ret FROM bars) JOIN mk USING (ts) WHERE ret IS NOT NULL AND mret IS NOT NULL)"""


@query("rolling_beta", "symbol:s ts:d beta_20:f beta_60:f", f"WITH {BM} SELECT symbol, ts, {full(20, 'covar_samp(ret, mret)', 'ret')} / var_samp(mret) OVER {fr(20)} AS beta_20, {full(60, 'covar_samp(ret, mret)', 'ret')} / var_samp(mret) OVER {fr(60)} AS beta_60 FROM bm", "bars index_bars")
def _(t):
    d = cx.with_market_return(t.bars, t.index_bars)
    return d.select("symbol", "ts", cx.rolling_beta(d, 20).alias("beta_20"), cx.rolling_beta(d, 60).alias("beta_60"))


@query("rolling_corr", "symbol:s ts:d corr_20:f", f"WITH {BM} SELECT symbol, ts, {full(20, 'corr(ret, mret)', 'ret')} AS corr_20 FROM bm", "bars index_bars")
def _(t):
    d = cx.with_market_return(t.bars, t.index_bars)
    return d.select("symbol", "ts", cx.rolling_corr(d, 20).alias("corr_20"))


def chg(val, h, part=""):
    return f"{val} / lag({val}, {h}) OVER ({part} ORDER BY ts) - 1"


@query("market_features", "symbol:s sector:s index_return_1d:f6 index_return_5d:f6 index_return_20d:f6 sector_return_1d:f6 sector_return_5d:f6 sector_return_20d:f6 relative_strength_20d:f6 vix_level:f vix_change_1d:f6 vix_change_5d:f6 vix_percentile:f6",
       f"""WITH ix AS (SELECT {chg('close', 1)} AS a, {chg('close', 5)} AS b, {chg('close', 20)} AS c, ts FROM index_bars), il AS (SELECT * FROM ix ORDER BY ts DESC LIMIT 1), sc AS (SELECT sector, ts, avg(close) AS close FROM bars JOIN instruments USING (symbol) WHERE sector IS NOT NULL GROUP BY sector, ts),
       sx AS (SELECT sector, ts, {chg('close', 1, 'PARTITION BY sector')} AS a, {chg('close', 5, 'PARTITION BY sector')} AS b, {chg('close', 20, 'PARTITION BY sector')} AS c FROM sc), sl AS (SELECT sector, arg_max(a, ts) AS a, arg_max(b, ts) AS b, arg_max(c, ts) AS c FROM sx GROUP BY sector),
       vx AS (SELECT ts, CAST(members AS DOUBLE) + close / 1000 AS v FROM index_bars), vl AS (SELECT ts, v, {chg('v', 1)} AS a, {chg('v', 5)} AS b FROM vx ORDER BY ts DESC LIMIT 1)
       SELECT symbol, sector, il.a AS index_return_1d, il.b AS index_return_5d, il.c AS index_return_20d, sl.a AS sector_return_1d, sl.b AS sector_return_5d, sl.c AS sector_return_20d, sl.c - il.c AS relative_strength_20d, vl.v AS vix_level, vl.a AS vix_change_1d, vl.b AS vix_change_5d,
       (SELECT avg(CASE WHEN vx.v < vl.v THEN 1e0 ELSE 0 END) FROM vx, vl) AS vix_percentile FROM instruments LEFT JOIN sl USING (sector) CROSS JOIN il CROSS JOIN vl""", "bars index_bars instruments")
def _(t):
    vix = t.index_bars.select("ts", (C("members").cast("double") + C("close") / 1000).alias("value"))
    return cx.market_features(t.bars, t.index_bars, t.instruments, vix)


@query("point_in_time_record", "symbol:s origin:d as_of:d pe:f",
       """WITH o AS (SELECT symbol, ts AS origin FROM bars), r AS (SELECT symbol, ts AS as_of, close AS pe FROM bars WHERE day(ts) = 15 AND symbol <> 'Brand#5' AND year(ts) > 1995) SELECT o.symbol, origin, r.as_of, coalesce(r.pe, 7e0) AS pe FROM o ASOF LEFT JOIN r ON o.symbol = r.symbol AND o.origin >= r.as_of""")
def _(t):
    r = t.bars.where((F.dayofmonth("ts") == 15) & (C("symbol") != "Brand#5") & (F.year("ts") > 1995)).select("symbol", C("ts").alias("as_of"), F.lit(1).alias("seq"), C("close").alias("pe"))
    u = t.instruments.select("symbol", F.lit(None).cast("date").alias("as_of"), F.lit(0).alias("seq"), F.lit(7.0).alias("pe"))
    return cx.point_in_time_record(t.bars.select("symbol", C("ts").alias("origin")), r.unionByName(u), "symbol", ["pe"])


@query("asof_align", "symbol:s origin:d name:s as_of:d rows:i status:s",
       """WITH o AS (SELECT symbol, max(ts) - 400 AS origin FROM bars WHERE symbol <> 'Brand#1' GROUP BY symbol UNION ALL SELECT 'Brand#1', DATE '1994-12-31'), c AS (SELECT 'market_index' AS name, ts FROM index_bars UNION ALL SELECT 'volatility_index', ts FROM index_bars WHERE day(ts) = 1)
       SELECT symbol, origin, name, max(ts) AS as_of, count(ts) AS rows, CASE WHEN count(ts) = 0 THEN 'unavailable' ELSE 'available' END AS status FROM (SELECT o.*, n.name FROM o CROSS JOIN (SELECT DISTINCT name FROM c) n) x LEFT JOIN c USING (name) WHERE TRUE AND (c.ts IS NULL OR c.ts <= origin OR origin < DATE '1995-01-01') GROUP BY symbol, origin, name HAVING origin >= DATE '1995-01-01'
       UNION ALL SELECT 'Brand#1', DATE '1994-12-31', name, NULL, 0, 'unavailable' FROM (SELECT DISTINCT name FROM c)""", "bars index_bars")
def _(t):
    o = t.bars.where("symbol <> 'Brand#1'").groupBy("symbol").agg(F.date_sub(F.max("ts"), 400).alias("origin")).unionByName(
        t.instruments.where("symbol = 'Brand#1'").select("symbol", F.lit("1994-12-31").cast("date").alias("origin")))
    c = t.index_bars.select(F.lit("market_index").alias("name"), "ts").unionByName(t.index_bars.where(F.dayofmonth("ts") == 1).select(F.lit("volatility_index").alias("name"), "ts"))
    return cx.asof_align(o, c)


ND = f"""nd0 AS (SELECT *, close / lag(close) OVER w - 1 AS r1, close / lag(close, 3) OVER w - 1 AS r3, open / lag(close) OVER w - 1 AS g, (high - low) / close AS rg, (close - low) / nullif(high - low, 0) AS cl, volume / nullif({full(20, 'avg(volume)')}, 0) AS vr FROM bars {W}),
  nd AS (SELECT symbol, ts, r1 AS return_1, r3 AS return_3, g AS gap_last, {full(20, 'avg(g)', 'g')} AS gap_mean_20, {full(20, 'stddev_samp(g)', 'g')} AS gap_std_20, {full(3, 'avg(rg)', 'rg')} AS range_3, {full(5, 'avg(r1 * r1)', 'r1')} AS rv_5, {full(22, 'avg(r1 * r1)', 'r1')} AS rv_22, close / open - 1 AS intraday_return, coalesce(cl, 0.5) AS close_location, coalesce(vr, 0) AS volume_ratio FROM nd0)"""


@query("asof_tolerance", "symbol:s ts:d return_1:f return_3:f gap_last:f gap_mean_20:f gap_std_20:f range_3:f rv_5:f rv_22:f intraday_return:f close_location:f6 volume_ratio:f sentiment:f sentiment_available:f",
       f"""WITH {ND}, s AS (SELECT symbol, CAST(ts AS TIMESTAMP) + INTERVAL 9 HOUR AS sts, ln(close) AS v FROM bars WHERE day(ts) % 4 = 1), j AS (SELECT nd.*, CAST(nd.ts AS TIMESTAMP) + INTERVAL 10 HOUR AS ca FROM nd)
       SELECT j.*, CASE WHEN s.sts >= ca - INTERVAL 24 HOUR THEN v ELSE 0 END AS sentiment, CASE WHEN s.sts >= ca - INTERVAL 24 HOUR THEN 1 ELSE 0 END AS sentiment_available FROM j ASOF LEFT JOIN s ON j.symbol = s.symbol AND j.ca >= s.sts""")
def _(t):
    s = t.bars.where(F.dayofmonth("ts") % 4 == 1).select("symbol", (F.to_timestamp("ts") + F.expr("INTERVAL 9 HOURS")).alias("ts"), F.log("close").alias("sentiment"))
    return cx.asof_tolerance(t.bars, s, ["sentiment"])


FEAT = f"""fm0 AS (SELECT ts, close, close / lag(close) OVER (ORDER BY ts) - 1 AS mr FROM index_bars), fm AS (SELECT ts, close / lag(close, 20) OVER (ORDER BY ts) - 1 AS market_momentum_20, CASE WHEN count(mr) OVER (ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 THEN stddev_samp(mr) OVER (ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS market_volatility_20 FROM fm0),
  f0 AS (SELECT *, close / lag(close) OVER w - 1 AS r, open / lag(close) OVER w - 1 AS g, abs(high - low) / close AS rg, volume * close AS tov FROM bars {W}),
  f1 AS (SELECT symbol, ts, close, lead(close, 5) OVER w / close - 1 AS target, close / lag(close, 5) OVER w - 1 AS momentum_5, close / lag(close, 20) OVER w - 1 AS momentum_20, {full(20, 'stddev_samp(r)', 'r')} AS volatility_20, {full(5, 'avg(g)', 'g')} AS gap_ratio_5, {full(20, 'avg(rg)', 'rg')} AS range_ratio_20, ln(1 + {full(20, 'quantile_cont(tov, 0.5)', 'tov')}) AS liquidity_log_turnover, market_momentum_20, market_volatility_20 FROM f0 JOIN fm USING (ts) {W}),
  f2 AS (SELECT *, momentum_20 - market_momentum_20 AS relative_strength_market_20 FROM f1 WHERE momentum_20 IS NOT NULL AND volatility_20 IS NOT NULL AND gap_ratio_5 IS NOT NULL AND market_momentum_20 IS NOT NULL AND market_volatility_20 IS NOT NULL), feat AS (SELECT * FROM f2 WHERE target IS NOT NULL)"""
FEAT_COLS = " ".join(f"{f}:f" for f in cx.FEATURES)


@query("instrument_features", "symbol:s ts:d target:f " + FEAT_COLS, f"WITH {FEAT} SELECT * FROM feat", "bars index_bars")
def _(t):
    return cx.instrument_features(t.bars, t.index_bars, 5)


@query("pooled_panel", "symbol:s rows:i first_origin:d last_origin:d included:b", f"WITH {FEAT} SELECT symbol, count(*) AS rows, min(ts) AS first_origin, max(ts) AS last_origin, count(*) >= 1500 AS included FROM feat GROUP BY symbol", "bars index_bars")
def _(t):
    return cx.pooled_panel(cx.instrument_features(t.bars, t.index_bars, 5), 1500)[1]


@query("supervised_frame", "symbol:s ts:d sma_20:f rsi_14:f target:f direction:i next_volatility:f target_date:d",
       f"""WITH {rsi_ctes(14)}, x AS (SELECT b.symbol, b.ts, close, {full(20, 'avg(close)')} AS sma_20, y AS rsi_14, (close / lag(close) OVER w - 1) * 100 AS dr FROM bars b LEFT JOIN rsi14 USING (symbol, ts) {W}), z AS (SELECT *, lead(close) OVER w AS target, abs(lead(dr) OVER w) AS next_volatility, lead(ts) OVER w AS target_date FROM x {W})
       SELECT *, CAST(target > close AS INT) AS direction FROM z WHERE sma_20 IS NOT NULL AND rsi_14 IS NOT NULL AND target IS NOT NULL""")
def _(t):
    d = with_rsi(t.bars).select("*", cx.S.mean("close", 20).alias("sma_20"), (change() * 100).alias("daily_return"))
    return cx.supervised_frame(d, ["sma_20", "rsi_14"])


@query("ipo_features", "symbol:s days_since_listing:i issue_price_vs_current:f lockin_days:i listing_gap:f",
       """SELECT symbol, max(ts) - make_date(CAST(any_value(listing_year) AS BIGINT), 6, 1) AS days_since_listing, arg_max(close, ts) / arg_min(close, ts) - 1 AS issue_price_vs_current, greatest(0, DATE '2001-12-31' - max(ts)) AS lockin_days, arg_min(open, ts) / arg_min(close, ts) - 1 AS listing_gap FROM bars JOIN instruments USING (symbol) GROUP BY symbol""", "bars instruments")
def _(t):
    first = t.bars.groupBy("symbol").agg(F.min_by("close", "ts").alias("issue_price"), F.min_by("open", "ts").alias("listing_open"))
    l = t.instruments.select("symbol", F.make_date("listing_year", F.lit(6), F.lit(1)).alias("listing_date"), F.lit("2001-12-31").cast("date").alias("lockin_date")).join(first, "symbol")
    return cx.ipo_features(t.bars, l)


PEER = """pr AS (SELECT * FROM (SELECT a.symbol AS target, b.symbol AS peer, CAST(coalesce(a.sector = b.sector, false) AS INT) + CAST(a.cap_bucket = b.cap_bucket AS INT) + CAST(a.listing_year = b.listing_year AS INT) AS score, row_number() OVER (PARTITION BY a.symbol ORDER BY CAST(coalesce(a.sector = b.sector, false) AS INT) + CAST(a.cap_bucket = b.cap_bucket AS INT) + CAST(a.listing_year = b.listing_year AS INT) DESC, b.symbol) AS rank
  FROM instruments a JOIN instruments b ON a.symbol <> b.symbol) WHERE score >= 2 AND rank <= 3)"""


@query("peer_select", "target:s peer:s score:i rank:i", f"WITH {PEER} SELECT * FROM pr", "instruments")
def _(t):
    return cx.peer_select(t.instruments, 3)


@query("peer_prior", "target:s mean_return:f std_return:f mean_vol:f peer_count:i",
       f"""WITH {PEER}, e AS (SELECT symbol, ts, close / lag(close) OVER w - 1 AS r, row_number() OVER w AS n FROM bars {W}), g AS (SELECT symbol, avg(r) * 5 AS m, stddev_samp(r) * sqrt(5) AS v FROM e WHERE n <= 90 GROUP BY symbol HAVING count(*) >= 90)
       SELECT target, avg(m) AS mean_return, stddev_pop(m) AS std_return, avg(v) AS mean_vol, count(*) AS peer_count FROM pr JOIN g ON g.symbol = pr.peer GROUP BY target""", "bars instruments")
def _(t):
    return cx.peer_prior(t.bars, cx.peer_select(t.instruments, 3))


@query("latest_feature_row", "symbol:s feature_ts:d momentum_5:f volatility_20:f latest_close_ts:d is_current:b sessions:i",
       f"WITH {FEAT}, l AS (SELECT symbol, max(ts) AS feature_ts, arg_max(momentum_5, ts) AS momentum_5, arg_max(volatility_20, ts) AS volatility_20 FROM feat GROUP BY symbol), b AS (SELECT symbol, max(ts) AS latest_close_ts, count(*) AS sessions FROM bars GROUP BY symbol) SELECT *, feature_ts = latest_close_ts AS is_current FROM l JOIN b USING (symbol)", "bars index_bars")
def _(t):
    return cx.latest_feature_row(cx.instrument_features(t.bars, t.index_bars, 5), t.bars)


@query("derivative_membership", "symbol:s has_derivatives:b contracts:i", "SELECT i.symbol, count(k) > 0 AS has_derivatives, count(k) AS contracts FROM (SELECT symbol FROM instruments UNION ALL SELECT 'UNLISTED') i LEFT JOIN (SELECT DISTINCT underlying, strike || option_type AS k FROM chain) c ON c.underlying = i.symbol GROUP BY i.symbol", "instruments chain")
def _(t):
    unlisted = t.raw("region").where("r_regionkey = 0").select(F.lit("UNLISTED").alias("symbol"))
    return cx.derivative_membership(t.instruments.select("symbol").unionByName(unlisted), t.chain.select(C("underlying").alias("symbol"), "strike", "option_type"), ["strike", "option_type"])


REG = f"""{ATR_CTES}, {ADX_CTES}, {MACD_CTES}, {rsi_ctes(14)}, e20 AS ({ewm_sql('bars', 'close', 2 / 21, 20)}), e50 AS ({ewm_sql('bars', 'close', 2 / 51, 50)}),
  mdd AS (SELECT ts, CASE WHEN n < 50 THEN 'unknown' WHEN d < -20 THEN 'crisis' WHEN d < -10 THEN 'elevated' WHEN d < -5 THEN 'moderate' ELSE 'low' END AS stress FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS n, (close / max(close) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1) * 100 AS d FROM index_bars)),
  rg0 AS (SELECT b.*, {full(20, 'avg(close)')} AS s20, {full(50, 'avg(close)')} AS s50, atr.y / close * 100 AS ap FROM bars b LEFT JOIN atr USING (symbol, ts)), rg1 AS (SELECT *, list(ap) FILTER (WHERE ap IS NOT NULL) OVER {fr(90)} AS l FROM rg0),
  rg2 AS (SELECT x.symbol, x.ts, s20, s50, stress, coalesce(adx >= 25, false) AS tg, rsi14.y AS rsi, CASE WHEN len(l) >= 5 AND ap IS NOT NULL THEN len(list_filter(l, lambda v: v < ap)) / len(l) END AS vp,
   CAST(coalesce(close > s20, false) AS INT) + CAST(coalesce(close > s50, false) AS INT) + CAST(coalesce(e20.y > e50.y, false) AS INT) + CAST(coalesce(macd_histogram > 0, false) AS INT) AS votes FROM rg1 x JOIN mdd USING (ts) LEFT JOIN adx USING (symbol, ts) LEFT JOIN rsi14 USING (symbol, ts) LEFT JOIN e20 USING (symbol, ts) LEFT JOIN e50 USING (symbol, ts) LEFT JOIN macd USING (symbol, ts)),
  rg3 AS (SELECT *, CASE WHEN votes >= 3 THEN CASE WHEN tg AND (rsi IS NULL OR rsi > 55) THEN 'strong_bullish' ELSE 'mild_bullish' END WHEN votes <= 1 THEN CASE WHEN tg AND (rsi IS NULL OR rsi < 45) THEN 'strong_bearish' ELSE 'mild_bearish' END ELSE 'sideways' END AS trend, CASE WHEN vp IS NULL THEN 'unknown' WHEN vp >= 0.8 THEN 'high' WHEN vp <= 0.2 THEN 'low' ELSE 'normal' END AS volatility FROM rg2),
  rg4 AS (SELECT *, CASE WHEN s20 IS NULL AND s50 IS NULL THEN 'unclassified' WHEN stress = 'crisis' THEN 'crisis' WHEN volatility IN ('high', 'low') THEN CASE WHEN trend LIKE '%bullish' THEN 'bull_trend' WHEN trend LIKE '%bearish' THEN 'bear_trend' ELSE 'sideways' END || '_' || volatility || '_vol' ELSE 'unclassified' END AS regime FROM rg3),
  reg AS (SELECT symbol, ts, trend, volatility, stress, regime, CASE WHEN regime = 'unclassified' THEN 0.5 ELSE least(0.9, CASE WHEN tg THEN 0.7 ELSE 0.6 END + CASE WHEN stress IN ('elevated', 'crisis') THEN 0.2 ELSE 0 END) END AS probability FROM rg4)"""


@query("regime_label", "symbol:s ts:d trend:s volatility:s stress:s regime:s probability:f", f"WITH {REG} SELECT * FROM reg", "bars index_bars")
def _(t):
    return cx.regime_label(t.bars, t.index_bars)


RW = "rw AS (SELECT symbol, ts, CASE day(ts) % 4 WHEN 0 THEN 'crisis' WHEN 1 THEN 'bull_trend_high_vol' WHEN 2 THEN 'sideways_low_vol' ELSE 'unclassified' END AS regime, 0.5e0 + month(ts) / 30e0 AS probability, close FROM bars)"


def regimes(t):
    k = F.dayofmonth("ts") % 4
    return t.bars.select("symbol", "ts", F.when(k == 0, "crisis").when(k == 1, "bull_trend_high_vol").when(k == 2, "sideways_low_vol").otherwise("unclassified").alias("regime"), (0.5 + F.month("ts") / 30.0).alias("probability"), "close")


@query("regime_weights", "symbol:s ts:d width_multiplier:f6 w_volatility_model:f6 w_per_stock_cqr:f6 w_mean_reversion:f6",
       f"""WITH {RW}, x AS (SELECT *, CASE regime WHEN 'crisis' THEN 1.4 WHEN 'bull_trend_high_vol' THEN 1.18 WHEN 'sideways_low_vol' THEN 0.93 ELSE 1 END AS rawm, CASE regime WHEN 'crisis' THEN 1.5 WHEN 'bull_trend_high_vol' THEN 1.3 WHEN 'sideways_low_vol' THEN 1.1 ELSE 1 END AS v, CASE regime WHEN 'crisis' THEN 0.5 ELSE 1 END AS q, CASE regime WHEN 'sideways_low_vol' THEN 1.3 ELSE 1 END AS m FROM rw)
       SELECT symbol, ts, greatest(0.9, least(1.5, 1 + (rawm - 1) * least(1, probability))) AS width_multiplier, probability * v / (v + q + m) + (1 - probability) / 3 AS w_volatility_model, probability * q / (v + q + m) + (1 - probability) / 3 AS w_per_stock_cqr, probability * m / (v + q + m) + (1 - probability) / 3 AS w_mean_reversion FROM x""")
def _(t):
    return cx.regime_weights(regimes(t), ["volatility_model", "per_stock_cqr", "mean_reversion"])


@query("component_stack", "symbol:s ts:d stacked:f applied:b usable:i dropped:s",
       """WITH m AS (SELECT symbol, ts, 'a' AS name, CASE WHEN day(ts) = 3 THEN NULL ELSE close END AS v, 1e0 AS w FROM bars UNION ALL SELECT symbol, ts, 'b', CASE WHEN day(ts) % 3 = 0 THEN -1 ELSE high END, 2e0 FROM bars UNION ALL SELECT symbol, ts, 'c', low, 0.5e0 FROM bars WHERE day(ts) % 2 = 0)
       SELECT symbol, ts, CASE WHEN count(*) FILTER (WHERE v >= 0) >= 2 THEN sum(v * w) FILTER (WHERE v >= 0) / sum(w) FILTER (WHERE v >= 0) ELSE 1 END AS stacked, count(*) FILTER (WHERE v >= 0) >= 2 AS applied, count(*) FILTER (WHERE v >= 0) AS usable, coalesce(string_agg(name || ':' || CASE WHEN v IS NULL THEN 'not_numeric' ELSE 'negative' END, ',' ORDER BY name) FILTER (WHERE v IS NULL OR v < 0), '') AS dropped FROM m GROUP BY symbol, ts""")
def _(t):
    d = F.dayofmonth("ts")
    b = t.bars
    one = lambda name, v, w: (b if name != "c" else b.where(d % 2 == 0)).select("symbol", "ts", F.lit(name).alias("name"), v.alias("value"), F.lit(w).alias("weight"), F.lit(1.0).alias("fallback"))
    m = one("a", F.when(d != 3, C("close")), 1.0).unionByName(one("b", F.when(d % 3 == 0, -1.0).otherwise(C("high")), 2.0)).unionByName(one("c", C("low"), 0.5))
    return cx.component_stack(m, ["symbol", "ts"])


def model_results(t):
    d = t.settled
    out = None
    for i, m in enumerate(("baseline", "quantile", "trend")):
        x = d.select("regime", F.lit(m).alias("model"), F.datediff(F.lit("2001-12-31").cast("date"), "target_date").alias("age"), C("coverage_hit").cast("double").alias("coverage"), C("confidence_level").alias("target"),
                     (F.abs(C("actual_price") - C("forecast_median")) / C("actual_price") * (1 + i)).alias("mase"))
        out = x if out is None else out.unionByName(x)
    return out


@query("regime_conditional_weights", "regime:s model:s samples:i weight:f6",
       """WITH r AS (SELECT regime, model, exp(-(DATE '2001-12-31' - target_date) * ln(2) / 250e0) AS w, (1 - abs(CAST(coverage_hit AS DOUBLE) - confidence_level)) / (1 + abs(actual_price - forecast_median) / actual_price * k) AS s FROM settled CROSS JOIN (VALUES ('baseline', 1), ('quantile', 2), ('trend', 3)) m(model, k)),
       g AS (SELECT regime, model, count(*) AS samples, sum(w * s) / sum(w) / count(*) AS sc FROM r GROUP BY regime, model) SELECT regime, model, samples, sc / sum(sc) OVER (PARTITION BY regime) AS weight FROM g""", "settled")
def _(t):
    return cx.regime_conditional_weights(model_results(t), 250.0, 20)


@query("ensemble_blend", "symbol:s ts:d low:f median:f high:f members:i",
       """SELECT symbol, ts, (0.75e0 * close * 0.9e0 + 0.35e0 * close * 0.8e0) / 1.1e0 AS low, (0.75e0 * close + 0.35e0 * open) / 1.1e0 AS median, (0.75e0 * close * 1.1e0 + 0.35e0 * close * 1.3e0) / 1.1e0 AS high, 2 AS members FROM bars""")
def _(t):
    f = lambda lo, md, hi, rw, mw: t.bars.select("symbol", "ts", (C("close") * lo).alias("low"), C(md).alias("median"), (C("close") * hi).alias("high"), F.lit(rw).alias("regime_weight"), F.lit(mw).alias("meta_weight"))
    return cx.ensemble_blend(f(0.9, "close", 1.1, 0.9, 0.6).unionByName(f(0.8, "open", 1.3, 0.1, 0.6)), ["symbol", "ts"])


@query("sector_coverage", "total:i populated:i populated_pct:f sectors:i", "SELECT count(*) AS total, count(sector) AS populated, count(sector) / count(*) * 100 AS populated_pct, count(DISTINCT sector) AS sectors FROM instruments", "instruments")
def _(t):
    return cx.sector_coverage(t.instruments)


@query("sector_rotation", "sector:s members:i measured:i average_change_pct:f",
       f"WITH c AS (SELECT symbol, ts, (close / lag(close, 5) OVER w - 1) * 100 AS c, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS d FROM bars {W}) SELECT sector, count(*) AS members, count(c) AS measured, avg(c) AS average_change_pct FROM instruments LEFT JOIN (SELECT * FROM c WHERE d = 1) USING (symbol) WHERE sector IS NOT NULL GROUP BY sector", "bars instruments")
def _(t):
    return cx.sector_rotation(t.instruments, t.bars)


SNAP = f"sn AS (SELECT * FROM (SELECT symbol, ts, close, (close / lag(close) OVER w - 1) * 100 AS change_pct, volume / avg(volume) OVER {fr(20)} AS volume_ratio, avg(high - low) OVER {fr(14)} / avg(close) OVER {fr(14)} * 100 AS range_pct, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS d, count(*) OVER (PARTITION BY symbol) AS sessions FROM bars {W}) WHERE d = 1)"


@query("morning_movers", "list:s symbol:s value:f",
       f"""WITH {SNAP} (SELECT 'gainers' AS list, symbol, change_pct AS value FROM sn WHERE sessions >= 1500 AND change_pct > 0 ORDER BY change_pct DESC LIMIT 5) UNION ALL (SELECT 'losers', symbol, change_pct FROM sn WHERE sessions >= 1500 AND change_pct < 0 ORDER BY change_pct LIMIT 5)
       UNION ALL (SELECT 'volume_leaders', symbol, volume_ratio FROM sn WHERE sessions >= 1500 ORDER BY volume_ratio DESC LIMIT 5) UNION ALL (SELECT 'widest_range', symbol, range_pct FROM sn WHERE sessions >= 1500 ORDER BY range_pct DESC LIMIT 5) UNION ALL SELECT 'excluded', symbol, sessions FROM sn WHERE sessions < 1500""")
def _(t):
    return cx.morning_movers(t.bars, 5, 1500)


@query("compare_symbols", "symbol:s ts:d close:f change_pct:f volume_ratio:f range_pct:f forecast_low:f forecast_high:f", f"WITH {SNAP} SELECT sn.*, close * 0.6e0 AS forecast_low, close * 1.4e0 AS forecast_high FROM sn WHERE symbol IN ('Brand#3', 'Brand#11', 'Brand#20')")
def _(t):
    return cx.compare_symbols(cx.symbol_snapshot(t.bars), t.ledger, ["Brand#3", "Brand#11", "Brand#20"])


@query("symbol_search", "query:s symbol:s name:s tier:i rank:i",
       """WITH q AS (SELECT unnest(['brand#1', 'ISSUER 2', '5', 'issuer']) AS query), j AS (SELECT query, symbol, name, CASE WHEN lower(symbol) = lower(query) OR lower(name) = lower(query) THEN 0 WHEN starts_with(lower(symbol), lower(query)) OR starts_with(lower(name), lower(query)) THEN 1 ELSE 2 END AS tier FROM instruments JOIN q ON contains(lower(symbol), lower(query)) OR contains(lower(name), lower(query)))
       SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, symbol) AS rank FROM j) WHERE rank <= 8""", "instruments")
def _(t):
    q = t.spark.createDataFrame([("brand#1",), ("ISSUER 2",), ("5",), ("issuer",)], "query string")
    return cx.symbol_search(q, t.instruments, 8)
