"""Option chain, futures and book queries."""

from pyspark.sql import functions as F

from ..functions.pricing import greeks_sql
from ..operators import options as op
from ..operators import risk as rk
from .quality_queries import BURST
from .registry import query

C = F.col
SPOT = "spot AS (SELECT symbol AS underlying, arg_max(close, ts) AS spot FROM bars GROUP BY symbol)"


def spots(t):
    return t.bars.groupBy(C("symbol").alias("underlying")).agg(F.max_by("close", "ts").alias("spot"))


@query("chain_normalise", "underlying:s rows:i oi:f2", "SELECT symbol AS underlying, count(*) AS rows, sum(qty) AS oi FROM trades WHERE linenumber NOT IN (2, 3, 4) GROUP BY symbol", "trades")
def _(t):
    n = C("linenumber")
    raw = t.trades.select(C("symbol").alias("underlying"), F.when(n == 2, "bad").otherwise((C("size") * 50).cast("string")).alias("strike"), F.when(n == 3, "fut").when(C("linestatus") == "O", " CALL ").otherwise("Put").alias("option_type"), F.when(n == 4, -1.0).otherwise(C("qty")).alias("open_interest"))
    return op.chain_normalise(raw).groupBy("underlying").agg(F.count("*").alias("rows"), F.sum("open_interest").alias("oi"))


@query("chain_validate", "underlying:s code:s rows:i",
       """WITH r AS (SELECT symbol AS u, linenumber AS n, discount * 100 AS b, CASE WHEN linenumber = 5 THEN discount * 100 - 1 ELSE discount * 100 + tax * 10 END AS a, qty, epoch(TIMESTAMP '2001-12-01 00:00:00') - epoch(shipdate) AS age FROM trades),
       x AS (SELECT u AS underlying, count(*) FILTER (WHERE n = 2) AS c1, count(*) FILTER (WHERE n = 4) AS c2, count(*) FILTER (WHERE n = 3) AS c3, 0 AS c4, count(*) FILTER (WHERE NOT (b >= 0 AND a > 0)) AS c5, count(*) FILTER (WHERE n NOT IN (2, 3, 4) AND b >= 0 AND a > 0 AND b > a) AS c6, count(*) FILTER (WHERE n NOT IN (2, 3, 4) AND b >= 0 AND a > 0 AND b <= a AND (a - b) / ((a + b) / 2) * 100 > 20) AS c7,
        count(*) FILTER (WHERE n NOT IN (2, 3, 4) AND b >= 0 AND a > 0 AND b <= a AND (qty / 5 < b OR qty / 5 > a)) AS c8, 0 AS c9, count(*) FILTER (WHERE age > 900) AS c10, count(*) FILTER (WHERE age < -60) AS c11 FROM r GROUP BY u)
       SELECT underlying, unnest(['INVALID_STRIKE','INVALID_OPEN_INTEREST','INVALID_OPTION_TYPE','ZERO_OPEN_INTEREST','INVALID_QUOTE','CROSSED_MARKET','WIDE_SPREAD','LAST_OUTSIDE_MARKET','INVALID_VOLUME','STALE_QUOTE','FUTURE_QUOTE_TIME']) AS code, unnest([c1,c2,c3,c4,c5,c6,c7,c8,c9,c10,c11]) AS rows FROM x""", "trades")
def _(t):
    n = C("linenumber")
    raw = t.trades.select(C("symbol").alias("underlying"), F.when(n == 2, -5.0).otherwise(C("size") * 50.0).alias("strike"), F.when(n == 3, "fut").otherwise("call").alias("option_type"), F.when(n == 4, -1.0).otherwise(C("qty")).alias("open_interest"), (C("discount") * 100).alias("bid"),
                          F.when(n == 5, C("discount") * 100 - 1).otherwise(C("discount") * 100 + C("tax") * 10).alias("ask"), (C("qty") / 5).alias("last"), C("qty").alias("volume"), C("shipdate").alias("quote_ts"))
    return op.chain_validate(raw, F.lit("2001-12-01").cast("timestamp"))


EV_ERR = ("INVALID_STRIKE", "INVALID_OPEN_INTEREST", "INVALID_OPTION_TYPE", "INSUFFICIENT_OI_EVIDENCE", "INVALID_QUOTE", "CROSSED_MARKET", "INVALID_VOLUME", "FUTURE_QUOTE_TIME")
EV_WARN = ("ZERO_OPEN_INTEREST", "WIDE_SPREAD", "LAST_OUTSIDE_MARKET", "STALE_QUOTE")


@query("chain_evidence", "underlying:s input_rows:i valid_rows:i oi_data_valid:b market_data_valid:b is_stale:b errors:s warnings:s evidence_quality:s",
       f"""WITH r AS (SELECT symbol || '-' || linenumber AS u, linenumber AS n, CASE WHEN linenumber = 2 THEN -5 ELSE size * 50e0 END AS k, CASE WHEN linenumber = 3 THEN 'fut' WHEN linestatus = 'O' THEN 'call' ELSE 'put' END AS ty, CASE WHEN linenumber = 4 THEN -1 WHEN linenumber = 1 THEN 0 ELSE qty END AS oi, 5 + discount * 100 AS b,
         CASE WHEN linenumber = 5 THEN 4 + discount * 100 WHEN linenumber = 6 THEN 20 + discount * 100 ELSE 5.5e0 + discount * 100 END AS a, epoch(TIMESTAMP '2001-12-01 00:00:00') - epoch(CASE WHEN linenumber >= 6 THEN TIMESTAMP '2001-11-30 23:59:00' ELSE shipdate END) AS age FROM trades),
       v AS (SELECT *, k > 0 AND oi >= 0 AND ty IN ('call', 'put') AS ok FROM r), g AS (SELECT u, count(*) AS input_rows, count(*) FILTER (WHERE ok) AS valid_rows, count(*) FILTER (WHERE ok AND ty = 'call') AS cs, count(*) FILTER (WHERE ok AND ty = 'put') AS ps,
         count(*) FILTER (WHERE k <= 0) AS INVALID_STRIKE, count(*) FILTER (WHERE oi < 0) AS INVALID_OPEN_INTEREST, count(*) FILTER (WHERE ty = 'fut') AS INVALID_OPTION_TYPE, CASE WHEN count(*) FILTER (WHERE ok) > 0 AND sum(oi) FILTER (WHERE ok) = 0 THEN 1 ELSE 0 END AS INSUFFICIENT_OI_EVIDENCE, 0 AS INVALID_QUOTE, count(*) FILTER (WHERE ok AND b > a) AS CROSSED_MARKET, 0 AS INVALID_VOLUME, count(*) FILTER (WHERE age < -60) AS FUTURE_QUOTE_TIME,
         count(*) FILTER (WHERE ok AND oi = 0) AS ZERO_OPEN_INTEREST, count(*) FILTER (WHERE ok AND b <= a AND (a - b) / ((a + b) / 2) * 100 > 20) AS WIDE_SPREAD, 0 AS LAST_OUTSIDE_MARKET, count(*) FILTER (WHERE age > 900) AS STALE_QUOTE FROM v GROUP BY u),
       h AS (SELECT *, concat_ws(',', {', '.join(f"CASE WHEN {c} > 0 THEN '{c}' END" for c in EV_ERR)}) AS errors, concat_ws(',', {', '.join(f"CASE WHEN {c} > 0 THEN '{c}' END" for c in EV_WARN)}) AS warnings FROM g)
       SELECT u AS underlying, input_rows, valid_rows, valid_rows > 0 AND cs > 0 AND ps > 0 AND INVALID_STRIKE + INVALID_OPEN_INTEREST + INVALID_OPTION_TYPE + INSUFFICIENT_OI_EVIDENCE = 0 AS oi_data_valid, INVALID_QUOTE + CROSSED_MARKET + FUTURE_QUOTE_TIME = 0 AS market_data_valid, STALE_QUOTE > 0 AS is_stale, errors, warnings,
         CASE WHEN errors <> '' OR STALE_QUOTE > 0 THEN 'low' WHEN warnings <> '' THEN 'limited' ELSE 'moderate' END AS evidence_quality FROM h""", "trades")
def _(t):
    """A chain for each symbol and line number, each number with a defect of its own."""
    n, q = C("linenumber"), 5 + C("discount") * 100
    raw = t.trades.select(F.concat("symbol", F.lit("-"), n.cast("string")).alias("underlying"), F.when(n == 2, -5.0).otherwise(C("size") * 50.0).alias("strike"), F.when(n == 3, "fut").when(C("linestatus") == "O", "call").otherwise("put").alias("option_type"), F.when(n == 4, -1.0).when(n == 1, 0.0).otherwise(C("qty")).alias("open_interest"), q.alias("bid"),
                          F.when(n == 5, q - 1).when(n == 6, q + 15).otherwise(q + 0.5).alias("ask"), (q + 0.25).alias("_mid"), C("qty").alias("volume"), F.when(n >= 6, F.lit("2001-11-30 23:59:00").cast("timestamp")).otherwise(C("shipdate")).alias("quote_ts"))
    return op.chain_evidence(raw.withColumn("last", F.when(C("bid") <= C("ask"), C("_mid"))).drop("_mid"), F.lit("2001-12-01").cast("timestamp"))


PAIN = "pn AS (SELECT s.underlying, s.strike, sum(greatest(0, CASE c.option_type WHEN 'call' THEN s.strike - c.strike ELSE c.strike - s.strike END) * c.open_interest) AS payout FROM (SELECT DISTINCT underlying, strike FROM chain) s JOIN chain c USING (underlying) GROUP BY s.underlying, s.strike), mp AS (SELECT underlying, arg_min(strike, (round(payout, 6), strike)) AS max_pain, min(payout) AS min_payout FROM pn GROUP BY underlying)"


@query("max_pain", "underlying:s max_pain:f2 min_payout:f2", f"WITH {PAIN} SELECT * FROM mp", "chain")
def _(t):
    return op.max_pain(t.chain)


@query("chain_summary", "underlying:s call_oi:f2 put_oi:f2 pcr:f6 call_wall:f2 put_wall:f2 max_pain:f2 payout_down:f2 payout_up:f2 score:f6 label:s",
       f"""WITH {SPOT}, {PAIN}, g AS (SELECT underlying, sum(open_interest) FILTER (WHERE option_type = 'call') AS call_oi, sum(open_interest) FILTER (WHERE option_type = 'put') AS put_oi, arg_max(strike, (open_interest, -strike)) FILTER (WHERE option_type = 'call') AS call_wall, arg_max(strike, (open_interest, -strike)) FILTER (WHERE option_type = 'put') AS put_wall,
       sum(greatest(0, CASE option_type WHEN 'call' THEN spot * 0.95e0 - strike ELSE strike - spot * 0.95e0 END) * open_interest) AS payout_down, sum(greatest(0, CASE option_type WHEN 'call' THEN spot * 1.05e0 - strike ELSE strike - spot * 1.05e0 END) * open_interest) AS payout_up, any_value(spot) AS spot FROM chain JOIN spot USING (underlying) GROUP BY underlying),
       z AS (SELECT *, put_oi / call_oi AS pcr, greatest(-1, least(1, greatest(-1, least(1, (put_oi / call_oi - 1) / 1.5)) + greatest(-0.25, least(0.25, (max_pain / spot - 1) * 2)))) AS score FROM g JOIN mp USING (underlying)) SELECT *, CASE WHEN score > 0.15 THEN 'Bullish structure' WHEN score < -0.15 THEN 'Bearish structure' ELSE 'Balanced structure' END AS label FROM z""", "chain bars")
def _(t):
    return op.chain_summary(t.chain, spots(t))


@query("oi_heatmap", "underlying:s strike:f2 call_oi:f2 put_oi:f2 call_change:f2 put_change:f2 net_oi:f2",
       "SELECT underlying, strike, coalesce(sum(open_interest) FILTER (WHERE option_type = 'call'), 0) AS call_oi, coalesce(sum(open_interest) FILTER (WHERE option_type = 'put'), 0) AS put_oi, sum(open_interest - previous_open_interest) FILTER (WHERE option_type = 'call') AS call_change, sum(open_interest - previous_open_interest) FILTER (WHERE option_type = 'put') AS put_change, coalesce(sum(open_interest) FILTER (WHERE option_type = 'call'), 0) - coalesce(sum(open_interest) FILTER (WHERE option_type = 'put'), 0) AS net_oi FROM chain GROUP BY underlying, strike", "chain")
def _(t):
    return op.oi_heatmap(t.chain)


@query("oi_movers", "underlying:s kind:s rank:i strike:f2 option_type:s change:f2",
       "SELECT * FROM (SELECT underlying, kind, strike, option_type, change, row_number() OVER (PARTITION BY underlying, kind ORDER BY abs(change) DESC, strike, option_type) AS rank FROM (SELECT underlying, strike, option_type, 2 * previous_open_interest - open_interest AS change, CASE WHEN 2 * previous_open_interest - open_interest > 0 THEN 'buildup' ELSE 'unwind' END AS kind FROM chain WHERE 2 * previous_open_interest <> open_interest)) WHERE rank <= 5", "chain")
def _(t):
    return op.oi_movers(t.chain.select("underlying", "strike", "option_type", (C("previous_open_interest") * 2).alias("open_interest"), C("open_interest").alias("previous_open_interest")))


HEAT = "og AS (SELECT underlying, strike, coalesce(sum(open_interest) FILTER (WHERE option_type = 'call'), 0) AS co, coalesce(sum(open_interest) FILTER (WHERE option_type = 'put'), 0) AS po, sum(previous_open_interest) FILTER (WHERE option_type = 'call') AS cp, sum(previous_open_interest) FILTER (WHERE option_type = 'put') AS pp FROM chain GROUP BY underlying, strike)"
MIDSPOT = "ms AS (SELECT underlying, avg(strike) + 10 AS spot FROM chain GROUP BY underlying)"


@query("oi_landmarks", "underlying:s spot:f2 call_oi:f2 put_oi:f2 pcr:f6 pcr_change:f6 call_wall:f2 put_wall:f2 support:f2 resistance:f2 max_oi_strike:f2 nearest_strike:f2 pin_max_pain:f2 pin_distance_pct:f pin_level:s",
       f"""WITH {HEAT}, {MIDSPOT}, d AS (SELECT og.*, spot, abs(strike - spot) AS gap FROM og JOIN ms USING (underlying)), c AS (SELECT * FROM d WHERE gap <= spot * 0.3e0),
       pn AS (SELECT s.underlying, s.strike, sum(greatest(0, s.strike - c.strike) * c.co + greatest(0, c.strike - s.strike) * c.po) AS cost FROM c s JOIN c USING (underlying) GROUP BY s.underlying, s.strike), mp AS (SELECT underlying, arg_min(strike, (round(cost, 6), strike)) AS pin_max_pain FROM pn GROUP BY underlying),
       t AS (SELECT underlying, any_value(spot) AS spot, sum(co) AS call_oi, sum(po) AS put_oi, sum(po) / sum(co) AS pcr, sum(po) / sum(co) - sum(pp) / sum(cp) AS pcr_change, arg_max(strike, (co, -strike)) AS call_wall, arg_max(strike, (po, -strike)) AS put_wall, arg_max(strike, (po, -strike)) FILTER (WHERE strike < spot) AS support, arg_min(strike, (co, strike)) FILTER (WHERE strike > spot) AS resistance,
         arg_max(strike, (co + po, -strike)) FILTER (WHERE gap <= spot * 0.3e0) AS max_oi_strike, arg_min(strike, (gap, strike)) FILTER (WHERE gap <= spot * 0.3e0) AS nearest_strike FROM d GROUP BY underlying),
       z AS (SELECT t.*, pin_max_pain, least(abs(pin_max_pain - spot), abs(max_oi_strike - spot)) / spot * 100 AS pin_distance_pct FROM t LEFT JOIN mp USING (underlying)) SELECT *, CASE WHEN pin_distance_pct <= 1 THEN 'high' WHEN pin_distance_pct <= 3 THEN 'moderate' WHEN pin_distance_pct IS NOT NULL THEN 'low' END AS pin_level FROM z""", "chain")
def _(t):
    return op.oi_landmarks(t.chain, t.chain.groupBy("underlying").agg((F.avg("strike") + 10).alias("spot")))


@query("oi_expiry_matrix", "underlying:s strike:f2 expiry:d expiries:i call_oi:f2 put_oi:f2 call_change:f2 put_change:f2",
       """WITH x AS (SELECT symbol AS underlying, CAST(size AS DOUBLE) * 50 AS strike, linestatus = 'O' AS cl, DATE '2001-12-01' + 30 * linenumber AS expiry, qty, CASE WHEN returnflag <> 'N' THEN qty ELSE 0 END AS old FROM trades), e AS (SELECT underlying, count(DISTINCT expiry) AS expiries FROM x GROUP BY underlying HAVING count(DISTINCT expiry) > 1)
       SELECT underlying, strike, expiry, any_value(expiries) AS expiries, sum(qty) FILTER (WHERE cl) AS call_oi, sum(qty) FILTER (WHERE NOT cl) AS put_oi, sum(qty - old) FILTER (WHERE cl) AS call_change, sum(qty - old) FILTER (WHERE NOT cl) AS put_change FROM x JOIN e USING (underlying) GROUP BY underlying, strike, expiry""", "trades")
def _(t):
    d = F.date_add(F.lit("2001-12-01").cast("date"), C("linenumber") * 30)
    rows = t.trades.select(C("symbol").alias("underlying"), (C("size").cast("double") * 50).alias("strike"), F.when(C("linestatus") == "O", "call").otherwise("put").alias("option_type"), d.alias("expiry"), C("qty").alias("open_interest"), F.when(C("returnflag") != "N", C("qty")).otherwise(0.0).alias("previous_open_interest"))
    return op.oi_expiry_matrix(rows)


IVR = "ivr AS (SELECT underlying, strike, spot, max(bid / 20) FILTER (WHERE option_type = 'call') AS ce, max(ask / 20) FILTER (WHERE option_type = 'put') AS pe FROM chain JOIN (SELECT underlying, avg(strike) AS spot FROM chain GROUP BY underlying) USING (underlying) GROUP BY ALL)"
ATM = f"{IVR}, am AS (SELECT underlying, arg_min(strike, (abs(strike - spot), strike)) AS strike, arg_min((coalesce(ce, pe) + coalesce(pe, ce)) / 2, (abs(strike - spot), strike)) AS iv, arg_min(CAST(ce IS NOT NULL AS INT) + CAST(pe IS NOT NULL AS INT), (abs(strike - spot), strike)) AS sides, any_value(spot) AS spot FROM ivr WHERE abs(strike - spot) / spot <= 0.05 GROUP BY underlying)"


def iv_rows(t):
    m = t.chain.groupBy("underlying").agg(F.avg("strike").alias("spot"))
    return t.chain.join(m, "underlying").groupBy("underlying", "strike", "spot").agg(F.max(F.when(C("option_type") == "call", C("bid") / 20)).alias("ce_iv"), F.max(F.when(C("option_type") == "put", C("ask") / 20)).alias("pe_iv"))


@query("atm_iv", "underlying:s strike:f2 iv:f6 sides:i", f"WITH {ATM} SELECT * FROM am", "chain")
def _(t):
    return op.atm_iv(iv_rows(t))


RVOL = "rv AS (SELECT symbol AS underlying, stddev_samp(lr) * sqrt(252) AS rvol FROM (SELECT symbol, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS lr FROM bars) GROUP BY symbol)"


@query("expected_move", "underlying:s sigma:i move:f low:f high:f flag:s scenario_low:f2 scenario_high:f2",
       f"""WITH {ATM}, {RVOL}, y AS (SELECT am.*, rvol, spot * iv * sqrt(20 / 252e0) AS one, spot * (CAST(substr(underlying, 7) AS INT) * 8) / 100 AS width, spot * (rvol + iv) / 2 * sqrt(20 / 365e0) AS half FROM am JOIN rv USING (underlying)), x AS (SELECT *, one * s AS move, s AS sigma FROM y CROSS JOIN (SELECT unnest([1, 2]) AS s))
       SELECT underlying, sigma, move, spot - move AS low, spot + move AS high, CASE WHEN width < 0.8e0 * 2 * one THEN 'model_tighter_than_implied' WHEN width > 4 * one THEN 'model_wider_than_implied' ELSE 'aligned' END AS flag, greatest(0.01, spot - half) AS scenario_low, spot + half AS scenario_high FROM x""", "chain bars")
def _(t):
    m = t.chain.groupBy("underlying").agg(F.avg("strike").alias("spot"))
    rv = rk.with_log_return(t.bars).groupBy(C("symbol").alias("underlying")).agg((F.stddev_samp("lr") * 252**0.5).alias("realized"))
    width = F.substring("underlying", 7, 4).cast("int") * 8.0
    return op.expected_move(op.atm_iv(iv_rows(t)).join(m, "underlying").join(rv, "underlying").select("underlying", "spot", "iv", F.lit(20).alias("days"), width.alias("model_width_pct"), "realized"))


CH = "ch AS (SELECT underlying, strike, option_type, spot, 30 + CAST(strike AS BIGINT) % 60 AS days, 0.15e0 + bid / 100 AS vol, greatest(ask, 0.5e0) AS premium FROM chain JOIN spot USING (underlying))"


def priced(t):
    return t.chain.join(spots(t), "underlying").select("underlying", "strike", "option_type", "spot", (30 + C("strike").cast("bigint") % 60).alias("days"), (0.15 + C("bid") / 100).alias("vol"), F.greatest("ask", F.lit(0.5)).alias("premium"))


G = greeks_sql("spot", "strike", "days", "vol", "(option_type = 'call')")


@query("chain_reprice", "underlying:s strike:f2 option_type:s price:f delta:f6 gamma:f6 theta:f vega:f rho:f", f"WITH {SPOT}, {CH} SELECT underlying, strike, option_type, {', '.join(f'{v} AS {k}' for k, v in G.items())} FROM ch", "chain bars")
def _(t):
    return op.chain_reprice(priced(t))


MID = greeks_sql("spot", "strike", "days", "((lo + hi) / 2)", "(option_type = 'call')")["price"]
LOW, HIGH = (greeks_sql("spot", "strike", "days", v, "(option_type = 'call')")["price"] for v in ("0.0001e0", "5e0"))


@query("chain_implied_vol", "underlying:s strike:f2 option_type:s implied_vol:f",
       f"""WITH RECURSIVE {SPOT}, {CH}, b AS (SELECT ch.*, {LOW} AS pl, {HIGH} AS ph FROM ch), it AS (SELECT *, 0.0001e0 AS lo, 5e0 AS hi, 0 AS k FROM b UNION ALL SELECT underlying, strike, option_type, spot, days, vol, premium, pl, ph, CASE WHEN p < premium THEN (lo + hi) / 2 ELSE lo END, CASE WHEN p < premium THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM (SELECT *, {MID} AS p FROM it WHERE k < 60))
       SELECT underlying, strike, option_type, CASE WHEN premium > 0 AND premium >= pl - 1e-6 AND premium <= ph + 1e-6 THEN (lo + hi) / 2 END AS implied_vol FROM it WHERE k = 60""", "chain bars")
def _(t):
    return op.chain_implied_vol(priced(t))


SG = greeks_sql("(spot * (1 + ss))", "strike", "greatest(1, days - dp)", "greatest(1e-4, vol + vs)", "(option_type = 'call')", "(0.065e0 + rs)")["price"]


@query("scenario_reprice", "underlying:s strike:f2 option_type:s scenario:s scenario_price:f change:f",
       f"WITH {SPOT}, {CH} SELECT underlying, strike, option_type, scenario, {SG} AS scenario_price, {SG} - {G['price']} AS change FROM ch CROSS JOIN (VALUES ('up', 0.05e0, 0e0, 0, 0e0), ('down_vol', -0.05e0, 0.1e0, 0, 0e0), ('week', 0e0, 0e0, 7, 0e0), ('rate', 0e0, 0e0, 0, 0.01e0)) s(scenario, ss, vs, dp, rs)", "chain bars")
def _(t):
    s = t.spark.createDataFrame([("up", 0.05, 0.0, 0, 0.0), ("down_vol", -0.05, 0.1, 0, 0.0), ("week", 0.0, 0.0, 7, 0.0), ("rate", 0.0, 0.0, 0, 0.01)], "scenario string, spot_shock double, vol_shock double, days_passed int, rate_shock double")
    return op.scenario_reprice(priced(t), s)


@query("atm_straddle_move", "underlying:s expiry:d strike:f2 implied_move:f6",
       f"""WITH {SPOT}, q AS (SELECT underlying, strike, option_type, ask + 1 AS premium, spot FROM chain JOIN spot USING (underlying)), s AS (SELECT underlying, strike, max(premium) FILTER (WHERE option_type = 'call') AS c, max(premium) FILTER (WHERE option_type = 'put') AS p, max(spot) AS spot FROM q GROUP BY underlying, strike)
       SELECT underlying, DATE '2001-12-31' AS expiry, arg_min(strike, (abs(strike - spot), strike)) AS strike, arg_min((c + p) / spot / sqrt(30), (abs(strike - spot), strike)) AS implied_move FROM s WHERE c IS NOT NULL AND p IS NOT NULL GROUP BY underlying""", "chain bars")
def _(t):
    at = F.lit("2001-12-01 10:00:00").cast("timestamp")
    base = t.chain.join(spots(t), "underlying").select("underlying", "strike", "option_type", "spot", (C("ask") + 1).alias("premium"))
    fresh = base.select("*", (at - F.expr("INTERVAL 5 MINUTES")).alias("ts"), F.lit("2001-12-31").cast("date").alias("expiry"))
    old = base.select("underlying", "strike", "option_type", "spot", (C("premium") * 9).alias("premium"), (at - F.expr("INTERVAL 10 MINUTES")).alias("ts"), F.lit("2001-12-31").cast("date").alias("expiry"))
    stale = base.select("underlying", "strike", "option_type", "spot", "premium", (at - F.expr("INTERVAL 2 HOURS")).alias("ts"), F.lit("2001-12-10").cast("date").alias("expiry"))
    return op.atm_straddle_move(fresh.unionByName(old).unionByName(stale), at)


def iv_ticks(t):
    return t.ticks.select(C("symbol").alias("underlying"), "ts", "event_id", (C("price") / 500).alias("iv"))


@query("iv_rank", "underlying:s samples:i current:f6 lo:f6 hi:f6 mean:f6 iv_rank:f6 iv_percentile:f6",
       """WITH l AS (SELECT symbol AS underlying, arg_max(price / 500, (ts, event_id)) AS cur, max(ts) AS mx FROM ticks GROUP BY symbol), d AS (SELECT l.*, price / 500 AS iv FROM ticks JOIN l ON l.underlying = ticks.symbol WHERE ts >= mx - INTERVAL 20 DAY)
       SELECT underlying, count(*) AS samples, any_value(cur) AS current, min(iv) AS lo, max(iv) AS hi, avg(iv) AS mean, (any_value(cur) - min(iv)) / (max(iv) - min(iv)) AS iv_rank, (count(*) FILTER (WHERE iv < cur) + 0.5 * count(*) FILTER (WHERE iv = cur)) / count(*) AS iv_percentile FROM d GROUP BY underlying""", "ticks")
def _(t):
    return op.iv_rank(iv_ticks(t), 20)


@query("iv_dedupe", "underlying:s event_id:i ts:t iv:f6", BURST.format(gap=30).replace("FROM events)", "FROM events WHERE value / 500 BETWEEN 0.001 AND 5)") + "SELECT k AS underlying, event_id, m.ts, value / 500 AS iv FROM m JOIN events USING (event_id) WHERE m.ts = anchor", "events")
def _(t):
    return op.iv_dedupe(iv_ticks(t))


@query("oi_classification", "underlying:s days_to_expiry:i state:s",
       "WITH p AS (SELECT *, (futures_price / lag(futures_price) OVER w - 1) * 100 AS pp, (open_interest / lag(open_interest) OVER w - 1) * 100 AS oo FROM futures WINDOW w AS (PARTITION BY underlying ORDER BY days_to_expiry)) SELECT underlying, days_to_expiry, CASE WHEN pp IS NULL THEN NULL WHEN abs(pp) < 0.25 OR abs(oo) < 0.25 THEN 'neutral' WHEN pp > 0 AND oo > 0 THEN 'long_buildup' WHEN pp < 0 AND oo > 0 THEN 'short_buildup' WHEN pp > 0 AND oo < 0 THEN 'short_covering' ELSE 'long_unwinding' END AS state FROM p WHERE pp IS NOT NULL", "futures")
def _(t):
    s = op.Span(("underlying",), ("days_to_expiry",))
    d = t.futures.select("underlying", "days_to_expiry", ((C("futures_price") / s.lag("futures_price") - 1) * 100).alias("pp"), ((C("open_interest") / s.lag("open_interest") - 1) * 100).alias("oo")).where("pp is not null")
    return d.withColumn("state", op.oi_classification(C("pp"), C("oo")))


@query("futures_analysis", "underlying:s days:i shock:f basis:f basis_pct:f annualised_basis_pct:f fair_value:f mispricing:f positioning:s shocked_fair_value:f",
       f"""WITH {SPOT}, x AS (SELECT underlying, days_to_expiry AS days, futures_price AS f, spot AS s, lag(futures_price, 1, futures_price * 0.9e0) OVER w AS pf, open_interest AS o, lag(open_interest, 1, open_interest * 1.1e0) OVER w AS po FROM futures JOIN spot USING (underlying) WINDOW w AS (PARTITION BY underlying ORDER BY days_to_expiry)), y AS (SELECT *, (f / pf - 1) * 100 AS pp, (o / po - 1) * 100 AS oo FROM x)
       SELECT underlying, days, k AS shock, f - s AS basis, (f - s) / s * 100 AS basis_pct, (f - s) / s * 365 / days * 100 AS annualised_basis_pct, s * exp(0.065e0 * days / 365) AS fair_value, f - s * exp(0.065e0 * days / 365) AS mispricing, CASE WHEN abs(pp) < 0.25 OR abs(oo) < 0.25 THEN 'neutral' WHEN pp > 0 AND oo > 0 THEN 'long_buildup' WHEN pp < 0 AND oo > 0 THEN 'short_buildup' WHEN pp > 0 AND oo < 0 THEN 'short_covering' ELSE 'long_unwinding' END AS positioning,
       s * (1 + k) * exp(0.065e0 * days / 365) AS shocked_fair_value FROM y CROSS JOIN (SELECT unnest([-0.05e0, 0e0, 0.05e0]) AS k)""", "futures bars")
def _(t):
    s = op.Span(("underlying",), ("days_to_expiry",))
    d = t.futures.join(spots(t), "underlying")
    return op.futures_analysis(d.select("underlying", "spot", C("days_to_expiry").alias("days"), "futures_price", "open_interest", F.coalesce(s.lag("futures_price"), C("futures_price") * 0.9).alias("previous_price"), F.coalesce(s.lag("open_interest"), C("open_interest") * 1.1).alias("previous_open_interest")))


@query("term_structure", "underlying:s days_to_expiry:i basis:f oi_share:f6 fair_value:f roll_cost:f roll_yield_pct:f curve:s",
       f"""WITH {SPOT}, x AS (SELECT *, lead(futures_price) OVER w - futures_price AS roll_cost, lead(days_to_expiry) OVER w - days_to_expiry AS gap FROM futures JOIN spot USING (underlying) WINDOW w AS (PARTITION BY underlying ORDER BY days_to_expiry))
       SELECT underlying, days_to_expiry, futures_price - spot AS basis, open_interest / sum(open_interest) OVER u AS oi_share, spot * exp(0.065e0 * days_to_expiry / 365) AS fair_value, roll_cost, roll_cost / futures_price * 365 / gap * 100 AS roll_yield_pct, CASE WHEN min(sign(roll_cost)) OVER u = max(sign(roll_cost)) OVER u THEN CASE min(sign(roll_cost)) OVER u WHEN 1 THEN 'contango' WHEN -1 THEN 'backwardation' ELSE 'flat' END ELSE 'mixed' END AS curve FROM x WINDOW u AS (PARTITION BY underlying)""", "futures bars")
def _(t):
    return op.term_structure(t.futures, spots(t))


def curve_sql(span, points, val, extra=""):
    return f"""ct AS (SELECT book_id, avg(strike) AS centre FROM lg GROUP BY book_id), gp AS (SELECT lg.*, i, centre * ({1 - span!r} + {2 * span!r} * i / {points - 1}) AS x FROM lg JOIN ct USING (book_id) CROSS JOIN (SELECT unnest(range({points})) AS i)),
  cu AS (SELECT book_id, i, any_value(x) AS x, sum({val}) AS pnl FROM gp GROUP BY book_id, i), cl AS (SELECT *, lead(pnl) OVER w AS n, lead(x) OVER w AS nx FROM cu WINDOW w AS (PARTITION BY book_id ORDER BY i)),
  cb AS (SELECT *, CASE WHEN pnl * n < 0 THEN x - pnl * (nx - x) / (n - pnl) WHEN pnl = 0 AND n IS NOT NULL THEN x END AS be FROM cl), cs AS (SELECT book_id, max(pnl) AS max_profit, min(pnl) AS max_loss, count(be) AS breakevens, min(be) AS first_breakeven, max(be) AS last_breakeven FROM cb GROUP BY book_id)"""


SGN = "CASE side WHEN 'buy' THEN 1e0 ELSE -1e0 END * contracts"
PAY = f"{SGN} * CASE type WHEN 'call' THEN greatest(0, x - strike) - premium WHEN 'put' THEN greatest(0, strike - x) - premium ELSE x - strike END"


@query("payoff_grid", "book_id:i max_profit:f2 max_loss:f2 breakevens:i first_breakeven:f2 last_breakeven:f2 up_slope:f down_slope:f",
       f"""WITH lg AS (SELECT * REPLACE (strike + 7e0 AS strike) FROM legs), tl AS (SELECT book_id, avg(strike) AS centre, sum(CASE type WHEN 'put' THEN 0 ELSE {SGN} END) AS up_slope, sum(CASE type WHEN 'put' THEN -({SGN}) WHEN 'call' THEN 0 ELSE {SGN} END) AS down_slope FROM lg GROUP BY book_id),
       px AS (SELECT DISTINCT book_id, x FROM (SELECT book_id, unnest([0e0, centre * 0.5e0, centre * 1.5e0]) AS x FROM tl UNION ALL SELECT book_id, strike FROM lg WHERE type <> 'future')), cv AS (SELECT book_id, x, sum({PAY}) AS v FROM px JOIN lg USING (book_id) GROUP BY book_id, x),
       cl AS (SELECT *, lead(v) OVER w AS n, lead(x) OVER w AS nx FROM cv WINDOW w AS (PARTITION BY book_id ORDER BY x)), cb AS (SELECT *, CASE WHEN v = 0 THEN x WHEN v * n < 0 THEN x - v * (nx - x) / (n - v) END AS be FROM cl),
       cs AS (SELECT book_id, max(v) AS hi, min(v) AS lo, count(be) FILTER (WHERE be BETWEEN centre * 0.5e0 AND centre * 1.5e0) AS breakevens, min(be) FILTER (WHERE be BETWEEN centre * 0.5e0 AND centre * 1.5e0) AS first_breakeven, max(be) FILTER (WHERE be BETWEEN centre * 0.5e0 AND centre * 1.5e0) AS last_breakeven FROM cb JOIN tl USING (book_id) GROUP BY book_id)
       SELECT *, CASE WHEN up_slope <= 1e-9 THEN hi END AS max_profit, CASE WHEN up_slope >= -1e-9 THEN lo END AS max_loss FROM cs JOIN tl USING (book_id)""", "legs")
def _(t):
    return op.payoff_grid(t.legs.withColumn("strike", C("strike") + 7.0))


CM = greeks_sql("x", "strike", "30", "0.3e0", "(type = 'call')")["price"]


@query("calendar_spread_grid", "book_id:i max_profit:f2 max_loss:f2 breakevens:i first_breakeven:f2",
       f"""WITH lg AS (SELECT * REPLACE (strike + 7e0 AS strike, CASE type WHEN 'future' THEN 'call' ELSE type END AS type), CASE WHEN linenumber % 2 = 0 THEN 'near' ELSE 'far' END AS leg FROM legs), {curve_sql(0.2, 41, f"{SGN} * (CASE leg WHEN 'near' THEN greatest(0, CASE type WHEN 'call' THEN x - strike ELSE strike - x END) ELSE {CM} END - premium)")} SELECT * FROM cs""", "legs")
def _(t):
    l = t.legs.withColumn("strike", C("strike") + 7.0).withColumn("type", F.when(C("type") == "future", "call").otherwise(C("type"))).withColumn("leg", F.when(C("linenumber") % 2 == 0, "near").otherwise("far"))
    return op.calendar_spread_grid(l, 30, 60, 0.3)


TMPL = [("iron_condor", 1, "put", "buy", -10.0), ("iron_condor", 2, "put", "sell", -5.0), ("iron_condor", 3, "call", "sell", 5.0), ("iron_condor", 4, "call", "buy", 10.0), ("straddle", 1, "call", "buy", 0.0), ("straddle", 2, "put", "buy", 0.0)]
SL = greeks_sql("spot", "k", "30", "0.25e0", "(type = 'call')")["price"]


@query("strategy_legs", "underlying:s template:s leg_no:i type:s side:s strike:f2 premium:f",
       f"WITH {SPOT}, x AS (SELECT underlying, spot, template, leg_no, type, side, greatest(50, floor(spot * (1 + o / 100) / 50 + 0.5e0) * 50) AS k FROM spot CROSS JOIN (VALUES {', '.join(f'({a!r}, {b}, {c!r}, {d!r}, {e}e0)' for a, b, c, d, e in TMPL)}) v(template, leg_no, type, side, o)) SELECT underlying, template, leg_no, type, side, k AS strike, {SL} AS premium FROM x", "bars")
def _(t):
    return op.strategy_legs(spots(t), t.spark.createDataFrame(TMPL, "template string, leg_no int, type string, side string, offset_pct double"), 50.0, 30, 0.25)


SM = greeks_sql("(spot * (1 + sh / 100))", "strike", "30", "greatest(1e-4, 0.3e0 * (1 + vr))", "(type = 'call')")["price"]


@query("scenario_margin", "book_id:i base_value:f2 worst:f2 short_premium:f2 total_margin:f2",
       f"""WITH lg AS (SELECT * REPLACE (strike + 50e0 AS strike) FROM legs), sp AS (SELECT book_id, avg(strike) AS spot FROM lg GROUP BY book_id), x AS (SELECT book_id, sh, vr, sum({SGN} * (CASE type WHEN 'future' THEN spot * (1 + sh / 100) ELSE {SM} END - premium)) AS v FROM lg JOIN sp USING (book_id) CROSS JOIN (SELECT unnest([0e0, -3, -5, -10, -15, 3, 5, 10, 15]) AS sh) CROSS JOIN (SELECT unnest([0e0, -0.25, 0.25, 0.5]) AS vr) GROUP BY book_id, sh, vr),
       g AS (SELECT book_id, max(v) FILTER (WHERE sh = 0 AND vr = 0) AS base_value, min(v) AS worst FROM x GROUP BY book_id), p AS (SELECT book_id, sum(CASE WHEN side = 'sell' AND type <> 'future' THEN premium * contracts ELSE 0 END) AS short_premium FROM lg GROUP BY book_id) SELECT *, greatest(base_value - worst, short_premium, 0) AS total_margin FROM g JOIN p USING (book_id)""", "legs")
def _(t):
    l = t.legs.withColumn("strike", C("strike") + 50.0)
    return op.scenario_margin(l, l.groupBy("book_id").agg(F.avg("strike").alias("spot")), 0.3, 30)


@query("bracket_trigger_scan", "order_id:s triggered_at:d",
       """WITH o AS (SELECT concat_ws('-', orderkey, linenumber, partkey, suppkey) AS order_id, symbol, CAST(ts AS DATE) AS ts, side, price, CASE WHEN linenumber % 2 = 0 THEN 'limit' ELSE 'stop' END AS kind, price * (CASE WHEN (side = 'BUY') = (linenumber % 2 = 0) THEN 0.85e0 ELSE 1.15e0 END) AS level FROM transactions)
       SELECT order_id, min(b.ts) AS triggered_at FROM o JOIN bars b ON b.symbol = o.symbol AND b.ts > o.ts AND b.ts <= o.ts + 30 AND CASE WHEN (side = 'BUY') = (kind = 'limit') THEN low <= level ELSE high >= level END GROUP BY order_id""", "transactions bars")
def _(t):
    buy_limit = (C("side") == "BUY") == (C("linenumber") % 2 == 0)
    o = t.transactions.select(F.concat_ws("-", "orderkey", "linenumber", "partkey", "suppkey").alias("order_id"), "symbol", F.to_date("ts").alias("ts"), "side", "price", F.when(C("linenumber") % 2 == 0, "limit").otherwise("stop").alias("kind"), (C("price") * F.when(buy_limit, 0.85).otherwise(1.15)).alias("level"))
    return op.bracket_trigger_scan(o, t.bars, 0.2, 30)
