"""Quality, corporate-action, provenance and operations queries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality as q
from ..operators.indicators import sma
from .indicator_queries import W, full
from .registry import query

C = F.col
SEQ = ["orderkey", "linenumber", "partkey", "suppkey"]


def raw_bars(t):
    """One-trade bars with broken highs, zero volumes and repeated timestamps, from all trades."""
    px = C("px")
    return t.trades.select("symbol", F.to_date("shipdate").alias("ts"), px.alias("open"), F.when(C("linenumber") % 7 == 5, px * 0.9).otherwise(px).alias("high"),
                           px.alias("low"), px.alias("close"), (C("qty") - 1).alias("volume"), *SEQ)


RAW = "raw AS (SELECT symbol, ts, px AS open, CASE WHEN linenumber % 7 = 5 THEN px * 0.9e0 ELSE px END AS high, px AS low, px AS close, qty - 1 AS volume, orderkey, linenumber, partkey, suppkey FROM trades)"


@query("price_contract", "symbol:s rule:s bad_rows:i",
       f"""WITH {RAW} SELECT symbol, unnest(['ohlc_positive','volume_non_negative','high_bound','low_bound','ts_missing','duplicate_ts']) AS rule,
       unnest([count(*) FILTER (WHERE least(open,high,low,close) <= 0), count(*) FILTER (WHERE volume < 0), count(*) FILTER (WHERE high < greatest(open,close,low)),
       count(*) FILTER (WHERE low > least(open,close,high)), count(*) FILTER (WHERE ts IS NULL), count(*) - count(DISTINCT ts)]) AS bad_rows FROM raw GROUP BY symbol""", "trades")
def _(t):
    return q.price_contract(raw_bars(t))


@query("bar_clean", "symbol:s rows:i close_sum:f2",
       f"WITH {RAW} SELECT symbol, count(*) AS rows, sum(close) AS close_sum FROM raw WHERE high >= greatest(open,close,low) AND low <= least(open,close,high) AND volume >= 0 GROUP BY symbol HAVING count(*) >= 10", "trades")
def _(t):
    return q.bar_clean(raw_bars(t)).groupBy("symbol").agg(F.count("*").alias("rows"), F.sum("close").alias("close_sum"))


SUSPECT = """sus AS (SELECT symbol, ts, r, k, g FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY g, k) AS b FROM (
  SELECT symbol, ts, r, k, abs(r - k) / k AS g FROM (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS r FROM {src}) s
  CROSS JOIN (SELECT unnest([0.2e0, 0.25e0, 1/3e0, 0.4e0, 0.5e0, 2/3e0, 1.5e0, 2e0, 2.5e0, 3e0, 4e0, 5e0]) AS k) WHERE r IS NOT NULL)) WHERE b = 1 AND g <= 0.035e0)"""


@query("data_quality_score", "symbol:s missingness:f6 zero_volume:f6 duplicates:i suspects:i score:f6 level:s",
       f"""WITH {RAW}, f AS (SELECT symbol, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY high >= close DESC, orderkey DESC, linenumber DESC, partkey DESC, suppkey DESC) AS d FROM raw) WHERE d = 1),
       {SUSPECT.format(src='f')}, a AS (SELECT symbol, avg(CASE WHEN high < close THEN 1e0 ELSE 0 END) AS missingness, avg(CASE WHEN volume = 0 THEN 1e0 ELSE 0 END) AS zero_volume, count(*) - count(DISTINCT ts) AS duplicates FROM raw GROUP BY symbol),
       s AS (SELECT a.*, coalesce(n, 0) AS suspects FROM a LEFT JOIN (SELECT symbol, count(*) AS n FROM sus GROUP BY symbol) USING (symbol)),
       z AS (SELECT *, greatest(0, least(1, 1 - missingness - 1.5 * zero_volume - CASE WHEN duplicates > 0 THEN 0.5 ELSE 0 END - CASE WHEN suspects > 0 THEN 0.25 ELSE 0 END)) AS score FROM s)
       SELECT *, CASE WHEN score >= 0.9 THEN 'strong' WHEN score >= 0.7 THEN 'limited' ELSE 'blocked' END AS level FROM z""", "trades")
def _(t):
    return q.data_quality_score(raw_bars(t), C("high") >= C("close"), SEQ)


@query("split_suspects", "symbol:s ts:d ratio:f6 known_ratio:f6 rank:i",
       f"WITH {SUSPECT.format(src='bars')} SELECT symbol, ts, r AS ratio, k AS known_ratio, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rank FROM sus")
def _(t):
    return q.split_suspects(t.bars)


@query("adjust_ratio_actions", "symbol:s ts:d open:f high:f low:f close:f volume:f events:i",
       """SELECT symbol, ts, open / f AS open, high / f AS high, low / f AS low, close / f AS close, volume * f AS volume, events FROM (SELECT b.*, coalesce(f, 1) AS f, coalesce(n, 0) AS events FROM bars b LEFT JOIN
       (SELECT b.symbol, b.ts, product(term) AS f, count(*) AS n FROM bars b JOIN (SELECT symbol, ex_date, term FROM actions WHERE action_type <> 'dividend' UNION ALL SELECT symbol, DATE '1999-06-30', 1.5e0 FROM actions WHERE action_type = 'split') a
        ON a.symbol = b.symbol AND b.ts < a.ex_date GROUP BY b.symbol, b.ts) USING (symbol, ts))""", "bars actions")
def _(t):
    a = t.actions.where("action_type <> 'dividend'").select("symbol", "ex_date", C("term").alias("ratio"))
    b = t.actions.where("action_type = 'split'").select("symbol", F.lit("1999-06-30").cast("date").alias("ex_date"), F.lit(1.5).alias("ratio"))
    return q.adjust_ratio_actions(t.bars, a.unionByName(b))


def typed_actions(t) -> DataFrame:
    cap = C("cap_bucket")
    none = F.lit(None)

    def rows(where, kind, day, seq, ratio=None, price=None, cash=None, factor=None, target=None):
        return t.instruments.where(where).select(
            "symbol", F.coalesce(F.lit(target), C("symbol")).alias("target_symbol"), F.lit(kind).alias("action_type"), F.lit(day).cast("date").alias("ex_date"),
            F.lit(seq).alias("seq"), F.lit(ratio).cast("double").alias("ratio"), F.lit(price).cast("double").alias("price"), F.lit(cash).cast("double").alias("cash"),
            F.lit(factor).cast("double").alias("factor"), none.cast("string").alias("new_isin"), none.cast("string").alias("source_isin"))

    parts = [rows(cap == "small", "split", "1998-06-30", 1, ratio=2.0), rows(cap == "mid", "bonus", "1998-06-30", 1, ratio=0.5),
             rows(cap == "large", "dividend", "1998-06-30", 1, cash=5.0), rows(cap == "mid", "rights", "1998-06-30", 2, ratio=0.25, price=50.0),
             rows(F.lit(True), "dividend", "1997-03-31", 1, cash=2.0), rows(cap == "large", "merger", "1999-01-15", 1, factor=0.8),
             rows(cap == "small", "merger", "1999-01-15", 1), rows(cap == "mid", "split", "2000-01-05", 1, ratio=-1.0),
             rows(cap == "large", "bonus", "2000-01-05", 1, ratio=1.0, target="OTHER")]
    return q.check_actions(reduce(DataFrame.unionByName, parts))


def adj_sql(c):
    p1 = f"CASE WHEN ts < DATE '1997-03-31' THEN {c} - 2 ELSE {c} END"
    return f"""CASE WHEN ts >= DATE '1999-01-15' OR (ts >= DATE '1998-06-30' AND cap_bucket <> 'large') THEN {c} WHEN ts >= DATE '1998-06-30' THEN {c} * 0.8e0
      WHEN cap_bucket = 'small' THEN ({p1}) / 2 WHEN cap_bucket = 'mid' THEN ({p1}) / 1.5e0 * terp ELSE (({p1}) - 5) * 0.8e0 END"""


ADJ = f"""adj AS (SELECT symbol, ts, {', '.join(f'{adj_sql(c)} AS {c}' for c in ('open', 'high', 'low', 'close'))},
  CASE WHEN ts >= DATE '1999-01-15' OR (ts >= DATE '1998-06-30' AND cap_bucket <> 'large') THEN volume WHEN ts >= DATE '1998-06-30' THEN volume / 0.8e0 WHEN cap_bucket = 'small' THEN volume * 2
   WHEN cap_bucket = 'mid' THEN volume * 1.5e0 / terp ELSE volume / 0.8e0 END AS volume FROM bars JOIN instruments USING (symbol) LEFT JOIN
  (SELECT symbol, (r / 1.5e0 + 12.5e0) / (r / 1.5e0 * 1.25e0) AS terp FROM (SELECT symbol, arg_max(close, ts) AS r FROM bars WHERE ts < DATE '1998-06-30' GROUP BY symbol)) USING (symbol))"""


@query("adjust_all_actions", "symbol:s ts:d open:f high:f low:f close:f volume:f", f"WITH {ADJ} SELECT * FROM adj", "bars instruments")
def _(t):
    return q.adjust_all_actions(t.bars, typed_actions(t))


@query("verify_adjustment", "symbol:s checks:i bad_price:i bad_volume:i in_range:i verified:b",
       f"""WITH {ADJ}, x AS (SELECT *, lag(close) OVER w AS pc, lag(volume) OVER w AS pv, row_number() OVER w AS rn, count(*) OVER (PARTITION BY symbol) AS n, min(ts) OVER (PARTITION BY symbol) AS t0, max(ts) OVER (PARTITION BY symbol) AS t1 FROM adj {W}),
       a AS (SELECT symbol, 'dividend' AS k, DATE '1997-03-31' AS ex, 1 AS seq, 0e0 AS w FROM instruments UNION ALL SELECT symbol, CASE cap_bucket WHEN 'small' THEN 'split' WHEN 'mid' THEN 'bonus' ELSE 'dividend' END, DATE '1998-06-30', 1, CASE cap_bucket WHEN 'small' THEN 2e0 ELSE 1.5e0 END FROM instruments
        UNION ALL SELECT symbol, 'rights', DATE '1998-06-30', 2, 0e0 FROM instruments WHERE cap_bucket = 'mid' UNION ALL SELECT symbol, 'merger', DATE '1999-01-15', 1, 0e0 FROM instruments WHERE cap_bucket = 'large'),
       m AS (SELECT * FROM (SELECT x.*, k, ex, w, row_number() OVER (PARTITION BY symbol, k, ex, seq ORDER BY abs(ts - ex), ts DESC) AS b FROM x JOIN a USING (symbol) WHERE ex BETWEEN t0 AND t1) WHERE b = 1),
       c AS (SELECT symbol, CASE WHEN rn >= 2 AND rn < n AND pc > 0 THEN abs(close - pc) / pc < 0.15 END AS p, CASE WHEN rn >= 2 AND rn < n AND k IN ('split', 'bonus') THEN abs(pv / volume - w) < 0.2 END AS v, ex > t0 AS ir FROM m)
       SELECT symbol, count(p) + count(v) AS checks, count(*) FILTER (WHERE NOT p) AS bad_price, count(*) FILTER (WHERE NOT v) AS bad_volume, count(*) FILTER (WHERE ir) AS in_range,
       count(*) FILTER (WHERE NOT p OR NOT v) = 0 AND (count(*) FILTER (WHERE ir) = 0 OR count(p) + count(v) > 0) AS verified FROM c GROUP BY symbol""", "bars instruments")
def _(t):
    a = typed_actions(t)
    return q.verify_adjustment(q.adjust_all_actions(t.bars, a), a)


def cached_versions(t):
    """Daily bars as two fetched versions; some differ, some repeat, some come from another provenance."""
    d = F.dayofyear("ts")
    b = t.bars.select("symbol", "ts", "open", "high", "low", "close", "volume", F.when(d % 97 == 3, "unknown").otherwise("real").alias("provenance"), F.lit("1D").alias("timeframe"),
                      (d % 89 != 5).alias("actions_verified"), (F.to_timestamp("ts") + F.expr("INTERVAL 11 HOURS")).alias("received_at"), F.lit(1).alias("version"))
    v2 = b.where(d % 61 == 7).withColumn("version", F.lit(2)).withColumn("volume", C("volume") + F.when(d == 68, 1).otherwise(0))
    return b.unionByName(v2)


ELIG = """e0 AS (SELECT b.*, dayofyear(ts) AS d, c.ts IS NOT NULL AS sess FROM bars b LEFT JOIN (SELECT ts FROM calendar) c USING (ts)),
  e1 AS (SELECT symbol, ts, open, high, low, close, volume + CASE WHEN d = 68 THEN 1 ELSE 0 END AS volume, sess, d = 68 AS conflict, list_filter([CASE WHEN d % 97 = 3 THEN 'unknown' END, CASE WHEN d % 89 = 5 THEN 'actions_unverified' END,
    CASE WHEN NOT sess THEN 'session_calendar_unverified_or_nonregular' END, CASE WHEN d = 68 THEN 'conflicting_session' END, CASE WHEN d % 61 = 7 AND d <> 68 THEN 'duplicate_session' END], lambda x: x IS NOT NULL) AS r FROM e0),
  e2 AS (SELECT *, max(CASE WHEN len(r) = 0 THEN ts END) OVER (PARTITION BY symbol) AS l FROM e1),
  e3 AS (SELECT *, max(CASE WHEN (NOT sess OR conflict) AND ts < l THEN ts END) OVER (PARTITION BY symbol) AS cut FROM e2),
  elig AS (SELECT symbol, ts, close, volume, len(r) = 0 AND NOT coalesce(ts <= cut, false) AS eligible, CASE WHEN len(r) = 0 AND ts <= cut THEN 'history_before_unverified_session_gap' ELSE array_to_string(r, ',') END AS reasons FROM e3)"""


@query("history_eligibility", "symbol:s ts:d volume:f eligible:b reasons:s", f"WITH {ELIG} SELECT * FROM elig", "bars calendar")
def _(t):
    return q.history_eligibility(cached_versions(t), t.calendar).withColumn("reasons", F.concat_ws(",", "reasons"))


@query("manifest_reconcile", "symbol:s missing:i extra:i repeated:i matches:b",
       """WITH e AS (SELECT symbol, ts FROM bars WHERE trades > 1), x AS (SELECT symbol, ts, count(*) AS have FROM (SELECT symbol, ts FROM bars WHERE day(ts) <> 13 UNION ALL SELECT symbol, ts FROM bars WHERE day(ts) = 7) GROUP BY symbol, ts)
       SELECT symbol, count(*) FILTER (WHERE x.ts IS NULL) AS missing, count(*) FILTER (WHERE e.ts IS NULL) AS extra, count(*) FILTER (WHERE have > 1) AS repeated,
       bool_and(x.ts IS NOT NULL AND e.ts IS NOT NULL AND have = 1) AS matches FROM (SELECT coalesce(e.symbol, x.symbol) AS symbol, e.ts AS ets, x.ts AS xts, have, e, x FROM e FULL JOIN x ON e.symbol = x.symbol AND e.ts = x.ts) GROUP BY symbol""".replace("x.ts IS NULL", "xts IS NULL").replace("e.ts IS NULL", "ets IS NULL").replace("x.ts IS NOT NULL", "xts IS NOT NULL").replace("e.ts IS NOT NULL", "ets IS NOT NULL").replace(", have, e, x FROM", ", have FROM"))
def _(t):
    b = t.bars
    return q.manifest_reconcile(b.where("trades > 1"), b.where(F.dayofmonth("ts") != 13).unionByName(b.where(F.dayofmonth("ts") == 7)))


@query("freshness", "symbol:s updated_at:d age_days:i sessions_behind:i is_stale:b",
       """SELECT *, sessions_behind > 3 AS is_stale FROM (SELECT symbol, max(ts) AS updated_at, DATE '2001-11-12' - max(ts) AS age_days, greatest(0, floor((DATE '2001-11-12' - max(ts)) * 5 / 7)) AS sessions_behind FROM bars GROUP BY symbol)""")
def _(t):
    return q.freshness(t.bars, F.lit("2001-11-12").cast("date"))


@query("universe_reconcile", "exchange:s expected:i resolved:i missing:i extra:i resolved_with_key:i covered_pct:f missing_sample:s extra_sample:s action:s",
       """WITH e AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'X1' ELSE 'X2' END AS exchange, concat(p_name, '#', CAST(p_partkey AS VARCHAR)) AS symbol FROM part),
       r AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'X1' ELSE 'X2' END AS exchange, concat(p_name, CASE WHEN p_size % 7 = 0 THEN '@' ELSE '#' END, CAST(p_partkey AS VARCHAR)) AS symbol, bool_or(p_size % 3 = 0) AS keyed FROM part GROUP BY ALL),
       j AS (SELECT coalesce(e.exchange, r.exchange) AS exchange, e.symbol AS es, r.symbol AS rs, keyed FROM e FULL JOIN r ON e.exchange = r.exchange AND e.symbol = r.symbol)
       SELECT exchange, count(es) AS expected, count(rs) AS resolved, count(*) FILTER (WHERE rs IS NULL) AS missing, count(*) FILTER (WHERE es IS NULL) AS extra, count(*) FILTER (WHERE keyed) AS resolved_with_key,
       100 - round(count(*) FILTER (WHERE rs IS NULL) / count(es) * 100, 2) AS covered_pct, coalesce(array_to_string(list_slice(list_sort(list(es) FILTER (WHERE rs IS NULL)), 1, 25), ','), '') AS missing_sample,
       coalesce(array_to_string(list_slice(list_sort(list(rs) FILTER (WHERE es IS NULL)), 1, 25), ','), '') AS extra_sample, CASE WHEN count(*) FILTER (WHERE rs IS NULL OR es IS NULL) > 0 THEN 'refresh' ELSE 'in_sync' END AS action FROM j GROUP BY exchange""", "part")
def _(t):
    p = t.raw("part").select(F.when(C("p_partkey") % 2 == 0, "X1").otherwise("X2").alias("exchange"), "p_name", "p_partkey", "p_size")
    named = lambda mark: F.concat("p_name", mark, C("p_partkey").cast("string"))
    renamed = F.when(C("p_size") % 7 == 0, "@").otherwise("#")  # what the provider lists under another name
    return q.universe_reconcile(p.withColumn("symbol", named(F.lit("#"))), p.withColumn("symbol", named(renamed)).withColumn("instrument_key", F.when(C("p_size") % 3 == 0, "K")))


@query("provider_compare", "symbol:s S0:f S1:f S2:f", "SELECT symbol, max(price) FILTER (WHERE provider = 'S0') AS S0, max(price) FILTER (WHERE provider = 'S1') AS S1, max(price) FILTER (WHERE provider = 'S2') AS S2 FROM quotes GROUP BY symbol", "quotes")
def _(t):
    return q.provider_compare(t.quotes, ["S0", "S1", "S2"])


HEALTH = """hl AS (SELECT provider, max(CASE WHEN ok THEN ts END) AS lo FROM calls GROUP BY provider), health AS (SELECT provider, count(*) AS requests, count(*) FILTER (WHERE ok) AS successes, count(*) FILTER (WHERE NOT ok) AS failures,
  CASE WHEN provider = 'P2' THEN 0 ELSE count(*) FILTER (WHERE ok) END AS fallbacks, arg_max(latency_ms, ts) AS last_latency_ms, count(*) FILTER (WHERE NOT ok AND ts > lo) AS failure_streak, any_value(lo) AS lo FROM calls JOIN hl USING (provider) GROUP BY provider)"""


@query("provider_health", "provider:s requests:i successes:i failures:i fallbacks:i last_latency_ms:i failure_streak:i demoted:b seconds_since_success:f",
       f"WITH {HEALTH} SELECT *, failure_streak >= 3 AS demoted, (epoch_us((SELECT max(ts) FROM calls)) - epoch_us(lo)) / 1e6 AS seconds_since_success FROM health", "calls")
def _(t):
    return q.provider_health(t.calls, ["P2", "P0", "P1", "P3"])


@query("provider_order", "symbol:s provider:s price:f candidates:i",
       f"""WITH {HEALTH} SELECT symbol, arg_min(provider, o) AS provider, arg_min(price, o) AS price, count(*) AS candidates FROM (SELECT symbol, replace(provider, 'S', 'P') AS provider, price,
       CASE WHEN failure_streak >= 3 THEN 10 ELSE 0 END + CASE provider WHEN 'S2' THEN 1 WHEN 'S0' THEN 2 WHEN 'S1' THEN 3 END AS o FROM quotes JOIN (SELECT replace(provider, 'P', 'S') AS provider, failure_streak FROM health) USING (provider)) GROUP BY symbol""", "quotes calls")
def _(t):
    h = q.provider_health(t.calls, ["P2", "P0", "P1", "P3"])
    return q.provider_order(t.quotes.withColumn("provider", F.regexp_replace("provider", "S", "P")), h)


FEATS = ["sma_20", "sma_200", "sma_50", "ret_1", "odd_gap"]


@query("trailing_complete_features", "symbol:s feature:s run:i rank:i kept:b",
       f"""WITH f AS (SELECT symbol, ts, {full(20, 'avg(close)')} AS sma_20, {full(200, 'avg(close)')} AS sma_200, {full(50, 'avg(close)')} AS sma_50, close / lag(close) OVER w - 1 AS ret_1,
        CASE WHEN day(ts) <> 31 THEN close END AS odd_gap, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS d, count(*) OVER (PARTITION BY symbol) AS n FROM bars {W}),
       u AS (SELECT symbol, ts, d, n, unnest(['sma_20','sma_200','sma_50','ret_1','odd_gap']) AS feature, unnest([sma_20, sma_200, sma_50, ret_1, odd_gap]) AS v FROM f),
       r AS (SELECT symbol, feature, coalesce(min(CASE WHEN v IS NULL THEN d END) - 1, max(n)) AS run FROM u GROUP BY symbol, feature),
       k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY run DESC, feature) AS rank FROM r),
       b AS (SELECT u.symbol, ts, min(CASE WHEN v IS NULL THEN rank END) AS fm FROM u JOIN k USING (symbol, feature) GROUP BY u.symbol, ts),
       c AS (SELECT k.symbol, rank, count(*) AS rows FROM k JOIN b ON b.symbol = k.symbol AND (fm IS NULL OR fm > rank) GROUP BY k.symbol, rank),
       m AS (SELECT symbol, max(rank) AS keep FROM c WHERE rows >= 1450 GROUP BY symbol) SELECT symbol, feature, run, rank, rank <= coalesce(keep, 6) AS kept FROM k LEFT JOIN m USING (symbol)""")
def _(t):
    from ..operators.indicators import change
    f = t.bars.select("symbol", "ts", sma(20).alias("sma_20"), sma(200).alias("sma_200"), sma(50).alias("sma_50"), change().alias("ret_1"),
                      F.when(F.dayofmonth("ts") != 31, C("close")).alias("odd_gap"))
    return q.trailing_complete_features(f, FEATS, 1450)


@query("dataset_fingerprint", "symbol:s fingerprint:s rows:i",
       """WITH r AS (SELECT symbol, year(ts) AS y, ts, sha256(concat_ws('|', CAST(ts AS VARCHAR), CAST(CAST(floor(open * 1e6) AS BIGINT) AS VARCHAR), CAST(CAST(floor(high * 1e6) AS BIGINT) AS VARCHAR), CAST(CAST(floor(low * 1e6) AS BIGINT) AS VARCHAR), CAST(CAST(floor(close * 1e6) AS BIGINT) AS VARCHAR), CAST(CAST(floor(volume * 1e6) AS BIGINT) AS VARCHAR))) AS h FROM bars),
       g AS (SELECT symbol, y, sha256(string_agg(h, '' ORDER BY ts)) AS h, count(*) AS n FROM r GROUP BY symbol, y) SELECT symbol, sha256(string_agg(h, '' ORDER BY y)) AS fingerprint, sum(n) AS rows FROM g GROUP BY symbol""")
def _(t):
    return q.dataset_fingerprint(t.bars)


@query("error_groups", "fingerprint:s event_type:s scope:s failures:i first_seen:t last_seen:t recent_ids:s",
       """WITH e AS (SELECT *, concat('S', CAST(user_id % 7 AS VARCHAR)) AS scope FROM events), g AS (SELECT *, substr(sha256(concat_ws('|', scope, event_type)), 1, 16) AS fingerprint, row_number() OVER (PARTITION BY scope, event_type ORDER BY ts DESC, event_id DESC) AS r FROM e)
       SELECT fingerprint, event_type, scope, count(*) AS failures, min(ts) AS first_seen, max(ts) AS last_seen, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY r) FILTER (WHERE r <= 10) AS recent_ids FROM g GROUP BY ALL""", "events")
def _(t):
    e = t.raw("events").select("event_id", "event_type", "ts", F.concat(F.lit("S"), (C("user_id") % 7).cast("string")).alias("scope"))
    return q.error_groups(e, ["scope", "event_type"])


@query("failure_budget_gate", "feature:s samples:i failure_rate:f action:s",
       """SELECT event_type AS feature, count(*) AS samples, CASE WHEN count(*) >= m THEN round(avg(CASE WHEN value > 100 THEN 1e0 ELSE 0 END), 4) END AS failure_rate, CASE WHEN count(*) < m THEN 'insufficient_samples' WHEN avg(CASE WHEN value > 100 THEN 1e0 ELSE 0 END) <= b THEN 'within_budget' ELSE 'rolled_back' END AS action
       FROM events JOIN (VALUES ('click', 100, 0.5e0), ('error', 100, 0.01e0), ('view', 1000000, 0.5e0), ('purchase', 50, 0.3e0)) v(event_type, m, b) USING (event_type) GROUP BY event_type, m, b""", "events")
def _(t):
    b = t.spark.createDataFrame([("click", 100, 0.5), ("error", 100, 0.01), ("view", 1000000, 0.5), ("purchase", 50, 0.3)], "feature string, min_samples int, max_failure_rate double")
    return q.failure_budget_gate(t.raw("events").select(C("event_type").alias("feature"), (C("value") > 100).alias("failed")), b)


@query("rollout_bucket", "event_type:s bucket:i canary:f subjects:i",
       """SELECT event_type, CAST(('0x' || substr(sha256(event_type || ':' || user_id), 1, 8)) AS BIGINT) % 100 AS bucket, CAST(('0x' || substr(sha256(upper(event_type || user_id)), 1, 8)) AS BIGINT) % 10000 / 100e0 AS canary, count(*) AS subjects FROM events GROUP BY ALL""", "events")
def _(t):
    u = C("user_id").cast("string")
    return t.raw("events").select("event_type", q.rollout_bucket(C("event_type"), u).alias("bucket"), q.canary_bucket(F.concat("event_type", u)).alias("canary")).groupBy("event_type", "bucket", "canary").agg(F.count("*").alias("subjects"))


RULES = [(1, "symbol", "BRAND#3", "halted", None, None), (2, "model_version", "v1997", "old model", None, None), (3, "symbol", "BRAND#3", "audit", None, None), (4, "timeframe", "1w", "weekly off", None, None),
         (5, "symbol", "BRAND#9", "expired", "2000-01-01", None), (6, "asset_class", "equity", "revoked", None, "2000-01-01")]


@query("scope_block_match", "blocked:b scope:s reason:s rows:i",
       """SELECT scope IS NOT NULL AS blocked, scope, reason, count(*) AS rows FROM (SELECT CASE WHEN upper(symbol) = 'BRAND#3' THEN 'symbol' WHEN year(origin_date) = 1997 THEN 'model_version' END AS scope,
       CASE WHEN upper(symbol) = 'BRAND#3' THEN 'audit' WHEN year(origin_date) = 1997 THEN 'old model' END AS reason FROM ledger) GROUP BY ALL""", "ledger")
def _(t):
    r = t.spark.createDataFrame(RULES, "rule_id int, scope string, target string, reason string, expires_at string, revoked_at string").withColumn("expires_at", C("expires_at").cast("timestamp"))
    rows = t.ledger.select("symbol", "timeframe", F.lit("Equity").alias("asset_class"), F.concat(F.lit("v"), F.year("origin_date").cast("string")).alias("model_version"))
    return q.scope_block_match(rows, r, F.lit("2001-12-01").cast("timestamp"), ["symbol"]).groupBy("blocked", "scope", "reason").agg(F.count("*").alias("rows"))


@query("retention_filter", "event_type:s kept:i deleted:i", "SELECT event_type, count(*) FILTER (WHERE NOT d) AS kept, count(*) FILTER (WHERE d) AS deleted FROM (SELECT event_type, ts < TIMESTAMP '2024-01-15' AND event_type <> 'signup' AS d FROM events) GROUP BY event_type", "events")
def _(t):
    e = t.raw("events")
    _, drop = q.retention_filter(e, C("ts"), F.lit("2024-01-15").cast("timestamp_ntz"), C("event_type") == "signup")
    return e.groupBy("event_type").agg(F.count_if(~drop).alias("kept"), F.count_if(drop).alias("deleted"))


BURST = """WITH RECURSIVE f AS (SELECT event_type AS k, ts, event_id FROM events), a AS (SELECT k, min(ts) AS a FROM f GROUP BY k UNION ALL
  SELECT a.k, (SELECT min(ts) FROM f WHERE f.k = a.k AND f.ts > a.a + INTERVAL {gap} MINUTE) FROM a WHERE a.a IS NOT NULL),
  m AS (SELECT f.k, f.ts, f.event_id, a.a AS anchor FROM f ASOF JOIN (SELECT * FROM a WHERE a IS NOT NULL) a ON f.k = a.k AND f.ts >= a.a) """


@query("failed_event_burst", "symbol:s event_id:i anchor:t failures:i locked:b",
       BURST.format(gap=180) + "SELECT k AS symbol, event_id, anchor, n AS failures, n >= 5 AS locked FROM (SELECT *, count(*) OVER (PARTITION BY k, anchor ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM m)", "events")
def _(t):
    return q.failed_event_burst(t.ticks.select("symbol", "ts", "event_id"), "symbol", 180, 5)


@query("impossible_travel", "user_id:i event_id:i new_device:b distance_km:f2 speed_kmh:f1 impossible:b",
       """WITH l AS (SELECT user_id, event_type AS device, ts, event_id, CAST(event_id * 7 % 120 - 60 AS DOUBLE) AS lat, CAST(event_id * 13 % 340 - 170 AS DOUBLE) AS lon FROM events),
       p AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, device ORDER BY ts, event_id) AS seen, lag(ts) OVER u AS pt, lag(lat) OVER u AS pa, lag(lon) OVER u AS po FROM l WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
       d AS (SELECT *, 2 * 6371e0 * asin(sqrt(pow(sin(radians(lat - pa) / 2), 2) + cos(radians(pa)) * cos(radians(lat)) * pow(sin(radians(lon - po) / 2), 2))) AS distance_km, greatest((epoch_us(ts) - epoch_us(pt)) / 3.6e9, 1e-6) AS h FROM p)
       SELECT user_id, event_id, seen IS NULL OR ts > seen + INTERVAL 5 DAY AS new_device, distance_km, distance_km / h AS speed_kmh, coalesce(distance_km > 50 AND distance_km / h > 900, false) AS impossible FROM d""", "events")
def _(t):
    e = t.ticks.select("user_id", C("symbol").alias("device"), "ts", "event_id", (C("event_id") * 7 % 120 - 60).cast("double").alias("lat"), (C("event_id") * 13 % 340 - 170).cast("double").alias("lon"))
    return q.impossible_travel(e, new_after_days=5)


def redact_sql():
    out, prev = [], "r0 AS (SELECT doc_id, text FROM documents)"
    out.append(prev)
    names = list(q.REDACTIONS)
    for i, (name, (pat, repl)) in enumerate(q.REDACTIONS.items()):
        p = pat.replace("'", "''")
        out.append(f"r{i + 1} AS (SELECT * EXCLUDE (text), len(regexp_extract_all(text, '{p}')) AS n_{name}, regexp_replace(text, '{p}', '{repl.replace('$', chr(92))}', 'g') AS text FROM r{i})")
    return "WITH " + ", ".join(out) + f" SELECT doc_id, {', '.join('n_' + n for n in names)}, md5(text) AS digest FROM r{len(names)}"


@query("redact_text", "doc_id:i n_bearer:i n_session:i n_jwt:i n_oauth_secret:i n_json_value:i n_assignment:i digest:s", redact_sql(), "documents")
def _(t):
    return q.redact_text(t.raw("documents").select("doc_id", "text"), "text").withColumn("digest", F.md5("text"))
