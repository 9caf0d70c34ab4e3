"""Streaming and plug-in queries; streams run over the available files and are read back."""

from pyspark.sql import functions as F

from ..operators import context as cx
from ..operators import plugins as pg
from ..operators.indicators import change
from ..operators.ledger import headline_sentiment
from ..session import shared_path
from ..sources.keyed_store import KeyedStore
from ..streaming import health, late
from ..streaming import ticks as st
from .evaluation_queries import replay_sql
from .indicator_queries import W
from .ledger_queries import SENT
from .registry import query
from .session_queries import bucket_sql, cal_sql, full_calendar

C = F.col


def stream(t):
    return st.tick_source(t.spark, f"{t.dir}/events*.parquet")


@query("tick_stream_source", "symbol:s ticks:i price_sum:f2 delta_sum:f bid_sum:f2 range_sum:f2 change_sum:f2 oi_sum:i iv_sum:f", "SELECT symbol, count(*) AS ticks, sum(price) AS price_sum, sum(least(1, price / 500)) AS delta_sum, sum(price - 0.05e0) AS bid_sum, sum(price * 1.01e0 - price * 0.98e0) AS range_sum, sum(price - price * 0.985e0) AS change_sum, sum(event_id % 1000) AS oi_sum, sum(least(1, price / 1000)) AS iv_sum FROM ticks GROUP BY symbol", "ticks")
def _(t):
    d = st.drain(stream(t), "ticks")
    return d.groupBy("symbol").agg(F.count("*").alias("ticks"), F.sum("price").alias("price_sum"), F.sum(C("greeks")["delta"]).alias("delta_sum"), F.sum(C("depth")[0]["bid"]).alias("bid_sum"),
                                   F.sum(C("high") - C("low")).alias("range_sum"), F.sum("change").alias("change_sum"), F.sum("open_interest").alias("oi_sum"), F.sum("implied_volatility").alias("iv_sum"))


@query("latest_quote", "symbol:s ts:t price:f volume:i", "SELECT symbol, max(ts) AS ts, arg_max(price, (ts, event_id)) AS price, arg_max(volume, (ts, event_id)) AS volume FROM ticks GROUP BY symbol", "ticks")
def _(t):
    d = st.drain(st.latest_quote(stream(t)), "quote", "update")
    return d.groupBy("symbol").agg(F.max_by(F.struct("ts", "price", "volume"), "batch_id").alias("q")).select("symbol", "q.*")


CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM ticks)"


@query("stream_bars", "symbol:s bar_start:t open:f high:f low:f close:f volume:i ticks:i",
       f"SELECT symbol, ts AS bar_start, open, high, low, close, volume, ticks FROM ({bucket_sql(60)}) WHERE ts + INTERVAL 1 HOUR <= {CLOSED}", "ticks")
def _(t):
    return st.drain(st.stream_bars(stream(t), "1 hour", "1 hour"), "bars")


@query("stream_bars_sliding", "symbol:s bar_start:t high:f low:f ticks:i",
       f"""SELECT symbol, s AS bar_start, max(price) AS high, min(price) AS low, count(*) AS ticks FROM (SELECT symbol, price, unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR]) AS s FROM ticks) WHERE s + INTERVAL 12 HOUR <= {CLOSED} GROUP BY symbol, s""", "ticks")
def _(t):
    return st.drain(st.stream_bars(stream(t), "12 hours", "1 hour", "6 hours"), "slide")


@query("stream_dedupe", "symbol:s rows:i price_sum:f2", "SELECT symbol, count(*) AS rows, sum(price) AS price_sum FROM ticks GROUP BY symbol", "ticks")
def _(t):
    twice = stream(t).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return st.drain(st.stream_dedupe(twice, "1 hour"), "dedupe").groupBy("symbol").agg(F.count("*").alias("rows"), F.sum("price").alias("price_sum"))


@query("stale_symbol_detect", "symbol:s last_ts:t reported_at:t state:s silent_seconds:f",
       """WITH g AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM ticks), e AS (SELECT symbol, max(ts) AS p FROM ticks GROUP BY symbol), f AS (SELECT * FROM g WHERE epoch_us(ts) - epoch_us(p) > 900000000)
       SELECT symbol, p AS last_ts, p + INTERVAL 15 MINUTE AS reported_at, 'stale' AS state, NULL::DOUBLE AS silent_seconds FROM f UNION ALL SELECT symbol, p, ts, 'resumed', (epoch_us(ts) - epoch_us(p)) / 1e6 FROM f
       UNION ALL SELECT symbol, p, p + INTERVAL 15 MINUTE, 'stale', NULL FROM e WHERE p + INTERVAL 15 MINUTE <= (SELECT max(ts) - INTERVAL 2 MINUTE FROM ticks)""", "ticks")
def _(t):
    return st.drain(health.stale_symbols(stream(t), 900, "2 minutes"), "stale")


RULES = [(1, "click", "ABOVE", 60.0), (2, "click", "BELOW", 20.0), (3, "error", "ABOVE", 100.0), (4, "view", "BELOW", 50.0)]


@query("alert_stream", "alert_id:i event_id:i price:f ts:t",
       """WITH RECURSIVE f AS (SELECT a AS alert_id, event_id, price, ts FROM ticks JOIN (VALUES (1, 'click', 'ABOVE', 60), (2, 'click', 'BELOW', 20), (3, 'error', 'ABOVE', 100), (4, 'view', 'BELOW', 50)) r(a, s, c, th) ON r.s = symbol WHERE CASE c WHEN 'ABOVE' THEN price >= th ELSE price <= th END),
       a AS (SELECT alert_id, min(ts) AS ts FROM f GROUP BY alert_id UNION ALL SELECT a.alert_id, (SELECT min(ts) FROM f WHERE f.alert_id = a.alert_id AND f.ts >= a.ts + INTERVAL 2 HOUR) FROM a WHERE a.ts IS NOT NULL) SELECT f.* FROM f JOIN a ON a.alert_id = f.alert_id AND a.ts = f.ts""", "ticks")
def _(t):
    r = t.spark.createDataFrame(RULES, "alert_id int, symbol string, condition string, threshold double")
    return st.drain(st.alert_stream(stream(t), r, 7200), "alerts")


@query("session_activity", "symbol:s session_date:d phase:s session_start:t session_end:t ticks:i",
       f"""WITH {cal_sql('events', 'ts', [2024])}, l AS (SELECT symbol, ts, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS session_date, epoch_us(ts + INTERVAL 330 MINUTE) % 86400000000 AS us FROM ticks),
       p AS (SELECT l.symbol, l.ts, session_date, CASE WHEN cal.is_session IS NULL THEN 'unknown' WHEN NOT cal.is_session THEN 'no_session' WHEN us < 33300000000 THEN 'pre' WHEN us <= 55800000000 THEN 'regular' ELSE 'post' END AS phase FROM l LEFT JOIN cal ON cal.ts = session_date),
       g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM p WINDOW w AS (PARTITION BY symbol, session_date, phase ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY symbol, session_date, phase ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
       SELECT symbol, session_date, phase, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS ticks FROM s GROUP BY symbol, session_date, phase, k HAVING max(ts) + INTERVAL 30 MINUTE <= {CLOSED}""", "ticks")
def _(t):
    return st.drain(st.session_activity(stream(t), full_calendar(t, "events", "ts", [2024]), "30 minutes", "1 hour"), "sessions")


@query("settlement_stream", "id:i matches:i first_price:f",
       f"""SELECT f.event_id AS id, count(k.ts) AS matches, arg_min(k.price, k.ts) AS first_price FROM ticks f LEFT JOIN ticks k ON f.symbol = k.symbol AND k.ts >= f.ts + INTERVAL 1 HOUR AND k.ts <= f.ts + INTERVAL 3 HOUR
       WHERE k.ts IS NOT NULL OR f.ts + INTERVAL 3 HOUR < {CLOSED} GROUP BY f.event_id""", "ticks")
def _(t):
    f = stream(t).select("symbol", C("event_id").alias("id"), (C("ts") + F.expr("INTERVAL 1 HOUR")).alias("target"))
    d = st.drain(st.settlement_stream(f, stream(t), "2 HOURS", "1 hour", summary=True), "settle")
    return d.groupBy("id").agg(F.sum("matches").alias("matches"), F.min_by("tick_price", "tick_ts").alias("first_price"))


@query("sentiment_ingest", "symbol:s window_start:t avg_score:f6 headlines:i",
       f"WITH {SENT} SELECT symbol, time_bucket(INTERVAL 7 DAY, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (doc_id % 90), TIMESTAMP '2024-01-01') AS window_start, avg(score) AS avg_score, count(*) AS headlines FROM snt GROUP BY ALL", "headlines")
def _(t):
    d = t.spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long").parquet(f"{t.dir}/documents*.parquet")
    at = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((C("doc_id") % 90).cast("int"))
    h = d.select("doc_id", F.concat(F.lit("Brand#"), (C("doc_id") % 25 + 1).cast("string")).alias("symbol"), C("text").alias("title"), at.alias("ts"))
    base = shared_path(t.spark, "sentiment")
    store = KeyedStore(t.spark, f"{base}/store", "symbol string, window_start timestamp, avg_score double, headlines long", ["symbol", "window_start"], ["headlines"])
    snapshots = st.sentiment_windows(headline_sentiment(h, "title"), "7 days", "90 days")
    st.upsert_stream(snapshots, store, f"{base}/ckpt")
    return store.read()


ARRIVE = "ar AS (SELECT symbol, ts, event_id, CAST(floor(epoch(ts + CASE WHEN event_id % 4 = 0 THEN INTERVAL 3 HOUR WHEN event_id % 7 = 3 THEN INTERVAL 40 HOUR ELSE INTERVAL 0 HOUR END) / 432000) AS BIGINT) AS b FROM ticks)"


@query("late_data_policy", "symbol:s route:s rows:i first_ts:t last_ts:t",
       f"""WITH {ARRIVE}, m AS (SELECT b, max(ts) AS newest FROM ar GROUP BY b), f AS (SELECT b, max(newest) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS front FROM m),
       r AS (SELECT symbol, ts, CASE WHEN front IS NULL OR ts >= front THEN 'on_time' WHEN epoch_us(front) - epoch_us(ts) <= 21600000000 THEN 'deferred' ELSE 'late' END AS route FROM ar JOIN f USING (b))
       SELECT symbol, route, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM r GROUP BY symbol, route""", "ticks")
def _(t):
    k = C("event_id")
    delay = F.when(k % 4 == 0, 3).when(k % 7 == 3, 40).otherwise(0)
    arrivals = t.ticks.select("symbol", "ts", "event_id", F.floor((C("ts").cast("double") + delay * 3600) / 432000).alias("b"))
    base, schema = shared_path(t.spark, "late"), "symbol string, ts timestamp, event_id long"
    router = late.LateRouter(f"{base}/out", "ts")
    days = [r["b"] for r in arrivals.select("b").distinct().orderBy("b").collect()]  # one for every five days of the stream
    late.arrive([arrivals.where(C("b") == b).drop("b") for b in days], f"{base}/in", lambda spark: spark.readStream.schema(schema).parquet(f"{base}/in"), router, f"{base}/ckpt")
    return router.read(t.spark, schema).groupBy("symbol", "route").agg(F.count("*").alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


THIN = "(SELECT symbol, ts FROM (SELECT symbol, ts, i, n, greatest(1, CAST(ceil((n - 45) / 24e0) AS BIGINT)) AS st FROM (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars)) WHERE i >= 40 AND i < n - 5 AND ((i - 40) % st = 0 OR i = n - 6))"


@query("forecaster_plugin", "symbol:s ts:d low:f median:f high:f usable:b coverage_hit:b direction:i net_pnl:f",
       f"""WITH m AS (SELECT symbol, ts, avg(close) OVER w AS m, stddev_pop(close) OVER w AS s FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)), {replay_sql(f"SELECT symbol, ts, CASE WHEN s / m <= 1.7 THEN m - 2 * s END AS low, CASE WHEN s / m <= 1.7 THEN m END AS median, CASE WHEN s / m <= 1.7 THEN m + 2 * s END AS high FROM m JOIN {THIN} USING (symbol, ts)")}
       SELECT symbol, ts, low, median, high, ok AS usable, CASE WHEN ok THEN act BETWEEN low AND high END AS coverage_hit, side AS direction, net AS net_pnl FROM rq""")
def _(t):
    def fn(symbol, history):
        c = history["close"].iloc[-20:]
        m, s = c.mean(), c.std(ddof=0)
        return None if s / m > 1.7 else (m - 2 * s, m, m + 2 * s)
    return pg.forecaster_plugin(t.bars, fn, 5)


@query("evaluator_plugin", "fold:s metric:f train_rows:i test_rows:i", "SELECT a.symbol AS fold, avg(abs(b.close - a.m)) AS metric, any_value(a.n) AS train_rows, count(*) AS test_rows FROM (SELECT symbol, avg(close) AS m, count(*) AS n FROM bars WHERE year(ts) < 2001 GROUP BY symbol) a JOIN bars b ON a.symbol = b.symbol AND year(b.ts) >= 2001 GROUP BY a.symbol")
def _(t):
    b = t.bars.select("symbol", "close", F.year("ts").alias("y"))
    return pg.evaluator_plugin(b.where("y < 2001"), b.where("y >= 2001"), "symbol", lambda a, c: (c["close"] - a["close"].mean()).abs().mean())


@query("history_loader_plugin", "symbol:s close:f change_pct:f", f"SELECT i.symbol, close, change_pct FROM (SELECT symbol FROM instruments UNION ALL SELECT 'UNLISTED') i LEFT JOIN (SELECT symbol, close, (close / lag(close) OVER w - 1) * 100 AS change_pct, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS d FROM bars {W}) x ON x.symbol = i.symbol AND d = 1", "bars instruments")
def _(t):
    unlisted = t.raw("region").where("r_regionkey = 0").select(F.lit("UNLISTED").alias("symbol"))
    return pg.history_loader_plugin(t.instruments.select("symbol").unionByName(unlisted), t.bars, cx.symbol_snapshot)


@query("feature_adapter", "feature:s score:f6 admitted:b",
       f"WITH x AS (SELECT close / lag(close) OVER w - 1 AS r, (high - low) / close AS rg, volume, lead(close) OVER w / close - 1 AS y FROM bars {W}) SELECT feature, score, score >= base + 0.001 AS admitted FROM (SELECT abs(corr(r, y)) AS base, unnest(['spread', 'size']) AS feature, unnest([abs(corr(rg, y)), abs(corr(volume, y))]) AS score FROM x WHERE r IS NOT NULL AND y IS NOT NULL)")
def _(t):
    from ..functions.span import BARS
    a = pg.FeatureAdapters()
    a.register("spread", lambda d: d.withColumn("spread", (C("high") - C("low")) / C("close")))
    a.register("size", lambda d: d.withColumn("size", C("volume")))
    d = t.bars.select("*", change().alias("r"), (BARS.lead("close") / C("close") - 1).alias("y")).where("r is not null and y is not null")
    return a.admit(d, "r", "y", 0.001)
