"""Calendar and session queries."""

from pyspark.sql import functions as F

from ..operators import sessions as se
from .registry import query

C = F.col

# Fixed yearly holidays (and one special session) applied to the years in the data.
HOLS = [("01-26", "holiday", "Republic Day"), ("08-15", "holiday", "Independence Day"), ("10-02", "holiday", "Gandhi Jayanti"), ("11-01", "special", "Special session")]


def full_calendar(t, table, col, verified):
    lim = t.raw(table).agg(F.year(F.min(col)).alias("y0"), (F.year(F.max(col)) + 1).alias("y1"))
    days = lim.select(F.explode(F.sequence(F.make_date("y0", F.lit(1), F.lit(1)), F.make_date("y1", F.lit(12), F.lit(31)), F.expr("INTERVAL 1 DAY"))).alias("ts"))
    h = t.spark.createDataFrame(HOLS, "md string, kind string, reason string")
    hol = days.join(F.broadcast(h), F.date_format("ts", "MM-dd") == C("md")).select("ts", "kind", "reason")
    return se.session_calendar(days, hol, verified)


def cal_sql(table, col, verified):
    rows = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in HOLS)
    return f"""days AS (SELECT CAST(d AS DATE) AS ts FROM range((SELECT make_date(CAST(year(min({col})) AS BIGINT), 1, 1) FROM {table}), (SELECT make_date(CAST(year(max({col})) + 2 AS BIGINT), 1, 1) FROM {table}), INTERVAL 1 DAY) x(d)),
  cal0 AS (SELECT ts, kind, reason, coalesce(kind = 'special' OR (kind IS NULL AND isodow(ts) < 6), false) AS is_session, year(ts) IN ({','.join(map(str, verified))}) AS verified FROM days LEFT JOIN (VALUES {rows}) h(md, kind, reason) ON strftime(ts, '%m-%d') = md),
  cal AS (SELECT *, sum(CAST(is_session AS INT)) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session_no FROM cal0)"""


@query("session_calendar", "ts:d kind:s reason:s is_session:b verified:b session_no:i", f"WITH {cal_sql('lineitem', 'l_shipdate', [1996, 1997])} SELECT * FROM cal", "lineitem")
def _(t):
    return full_calendar(t, "lineitem", "l_shipdate", [1996, 1997])


@query("market_status", "event_id:i local:t is_open:b status:s",
       f"""WITH {cal_sql('events', 'ts', [2024])}, x AS (SELECT event_id, ts + INTERVAL 330 MINUTE AS local FROM events), y AS (SELECT event_id, local, kind, reason, verified, isodow(local) >= 6 AS we, (epoch_us(local) - epoch_us(date_trunc('day', local))) / 1e6 AS s FROM x LEFT JOIN cal ON cal.ts = CAST(local AS DATE)),
       z AS (SELECT *, (coalesce(kind = 'special', false) OR (NOT we AND coalesce(kind <> 'holiday', true))) AND s BETWEEN 33300 AND 55800 AS is_open FROM y)
       SELECT event_id, local, is_open, CASE WHEN kind = 'special' AND is_open THEN reason WHEN kind = 'special' THEN reason || ' - outside regular session' WHEN kind = 'holiday' THEN reason WHEN we THEN 'Weekend' WHEN s < 33300 THEN 'Pre-market' WHEN s > 55800 THEN 'Closed' ELSE 'Open' END || CASE WHEN verified THEN '' ELSE ' (calendar not verified)' END AS status FROM z""", "events")
def _(t):
    return se.market_status(t.ticks, full_calendar(t, "events", "ts", [2024]))


@query("target_session", "kind:s rowid:s origin:t target:t",
       f"""WITH {cal_sql('lineitem', 'l_shipdate', [1996])}, s AS (SELECT ts AS sts, session_no AS sno FROM cal WHERE is_session) SELECT '1D' AS kind, symbol AS rowid, CAST(b.ts AS TIMESTAMP) AS origin, CAST(s1.sts AS TIMESTAMP) AS target FROM bars b JOIN cal c USING (ts) LEFT JOIN s s1 ON s1.sno = c.session_no + 1
       UNION ALL SELECT '1W', symbol, CAST(b.ts AS TIMESTAMP), CAST(s1.sts AS TIMESTAMP) FROM bars b JOIN cal c USING (ts) LEFT JOIN s s1 ON s1.sno = c.session_no + 5
       UNION ALL SELECT '1h', CAST(event_id AS VARCHAR), local, target FROM (WITH RECURSIVE {cal_sql('events', 'ts', [2024])}, ss AS (SELECT ts AS sts, session_no AS sno FROM cal WHERE is_session),
         st AS (SELECT event_id, ts + INTERVAL 330 MINUTE AS local, ts + INTERVAL 330 MINUTE AS target, 0 AS k FROM events UNION ALL
           SELECT event_id, local, CASE WHEN c.is_session AND target - date_trunc('day', target) < INTERVAL 555 MINUTE THEN date_trunc('day', target) + INTERVAL 615 MINUTE
             WHEN c.is_session AND target + INTERVAL 60 MINUTE - date_trunc('day', target + INTERVAL 60 MINUTE) <= INTERVAL 930 MINUTE AND CAST(target + INTERVAL 60 MINUTE AS DATE) = CAST(target AS DATE) THEN target + INTERVAL 60 MINUTE
             ELSE nx.sts + INTERVAL 615 MINUTE END, k + 1 FROM st JOIN cal c ON c.ts = CAST(target AS DATE) JOIN ss nx ON nx.sno = c.session_no + 1 WHERE k < 8)
         SELECT event_id, local, target FROM st WHERE k = 8)""", "bars lineitem events")
def _(t):
    cal = full_calendar(t, "lineitem", "l_shipdate", [1996])
    daily = [se.target_daily(t.bars.select("symbol", "ts"), cal, "ts", n).select(F.lit(k).alias("kind"), C("symbol").alias("rowid"), C("ts").cast("timestamp").alias("origin"), C("target_date").cast("timestamp").alias("target"))
             for k, n in (("1D", 1), ("1W", 5))]
    ticks = t.ticks.select("event_id", F.from_utc_timestamp("ts", se.ZONE).alias("local"))
    h = se.target_intraday(ticks, full_calendar(t, "events", "ts", [2024]), "local", "1h", 8)
    return daily[0].unionByName(daily[1]).unionByName(h.select(F.lit("1h").alias("kind"), C("event_id").cast("string").alias("rowid"), C("local").alias("origin"), C("target_local").alias("target")))


@query("session_gaps", "symbol:s gaps:i last_gap:d",
       f"""WITH {cal_sql('lineitem', 'l_shipdate', [1996])} SELECT l.symbol, count(*) AS gaps, max(cal.ts) AS last_gap FROM (SELECT symbol, min(ts) AS a, max(ts) AS b FROM bars GROUP BY symbol) l JOIN cal ON cal.is_session AND cal.ts BETWEEN a AND b
       LEFT JOIN bars x ON x.symbol = l.symbol AND x.ts = cal.ts WHERE x.ts IS NULL GROUP BY l.symbol""", "bars lineitem")
def _(t):
    return se.session_gaps(t.bars, full_calendar(t, "lineitem", "l_shipdate", [1996])).groupBy("symbol").agg(F.count("*").alias("gaps"), F.max("ts").alias("last_gap"))


def bucket_sql(minutes):
    return f"""SELECT symbol, time_bucket(INTERVAL {minutes} MINUTE, ts, TIMESTAMP '1970-01-01') AS ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, sum(volume) AS volume, count(*) AS ticks FROM ticks GROUP BY ALL"""


@query("resample_bars", "symbol:s ts:t open:f high:f low:f close:f volume:f ticks:i", bucket_sql(240), "ticks")
def _(t):
    return se.resample_bars(t.ticks, "4 hours")


@query("intraday_session_summary", "symbol:s day:d late_momentum:f6 late_volume_share:f6 intraday_rv:f6 vwap_distance:f6 bars:i",
       f"""WITH b AS (SELECT 'all' AS symbol, ts + INTERVAL 15 MINUTE + INTERVAL 330 MINUTE AS local, open, high, low, close, volume FROM ({bucket_sql(15).replace("symbol, time_bucket", "time_bucket")})),
       x AS (SELECT *, CAST(local AS DATE) AS day, (epoch(local) - epoch(date_trunc('day', local))) / 60 AS m FROM b), y AS (SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol, day ORDER BY local) AS lr FROM x WHERE m > 555 AND m <= 930)
       SELECT symbol, day, arg_max(close, local) / arg_min(close, local) FILTER (WHERE m >= 900) - 1 AS late_momentum, sum(volume) FILTER (WHERE m >= 900) / sum(volume) AS late_volume_share, sum(lr * lr) AS intraday_rv, arg_max(close, local) / (sum((high + low + close) / 3 * volume) / sum(volume)) - 1 AS vwap_distance, count(*) AS bars
       FROM y GROUP BY symbol, day HAVING count(*) >= 10 AND max(m) = 930 AND min(m) <= 570 AND count(*) FILTER (WHERE m >= 900) >= 2""", "ticks")
def _(t):
    b = se.resample_bars(t.ticks.withColumn("symbol", F.lit("all")), "15 minutes").withColumn("ts", C("ts") + F.expr("INTERVAL 15 MINUTES"))
    return se.intraday_session_summary(b, 15)


@query("expiry_list", "underlying:s expiries:s nearest:d days_to_expiry:i listed:i",
       """SELECT symbol AS underlying, array_to_string(list_transform(l, lambda x: CAST(x AS VARCHAR)), ',') AS expiries, l[1] AS nearest, l[1] - DATE '2001-12-01' AS days_to_expiry, len(l) AS listed FROM (SELECT symbol, list_sort(list(DISTINCT DATE '2001-12-01' + 30 * linenumber)) AS l FROM trades GROUP BY symbol)""", "trades")
def _(t):
    d = F.date_add(F.lit("2001-12-01").cast("date"), C("linenumber") * 30)
    return se.expiry_list(t.trades.select(C("symbol").alias("underlying"), d.alias("expiry")), F.lit("2001-12-01").cast("date"))
