"""Scan, load and sink queries."""

from pyspark.sql import functions as F

from ..session import shared_path
from ..sources import ohlcv as src
from ..sources.keyed_store import KeyedStore
from .registry import query

C = F.col
SEQ = ["orderkey", "linenumber", "partkey", "suppkey"]


SCAN_SQL = """SELECT symbol, ts, px AS open, px AS high, px AS low, px AS close, qty AS volume FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY orderkey DESC, linenumber DESC, partkey DESC, suppkey DESC) AS rn
  FROM trades WHERE linenumber % 7 <> 3) WHERE rn = 1"""


@query("ohlcv_scan", "symbol:s ts:d open:f high:f low:f close:f volume:f", SCAN_SQL, "trades")
def _(t):
    px = F.when(C("linenumber") % 7 == 3, "NaN").otherwise(C("px").cast("string"))
    raw = t.trades.select("symbol", F.to_date("shipdate").alias("ts"), *SEQ, px.alias("OPEN"), px.alias("High"), px.alias("low"),
                          C("px").alias("Close"), C("qty").cast("string").alias("Volume"))
    return src.ohlcv_scan(raw, "symbol", "ts", SEQ)


@query("candle_explode", "symbol:s ts:d open:f high:f low:f close:f volume:f", "SELECT symbol, ts, open, high, low, close, volume FROM bars")
def _(t):
    candle = F.array(C("ts").cast("string"), *[C(c).cast("string") for c in src.FIELDS])
    month = F.date_format("ts", "yyyy-MM")
    parts = t.bars.select("symbol", month.alias("segment"), candle.alias("c")).unionByName(
        t.bars.where(F.dayofmonth("ts") == 1).select("symbol", F.date_format(F.add_months("ts", -1), "yyyy-MM").alias("segment"), candle.alias("c")))
    seg = parts.groupBy("symbol", "segment").agg(F.to_json(F.sort_array(F.collect_list("c"))).alias("payload"))
    return src.candle_explode(seg)


@query("bar_cache_json", "symbol:s ts:d close:f volume:f provider:s is_stale:b timeframe:s",
       "SELECT symbol, ts, close, volume, 'main' AS provider, false AS is_stale, '1D' AS timeframe FROM bars")
def _(t):
    path = shared_path(t.spark, "barcache")
    src.write_bar_cache(t.bars, path, "1D", "main")
    return src.read_bar_cache(t.spark, path, "1D")


@query("window_select", "window_name:s symbol:s bars:i first_ts:d",
       """WITH m AS (SELECT *, max(ts) OVER (PARTITION BY symbol) AS mx, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS d FROM bars)
       SELECT '1mo' AS "window", symbol, count(*) AS bars, min(ts) AS first_ts FROM m WHERE ts >= mx - 35 GROUP BY symbol
       UNION ALL SELECT '1y', symbol, count(*), min(ts) FROM m WHERE ts >= mx - 370 GROUP BY symbol
       UNION ALL SELECT '6mo', symbol, count(*), min(ts) FROM m WHERE ts >= mx - 370 AND d <= 126 GROUP BY symbol
       UNION ALL SELECT '2y', symbol, count(*), min(ts) FROM m WHERE ts >= mx - 1835 AND d <= 504 GROUP BY symbol""".replace('"window"', "window_name"))
def _(t):
    parts = [src.window_select(t.bars, n).groupBy("symbol").agg(F.count("*").alias("bars"), F.min("ts").alias("first_ts")).withColumn("window_name", F.lit(n))
             for n in ("1mo", "1y", "6mo", "2y")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("catalogue_build", "symbol:s exchange:s name:s country:s sector:s",
       """WITH u AS (SELECT 0 AS r, lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS k, upper(trim(p_brand)) AS symbol, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'X1' ELSE 'X2' END AS exchange, NULL AS country, p_type AS sector FROM part
        UNION ALL SELECT 1, lpad(CAST(c_custkey AS VARCHAR), 12, '0'), upper(trim(c_mktsegment)), coalesce(c_name, c_mktsegment), 'X1', n_name, NULL FROM customer JOIN nation ON n_nationkey = c_nationkey)
        SELECT symbol, exchange, name, country, sector FROM (SELECT *, row_number() OVER (PARTITION BY symbol, exchange ORDER BY r, k) AS rn FROM u) WHERE rn = 1""", "part customer nation")
def _(t):
    key = lambda c: F.lpad(C(c).cast("string"), 12, "0").alias("k")
    a = t.raw("part").select(key("p_partkey"), F.concat(F.lit(" "), F.lower("p_brand"), F.lit(" ")).alias("symbol"), C("p_name").alias("name"),
                             F.when(C("p_size") % 2 == 0, "X1").otherwise("X2").alias("exchange"), C("p_type").alias("sector"))
    n = t.raw("nation")
    b = t.raw("customer").join(n, C("c_nationkey") == C("n_nationkey")).select(
        key("c_custkey"), C("c_mktsegment").alias("symbol"), C("c_name").alias("name"), F.lit("X1").alias("exchange"), C("n_name").alias("country"))
    return src.catalogue_build([a, b], ["k"])


@query("instrument_master_load", "symbol:s name:s exchange:s segment:s instrument_type:s strike:f option_type:s underlying_symbol:s sector:s cap_bucket:s listing_year:i rows:i",
       """SELECT symbol, name, exchange, segment, instrument_type, strike, option_type, underlying_symbol, sector, cap_bucket, listing_year, count(*) AS rows FROM (
       SELECT upper(CASE WHEN p_size % 3 = 0 THEN p_brand || ' OPT' ELSE p_brand END) AS symbol, p_name AS name,
         CASE WHEN p_size % 2 = 0 THEN 'X1' ELSE 'X2' END AS exchange, CASE WHEN p_size % 2 = 0 THEN 'X1' ELSE 'X2' END || CASE WHEN p_size % 3 = 0 THEN '_FO' ELSE '_EQ' END AS segment,
         CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 6 = 0 THEN 'CE' ELSE 'PE' END ELSE 'EQ' END AS instrument_type,
         CASE WHEN p_size % 3 = 0 THEN p_size * 50 END AS strike, CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 6 = 0 THEN 'CE' ELSE 'PE' END END AS option_type,
         CASE WHEN p_size % 3 = 0 THEN upper(p_brand) END AS underlying_symbol, p_type AS sector, CASE WHEN p_size < 10 THEN 'small' END AS cap_bucket,
         CASE WHEN p_size >= 5 THEN 1980 + p_size END AS listing_year FROM part WHERE p_size % 5 <> 0) GROUP BY ALL""", "part")
def _(t):
    s = C("p_size")
    opt = s % 3 == 0
    ex = F.when(s % 2 == 0, "X1").otherwise("X2")
    payload = F.to_json(F.struct(
        F.when(s % 5 == 0, "ZZ_EQ").otherwise(F.lower(F.concat(ex, F.when(opt, "_FO").otherwise("_EQ")))).alias("segment"),
        F.when(opt, F.concat("p_brand", F.lit(" opt"))).alias("tradingsymbol"), F.when(~opt, C("p_brand")).alias("trading_symbol"),
        F.when(opt, C("p_brand")).alias("underlying_symbol"), C("p_name").alias("short_name"), F.when(opt, F.when(s % 6 == 0, "ce").otherwise("pe")).alias("instrument_type"),
        F.when(opt & (s % 2 == 0), (s * 50).cast("string")).alias("strike_price"), F.when(opt, (s * 50).cast("string")).alias("strike"),
        F.when(s % 2 == 0, C("p_type")).alias("sector"), C("p_type").alias("industry"), F.when(s < 10, "small").alias("cap_bucket"),
        F.when(s >= 5, F.concat((s + 1980).cast("string"), F.lit("-01-05"))).otherwise("n/a").alias("listing_date")))
    d = src.instrument_master(t.raw("part").select(payload.alias("payload")), ["X1_EQ", "X2_EQ", "X1_FO", "X2_FO"])
    keys = "symbol name exchange segment instrument_type strike option_type underlying_symbol sector cap_bucket listing_year".split()
    return d.groupBy(*keys).agg(F.count("*").alias("rows"))


@query("index_merge", "symbol:s exchange:s instrument_key:s source:i",
       """WITH x AS (SELECT 0 AS src, p_partkey AS row_no, p_type AS symbol, CASE WHEN p_size % 2 = 0 THEN 'X1' ELSE 'X2' END AS exchange, CASE WHEN p_partkey % 3 = 0 AND p_size > 45 THEN 'K' || p_partkey END AS k FROM part
        UNION ALL SELECT 1, s_suppkey, n_name, 'X1', 'S' || s_suppkey FROM supplier JOIN nation ON n_nationkey = s_nationkey
        UNION ALL SELECT 1, s_suppkey, 'ECONOMY', 'X2', 'S' || s_suppkey FROM supplier)
        SELECT symbol, exchange, k AS instrument_key, src AS source FROM (SELECT *, row_number() OVER (PARTITION BY symbol, exchange ORDER BY k IS NULL, src, row_no) AS rn FROM x) WHERE rn = 1""", "part supplier nation")
def _(t):
    items = t.raw("part").select(C("p_partkey").alias("row_no"), C("p_type").alias("symbol"), F.when(C("p_size") % 2 == 0, "X1").otherwise("X2").alias("exchange"),
                                 F.lit("X_INDEX").alias("segment"), F.when((C("p_partkey") % 3 == 0) & (C("p_size") > 45), F.concat(F.lit("K"), C("p_partkey").cast("string"))).alias("instrument_key"))
    s = t.raw("supplier").join(t.raw("nation"), C("s_nationkey") == C("n_nationkey"))
    key = F.concat(F.lit("S"), C("s_suppkey").cast("string")).alias("instrument_key")
    b = s.select(C("s_suppkey").alias("row_no"), C("n_name").alias("symbol"), F.lit("X1").alias("exchange"), F.lit("X_INDEX").alias("segment"), key)
    b2 = s.select(C("s_suppkey").alias("row_no"), F.lit("ECONOMY").alias("symbol"), F.lit("X2").alias("exchange"), F.lit("X_INDEX").alias("segment"), key)
    return src.index_merge(items, b.unionByName(b2))


REG_SQL = """SELECT upper(p_brand) AS symbol, CASE WHEN p_size % 4 = 0 THEN 'merger' WHEN p_size % 4 = 1 THEN 'split' ELSE 'bonus' END AS event_type,
  DATE '1996-01-01' + p_size AS effective_date, CASE WHEN p_size % 9 = 0 THEN 0 ELSE p_size / 10e0 END AS ratio FROM part"""


@query("action_registry_load", "status:s event_type:s reason:s rows:i ratio_sum:f first_date:d",
       f"""WITH r AS ({REG_SQL}), j AS (SELECT *, CASE WHEN ratio <= 0 THEN 'ratio' WHEN event_type = 'merger' THEN 'unsupported' END AS reason FROM r)
       SELECT CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, event_type, reason, count(*) AS rows, sum(ratio) AS ratio_sum, min(effective_date) AS first_date
       FROM j GROUP BY ALL""", "part")
def _(t):
    s = C("p_size")
    row = F.to_json(F.struct(F.lower("p_brand").alias("symbol"), F.when(s % 4 == 0, "merger").when(s % 4 == 1, "split").otherwise("bonus").alias("event_type"),
                             F.date_add(F.lit("1996-01-01").cast("date"), s).cast("string").alias("effective_date"),
                             F.when(s % 9 == 0, "0").otherwise((s / 10).cast("string")).alias("ratio")))
    ok, bad = src.action_registry(t.raw("part").select(row.alias("row")))
    both = ok.withColumn("reason", F.lit(None).cast("string")).unionByName(bad.select("symbol", "event_type", "effective_date", "ratio", "reason"))
    return both.groupBy(F.when(C("reason").isNull(), "accepted").otherwise("rejected").alias("status"), "event_type", "reason").agg(
        F.count("*").alias("rows"), F.sum("ratio").alias("ratio_sum"), F.min("effective_date").alias("first_date"))


@query("symbol_normalise", "symbol:s rows:i",
       """SELECT CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN 'BRAND#1' ELSE upper(p_brand) END AS symbol, count(*) AS rows FROM part GROUP BY 1""", "part")
def _(t):
    k = C("p_partkey")
    raw = F.when(k % 11 == 0, "unknown").when(k % 13 == 0, "first brand").when(k % 2 == 0, F.concat(F.lit(" "), F.lower("p_brand"), F.lit(".ns"))).otherwise(F.concat("p_brand", F.lit(".BO")))
    d = src.normalise_symbols(t.raw("part").select(raw.alias("raw")), "raw", t.instruments.select("symbol"), {"FIRST BRAND": "BRAND#1"})
    return d.groupBy("symbol").agg(F.count("*").alias("rows"))


@query("verified_csv_sink", "symbol:s available_at:t close:f volume:f",
       "SELECT symbol, CAST(ts AS TIMESTAMP) + INTERVAL 10 HOUR AS available_at, close, volume FROM bars")
def _(t):
    path = shared_path(t.spark, "verified")
    src.write_verified_csv(t.bars, path)
    return t.spark.read.csv(path, header=True, schema="available_at timestamp, open double, high double, low double, close double, volume double, symbol string")


@query("safe_csv_sink", "quoted:b rows:i text_chars:i",
       """SELECT cell LIKE '''%' AS quoted, count(*) AS rows, sum(length(cell)) AS text_chars FROM (SELECT CASE WHEN regexp_matches(p, '^([ \\t\\r\\n]*[=+@-]|[\\t\\r\\n])') THEN '''' || p ELSE p END AS cell FROM
       (SELECT CASE doc_id % 4 WHEN 0 THEN '=' WHEN 1 THEN '  -' ELSE '' END || text AS p FROM documents)) GROUP BY 1""", "documents")
def _(t):
    k = C("doc_id") % 4
    d = t.raw("documents").select("doc_id", F.concat(F.when(k == 0, "=").when(k == 1, "  -").otherwise(""), "text").alias("cell"))
    safe = src.safe_frame(d)
    return safe.groupBy(C("cell").startswith("'").alias("quoted")).agg(F.count("*").alias("rows"), F.sum(F.length("cell")).alias("text_chars"))


@query("forecast_ledger_append", "symbol:s rows:i hash_min:s",
       """SELECT symbol, count(*) AS rows, min(h) AS hash_min FROM (SELECT symbol, sha256(concat_ws('|', symbol, timeframe, horizon, CAST(origin_date AS VARCHAR))) AS h FROM ledger WHERE year(origin_date) >= 1998) GROUP BY symbol""", "ledger")
def _(t):
    key = ["symbol", "timeframe", "horizon", "origin_date"]
    old = src.append_ledger(None, t.ledger.where(F.year("origin_date") < 1998), key)
    new = src.append_ledger(old, t.ledger.unionByName(t.ledger), key)
    return new.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("snapshot_hash").alias("hash_min"))


@query("keyed_upsert", "symbol:s publisher:s doc_id:i chars:i",
       "SELECT symbol, publisher, max(doc_id) AS doc_id, arg_max(length(title), doc_id) AS chars FROM headlines GROUP BY symbol, publisher", "headlines")
def _(t):
    """Two upserts, the greater part of the newer rows first, so that older versions arrive late."""
    store = KeyedStore(t.spark, shared_path(t.spark, "store"), "symbol string, publisher string, doc_id long, chars int", ["symbol", "publisher"], ["doc_id"])
    rows = t.headlines.select("symbol", "publisher", "doc_id", F.length("title").alias("chars"))
    first = C("doc_id") % 3 != 0
    store.upsert(rows.where(first), 0)
    store.upsert(rows.where(~first), 1)
    return store.read()
