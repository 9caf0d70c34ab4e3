"""Market-data views over the given Parquet tables, for Spark and as SQL text.

The Spark views are written for large inputs: opening and closing prices come from
`min_by`/`max_by` aggregates (map-side combined, so a hot symbol does not concentrate
raw trades in one task) rather than from row numbers over all trades of a day.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

FILL_ORDER = ("shipdate", "orderkey", "linenumber", "partkey", "suppkey")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark = spark
        self.dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def trades(self) -> DataFrame:
        """Every trade with its symbol; the dimension is joined by key and sized by Catalyst."""
        li = self.raw("lineitem").select(
            F.col("l_partkey").alias("partkey"), F.col("l_orderkey").alias("orderkey"),
            F.col("l_linenumber").alias("linenumber"), F.col("l_suppkey").alias("suppkey"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_quantity").alias("qty"),
            F.col("l_shipdate").cast("timestamp").alias("shipdate"), F.col("l_returnflag").alias("returnflag"),
            F.col("l_linestatus").alias("linestatus"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
        part = self.raw("part").select(F.col("p_partkey").alias("partkey"), F.col("p_brand").alias("symbol"),
                                       F.col("p_size").alias("size"))
        return li.join(part, "partkey")

    @cached_property
    def bars(self) -> DataFrame:
        seq = F.struct("orderkey", "linenumber", "partkey", "suppkey", "px", "qty")
        return (self.trades.withColumn("ts", F.to_date("shipdate")).groupBy("symbol", "ts").agg(
            F.min_by("px", seq).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
            F.max_by("px", seq).alias("close"), F.sum("qty").alias("volume"), F.count("*").alias("trades")))

    @cached_property
    def index_bars(self) -> DataFrame:
        return self.bars.groupBy("ts").agg(F.avg("close").alias("close"), F.count("*").alias("members"))

    @cached_property
    def ticks(self) -> DataFrame:
        return self.raw("events").select(
            "event_id", F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
            F.col("value").alias("price"), (1 + F.col("event_id") % 100).alias("volume"), "user_id")

    @cached_property
    def calls(self) -> DataFrame:
        return self.raw("events").select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"),
            F.concat(F.lit("P"), (F.col("user_id") % 4).cast("string")).alias("provider"),
            (F.col("event_type") != "error").alias("ok"),
            F.regexp_replace("props", "[^0-9]", "").cast("int").alias("latency_ms"))

    @cached_property
    def instruments(self) -> DataFrame:
        b = self.raw("part").select(F.col("p_brand").alias("symbol")).distinct().withColumn(
            "n", F.element_at(F.split("symbol", "#"), 2).cast("int"))
        r = self.raw("region").select(F.col("r_regionkey"), F.col("r_name"))
        n = F.col("n")
        return b.join(r, F.col("r_regionkey") == n % 5).select(
            "symbol", F.concat(F.lit("Issuer "), n.cast("string")).alias("name"),
            F.when(n % 2 == 0, "X1").otherwise("X2").alias("exchange"),
            F.when(n % 6 != 0, F.col("r_name")).alias("sector"),
            F.when(n % 3 == 0, "small").when(n % 3 == 1, "mid").otherwise("large").alias("cap_bucket"),
            (1995 + n % 5).alias("listing_year"))

    @cached_property
    def actions(self) -> DataFrame:
        cap = F.col("cap_bucket")
        return self.instruments.select(
            "symbol", F.when(cap == "small", "split").when(cap == "mid", "bonus").otherwise("dividend").alias("action_type"),
            F.lit("1998-06-30").cast("date").alias("ex_date"),
            F.when(cap == "small", 2.0).when(cap == "mid", 0.5).otherwise(5.0).alias("term"))

    @cached_property
    def transactions(self) -> DataFrame:
        o = self.raw("orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_custkey").alias("user_id"))
        return self.trades.join(o, "orderkey").select(
            "user_id", "symbol", F.when(F.col("returnflag") == "R", "SELL").otherwise("BUY").alias("side"),
            F.col("qty").alias("shares"), F.col("px").alias("price"), F.col("shipdate").alias("ts"), *FILL_ORDER)

    @cached_property
    def chain(self) -> DataFrame:
        return (self.trades.groupBy(
            F.col("symbol").alias("underlying"), (F.col("size").cast("double") * 50).alias("strike"),
            F.when(F.col("linestatus") == "O", "call").otherwise("put").alias("option_type"))
            .agg(F.sum("qty").alias("open_interest"),
                 F.sum(F.when(F.col("returnflag") != "N", F.col("qty")).otherwise(0.0)).alias("previous_open_interest"),
                 (F.avg("discount") * 100).alias("bid"), (F.avg("discount") * 100 + F.avg("tax") * 10).alias("ask")))

    @cached_property
    def futures(self) -> DataFrame:
        return self.trades.groupBy(F.col("symbol").alias("underlying"), (F.col("linenumber") * 30).alias("days_to_expiry")).agg(
            F.avg("px").alias("futures_price"), F.sum("qty").alias("open_interest"))

    @cached_property
    def legs(self) -> DataFrame:
        t = self.trades
        return t.select(
            F.col("orderkey").alias("book_id"),
            F.when(F.col("returnflag") == "A", "call").when(F.col("returnflag") == "R", "put").otherwise("future").alias("type"),
            F.when(F.col("linestatus") == "O", "buy").otherwise("sell").alias("side"),
            (F.floor(F.col("px") / 50) * 50).cast("double").alias("strike"), (F.col("px") * 0.05).alias("premium"),
            F.col("linenumber").alias("contracts"), "linenumber", "partkey", "suppkey")

    @cached_property
    def ledger(self) -> DataFrame:
        from ..functions.span import BARS
        return self.bars.select(
            "symbol", F.lit("1D").alias("timeframe"), F.lit(1).alias("horizon"), BARS.rn().cast("bigint").alias("id"),
            F.col("ts").alias("origin_date"), BARS.lead("ts").alias("target_date"), (F.col("close") * 0.6).alias("forecast_low"),
            F.col("close").alias("forecast_median"), (F.col("close") * 1.4).alias("forecast_high"),
            F.lit(0.8).alias("confidence_level"), BARS.lead("close").alias("actual_price"))

    @cached_property
    def settled(self) -> DataFrame:
        """Settled forecasts with a shifted median, a tier and a regime label."""
        i = F.col("id")
        d = self.ledger.where("actual_price is not null").withColumn("forecast_median", F.col("forecast_median") * (0.9 + 0.02 * (i % 11)))
        a, lo, hi = F.col("actual_price"), F.col("forecast_low"), F.col("forecast_high")
        miss = F.when(a < lo, lo - a).when(a > hi, a - hi).otherwise(0.0)
        return d.select("*", a.between(lo, hi).alias("coverage_hit"), (hi - lo + 2 / (1 - F.col("confidence_level")) * miss).alias("winkler"),
                        F.concat(F.lit("T"), (i % 5).cast("string")).alias("tier"),
                        F.when(i % 3 == 0, "calm").when(i % 3 == 1, "normal").otherwise("stressed").alias("regime"))

    @cached_property
    def headlines(self) -> DataFrame:
        return self.raw("documents").select(
            "doc_id", F.concat(F.lit("Brand#"), (F.col("doc_id") % 25 + 1).cast("string")).alias("symbol"),
            F.col("source").alias("publisher"), F.col("text").alias("title"))

    @cached_property
    def quotes(self) -> DataFrame:
        seq = F.struct("shipdate", -F.col("orderkey"), -F.col("linenumber"), -F.col("partkey"), -F.col("suppkey"), "px")
        return self.trades.groupBy("symbol", F.concat(F.lit("S"), (F.col("suppkey") % 3).cast("string")).alias("provider")).agg(
            F.max_by("px", seq).alias("price"))

    @cached_property
    def calendar(self) -> DataFrame:
        """Weekdays between the first and last trade dates' calendar years, from the data's own range."""
        lim = self.raw("lineitem").agg(F.year(F.min("l_shipdate")).alias("y0"), F.year(F.max("l_shipdate")).alias("y1"))
        d = lim.select(F.explode(F.sequence(F.make_date("y0", F.lit(1), F.lit(1)), F.make_date("y1", F.lit(12), F.lit(31)),
                                            F.expr("INTERVAL 1 DAY"))).alias("ts"))
        return d.where(F.weekday("ts") < 5)


# The same views for the SQL twins.
TRADES_SQL = """SELECT p.p_brand AS symbol, p.p_size AS size, CAST(l.l_shipdate AS DATE) AS ts, l.l_extendedprice / l.l_quantity AS px,
  l.l_quantity AS qty, l.l_shipdate AS shipdate, l.l_orderkey AS orderkey, l.l_linenumber AS linenumber, l.l_partkey AS partkey,
  l.l_suppkey AS suppkey, l.l_returnflag AS returnflag, l.l_linestatus AS linestatus, l.l_discount AS discount, l.l_tax AS tax
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey"""

SQL_VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "trades": (TRADES_SQL, ()),
    "bars": ("""SELECT symbol, ts, max(CASE WHEN rn = 1 THEN px END) AS open, max(px) AS high, min(px) AS low,
  max(CASE WHEN rn = n THEN px END) AS close, sum(qty) AS volume, count(*) AS trades
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY orderkey, linenumber, partkey, suppkey) AS rn,
          count(*) OVER (PARTITION BY symbol, ts) AS n FROM trades) GROUP BY symbol, ts""", ("trades",)),
    "index_bars": ("SELECT ts, avg(close) AS close, count(*) AS members FROM bars GROUP BY ts", ("bars",)),
    "ticks": ("""SELECT event_id, event_type AS symbol, CAST(ts AS TIMESTAMP) AS ts, value AS price,
  1 + event_id % 100 AS volume, user_id FROM events""", ()),
    "calls": ("""SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, concat('P', CAST(user_id % 4 AS VARCHAR)) AS provider,
  event_type <> 'error' AS ok, CAST(regexp_replace(props, '[^0-9]', '', 'g') AS INT) AS latency_ms FROM events""", ()),
    "instruments": ("""SELECT b.symbol, concat('Issuer ', CAST(b.n AS VARCHAR)) AS name,
  CASE WHEN b.n % 2 = 0 THEN 'X1' ELSE 'X2' END AS exchange, CASE WHEN b.n % 6 = 0 THEN NULL ELSE r.r_name END AS sector,
  CASE b.n % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'mid' ELSE 'large' END AS cap_bucket, 1995 + b.n % 5 AS listing_year
  FROM (SELECT DISTINCT p_brand AS symbol, CAST(split_part(p_brand, '#', 2) AS INT) AS n FROM part) b
  JOIN region r ON r.r_regionkey = b.n % 5""", ()),
    "actions": ("""SELECT symbol, CASE cap_bucket WHEN 'small' THEN 'split' WHEN 'mid' THEN 'bonus' ELSE 'dividend' END AS action_type,
  DATE '1998-06-30' AS ex_date, CASE cap_bucket WHEN 'small' THEN 2e0 WHEN 'mid' THEN 0.5e0 ELSE 5e0 END AS term
  FROM instruments""", ("instruments",)),
    "transactions": ("""SELECT o.o_custkey AS user_id, symbol, CASE returnflag WHEN 'R' THEN 'SELL' ELSE 'BUY' END AS side,
  qty AS shares, px AS price, shipdate AS ts, shipdate, orderkey, linenumber, partkey, suppkey,
  row_number() OVER (ORDER BY shipdate, orderkey, linenumber, partkey, suppkey) AS id
  FROM trades JOIN orders o ON o.o_orderkey = orderkey""", ("trades",)),
    "chain": ("""SELECT symbol AS underlying, CAST(size AS DOUBLE) * 50 AS strike, CASE linestatus WHEN 'O' THEN 'call' ELSE 'put' END AS option_type,
  sum(qty) AS open_interest, sum(CASE WHEN returnflag <> 'N' THEN qty ELSE 0 END) AS previous_open_interest,
  avg(discount) * 100 AS bid, avg(discount) * 100 + avg(tax) * 10 AS ask FROM trades GROUP BY ALL""", ("trades",)),
    "futures": ("""SELECT symbol AS underlying, 30 * linenumber AS days_to_expiry, avg(px) AS futures_price,
  sum(qty) AS open_interest FROM trades GROUP BY symbol, linenumber""", ("trades",)),
    "legs": ("""SELECT orderkey AS book_id, CASE returnflag WHEN 'A' THEN 'call' WHEN 'R' THEN 'put' ELSE 'future' END AS type,
  CASE linestatus WHEN 'O' THEN 'buy' ELSE 'sell' END AS side, CAST(floor(px / 50) * 50 AS DOUBLE) AS strike, px * 0.05e0 AS premium,
  linenumber AS contracts, linenumber, partkey, suppkey FROM trades""", ("trades",)),
    "ledger": ("""SELECT symbol, '1D' AS timeframe, 1 AS horizon, row_number() OVER w AS id, ts AS origin_date,
  lead(ts) OVER w AS target_date, close * 0.6e0 AS forecast_low, close AS forecast_median, close * 1.4e0 AS forecast_high,
  0.8e0 AS confidence_level, lead(close) OVER w AS actual_price FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)""", ("bars",)),
    "settled": ("""SELECT *, actual_price BETWEEN forecast_low AND forecast_high AS coverage_hit, forecast_high - forecast_low + 2 / (1 - confidence_level) * CASE WHEN actual_price < forecast_low THEN forecast_low - actual_price WHEN actual_price > forecast_high THEN actual_price - forecast_high ELSE 0 END AS winkler,
  concat('T', CAST(id % 5 AS VARCHAR)) AS tier, CASE id % 3 WHEN 0 THEN 'calm' WHEN 1 THEN 'normal' ELSE 'stressed' END AS regime FROM
  (SELECT * REPLACE (forecast_median * (0.9e0 + 0.02e0 * (id % 11)) AS forecast_median) FROM ledger WHERE actual_price IS NOT NULL)""", ("ledger",)),
    "headlines": ("""SELECT doc_id, concat('Brand#', CAST(doc_id % 25 + 1 AS VARCHAR)) AS symbol, source AS publisher, text AS title
  FROM documents""", ()),
    "quotes": ("""SELECT symbol, provider, price FROM (SELECT symbol, concat('S', CAST(suppkey % 3 AS VARCHAR)) AS provider, px AS price,
  row_number() OVER (PARTITION BY symbol, suppkey % 3 ORDER BY shipdate DESC, orderkey, linenumber, partkey, suppkey) AS rn FROM trades)
  WHERE rn = 1""", ("trades",)),
    "calendar": ("""SELECT CAST(d AS DATE) AS ts FROM range((SELECT make_date(CAST(year(min(l_shipdate)) AS BIGINT), 1, 1) FROM lineitem),
  (SELECT make_date(CAST(year(max(l_shipdate)) + 1 AS BIGINT), 1, 1) FROM lineitem), INTERVAL 1 DAY) t(d)
  WHERE dayofweek(d) NOT IN (0, 6)""", ()),
}


def sql_views(names) -> list[tuple[str, str]]:
    out: dict[str, str] = {}

    def add(name):
        if name in TABLES or name in out or not name:
            return
        sql, deps = SQL_VIEWS[name]
        for d in deps:
            add(d)
        out[name] = sql

    for n in names:
        add(n)
    return list(out.items())
