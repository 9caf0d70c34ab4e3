"""Readers, loaders and sinks for bars, instruments, actions and forecasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.span import BARS

C = F.col
FIELDS = ("open", "high", "low", "close", "volume")

# Calendar days behind each named window, and session tails.
WINDOW_DAYS = {"1w": 10, "1mo": 35, "3mo": 100, "1y": 370, "5y": 1835, "10y": 3670, "max": 7300}
TAIL_SESSIONS = {"6mo": ("1y", 126), "2y": ("5y", 504)}

# Cells starting with these are quoted in spreadsheet exports.
FORMULA_START = r"^(?:[ \t\r\n]*[=+@-]|[\t\r\n])"


def finite(c: Column) -> Column:
    """Numeric value or null: text that is not a number, NaN and infinities all become null."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def ohlcv_scan(raw: DataFrame, symbol: str, ts: str, sequence: list[str]) -> DataFrame:
    """Map columns whatever their case, coerce, drop incomplete rows, keep the last row per timestamp.

    Keep-last is a `max_by` aggregate, so duplicates collapse before the shuffle.
    """
    names = {c.lower(): c for c in raw.columns}
    missing = [f for f in FIELDS if f not in names]
    if missing:
        raise ValueError(f"missing OHLCV columns: {', '.join(missing)}")
    values = [finite(C(names[f])).alias(f) for f in FIELDS]
    rows = raw.select(C(symbol).alias("symbol"), C(ts).alias("ts"), *values, F.struct(*sequence).alias("_seq"))
    rows = rows.where(reduce(lambda a, b: a & b, [C(f).isNotNull() for f in FIELDS]))
    last = rows.groupBy("symbol", "ts").agg(F.max_by(F.struct(*FIELDS), "_seq").alias("r"))
    return last.select("symbol", "ts", "r.*")


def candle_explode(segments: DataFrame) -> DataFrame:
    """segments(symbol, segment, payload JSON array of [ts, o, h, l, c, v]) to bars, later segment wins."""
    rows = segments.select("symbol", "segment", F.posexplode(F.from_json("payload", "array<array<string>>")).alias("pos", "c"))
    at = [F.try_element_at(C("c"), F.lit(i + 2)).alias(f) for i, f in enumerate(FIELDS)]
    return ohlcv_scan(rows.select("symbol", "segment", "pos", F.try_element_at(C("c"), F.lit(1)).cast("date").alias("ts"), *at),
                      "symbol", "ts", ["segment", "pos"])


def write_bar_cache(bars: DataFrame, path: str, timeframe: str, provider: str) -> None:
    """Parquet dataset by timeframe, files clustered and sorted by symbol for pruned reads."""
    (bars.withColumn("timeframe", F.lit(timeframe)).withColumn("provider", F.lit(provider)).withColumn("is_stale", F.lit(False))
     .repartition("symbol").sortWithinPartitions("symbol", "ts").write.mode("overwrite").partitionBy("timeframe").parquet(path))


def read_bar_cache(spark: SparkSession, path: str, timeframe: str, ts_type: str = "date") -> DataFrame:
    """Explicit schema: partition-type inference would read a timeframe such as 1D as a number."""
    schema = (f"symbol string, ts {ts_type}, " + ", ".join(f"{f} double" for f in FIELDS)
              + ", provider string, is_stale boolean, timeframe string")
    return spark.read.schema(schema).parquet(path).where(C("timeframe") == timeframe)


def window_select(bars: DataFrame, name: str) -> DataFrame:
    """Rows of a named look-back window ending at each symbol's newest bar."""
    key = name.lower()
    base, tail = TAIL_SESSIONS.get(key, (key if key in WINDOW_DAYS else "1y", None))
    out = bars.withColumn("_max", F.max("ts").over(BARS.whole)).where(C("ts") >= F.date_sub(C("_max"), WINDOW_DAYS[base])).drop("_max")
    if tail:
        out = out.withColumn("_d", BARS.rn_desc()).where(C("_d") <= tail).drop("_d")
    return out


def catalogue_build(sources: list[DataFrame], order: list[str]) -> DataFrame:
    """Union of catalogue tables; the first source (then lowest row key) wins per (symbol, exchange)."""
    cols = ["name", "symbol", "exchange", "country", "sector"]
    parts = []
    for rank, src in enumerate(sources):
        have = [C(c).cast("string").alias(c) if c in src.columns else F.lit(None).cast("string").alias(c) for c in cols]
        parts.append(src.select(*have, F.struct(F.lit(rank).alias("r"), *[C(c).cast("string") for c in order]).alias("_o")))
    rows = reduce(DataFrame.unionByName, parts).withColumn("symbol", F.upper(F.trim("symbol")))
    rows = rows.where(C("symbol").isNotNull() & ~C("symbol").isin("", "NAN")).withColumn("name", F.trim(F.coalesce("name", "symbol")))
    best = rows.groupBy("symbol", "exchange").agg(F.min_by(F.struct("name", "country", "sector"), "_o").alias("r"))
    return best.select("symbol", "exchange", "r.*")


def read_catalogue_csv(spark: SparkSession, paths: list[str], order: list[str]) -> DataFrame:
    schema = "name string, symbol string, exchange string, country string, sector string"
    return catalogue_build([spark.read.csv(p, header=True, schema=schema) for p in paths], order)


def listing_year(c: Column) -> Column:
    y = F.regexp_extract(F.trim(c.cast("string")), r"^(\d{4})", 1).try_cast("int")
    return F.when(y.between(1900, 2100), y)


def instrument_master(raw: DataFrame, segments: list[str]) -> DataFrame:
    """raw(payload JSON) with alternative field names to one typed instrument row."""
    names = ("segment trading_symbol tradingsymbol underlying_symbol instrument_type option_type optionType name short_name exchange "
             "instrument_key isin lot_size expiry strike_price strike sector industry market_cap_bucket cap_bucket "
             "listing_year ipo_year listing_date ipo_date").split()
    j = raw.select(F.from_json("payload", "struct<" + ",".join(f"{n}:string" for n in names) + ">", {"dropFieldIfAllNull": "false"}).alias("j")).select("j.*")

    def first(*cols):
        return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cols])

    seg = F.upper("segment")
    it = F.upper(F.coalesce("instrument_type", F.lit("")))
    ot = F.upper(F.coalesce(first("option_type"), first("optionType"), F.lit("")))
    sym = F.upper(first("trading_symbol", "tradingsymbol", "underlying_symbol"))
    sides = ["CE", "PE"]
    return j.where(seg.isin(segments) & sym.isNotNull()).select(
        sym.alias("symbol"), F.coalesce(first("name", "short_name"), sym).alias("name"),
        F.upper(F.coalesce(first("exchange"), F.split(seg, "_")[0])).alias("exchange"), seg.alias("segment"),
        F.when(it != "", it).otherwise(F.when(seg.endswith("INDEX"), "INDEX").otherwise("EQ")).alias("instrument_type"),
        first("instrument_key").alias("instrument_key"), first("lot_size").try_cast("double").alias("lot_size"),
        first("expiry").try_cast("date").alias("expiry"), first("strike_price", "strike").try_cast("double").alias("strike"),
        F.when(ot.isin(sides), ot).when(it.isin(sides), it).alias("option_type"), F.upper(first("underlying_symbol")).alias("underlying_symbol"),
        first("sector", "industry").alias("sector"), first("market_cap_bucket", "cap_bucket").alias("cap_bucket"),
        listing_year(first("listing_year", "ipo_year", "listing_date", "ipo_date")).alias("listing_year"))


def index_merge(items: DataFrame, bundled: DataFrame) -> DataFrame:
    """One index row per (symbol, exchange): a keyed row first, then a keyed fallback, then the earliest item."""
    rows = items.withColumn("_src", F.lit(0)).unionByName(bundled.withColumn("_src", F.lit(1)))
    is_index = C("segment").endswith("_INDEX")
    rank = F.struct(C("instrument_key").isNull().alias("a"), C("_src"), C("row_no"))
    best = rows.where(is_index).groupBy("symbol", "exchange").agg(F.min_by(F.struct("segment", "instrument_key", "row_no", "_src"), rank).alias("r"))
    others = rows.where(~is_index & (C("_src") == 0)).select("symbol", "exchange", "segment", "instrument_key", C("_src").alias("source"))
    return best.select("symbol", "exchange", "r.segment", "r.instrument_key", C("r._src").alias("source")).unionByName(others)


# Event types the ratio registry accepts.
RATIO_EVENTS = ("split", "bonus", "demerger", "reverse_split")


def action_registry(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw(row JSON) to (accepted actions, rejected rows with a reason)."""
    j = raw.select("row", F.from_json("row", "symbol string, event_type string, effective_date string, ratio string, note string").alias("j"))
    d = j.select("row", F.upper(F.trim("j.symbol")).alias("symbol"), F.trim("j.event_type").alias("event_type"),
                 F.to_date(C("j.effective_date").try_cast("date")).alias("effective_date"), C("j.ratio").try_cast("double").alias("ratio"))
    bad = (F.when(F.coalesce("symbol", F.lit("")) == "", "symbol").when(F.coalesce("event_type", F.lit("")) == "", "event_type")
           .when(C("ratio").isNull() | (C("ratio") <= 0), "ratio").when(C("effective_date").isNull(), "effective_date")
           .when(~C("event_type").isin(*RATIO_EVENTS), "unsupported"))
    d = d.withColumn("reason", bad)
    return d.where("reason is null").drop("row", "reason"), d.where("reason is not null")


def normalise_symbols(df: DataFrame, column: str, universe: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Adds `symbol`: trimmed, upper, exchange suffix dropped, aliases applied, null when outside the universe."""
    v = F.upper(F.trim(column))
    v = F.regexp_replace(v, r"\.(NS|BO)$", "")
    if aliases:
        v = F.coalesce(F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[v], v)
    d = df.withColumn("_v", v)
    u = universe.select(F.upper("symbol").alias("_v"), F.lit(True).alias("_known")).distinct()
    return d.join(u, "_v", "left").withColumn("symbol", F.when(C("_known"), C("_v"))).drop("_v", "_known")


def safe_cell(c: Column) -> Column:
    return F.when(c.rlike(FORMULA_START), F.concat(F.lit("'"), c)).otherwise(c)


def safe_frame(df: DataFrame) -> DataFrame:
    """Text cells and headings that a spreadsheet would evaluate get a leading quote."""
    out = []
    for f in df.schema.fields:
        name = f.name
        head = "'" + name if name.lstrip(" \t\r\n")[:1] in tuple("=+-@") or name[:1] in tuple("\t\r\n") else name
        c = df[f"`{name}`"]
        out.append((safe_cell(c) if f.dataType.simpleString() == "string" else c).alias(head))
    return df.select(*out)


def write_safe_csv(df: DataFrame, path: str) -> None:
    safe_frame(df).write.mode("overwrite").option("escape", '"').csv(path, header=True)


def write_verified_csv(bars: DataFrame, path: str) -> None:
    """Per-symbol daily CSV folders, closing time first."""
    close_at = F.to_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" 10:00:00"))).alias("available_at")
    (bars.select("symbol", close_at, *FIELDS).repartition("symbol").sortWithinPartitions("symbol", "available_at")
     .write.mode("overwrite").partitionBy("symbol").csv(path, header=True))


def snapshot_hash(cols: list[str]) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(C(c).cast("string"), F.lit("")) for c in cols]), 256)


def append_ledger(existing: DataFrame | None, new: DataFrame, key: list[str]) -> DataFrame:
    """New forecast rows not stored yet: hashed, first of equal hashes, anti-joined to the ledger."""
    rows = new.withColumn("snapshot_hash", snapshot_hash(key)).dropDuplicates(["snapshot_hash"])
    return rows if existing is None else rows.join(existing.select("snapshot_hash"), "snapshot_hash", "left_anti")


def latest_by_key(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Upsert view: newest version per key, combined map-side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("r")).select(*keys, "r.*")
