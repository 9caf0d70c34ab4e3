"""Session calendars, session targets, resampling and intraday summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.span import Span

C = F.col
ZONE = "Asia/Kolkata"

# Regular cash session in minutes after local midnight.
OPEN_MIN, CLOSE_MIN = 9 * 60 + 15, 15 * 60 + 30
TIMEFRAME_MIN = {"1m": 1, "5m": 5, "15m": 15, "1h": 60, "4h": 240}


def session_calendar(days: DataFrame, holidays: DataFrame, verified_years: list[int]) -> DataFrame:
    """days(ts) x holidays(ts, kind, reason) to one row per day; one row per calendar day, so small by nature."""
    d = days.join(F.broadcast(holidays), "ts", "left")
    is_open = (C("kind") == "special") | (C("kind").isNull() & (F.weekday("ts") < 5))
    d = d.withColumn("is_session", F.coalesce(is_open, F.lit(False)))
    run = Window.partitionBy().orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("ts", "kind", "reason", "is_session", F.year("ts").isin(verified_years).alias("verified"),
                    F.sum(C("is_session").cast("int")).over(run).alias("session_no"))


def market_status(ticks: DataFrame, calendar: DataFrame) -> DataFrame:
    local = F.from_utc_timestamp("ts", ZONE)
    d = ticks.withColumn("local", local).withColumn("day", F.to_date("local"))
    c = calendar.select(C("ts").alias("day"), "kind", "reason", "verified")
    d = d.join(F.broadcast(c), "day", "left")
    sec = F.hour("local") * 3600 + F.minute("local") * 60 + F.second("local") + F.date_format("local", "SSSSSS").cast("double") / 1e6
    weekend = F.weekday("day") >= 5
    holiday, special = F.coalesce(C("kind") == "holiday", F.lit(False)), F.coalesce(C("kind") == "special", F.lit(False))
    inside = sec.between(OPEN_MIN * 60, CLOSE_MIN * 60)
    is_open = (special | (~weekend & ~holiday)) & inside
    why = (F.when(special & is_open, C("reason")).when(special, F.concat("reason", F.lit(" - outside regular session"))).when(holiday, C("reason"))
           .when(weekend, "Weekend").when(sec < OPEN_MIN * 60, "Pre-market").when(sec > CLOSE_MIN * 60, "Closed").otherwise("Open"))
    why = F.when(F.coalesce("verified", F.lit(False)), why).otherwise(F.concat(why, F.lit(" (calendar not verified)")))
    return d.withColumn("is_open", is_open).withColumn("status", why)


def target_daily(rows: DataFrame, calendar: DataFrame, origin: str, sessions: int) -> DataFrame:
    """Add target_date: the session `sessions` after the origin day (equi-join on session number)."""
    here = calendar.select(C("ts").alias(origin), C("session_no").alias("_no"))
    there = calendar.where("is_session").select(C("ts").alias("target_date"), (C("session_no") - sessions).alias("_no"))
    return rows.join(F.broadcast(here), origin, "left").join(F.broadcast(there), "_no", "left").drop("_no")


def target_intraday(rows: DataFrame, calendar: DataFrame, local: str, timeframe: str, steps: int) -> DataFrame:
    """Add target_local: bar end `steps` bars ahead, rolling into the next session's opening bars."""
    m = TIMEFRAME_MIN[timeframe]
    length = CLOSE_MIN - OPEN_MIN
    per_day = length // m
    here = F.broadcast(calendar.select(C("ts").alias("_day"), C("session_no").alias("_no"), "is_session"))
    there = F.broadcast(calendar.where("is_session").select(C("ts").alias("_tday"), C("session_no").alias("_tno")))
    d = rows.withColumn("_day", F.to_date(local)).join(here, "_day", "left")
    off = (C(local).cast("double") - F.to_timestamp("_day").cast("double")) / 60 - OPEN_MIN
    fresh = ~C("is_session") | (off < 0)
    # First step: opening bar of this or the next session, next bar of the day, or next session.
    d = d.withColumn("_fresh", fresh).withColumn("_room", F.greatest(F.lit(0), F.floor((length - off) / m)))
    stay = F.lit(steps) <= C("_room")
    left = F.when(C("_fresh"), F.lit(steps)).otherwise(F.lit(steps) - C("_room"))
    ahead = F.when(C("_fresh") & C("is_session"), F.ceil(left / per_day) - 1).otherwise(F.ceil(left / per_day))
    days = F.when(~C("_fresh") & stay, F.lit(0)).otherwise(ahead)
    bar = F.when(~C("_fresh") & stay, off + steps * m).otherwise((left - (F.ceil(left / per_day) - 1) * per_day) * m)
    d = d.withColumn("_tno", C("_no") + days).withColumn("_bar", bar).join(there, "_tno", "left")
    at = F.to_timestamp("_tday").cast("double") + (C("_bar") + OPEN_MIN) * 60
    return d.withColumn("target_local", F.timestamp_micros(F.round(at * 1e6).cast("bigint"))).drop("_day", "_no", "is_session", "_fresh", "_room", "_tno", "_bar", "_tday")


def session_gaps(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Sessions between a symbol's first and last bar without a bar.

    Each symbol expands only its own session-number range, then anti-joins its bars.
    """
    cal = F.broadcast(calendar.where("is_session").select("ts", "session_no"))
    lim = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    want = lim.select("symbol", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("ts")).join(cal, "ts", "left_semi")
    return want.join(bars.select("symbol", "ts"), ["symbol", "ts"], "left_anti")


def resample_bars(ticks: DataFrame, width: str) -> DataFrame:
    """OHLCV per time bucket from ticks; partial aggregation keeps a hot symbol off one task."""
    at = F.struct("ts", "event_id")
    g = ticks.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("volume").cast("double").alias("volume"), F.count("*").alias("ticks"))
    return g.select("symbol", C("w.start").alias("ts"), "open", "high", "low", "close", "volume", "ticks")


def intraday_session_summary(bars: DataFrame, bar_minutes: int) -> DataFrame:
    """bars(symbol, ts=UTC bar end, ohlcv) to per-session late momentum, volume share, realised variance, VWAP distance."""
    d = bars.withColumn("local", F.from_utc_timestamp("ts", ZONE)).withColumn("day", F.to_date("local"))
    d = d.withColumn("mins", (C("local").cast("double") - F.to_timestamp("day").cast("double")) / 60).where((C("mins") > OPEN_MIN) & (C("mins") <= CLOSE_MIN))
    s = Span(("symbol", "day"), ("ts",))
    d = d.withColumn("lr", F.log("close") - F.log(s.lag("close")))
    late = C("mins") >= CLOSE_MIN - 30
    g = d.groupBy("symbol", "day").agg(
        F.count("*").alias("bars"), F.max("mins").alias("last"), F.min("mins").alias("first"), F.sum("volume").alias("vol"), F.count_if(late).alias("late_bars"),
        F.max_by("close", "ts").alias("close"), F.min_by(F.when(late, C("close")), F.when(late, C("ts"))).alias("late_open"),
        F.sum(F.when(late, C("volume"))).alias("late_vol"), F.sum(C("lr") * C("lr")).alias("intraday_rv"),
        F.sum((C("high") + C("low") + C("close")) / 3 * C("volume")).alias("pv"))
    ok = (C("bars") >= 10) & (C("last") == CLOSE_MIN) & (C("first") <= OPEN_MIN + 15) & (C("vol") > 0) & (C("late_bars") >= 2)
    return g.where(ok).select("symbol", "day", (C("close") / C("late_open") - 1).alias("late_momentum"), (C("late_vol") / C("vol")).alias("late_volume_share"),
                              "intraday_rv", (C("close") / (C("pv") / C("vol")) - 1).alias("vwap_distance"), "bars")


def expiry_list(contracts: DataFrame, today: Column) -> DataFrame:
    """All sorted expiries, nearest one and days to it, per underlying."""
    d = contracts.where("expiry is not null").groupBy("underlying").agg(F.array_sort(F.collect_set("expiry")).alias("all"))
    return d.select("underlying", F.concat_ws(",", F.transform("all", lambda x: x.cast("string"))).alias("expiries"),
                    C("all")[0].alias("nearest"), F.datediff(C("all")[0], today).alias("days_to_expiry"), F.size("all").alias("listed"))
