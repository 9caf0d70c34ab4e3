"""Structured Streaming counterparts: quotes, bars, sessions, alerts and settlement."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.span import ratio
from ..operators.sessions import CLOSE_MIN, OPEN_MIN, ZONE
from ..session import shared_path
from ..sources.keyed_store import KeyedStore

C = F.col
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def tick_source(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Unbounded ticks from Parquet files: session prices, open interest, implied volatility, nested depth and a greeks map."""
    r = spark.readStream.schema(EVENTS)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    d = r.parquet(path)
    depth = F.array(F.struct((C("value") - 0.05).alias("bid"), F.lit(1).alias("bid_qty"), (C("value") + 0.05).alias("ask"), F.lit(1).alias("ask_qty")))
    return d.select("event_id", C("event_type").alias("symbol"), C("ts").cast("timestamp").alias("ts"), C("value").alias("price"), (1 + C("event_id") % 100).alias("volume"), "user_id",
                    (C("value") * 0.99).alias("open"), (C("value") * 1.01).alias("high"), (C("value") * 0.98).alias("low"), (C("value") * 0.985).alias("previous_close"),
                    depth.alias("depth"), (C("event_id") % 1000).cast("double").alias("open_interest"), F.least(F.lit(1.0), C("value") / 1000).alias("implied_volatility"),
                    F.create_map(F.lit("delta"), F.least(F.lit(1.0), C("value") / 500)).alias("greeks")).withColumns(
                        {"change": C("price") - C("previous_close"), "change_pct": ratio(C("price"), C("previous_close")) * 100 - 100})


def drain(stream: DataFrame, name: str, mode: str = "append", each=None) -> DataFrame:
    """Run a stream over what is available now into a Parquet folder and read it back."""
    spark = stream.sparkSession
    base = shared_path(spark, name)
    out = f"{base}/out"
    w = stream.writeStream.option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True)
    if each is None and mode == "append":
        q = w.outputMode("append").format("parquet").option("path", out).start()
    else:
        fn = each or (lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch_id={i}"))  # a batch that runs again replaces its rows
        q = w.outputMode(mode).foreachBatch(fn if each is None else (lambda df, i: each(df, i, out))).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def latest_quote(ticks: DataFrame) -> DataFrame:
    """Latest-wins per symbol; state is one struct per symbol."""
    return ticks.groupBy("symbol").agg(F.max_by(F.struct("ts", "price", "volume"), F.struct("ts", "event_id")).alias("q")).select("symbol", "q.*")


def stream_bars(ticks: DataFrame, width: str, delay: str, slide: str | None = None) -> DataFrame:
    at = F.struct("ts", "event_id")
    g = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", width, slide) if slide else F.window("ts", width)).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("ticks"))
    return g.select("symbol", C("window.start").alias("bar_start"), C("window.end").alias("bar_end"), "open", "high", "low", "close", "volume", "ticks")


def stream_dedupe(ticks: DataFrame, delay: str) -> DataFrame:
    """One record per (symbol, ts) inside the watermark. Keeps the first, where the batch loader keeps the last."""
    return ticks.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "ts"])


def alert_stream(ticks: DataFrame, rules: DataFrame, cooldown: int = 900) -> DataFrame:
    """Threshold alerts; each alert remembers its last trigger and stays silent for the cooldown."""
    hit = F.when(C("condition") == "ABOVE", C("price") >= C("threshold")).otherwise(C("price") <= C("threshold"))
    hits = ticks.join(rules, "symbol").where(hit).select("alert_id", "event_id", "price", F.unix_micros("ts").alias("us"))

    def step(key, pdfs, state: GroupState):
        last = state.get[0] if state.exists else None
        rows = []
        for r in pd.concat(list(pdfs)).sort_values(["us", "event_id"]).itertuples(index=False):
            if last is None or r.us - last >= cooldown * 1_000_000:
                rows.append((key[0], r.event_id, r.price, r.us))
                last = int(r.us)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(rows, columns=["alert_id", "event_id", "price", "us"])

    return hits.groupBy("alert_id").applyInPandasWithState(step, "alert_id int, event_id long, price double, us long", "last long", "append", GroupStateTimeout.NoTimeout).select(
        "alert_id", "event_id", "price", F.timestamp_micros("us").alias("ts"))


def session_phases(calendar: DataFrame) -> DataFrame:
    """Intervals (session_date, phase, from_us, to_us) of the local day: pre, regular and post on session days, no_session on others."""
    day, open_us, close_us = 86_400_000_000, OPEN_MIN * 60_000_000, CLOSE_MIN * 60_000_000 + 1  # the closing instant belongs to the session
    part = lambda name, a, b: F.struct(F.lit(name).alias("phase"), F.lit(a).cast("bigint").alias("from_us"), F.lit(b).cast("bigint").alias("to_us"))
    phases = F.when(C("is_session"), F.array(part("pre", 0, open_us), part("regular", open_us, close_us), part("post", close_us, day))).otherwise(F.array(part("no_session", 0, day)))
    return calendar.select(C("ts").alias("session_date"), F.explode(phases).alias("p")).select("session_date", "p.*")


def with_session(ticks: DataFrame, calendar: DataFrame) -> DataFrame:
    """Add session_date and phase: a stream-static interval join, on the local day and the time within it. Days outside the calendar are `unknown`."""
    local = F.from_utc_timestamp("ts", ZONE)
    t = ticks.withColumn("_day", F.to_date(local)).withColumn("_us", F.unix_micros(local) - F.unix_micros(F.to_timestamp("_day")))
    p = session_phases(calendar)
    j = t.join(p, (C("_day") == C("session_date")) & (C("_us") >= C("from_us")) & (C("_us") < C("to_us")), "left")
    return j.select(*ticks.columns, C("_day").alias("session_date"), F.coalesce("phase", F.lit("unknown")).alias("phase"))


def session_activity(ticks: DataFrame, calendar: DataFrame, gap: str, delay: str) -> DataFrame:
    """Gap sessions of a symbol within each calendar session and phase, with their tick counts."""
    d = with_session(ticks.withWatermark("ts", delay), calendar)
    g = d.groupBy("symbol", "session_date", "phase", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("ticks"))
    return g.select("symbol", "session_date", "phase", C("w.start").alias("session_start"), C("w.end").alias("session_end"), "ticks")


def settlement_stream(forecasts: DataFrame, ticks: DataFrame, tolerance: str, delay: str, summary: bool = False) -> DataFrame:
    """Forecasts(symbol, id, target) joined to ticks inside the tolerance; unmatched ones come out once the watermark passes.

    Time is cut into slots as long as the tolerance. A forecast is in one slot, a tick goes to the two slots it can settle,
    so a row meets the rows of its symbol and slot only and no pair is met twice. With `summary` the pairs are not written
    out: in each batch a forecast with new ticks gives one row, with their number (matches) and its first tick so far.
    """
    span = F.expr(f"INTERVAL {tolerance}")
    width = forecasts.sparkSession.range(1).select(F.unix_micros(F.timestamp_micros(F.lit(0)) + span)).first()[0]
    slot = lambda at: F.floor(F.unix_micros(at) / F.lit(max(1, width)))
    f = forecasts.withWatermark("target", delay).withColumn("slot", slot(C("target")))
    t = ticks.select(C("symbol").alias("tick_symbol"), C("ts").alias("tick_ts"), C("price").alias("tick_price")).withWatermark("tick_ts", delay)
    t = t.select("*", F.explode(F.array_distinct(F.array(slot(C("tick_ts") - span), slot(C("tick_ts"))))).alias("tick_slot"))
    if summary:
        return settled(f, t, width)
    cond = (C("symbol") == C("tick_symbol")) & (C("slot") == C("tick_slot")) & (C("tick_ts") >= C("target")) & (C("tick_ts") <= C("target") + span)
    return f.join(t, cond, "leftOuter").select("symbol", "id", "target", "tick_ts", "tick_price")


def settled(f: DataFrame, t: DataFrame, width: int) -> DataFrame:
    """The outer join of `settlement_stream` as counts: sorted ticks of a symbol and slot are searched for both ends of a forecast's tolerance.

    symbol, id (a number or text), target, matches, tick_ts and tick_price of the first tick; of several at that time the
    one with the lowest price. State holds the forecasts and ticks of a slot until the watermark has passed what can settle it.
    """
    kind = dict(f.dtypes)["id"]
    side = lambda at, price, forecast: (at.alias("at"), F.unix_micros(at).alias("us"), price.cast("double").alias("price"), price.isNotNull().alias("known"), F.lit(forecast).alias("forecast"))
    a = f.where("target is not null").select("symbol", "slot", F.coalesce("id", F.lit(0).cast(kind)).alias("id"), C("id").isNull().alias("none"), *side(C("target"), F.lit(None).cast("double"), True))
    b = t.where("tick_symbol is not null and tick_ts is not null").select(C("tick_symbol").alias("symbol"), C("tick_slot").alias("slot"), F.lit(0).cast(kind).alias("id"), F.lit(False).alias("none"), *side(C("tick_ts"), C("tick_price"), False))

    def step(key, pdfs, state: GroupState):
        new = [x for x in pdfs if len(x)] if not state.hasTimedOut else []
        # targets, ids, nulls among them, matches told (-1: told that there are none); times, prices, whether known
        held = pickle.loads(state.get[0]) if state.exists else None
        open_, tick = held or ([np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0, bool), np.zeros(0, np.int64)], [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)])
        if new:
            rows = pd.concat(new)
            more, seen = rows[rows["forecast"]], rows[~rows["forecast"]]
            open_ = [np.concatenate([o, x.to_numpy(o.dtype)]) for o, x in zip(open_, (more["us"], more["id"], more["none"], more["us"] * 0), strict=True)]
            tick = [np.concatenate([o, x.to_numpy(o.dtype)]) for o, x in zip(tick, (seen["us"], seen["price"], seen["known"]), strict=True)]
            order = np.lexsort((tick[1], ~tick[2], tick[0]))
            tick = [x[order] for x in tick]
        target, ids, none, told = open_
        start = np.searchsorted(tick[0], target, "left")
        count = np.searchsorted(tick[0], target + width, "right") - start
        now = state.getCurrentWatermarkMs()
        past = target + width < now * 1000
        out = (count > told) & (told >= 0) | past & (count == 0) & (told == 0)
        first = np.minimum(start, max(0, len(tick[0]) - 1))[out]
        met = count[out] > 0
        at, price, known = (x[first] if len(x) else np.zeros(len(first), x.dtype) for x in tick)
        result = pd.DataFrame({"symbol": [key[0]] * len(met), "id": ids[out], "none": none[out], "target_us": target[out], "matches": (count - told)[out], "first_us": at, "price": price, "known": known & met})
        close = ((int(key[1]) + 1) * max(1, width) + width) // 1000
        if now > close:
            if state.exists:
                state.remove()
        else:
            told = np.where(past & (count == 0), -1, count)
            open_ = [x[~past] for x in (target, ids, none, told)]
            waiting = open_[0][open_[3] == 0]
            state.update((pickle.dumps((open_, tick)),))
            state.setTimeoutTimestamp(max(now + 1, min(close, int(waiting.min() + width) // 1000 if len(waiting) else close)))
        if len(result):
            yield result

    rows = a.unionByName(b).groupBy("symbol", "slot").applyInPandasWithState(
        step, f"symbol string, id {kind}, none boolean, target_us long, matches long, first_us long, price double, known boolean", "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    met = C("matches") > 0
    return rows.select("symbol", F.when(~C("none"), C("id")).alias("id"), F.timestamp_micros("target_us").alias("target"), "matches",
                       F.when(met, F.timestamp_micros("first_us")).alias("tick_ts"), F.when(met & C("known"), F.coalesce("price", F.lit(float("nan")))).alias("tick_price"))


def sentiment_windows(scored: DataFrame, width: str, delay: str) -> DataFrame:
    """Average score and headlines per symbol and window, updated as headlines come in."""
    g = scored.withWatermark("ts", delay).groupBy("symbol", F.window("ts", width, startTime="4 days").alias("w")).agg(F.avg("score").alias("avg_score"), F.count("*").alias("headlines"))
    return g.select("symbol", C("w.start").alias("window_start"), "avg_score", "headlines")


def upsert_stream(updates: DataFrame, store: KeyedStore, checkpoint: str) -> None:
    """Run an update-mode stream over what is available now into a keyed store; a batch that runs again changes nothing."""
    def each(batch: DataFrame, batch_id: int) -> None:
        store.upsert(batch, batch_id)

    updates.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("update").foreachBatch(each).start().awaitTermination()
