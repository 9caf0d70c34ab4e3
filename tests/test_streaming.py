"""Streams with state, timers and stores: restarts, repeated batches, late rows."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tapeline.operators import sessions
from tapeline.session import shared_path
from tapeline.sources.keyed_store import KeyedStore
from tapeline.streaming import health, late, ticks


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def arrive(spark, path, rows):
    """rows: (symbol, minute) ticks as one more file."""
    made = [(i, at(m), 1, s, 5.0, "{}") for i, (s, m) in enumerate(rows)]
    spark.createDataFrame(made, ticks.EVENTS).coalesce(1).write.mode("append").parquet(path)


def watch(spark, path, base, per_batch=None):
    stream = health.stale_symbols(ticks.tick_source(spark, path, per_batch), 3600, "10 minutes")
    stream.writeStream.option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).outputMode("append").format("parquet").option("path", f"{base}/out").start().awaitTermination()
    return sorted((r["symbol"], r["last_ts"], r["reported_at"], r["state"], r["silent_seconds"]) for r in spark.read.parquet(f"{base}/out").collect())


def test_silence_is_told_by_a_timer_once_and_survives_a_restart(spark):
    path, base = shared_path(spark, "events"), shared_path(spark, "watch")
    arrive(spark, path, [("A", 0), ("A", 10)] + [("B", m) for m in range(0, 121, 20)])
    told = [("A", at(10), at(70), "stale", None)]
    assert watch(spark, path, base) == told  # no tick of A after it
    assert watch(spark, path, base) == told
    arrive(spark, path, [("B", 130)])
    assert watch(spark, path, base) == told
    arrive(spark, path, [("A", 200), ("B", 200), ("A", 205)])
    after = [("A", at(10), at(70), "stale", None), ("A", at(10), at(200), "resumed", 190 * 60.0), ("B", at(130), at(190), "stale", None), ("B", at(130), at(200), "resumed", 70 * 60.0)]
    assert watch(spark, path, base) == sorted(after, key=lambda r: r[:4])


@pytest.mark.parametrize("per_batch", [1, None])
def test_silences_do_not_depend_on_batches(spark, per_batch):
    path, base = shared_path(spark, "events"), shared_path(spark, "watch")
    for rows in ([("A", 0), ("B", 1)], [("A", 30), ("B", 95)], [("B", 100), ("A", 99)], [("B", 300)]):
        arrive(spark, path, rows)
    got = watch(spark, path, base, per_batch)
    assert [(s, a, b, k) for s, a, b, k, _ in got] == [("A", at(30), at(90), "stale"), ("A", at(30), at(99), "resumed"), ("A", at(99), at(159), "stale"),
                                                      ("B", at(1), at(61), "stale"), ("B", at(1), at(95), "resumed"), ("B", at(100), at(160), "stale"), ("B", at(100), at(300), "resumed")]


def test_late_rows_go_to_their_tables_and_a_repeated_batch_changes_nothing(spark):
    base, schema = shared_path(spark, "late"), "id int, ts timestamp"
    router = late.LateRouter(base, "ts", grace=3600)
    batches = [[(1, at(0)), (2, at(100))], [(3, at(100)), (4, at(41)), (5, at(39)), (6, None)], [], [(7, at(90)), (8, at(500))]]
    for run in (0, 1):
        for i, rows in enumerate(batches):
            router(spark.createDataFrame(rows, schema), i)
        got = {name: sorted(r["id"] for r in router.read(spark, schema, name).collect()) for name in late.ROUTES}
        assert got == {"on_time": [1, 2, 3, 6, 8], "deferred": [4, 7], "late": [5]}
    router(spark.createDataFrame([(9, at(445))], schema), 4)
    assert router.read(spark, schema, "deferred").where("id = 9").count() == 1
    assert late.grace_period(10**9) == 172800 and late.grace_period(-5) == 0


def files(store):
    return store.manifest()[1]


def test_store_rewrites_touched_buckets_only_and_old_versions_lose(spark):
    store = KeyedStore(spark, shared_path(spark, "store"), "k int, g string, v int, x double", ["k", "g"], ["v"], buckets=8)
    assert store.read().collect() == [] and store.manifest() == (-1, {}, -1)
    rows = [(k, g, 5, float(k)) for k in range(60) for g in ("a", None)]
    assert store.upsert(spark.createDataFrame(rows, store.schema), 0)
    before = files(store)
    assert len(before) == 8 and store.read().count() == 120
    change = [(3, "a", 6, -1.0), (3, "a", 7, -2.0), (3, None, 4, -3.0), (99, "z", 1, 0.5)]
    assert store.upsert(spark.createDataFrame(change, store.schema), 1)
    after, got = files(store), {(r["k"], r["g"]): (r["v"], r["x"]) for r in store.read().collect()}
    assert 1 <= sum(before[b] != after[b] for b in before) <= 3
    assert got[3, "a"] == (7, -2.0) and got[3, None] == (5, 3.0) and got[99, "z"] == (1, 0.5) and len(got) == 121
    assert not store.upsert(spark.createDataFrame([(3, "a", 99, 0.0)], store.schema), 1) and files(store) == after
    assert store.upsert(spark.createDataFrame([(3, "a", 7, 8.0)], store.schema)) and store.manifest()[2] == 1
    assert store.read().where("k = 3 and g = 'a'").first()["x"] == 8.0  # of equal versions the update
    assert store.upsert(spark.createDataFrame([], store.schema), 2) and store.manifest()[2] == 2 and store.read().count() == 121


def test_two_writers_of_a_store_do_not_overwrite_each_other(spark):
    store = KeyedStore(spark, shared_path(spark, "store"), "k int, v int", ["k"], ["v"], buckets=2)
    rival = KeyedStore(spark, store.path, store.schema, store.keys, store.version, 2)
    stale = rival.manifest()
    store.upsert(spark.createDataFrame([(1, 1)], store.schema))
    rival.manifest = lambda: stale
    with pytest.raises(AnalysisException):
        rival.upsert(spark.createDataFrame([(2, 1)], store.schema))
    assert [tuple(r) for r in store.read().collect()] == [(1, 1)]


def test_windowed_sentiment_is_upserted_batch_by_batch(spark):
    path, base = shared_path(spark, "in"), shared_path(spark, "sentiment")
    schema = "symbol string, ts timestamp, score double"
    store = KeyedStore(spark, f"{base}/store", "symbol string, window_start timestamp, avg_score double, headlines long", ["symbol", "window_start"], ["headlines"])
    for rows in ([("A", at(0), 1.0), ("B", at(0), 0.5)], [("A", at(60), 0.0), ("A", at(60 * 24 * 8), 0.25)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        ticks.upsert_stream(ticks.sentiment_windows(spark.readStream.schema(schema).parquet(path), "7 days", "30 days"), store, f"{base}/ckpt")
    got = sorted(tuple(r) for r in store.read().collect())
    assert got == [("A", at(0), 0.5, 2), ("A", at(60 * 24 * 7), 0.25, 1), ("B", at(0), 0.5, 1)]


def test_phases_of_a_session_day(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 2, 6)], "ts date")
    cal = sessions.session_calendar(days, spark.createDataFrame([(dt.date(2024, 1, 1), "holiday", "x")], "ts date, kind string, reason string"), [2024])
    local = [("h", 1, 10, 0, 0), ("pre", 2, 9, 14, 59), ("open", 2, 9, 15, 0), ("close", 2, 15, 30, 0), ("post", 2, 15, 30, 1), ("sat", 6, 12, 0, 0), ("out", 9, 12, 0, 0)]
    rows = [(n, dt.datetime(2024, 1, d, h, m, s) - dt.timedelta(minutes=330)) for n, d, h, m, s in local]
    got = {r["symbol"]: (r["session_date"].day, r["phase"]) for r in ticks.with_session(spark.createDataFrame(rows, "symbol string, ts timestamp"), cal).collect()}
    assert got == {"h": (1, "no_session"), "pre": (2, "pre"), "open": (2, "regular"), "close": (2, "regular"), "post": (2, "post"), "sat": (6, "no_session"), "out": (9, "unknown")}
    assert ticks.session_phases(cal).groupBy("session_date").agg(F.sum(F.col("to_us") - F.col("from_us")).alias("n")).where("n <> 86400000000").count() == 0


def test_settlement_meets_only_rows_of_a_slot(spark):
    path = shared_path(spark, "ticks")
    rows = [("A", at(m), float(m)) for m in range(0, 1000, 7)] + [("B", at(500), 1.0)]
    spark.createDataFrame(rows, "symbol string, ts timestamp, price double").coalesce(1).write.parquet(path)
    t = spark.readStream.schema("symbol string, ts timestamp, price double").parquet(path)
    f = t.select("symbol", F.col("price").alias("id"), (F.col("ts") + F.expr("INTERVAL 60 MINUTES")).alias("target"))
    joined = ticks.settlement_stream(f, t, "2 HOURS", "1 hour")
    plan = joined._jdf.queryExecution().analyzed().toString()
    assert "tick_slot" in next(line for line in plan.splitlines() if "Join LeftOuter" in line)
    got = sorted((r["symbol"], r["id"], r["tick_price"]) for r in ticks.drain(joined, "settle").collect() if r["tick_ts"] is not None)
    assert got == [("A", float(a), float(b)) for a in range(0, 1000, 7) for b in range(0, 1000, 7) if 60 <= b - a <= 180]


def test_settlement_summary_counts_what_the_pairs_are(spark):
    schema = "symbol string, ts timestamp, price double"
    batches = [[("A", at(m), float(m)) for m in range(0, 700, 7)] + [("A", at(70), 1.0), ("A", at(203), None), ("B", at(90), None), (None, at(10), 2.0), (None, at(100), 3.0), ("A", None, 4.0)],
               [("A", at(m), float(m)) for m in range(640, 1000, 9)] + [("B", at(980), 5.0)], [("A", at(2000), 6.0)]]
    for per_batch in (1, None):
        got = {}
        for summary in (False, True):
            path, base = shared_path(spark, "ticks"), shared_path(spark, "settle")
            for rows in batches:  # a run for each: state is kept from one to the next
                spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
                if per_batch is None and rows is not batches[-1]:
                    continue
                t = spark.readStream.schema(schema).parquet(path)
                f = t.select("symbol", F.when(F.col("price") != 63, F.col("price")).alias("id"), (F.col("ts") + F.expr("INTERVAL 60 MINUTES")).alias("target"))
                s = ticks.settlement_stream(f, t, "2 HOURS", "1 hour", summary=summary)
                s.writeStream.option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).outputMode("append").format("parquet").option("path", f"{base}/out").start().awaitTermination()
            d = spark.read.parquet(f"{base}/out")
            matches = F.sum("matches") if summary else F.count("tick_ts")
            first = F.min(F.when(F.col("tick_ts").isNotNull(), F.struct("tick_ts", F.col("tick_price").isNull().alias("none"), "tick_price")))
            got[summary] = sorted(map(repr, d.groupBy("symbol", "id", "target").agg(matches.alias("matches"), first.alias("first")).collect()))
            if summary and per_batch is None:
                assert d.count() <= sum(map(len, batches))  # no pairs
        assert got[True] == got[False] and len(got[True]) > 100
