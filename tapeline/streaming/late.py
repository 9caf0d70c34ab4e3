"""Late rows of a stream, routed by a grace period."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

C = F.col
# Seconds before an absent target is final, and the most that may be asked for.
GRACE_SECONDS, GRACE_CAP = 21600, 172800
ROUTES = ("on_time", "deferred", "late")


def grace_period(seconds: int) -> int:
    return min(max(0, seconds), GRACE_CAP)


def route(ts: str, front: Column, grace: int = GRACE_SECONDS) -> Column:
    """on_time at or after the front (or without one), deferred within the grace period before it, late beyond."""
    age = F.unix_micros(front) - F.unix_micros(C(ts))
    return F.when(front.isNull() | C(ts).isNull() | (age <= 0), "on_time").when(age <= grace_period(grace) * 1_000_000, "deferred").otherwise("late")


class LateRouter:
    """foreachBatch sink: rows go to the tables `on_time`, `deferred` and `late` under one path.

    The front is the newest event time of all earlier batches, so front less grace is the watermark that Spark holds with
    the grace period as delay. Each batch writes its rows (one job for all routes, its own newest time observed on the way)
    and then its front, both under its batch id: a batch that runs again finds the same earlier fronts and replaces its own
    rows, nothing else.
    """

    def __init__(self, path: str, ts: str, grace: int = GRACE_SECONDS):
        self.path, self.ts, self.grace = path.rstrip("/"), ts, grace_period(grace)

    def _front(self, spark: SparkSession, batch_id: int):
        if batch_id == 0:
            return None
        fronts = spark.read.schema("front timestamp, batch_id long").parquet(f"{self.path}/fronts")
        return fronts.where(C("batch_id") < batch_id).agg(F.max("front")).first()[0]

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        front, seen = self._front(spark, batch_id), Observation()
        rows = batch.withColumn("route", route(self.ts, F.lit(front).cast("timestamp"), self.grace)).observe(seen, F.max(self.ts).alias("newest"))
        rows.write.mode("overwrite").partitionBy("route").parquet(f"{self.path}/rows/batch_id={batch_id}")
        newest = max((x for x in (front, seen.get["newest"]) if x is not None), default=None)
        spark.createDataFrame([(newest,)], "front timestamp").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/fronts/batch_id={batch_id}")

    def read(self, spark: SparkSession, schema: str, name: str | None = None) -> DataFrame:
        """Rows of one route, or of all, with `batch_id` and `route`."""
        rows = spark.read.schema(f"{schema}, batch_id long, route string").parquet(f"{self.path}/rows")
        return rows if name is None else rows.where(C("route") == name)


def arrive(batches: list[DataFrame], path: str, stream: Callable[[SparkSession], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Let batches arrive in a folder one after the other and run the stream over each; a run picks up where the last one stopped."""
    for rows in batches:
        rows.write.mode("append").parquet(path)
        stream(rows.sparkSession).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
