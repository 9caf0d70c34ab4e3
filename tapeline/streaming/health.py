"""Silence of symbols, watched with keyed state and event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import STATE_STORE

OUT = "symbol string, last_us long, at_us long, state string, silent_seconds double"


def spells(ticks: list[np.ndarray], limit: int) -> np.ndarray:
    """Sorted (first, last) of the stretches in which no two neighbouring ticks are more than `limit` apart."""
    edges = np.concatenate(ticks).reshape(-1, 2)
    edges = edges[np.argsort(edges[:, 0], kind="stable")]
    last = np.maximum.accumulate(edges[:, 1])
    start = np.append(True, edges[1:, 0] - last[:-1] > limit)
    return np.stack([edges[start, 0], last[np.append(np.flatnonzero(start)[1:] - 1, len(edges) - 1)]], axis=1)


class SilenceWatch(StatefulProcessor):
    """Remembers each symbol's newest tick and whether its silence was told, and holds one timer at newest tick + limit.

    The rows of a batch are brought down to stretches without a silence as they come in, so memory follows the number of
    silences and not that of ticks.
    """

    def __init__(self, limit_seconds: float):
        self.limit = int(limit_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "us long, told boolean")

    def _timer(self, us: int) -> int:
        return -(-(us + self.limit) // 1000)  # whole milliseconds, not before the limit

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.newest.get() if self.newest.exists() else None
        last, told = state if state else (None, False)
        parts = [np.array([[last, last]], np.int64)] if state else []
        for pdf in rows:
            us = np.sort(pdf["us"].to_numpy(np.int64))
            us = us if last is None else us[us > last]  # a late tick does not end a silence
            if len(us):
                parts = [spells([*parts, np.stack([us, us], axis=1)], self.limit)]
        if not parts:
            return
        found = parts[0]
        out = []
        for n, ((_, a), (b, _)) in enumerate(zip(found[:-1].tolist(), found[1:].tolist(), strict=True)):
            if not (n == 0 and told):
                out.append((key[0], a, a + self.limit, "stale", None))
            out.append((key[0], a, b, "resumed", (b - a) / 1e6))
        newest = int(found[-1, 1])
        if last is None or newest > last:
            if last is not None and not told:
                self.handle.deleteTimer(self._timer(last))
            self.handle.registerTimer(self._timer(newest))
            self.newest.update((newest, False))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, told = self.newest.get()
        if not told and self._timer(last) <= expiredTimerInfo.getExpiryTimeInMs():
            self.newest.update((last, True))
            yield pd.DataFrame([(key[0], last, last + self.limit, "stale", None)], columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def stale_symbols(ticks: DataFrame, limit_seconds: float, delay: str) -> DataFrame:
    """`stale` once a symbol has been silent for longer than the limit, `resumed` at its next tick: symbol, last_ts, reported_at, state, silent_seconds.

    A silence is told as soon as the watermark (newest tick of all symbols less `delay`) passes its limit, with no need for
    another tick of the symbol, and only once, also across restarts. The rows do not depend on how ticks fall into batches
    as long as none is later than `delay`.
    """
    ticks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = ticks.withWatermark("ts", delay).select("symbol", "ts", F.unix_micros("ts").alias("us"))
    told = rows.groupBy("symbol").transformWithStateInPandas(SilenceWatch(limit_seconds), OUT, "Append", "EventTime")
    return told.select("symbol", F.timestamp_micros("last_us").alias("last_ts"), F.timestamp_micros("at_us").alias("reported_at"), "state", "silent_seconds")
