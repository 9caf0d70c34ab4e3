"""User functions: forecasters, evaluators and feature adapters plugged into grouped jobs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .replay import origins, plugin_forecasts, replay_records

C = F.col


def forecaster_plugin(bars: DataFrame, fn: Callable[[str, pd.DataFrame], tuple[float, float, float] | None], horizon: int, most: int | None = 24) -> DataFrame:
    """Walk-forward replay of fn(symbol, history) -> (low, median, high) or None: one scored row per origin, see `replay`."""
    return replay_records(bars, plugin_forecasts(bars, fn, origins(bars, horizon, most=most)), horizon)


def evaluator_plugin(train: DataFrame, test: DataFrame, key: str, fn: Callable[[pd.DataFrame, pd.DataFrame], float]) -> DataFrame:
    """fn(train, test) -> metric, cogrouped by fold."""
    def call(k, a, b):
        return pd.DataFrame([(str(k[0]), float(fn(a, b)), len(a), len(b))], columns=["fold", "metric", "train_rows", "test_rows"])

    # Fresh column ids let both sides come from one table.
    test = test.select(*[C(c).alias(c) for c in test.columns])
    return train.groupBy(key).cogroup(test.groupBy(key)).applyInPandas(call, "fold string, metric double, train_rows long, test_rows long")


def history_loader_plugin(universe: DataFrame, history: DataFrame, report: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A report over injected history: the loader is a DataFrame, symbols without rows are marked."""
    done = report(history.join(universe.select("symbol"), "symbol", "left_semi"))
    return universe.select("symbol").join(done, "symbol", "left")


class FeatureAdapters:
    """Named DataFrame transforms; a feature is admitted when it improves the score over the base."""

    def __init__(self):
        self.items: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
        self.items[name] = fn

    def apply(self, df: DataFrame) -> DataFrame:
        for fn in self.items.values():
            df = df.transform(fn)
        return df

    def admit(self, df: DataFrame, base: str, target: str, min_gain: float) -> DataFrame:
        d = self.apply(df)
        g = d.agg(F.abs(F.corr(base, target)).alias("base"), *[F.abs(F.corr(n, target)).alias(n) for n in self.items])
        return g.unpivot(["base"], list(self.items), "feature", "score").withColumn("admitted", F.coalesce(C("score") >= C("base") + min_gain, F.lit(False)))
