"""Exact order statistics for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .span import UP

C = F.col


def order_stat(df: DataFrame, keys: list[str], value: str, rank: Column, levels: int = 2, fan: int = 4096) -> DataFrame:
    """(keys, n, stat): the value of the given 1-based rank; `rank` may use the group size `n`.

    Histograms narrow the range around the rank `levels` times; only the last narrow slice is
    ranked, with equal values collapsed to counts first. No group is sorted or collected whole.
    """
    v = cut(df.where(C(value).isNotNull()).select(*keys, C(value).alias("v")))
    g = v.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    g = g.select("*", F.greatest(F.lit(1), F.least(C("n"), rank)).cast("bigint").alias("k")).withColumn("below", F.lit(0).cast("bigint"))
    width = (C("hi") - C("lo")) / fan
    for _ in range(levels):
        inside = v.join(g, keys).where((C("v") >= C("lo")) & (C("v") <= C("hi")))
        b = F.when(width > 0, F.least(F.lit(fan - 1), F.floor((C("v") - C("lo")) / width))).otherwise(0)
        h = inside.groupBy(*keys, b.alias("b")).agg(F.count("*").alias("c"), F.min("v").alias("blo"), F.max("v").alias("bhi"), F.first("n").alias("n"), F.first("k").alias("k"), F.first("below").alias("below"))
        w = Window.partitionBy(*keys).orderBy("b").rowsBetween(UP, 0)
        h = h.withColumn("cum", C("below") + F.sum("c").over(w)).where((C("cum") >= C("k")) & (C("cum") - C("c") < C("k")))
        g = h.select(*keys, "n", C("blo").alias("lo"), C("bhi").alias("hi"), "k", (C("cum") - C("c")).alias("below"))
    t = v.join(g, keys).where((C("v") >= C("lo")) & (C("v") <= C("hi"))).groupBy(*keys, "v").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("k").alias("k"), F.first("below").alias("below"))
    w = Window.partitionBy(*keys).orderBy("v").rowsBetween(UP, 0)
    t = t.withColumn("cum", C("below") + F.sum("c").over(w)).where((C("cum") >= C("k")) & (C("cum") - C("c") < C("k")))
    return t.select(*keys, "n", C("v").alias("stat"))


def conformal_rank(confidence: float) -> Column:
    return F.ceil((C("n") + 1) * F.lit(confidence) - 1e-12)


def conformal_width(df: DataFrame, keys: list[str], value: str, confidence: float) -> DataFrame:
    """(keys, n, half_width): the ceil((n+1)c)-th smallest |value|, the largest when that rank reaches n."""
    a = df.select(*keys, F.abs(value).alias("_a"))
    return order_stat(a, keys, "_a", conformal_rank(confidence)).withColumnRenamed("stat", "half_width")


def ranges(df: DataFrame, keys: list[str], value: str, parts: int = 64) -> DataFrame:
    """Add `_r`: the number of approximate quantiles of the group below the value, so ranges follow the value and hold about equal numbers of rows."""
    at = [i / parts for i in range(1, parts)]
    splits = df.groupBy(*keys).agg(F.percentile_approx(value, at, 1000).alias("_s"))
    return df.join(splits, keys).withColumn("_r", F.coalesce(F.size(F.filter("_s", lambda s: s < C(value))), F.lit(0))).drop("_s")


def ecdf(df: DataFrame, keys: list[str], value: str, parts: int = 64) -> DataFrame:
    """(keys, v, c, below, n): each distinct non-null value with its count, the rows below it and the size of its group.

    Equal values collapse before the shuffle. A group is then cut at approximate quantiles into ranges of about equal
    numbers of distinct values; only one count per range travels along the group, and a window orders one range at a time.
    """
    c = cut(df.where(C(value).isNotNull()).groupBy(*keys, C(value).alias("v")).agg(F.count("*").alias("c")))
    r = ranges(c, keys, "v", parts).join(c.groupBy(*keys).agg(F.sum("c").alias("n")), keys)
    totals = r.groupBy(*keys, "_r").agg(F.sum("c").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_r").rowsBetween(UP, -1)
    carry = totals.select(*keys, "_r", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_b"))  # at most `parts` rows a group
    within = Window.partitionBy(*keys, "_r").orderBy("v").rowsBetween(UP, 0)
    r = r.withColumn("_u", F.sum("c").over(within) - C("c"))
    return r.join(carry, [*keys, "_r"]).select(*keys, "v", "c", (C("_b") + C("_u")).alias("below"), "n")


def percentiles(df: DataFrame, keys: list[str], value: str, names: dict[str, float]) -> DataFrame:
    """(keys, name ...): exact interpolated percentiles of groups of any size, all in one pass over the distribution."""
    e, out = ecdf(df, keys, value), []
    for name, p in names.items():
        rank = (C("n") - 1) * p
        of = lambda k: F.min(F.when(C("below") + C("c") > k, C("v")))  # noqa: E731, B023
        low, high = of(F.floor(rank)), of(F.ceil(rank))
        out.append((low + (high - low) * (F.max(rank) - F.floor(F.max(rank)))).alias(name))
    return e.groupBy(*keys).agg(*out)
