"""Connected components of an edge table by alternating large and small stars; no edge list leaves Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

C = F.col


def _signature(e: DataFrame):
    return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = e.unionByName(e.select(C("v").alias("u"), C("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low"))
    return both.join(low, "u").where(C("v") > C("u")).select(C("v").alias("u"), F.least("low", "u").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("low"))
    joined = e.join(low, "u")
    return joined.select(F.explode(F.array("u", "v")).alias("u"), C("low").alias("v")).where(C("u") != C("v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root (the smallest node of its component) of every node that has an edge to another one.

    Rows with a null end and loops are ignored; repeated edges count once; without edges the result is empty. Each
    round is a table in the shared folder; rounds grow with the logarithm of a component's width.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(C("u") != C("v")).distinct()
    e = cut(e)
    seen = _signature(e)
    while seen[0]:
        e = cut(_small_star(_large_star(e)))
        now = _signature(e)
        if now == seen:
            break
        seen = now
    return e.select(C("u").alias("node"), C("v").alias("root")).unionByName(e.select(C("v").alias("node"), C("v").alias("root")).distinct())
