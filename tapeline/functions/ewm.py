"""Exponential smoothing (adjust=False) with built-in window functions only.

y_t = (1-a) y_{t-1} + a x_t is evaluated in blocks of B rows: inside a block the
weighted prefix sum is anchored at the block start (so powers stay below 1e13), and
finished blocks are carried forward with enough terms to exhaust double precision.
The result matches the sequential recursion to about 1e-15 relative. Inputs may have
a null warm-up; after the first value the series must have no holes.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .span import BARS, UP, Span

MAX_GROWTH = 13 * math.log(10)
PRECISION = 37.0


def span_alpha(n: int) -> float:
    return 2.0 / (n + 1)


def ewm(df: DataFrame, specs: dict[str, tuple[str, float, int]], span: Span = BARS) -> DataFrame:
    """Add one smoothed column per `out: (input column, alpha, min_periods)`."""
    fastest = max(alpha for _, alpha, _ in specs.values())
    block = max(4, min(512, int(MAX_GROWTH / -math.log(1 - fastest))))
    inputs = sorted({c for c, _, _ in specs.values()})
    keep = df.columns

    out = df.select(
        "*",
        (F.row_number().over(span.w) - 1).alias("_rn"),
        *[F.count(c).over(span.running).alias(f"_n_{c}") for c in inputs],
    ).select("*", F.floor(F.col("_rn") / block).alias("_blk"), (F.col("_rn") % block).alias("_pos"))

    inside = Window.partitionBy(*span.keys, "_blk").orderBy(*span.order).rowsBetween(UP, 0)
    local = []
    for name, (c, alpha, _) in specs.items():
        q = 1.0 - alpha
        weight = F.when(F.col(f"_n_{c}") == 1, F.lit(1.0)).otherwise(F.lit(alpha))
        term = F.coalesce(weight * F.col(c), F.lit(0.0)) * F.pow(F.lit(1.0 / q), F.col("_pos"))
        local.append((F.sum(term).over(inside) * F.pow(F.lit(q), F.col("_pos"))).alias(f"_l_{name}"))
    out = out.select("*", *local)

    ends = []
    for name, (_, alpha, _) in specs.items():
        log_q = -math.log(1.0 - alpha)
        depth = max(1, math.ceil(PRECISION / (block * log_q)))
        total = F.col(f"_l_{name}")
        for j in range(1, depth):
            total = total + math.exp(-log_q * block * j) * F.coalesce(span.lag(f"_l_{name}", j * block), F.lit(0.0))
        ends.append(F.when(F.col("_pos") == block - 1, total).alias(f"_e_{name}"))
    out = out.select("*", *ends)

    final = []
    for name, (c, alpha, warm) in specs.items():
        carry = F.coalesce(F.last(f"_e_{name}", ignorenulls=True).over(span.before), F.lit(0.0))
        y = F.col(f"_l_{name}") + carry * F.pow(F.lit(1.0 - alpha), F.col("_pos") + 1)
        final.append(F.when(F.col(f"_n_{c}") >= max(1, warm), y).alias(name))
    return out.select(*keep, *final)
