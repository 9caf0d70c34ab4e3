"""Ordered computations over keys that may hold a large share of all rows.

A series is cut into order-preserving chunks (an hour, a day, a range of ids). Each
(key, chunk) group is processed on its own; only one summary row per chunk is carried
along the key. No task ever sees a whole hot key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .span import UP


def _carry_join(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(carry, [*keys, "_chunk"], "left")


def previous(df: DataFrame, keys: list[str], chunk: Column, order: list[str], values: dict[str, str]) -> DataFrame:
    """Add `out: column` with the value of the preceding row of the key."""
    df = cut(df.withColumn("_chunk", chunk))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    packed = F.struct(*[F.col(c).alias(o) for o, c in values.items()])
    ends = df.groupBy(*keys, "_chunk").agg(F.max_by(packed, F.struct(*order)).alias("_end"))
    carry = ends.select(*keys, "_chunk", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_in"))
    local = df.select("*", F.lag(packed).over(w).alias("_prev"))
    joined = _carry_join(local, carry, keys)
    prev = F.coalesce("_prev", "_in")
    return joined.select(*df.columns, *[prev[o].alias(o) for o in values]).drop("_chunk")


def lags(df: DataFrame, keys: list[str], chunk: Column, order: list[str], values: dict[str, tuple[str, int]]) -> DataFrame:
    """Add `out: (column, k)` with the value k rows earlier in the key.

    Only the last rows of each chunk, as many as the greatest k, travel along the key.
    """
    keep, most = df.columns, max(k for _, k in values.values())
    df = cut(df.withColumn("_chunk", chunk))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    local = df.select("*", F.row_number().over(w).alias("_k"), *[F.lag(c, k).over(w).alias(f"_l_{o}") for o, (c, k) in values.items()])
    cols = sorted({c for c, _ in values.values()})
    back = Window.partitionBy(*keys, "_chunk").orderBy(*[F.desc(c) for c in order])
    last = df.select(*keys, "_chunk", F.row_number().over(back).alias("_d"), F.struct(*cols).alias("_v")).where(F.col("_d") <= most)
    tails = last.groupBy(*keys, "_chunk").agg(F.array_sort(F.collect_list(F.struct((-F.col("_d")).alias("at"), F.col("_v").alias("v")))).alias("_tail"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(-most, -1)
    carry = tails.select(*keys, "_chunk", F.flatten(F.collect_list("_tail").over(before)).alias("_in"))
    joined = _carry_join(local, carry, keys)

    def earlier(o, c, k):
        return F.when(F.col("_k") > k, F.col(f"_l_{o}")).otherwise(F.try_element_at("_in", (F.col("_k") - (k + 1)).cast("int"))["v"][c]).alias(o)

    return joined.select(*keep, *[earlier(o, c, k) for o, (c, k) in values.items()])


def running(df: DataFrame, keys: list[str], chunk: Column, order: list[str], aggs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add inclusive running aggregates `out: (sum|min|max, expression)` in key order."""
    fn = {"sum": F.sum, "min": F.min, "max": F.max}
    keep = df.columns
    df = cut(df.select("*", chunk.alias("_chunk"), *[e.alias(f"_x_{o}") for o, (_, e) in aggs.items()]))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(UP, 0)
    local = df.select("*", *[fn[k](f"_x_{o}").over(w).alias(f"_l_{o}") for o, (k, _) in aggs.items()])
    totals = df.groupBy(*keys, "_chunk").agg(*[fn[k](f"_x_{o}").alias(f"_t_{o}") for o, (k, _) in aggs.items()])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(UP, -1)
    carry = totals.select(*keys, "_chunk", *[fn[k](f"_t_{o}").over(before).alias(f"_c_{o}") for o, (k, _) in aggs.items()])
    joined = _carry_join(local, carry, keys)

    def merge(o, k):
        a, b = F.col(f"_l_{o}"), F.col(f"_c_{o}")
        if k == "sum":
            return F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))
        return F.least(a, b) if k == "min" else F.greatest(a, b)

    return joined.select(*keep, *[merge(o, k).alias(o) for o, (k, _) in aggs.items()])


def level_and_sides(df: DataFrame, keys: list[str], chunk: Column, order: list[str], up: Column, down: Column) -> DataFrame:
    """Add the running sums `ups` and `downs`, `low` (the least of ups - downs so far) and `low_before` (the same before the row, null for the first).

    A chunk is summed up by its two totals and the lowest point of its own level; all compose, so one carry per chunk and
    one scan of the rows serve every column.
    """
    keep = df.columns
    df = cut(df.select("*", chunk.alias("_chunk"), up.alias("_up"), down.alias("_down")))
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    so_far = w.rowsBetween(UP, 0)
    local = df.withColumns({"_u": F.sum("_up").over(so_far), "_d": F.sum("_down").over(so_far)}).withColumn("_level", F.col("_u") - F.col("_d"))
    local = local.withColumns({"_low": F.min("_level").over(so_far), "_prev": F.min("_level").over(w.rowsBetween(UP, -1))})
    parts = local.groupBy(*keys, "_chunk").agg(F.sum("_up").alias("_tu"), F.sum("_down").alias("_td"), F.min("_level").alias("_least"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(UP, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    parts = parts.withColumns({"_iu": zero("_tu"), "_id": zero("_td")})
    carry = parts.select(*keys, "_chunk", "_iu", "_id", F.min(F.col("_iu") - F.col("_id") + F.col("_least")).over(before).alias("_in_low"))
    d, base = _carry_join(local, carry, keys), F.col("_iu") - F.col("_id")
    return d.select(*keep, (F.col("_iu") + F.col("_u")).alias("ups"), (F.col("_id") + F.col("_d")).alias("downs"), F.least("_in_low", base + F.col("_low")).alias("low"), F.least("_in_low", base + F.col("_prev")).alias("low_before"))


def lowest_level(df: DataFrame, keys: list[str], chunk: Column, order: list[str], change: Column) -> DataFrame:
    """Add `level` (running sum of `change`), `low` (its minimum so far) and `low_before` (the same before the row)."""
    d = level_and_sides(df, keys, chunk, order, F.greatest(change, F.lit(0.0)), F.greatest(-change, F.lit(0.0)))
    return d.select(*df.columns, (F.col("ups") - F.col("downs")).alias("level"), "low", "low_before")


def three_pass(df: DataFrame, keys: list[str], chunk: Column, cols: list[str], summarise, summary: str, step, state: str, walk, out: str) -> DataFrame:
    """Sequential state machine over chunked keys.

    summarise(rows) describes a chunk as a function of its incoming state; step(state, summary)
    folds those along the key (state is a tuple, None at the start); walk(rows, state) then
    produces the output of each chunk on its own.
    """
    kd = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    base = cut(df.select(*keys, chunk.alias("_chunk"), *cols))
    cd = f"_chunk {base.schema['_chunk'].dataType.simpleString()}"
    names = [c.strip().split(" ")[0] for c in state.split(",")]
    g = [*keys, "_chunk"]

    def tag(key, pdf):
        for name, value in zip(g, key):
            pdf[name] = [value] * len(pdf)
        return pdf

    def order_key(v):
        return tuple(v.values()) if isinstance(v, dict) else v

    maps = base.groupBy(*g).applyInPandas(lambda key, pdf: tag(key, summarise(pdf)), f"{summary}, {kd}, {cd}")

    def fold(key, pdf):
        parts, rows, s = {}, [], None
        for i, c in enumerate(pdf["_chunk"]):
            parts.setdefault(order_key(c), []).append(i)
        for ck in sorted(parts):
            part = pdf.iloc[parts[ck]]
            rows.append((*key, part["_chunk"].iloc[0], s is not None, *(s or [0] * len(names))))
            s = step(s, part)
        return pd.DataFrame(rows, columns=[*g, "_started", *names])

    incoming = maps.groupBy(*keys).applyInPandas(fold, f"{kd}, {cd}, _started boolean, {state}")

    def finish(key, pdf):
        s = tuple(pdf[n].iloc[0] for n in names) if pdf["_started"].iloc[0] else None
        return tag(key, walk(pdf, s))

    return base.join(incoming, g).groupBy(*g).applyInPandas(finish, f"{out}, {kd}, {cd}").drop("_chunk")


def greedy_anchors(df: DataFrame, keys: list[str], ts: str, gap_seconds: float, every: str = "day") -> DataFrame:
    """Assign every row the anchor of its greedy window.

    The first row of a key is an anchor; a row becomes the next anchor once it lies more than
    `gap_seconds` after the current one. Rows with equal timestamps share an anchor.
    """
    import numpy as np
    gap = int(gap_seconds * 1_000_000)
    stamps = df.select(*keys, F.col(ts).cast("timestamp").alias("_ts")).distinct().withColumn("_us", F.unix_micros("_ts"))

    def summarise(pdf):
        t = np.sort(pdf["_us"].to_numpy())
        nxt = np.searchsorted(t, t + gap, side="right")
        out = t.copy()
        for i in range(len(t) - 1, -1, -1):
            if nxt[i] < len(t):
                out[i] = out[nxt[i]]
        # Only rows within one gap of the chunk start can be entered from outside; equal exits are merged.
        reach = np.searchsorted(t, t[0] + gap, side="right") + 1
        ent, ext = t[:reach], out[:reach]
        last = np.append(ext[1:] != ext[:-1], True)
        return pd.DataFrame({"upto": ent[last], "leave": ext[last]})

    def step(s, part):
        part = part.sort_values("upto")
        upto = part["upto"].to_numpy()
        i = 0 if s is None else int(np.searchsorted(upto, s[0] + gap, side="right"))
        return (int(part["leave"].iloc[i]),) if i < len(upto) else s

    def walk(pdf, s):
        t = np.sort(pdf["_us"].to_numpy())
        out, i = np.empty(len(t), dtype="int64"), 0
        if s is not None:
            i = int(np.searchsorted(t, s[0] + gap, side="right"))
            out[:i] = s[0]
        while i < len(t):
            stop = int(np.searchsorted(t, t[i] + gap, side="right"))
            out[i:stop] = t[i]
            i = stop
        return pd.DataFrame({"_us": t, "_anchor": out})

    walked = three_pass(stamps, keys, F.date_trunc(every, F.col("_ts")), ["_us"], summarise, "upto long, leave long", step, "at long", walk, "_us long, _anchor long")
    base = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    out = base.join(walked, [*keys, "_us"])
    return out.select(*df.columns, F.timestamp_micros("_anchor").alias("anchor"), (F.col("_us") == F.col("_anchor")).alias("is_anchor"))
