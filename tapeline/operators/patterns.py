"""Chart structure: pivots, double tops, triangles, gaps and breakouts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.span import BARS as S
from ..session import cut

C = F.col


def with_pivots(bars: DataFrame, w: int = 3) -> DataFrame:
    frame = S.rows(-w, w)
    full = F.count(F.lit(1)).over(frame) == 2 * w + 1
    return bars.select("*", (full & (C("high") >= F.max("high").over(frame))).alias("pivot_high"), (full & (C("low") <= F.min("low").over(frame))).alias("pivot_low"), S.rn().alias("rn"))


def _double(bars: DataFrame, flag: str, level: str, other: str, name: str, w: int, tol: float) -> DataFrame:
    """Last two pivots of a kind, then the opposite extreme of the bars between them."""
    top = name == "Double Top"
    p = with_pivots(bars, w)
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    two = p.where(flag).withColumn("_r", rank).where("_r <= 2").groupBy("symbol").agg(
        F.max(F.when(C("_r") == 2, F.struct("rn", level, "ts"))).alias("a"), F.max(F.when(C("_r") == 1, F.struct("rn", level, "ts"))).alias("b")).where("a is not null and b.rn - a.rn >= 4")
    sim = F.abs(C(f"a.{level}") - C(f"b.{level}")) / F.greatest(C(f"a.{level}"), C(f"b.{level}"))
    two = two.withColumn("sim", sim).where(C("sim") <= tol)
    neck = F.min(F.when(C("rn").between(C("a.rn"), C("b.rn")), C(other))) if top else F.max(F.when(C("rn").between(C("a.rn"), C("b.rn")), C(other)))
    g = p.join(two, "symbol").groupBy("symbol").agg(neck.alias("neckline"), F.max_by("close", p["ts"]).alias("last_close"), F.first("sim").alias("sim"), F.first("a").alias("a"), F.first("b").alias("b"))
    ok = C("last_close") < C("neckline") if top else C("last_close") > C("neckline")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - C("sim") / tol))
    return g.select("symbol", F.lit(name).alias("pattern"), F.lit("Bearish" if top else "Bullish").alias("direction"),
                    F.when(ok, F.least(F.lit(1.0), score + 0.15)).otherwise(score).alias("quality"), ok.alias("confirmed"),
                    C("b.ts").alias("ts"), C("neckline").alias("level"))


def double_patterns(bars: DataFrame, w: int = 3, tol: float = 0.025) -> DataFrame:
    return _double(bars, "pivot_high", "high", "low", "Double Top", w, tol).unionByName(_double(bars, "pivot_low", "low", "high", "Double Bottom", w, tol))


# Slope threshold relative to the mean price, and the contraction limit.
SLOPE, CONTRACTION = 0.0002, 0.85


def triangle(bars: DataFrame, lookback: int = 40) -> DataFrame:
    d = bars.withColumn("_d", S.rn_desc()).where(C("_d") <= lookback)
    x = -C("_d").cast("double")
    d = d.withColumn("_n", F.count("*").over(Window.partitionBy("symbol")))
    first, last = C("_d") > C("_n") - 5, C("_d") <= 5
    g = d.groupBy("symbol").agg(
        (F.regr_slope("high", x) / F.avg("close")).alias("hs"), (F.regr_slope("low", x) / F.avg("close")).alias("ls"),
        (F.avg(F.when(first, C("high"))) - F.avg(F.when(first, C("low")))).alias("w0"), (F.avg(F.when(last, C("high"))) - F.avg(F.when(last, C("low")))).alias("w1"), F.max("ts").alias("ts"))
    h, lo = C("hs"), C("ls")
    name = (F.when((h < -SLOPE) & (lo > SLOPE), "Symmetrical Triangle").when((F.abs(h) <= SLOPE) & (lo > SLOPE), "Ascending Triangle")
            .when((h < -SLOPE) & (F.abs(lo) <= SLOPE), "Descending Triangle"))
    side = F.when(name == "Symmetrical Triangle", "Neutral / breakout pending").when(name == "Ascending Triangle", "Bullish bias").otherwise("Bearish bias")
    contraction = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - C("w1") / F.greatest(C("w0"), F.lit(1e-9))))
    return g.where((C("w1") < C("w0") * CONTRACTION) & name.isNotNull()).select(
        "symbol", name.alias("pattern"), side.alias("direction"), (0.45 + 0.5 * contraction).alias("quality"), F.lit(False).alias("confirmed"), "ts", F.lit(None).cast("double").alias("level"))


def fair_value_gaps(bars: DataFrame) -> DataFrame:
    """Every gap, numbered from the newest."""
    d = bars.select("symbol", "ts", "high", "low", S.lag("high", 2).alias("fh"), S.lag("low", 2).alias("fl"))
    up, dn = C("low") > C("fh"), C("high") < C("fl")
    d = d.where(up | dn).select("symbol", "ts", F.when(up, "Bullish Fair Value Gap").otherwise("Bearish Fair Value Gap").alias("pattern"), F.when(up, "Bullish").otherwise("Bearish").alias("direction"),
                                F.least(F.lit(1.0), F.when(up, (C("low") - C("fh")) / C("fh")).otherwise((C("fl") - C("high")) / C("fl")) * 20).alias("quality"),
                                F.when(up, C("fh")).otherwise(C("high")).alias("zone_low"), F.when(up, C("low")).otherwise(C("fl")).alias("zone_high"))
    return d.withColumn("rank", S.rn_desc())


def breakout_levels(bars: DataFrame, lookback: int = 60) -> DataFrame:
    prior = S.rows(-lookback, -1)
    d = bars.select("symbol", "ts", "close", F.max("high").over(prior).alias("resistance"), F.min("low").over(prior).alias("support"), S.rn_desc().alias("_d")).where("_d = 1").drop("_d")
    return d.withColumn("status", F.when(C("close") > C("resistance"), "Bullish breakout").when(C("close") < C("support"), "Bearish breakdown").otherwise("None"))


def breakout(bars: DataFrame) -> DataFrame:
    """All patterns of a symbol with its breakout, ranked by quality; the bars are made once for all of them."""
    bars = cut(bars.select("symbol", "ts", "open", "high", "low", "close", "volume"))
    b = breakout_levels(bars)
    up = C("status") == "Bullish breakout"
    brk = b.where("status <> 'None'").select(
        "symbol", C("status").alias("pattern"), F.when(up, "Bullish").otherwise("Bearish").alias("direction"),
        F.least(F.lit(1.0), 0.6 + F.when(up, C("close") / C("resistance") - 1).otherwise(C("support") / C("close") - 1) * 20).alias("quality"),
        F.lit(True).alias("confirmed"), "ts", F.when(up, C("resistance")).otherwise(C("support")).alias("level"))
    gaps = fair_value_gaps(bars).select("symbol", "pattern", "direction", "quality", F.lit(True).alias("confirmed"), "ts", C("zone_low").alias("level"))
    allp = reduce(DataFrame.unionByName, [double_patterns(bars), triangle(bars), gaps, brk])
    return allp.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("quality"), "pattern", "ts")))
