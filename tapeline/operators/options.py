"""Option chains, futures curves and multi-leg books."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chunks
from ..functions.pricing import RATE, price, price_array, with_greeks
from ..functions.span import UP, Span, ratio
from ..sources.ohlcv import finite

C = F.col
CALL = "call"

# Scan grid of the scenario margin, and price-band and quote limits.
SPOT_SHOCKS = (0.0, -3.0, -5.0, -10.0, -15.0, 3.0, 5.0, 10.0, 15.0)
VOL_SHOCKS = (0.0, -0.25, 0.25, 0.50)
ATM_FRACTION, IV_MIN, IV_MAX = 0.05, 0.001, 5.0
IV_DEDUPE_SECONDS = 30 * 60


def chain_normalise(raw: DataFrame) -> DataFrame:
    d = raw.withColumn("strike", finite(C("strike"))).withColumn("open_interest", finite(C("open_interest"))).withColumn("option_type", F.lower(F.trim("option_type")))
    return d.where((C("strike") > 0) & (C("open_interest") >= 0) & C("option_type").isin("call", "put"))


# Defect codes by severity.
CHAIN_ERRORS = ("INVALID_STRIKE", "INVALID_OPEN_INTEREST", "INVALID_OPTION_TYPE", "INSUFFICIENT_OI_EVIDENCE", "INVALID_QUOTE", "CROSSED_MARKET", "INVALID_VOLUME", "FUTURE_QUOTE_TIME")
CHAIN_WARNINGS = ("ZERO_OPEN_INTEREST", "WIDE_SPREAD", "LAST_OUTSIDE_MARKET", "STALE_QUOTE")


def chain_defects(raw: DataFrame, as_of: Column, stale_seconds: float, wide_pct: float) -> DataFrame:
    """One row per chain: rows under each defect code, usable rows and the sides they are on."""
    k, oi = finite(C("strike")), finite(C("open_interest"))
    kind = F.lower(F.trim("option_type"))
    ok = F.coalesce((k > 0) & (oi >= 0) & kind.isin("call", "put"), F.lit(False))
    b, a = finite(C("bid")), finite(C("ask"))
    supplied = C("bid").isNotNull() | C("ask").isNotNull()
    quote = ok & F.coalesce((b >= 0) & (a > 0), F.lit(False))
    open_q = quote & (b <= a)
    age = as_of.cast("double") - C("quote_ts").cast("double")
    rules = {
        "INVALID_STRIKE": ~F.coalesce(k > 0, F.lit(False)), "INVALID_OPEN_INTEREST": ~F.coalesce(oi >= 0, F.lit(False)), "INVALID_OPTION_TYPE": ~F.coalesce(kind.isin("call", "put"), F.lit(False)),
        "ZERO_OPEN_INTEREST": ok & (oi == 0), "INVALID_QUOTE": supplied & ~F.coalesce((b >= 0) & (a > 0), F.lit(False)), "CROSSED_MARKET": quote & (b > a),
        "WIDE_SPREAD": open_q & ((a - b) / ((a + b) / 2) * 100 > wide_pct), "LAST_OUTSIDE_MARKET": open_q & ((C("last") < b) | (C("last") > a)), "INVALID_VOLUME": C("volume") < 0,
        "STALE_QUOTE": age > stale_seconds, "FUTURE_QUOTE_TIME": age < -60}
    g = raw.groupBy("underlying").agg(*[F.count_if(F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()], F.count("*").alias("input_rows"), F.count_if(ok).alias("valid_rows"),
                                      F.count_if(ok & (kind == "call")).alias("_calls"), F.count_if(ok & (kind == "put")).alias("_puts"), F.sum(F.when(ok, oi)).alias("_oi"), F.count("quote_ts").alias("_timed"), F.count_if(quote).alias("_quoted"))
    return g.withColumn("INSUFFICIENT_OI_EVIDENCE", F.when((C("valid_rows") > 0) & (C("_oi") == 0), C("valid_rows")).otherwise(0))


def chain_validate(raw: DataFrame, as_of: Column, stale_seconds: float = 900.0, wide_pct: float = 20.0) -> DataFrame:
    """(underlying, code, rows): defect counts of each chain."""
    codes = [c for c in (*CHAIN_ERRORS, *CHAIN_WARNINGS) if c != "INSUFFICIENT_OI_EVIDENCE"]
    return chain_defects(raw, as_of, stale_seconds, wide_pct).unpivot(["underlying"], codes, "code", "rows")


def chain_evidence(raw: DataFrame, as_of: Column, stale_seconds: float = 900.0, wide_pct: float = 20.0) -> DataFrame:
    """The evidence of each chain: usable rows, whether open interest and market data hold, staleness, and a grade.

    The grade is low with any error or stale quote, limited with any other warning, else moderate.
    """
    g = chain_defects(raw, as_of, stale_seconds, wide_pct)
    seen = lambda codes: reduce(lambda x, y: x | y, [C(c) > 0 for c in codes])
    listed = lambda codes: F.concat_ws(",", *[F.when(C(c) > 0, F.lit(c)) for c in codes])
    market = seen(("INVALID_QUOTE", "CROSSED_MARKET", "FUTURE_QUOTE_TIME"))
    grade = F.when(seen(CHAIN_ERRORS) | (C("STALE_QUOTE") > 0), "low").when(seen(CHAIN_WARNINGS), "limited").otherwise("moderate")
    return g.select("underlying", "input_rows", "valid_rows", ((C("valid_rows") > 0) & (C("_calls") > 0) & (C("_puts") > 0) & ~seen(CHAIN_ERRORS[:4])).alias("oi_data_valid"),
                    F.when((C("_timed") > 0) | (C("_quoted") > 0) | market, ~market).alias("market_data_valid"), F.when(C("_timed") > 0, C("STALE_QUOTE") > 0).alias("is_stale"),
                    listed(CHAIN_ERRORS).alias("errors"), listed(CHAIN_WARNINGS).alias("warnings"), grade.alias("evidence_quality"))


def pain_curve(chain: DataFrame, key: str = "underlying") -> DataFrame:
    """Writer payout if settled at each listed strike, by prefix sums over strikes (no self join)."""
    s = chain.groupBy(key, "strike").agg(*[F.sum(F.when(C("option_type") == t, C("open_interest")).otherwise(0.0)).alias(t[0]) for t in ("call", "put")])
    lo = Window.partitionBy(key).orderBy("strike").rowsBetween(UP, 0)
    tot = Window.partitionBy(key)
    k = C("strike")
    d = s.select(key, "strike", F.sum("c").over(lo).alias("c0"), F.sum(C("c") * k).over(lo).alias("c1"), (F.sum("p").over(tot) - F.sum("p").over(lo)).alias("p0"), (F.sum(C("p") * k).over(tot) - F.sum(C("p") * k).over(lo)).alias("p1"))
    return d.select(key, "strike", (k * C("c0") - C("c1") + C("p1") - k * C("p0")).alias("payout"))


def max_pain(chain: DataFrame, key: str = "underlying") -> DataFrame:
    """Lowest strike among those with the smallest payout."""
    return pain_curve(chain, key).groupBy(key).agg(F.min_by(F.struct("strike", "payout"), F.struct(F.round("payout", 6), "strike")).alias("r")).select(key, C("r.strike").alias("max_pain"), C("r.payout").alias("min_payout"))


def chain_summary(chain: DataFrame, spots: DataFrame) -> DataFrame:
    c, p, oi = C("option_type") == "call", C("option_type") == "put", C("open_interest")
    wall = lambda side: F.max_by(F.when(side, C("strike")), F.when(side, F.struct("open_interest", -C("strike"))))
    j = chain.join(spots, "underlying")

    def payout(shock):
        s = C("spot") * (1 + shock)
        return F.sum(F.greatest(F.lit(0.0), F.when(c, s - C("strike")).otherwise(C("strike") - s)) * oi)

    g = j.groupBy("underlying").agg(F.sum(F.when(c, oi).otherwise(0.0)).alias("call_oi"), F.sum(F.when(p, oi).otherwise(0.0)).alias("put_oi"), wall(c).alias("call_wall"), wall(p).alias("put_wall"),
                                    payout(-0.05).alias("payout_down"), payout(0.0).alias("payout_spot"), payout(0.05).alias("payout_up"), F.first("spot").alias("spot"))
    d = g.join(max_pain(chain), "underlying").withColumn("pcr", F.when(C("call_oi") > 0, C("put_oi") / C("call_oi")).otherwise(0.0))
    clip = lambda x, m: F.greatest(F.lit(-m), F.least(F.lit(m), x))
    base = F.when((C("call_oi") == 0) | (C("put_oi") == 0), 0.0).otherwise(clip((C("pcr") - 1) / 1.5, 1.0))
    d = d.withColumn("score", clip(base + clip((C("max_pain") / C("spot") - 1) * 2, 0.25), 1.0))
    return d.withColumn("label", F.when(C("score") > 0.15, "Bullish structure").when(C("score") < -0.15, "Bearish structure").otherwise("Balanced structure"))


def oi_heatmap(chain: DataFrame) -> DataFrame:
    """Strike grid with open interest and change per side, one pivot-style aggregate."""
    t = lambda k, x: F.sum(F.when(C("option_type") == k, x))
    oi, ch = C("open_interest"), C("open_interest") - C("previous_open_interest")
    g = chain.groupBy("underlying", "strike").agg(F.coalesce(t("call", oi), F.lit(0.0)).alias("call_oi"), F.coalesce(t("put", oi), F.lit(0.0)).alias("put_oi"), t("call", ch).alias("call_change"), t("put", ch).alias("put_change"))
    return g.withColumn("net_oi", C("call_oi") - C("put_oi"))


def oi_movers(chain: DataFrame, k: int = 5) -> DataFrame:
    d = chain.groupBy("underlying", "strike", "option_type").agg(F.sum(C("open_interest") - C("previous_open_interest")).alias("change")).where("change <> 0")
    d = d.withColumn("kind", F.when(C("change") > 0, "buildup").otherwise("unwind"))
    w = Window.partitionBy("underlying", "kind").orderBy(F.desc(F.abs("change")), "strike", "option_type")
    return d.withColumn("rank", F.row_number().over(w)).where(C("rank") <= k)


# Distance limits of the pin score and of its search, in percent of spot.
TIGHT_PIN, LOOSE_PIN, PIN_BAND = 1.0, 3.0, 30.0


def oi_landmarks(chain: DataFrame, spots: DataFrame) -> DataFrame:
    """Per underlying: put-call ratio and its change, walls, support below and resistance above spot, and the risk of a pin.

    Support is the strike below spot with the most puts, resistance the one above with the fewest calls; on a tie the lower
    strike. A pin is scored by the nearer of max pain and the strike with most open interest, within a band around spot.
    """
    def side(kind, c):
        return F.sum(F.when(C("option_type") == kind, C(c)))

    oi, old = "open_interest", "previous_open_interest"
    g = chain.groupBy("underlying", "strike").agg(*[F.coalesce(side(k, oi), F.lit(0.0)).alias(f"{k}_oi") for k in ("call", "put")], *[side(k, old).alias(f"{k}_old") for k in ("call", "put")])
    d = g.join(spots, "underlying").withColumn("gap", F.abs(C("strike") - C("spot")))
    near = F.coalesce(C("gap") <= C("spot") * PIN_BAND / 100, F.lit(False))
    most = lambda cond, value: F.max_by(F.when(cond, C("strike")), F.when(cond, F.struct(value, -C("strike"))))
    every = F.lit(True)
    t = d.groupBy("underlying").agg(
        F.first("spot").alias("spot"), F.sum("call_oi").alias("call_oi"), F.sum("put_oi").alias("put_oi"), F.coalesce(F.sum("call_old"), F.lit(0.0)).alias("_call_old"), F.coalesce(F.sum("put_old"), F.lit(0.0)).alias("_put_old"),
        most(every, C("call_oi")).alias("call_wall"), most(every, C("put_oi")).alias("put_wall"), most(C("strike") < C("spot"), C("put_oi")).alias("support"), most(C("strike") > C("spot"), -C("call_oi")).alias("resistance"),
        most(near, C("call_oi") + C("put_oi")).alias("max_oi_strike"), most(near, -C("gap")).alias("nearest_strike"))
    pain = max_pain(chain.join(spots, "underlying").where(F.abs(C("strike") - C("spot")) <= C("spot") * PIN_BAND / 100)).select("underlying", C("max_pain").alias("pin_max_pain"))
    away = lambda c: F.abs(C(c) - C("spot")) / C("spot") * 100
    t = t.join(pain, "underlying", "left").withColumn("pcr", F.when(C("call_oi") > 0, C("put_oi") / C("call_oi"))).withColumn("pin_distance_pct", F.least(away("pin_max_pain"), away("max_oi_strike")))
    change = F.when((C("_call_old") > 0) & (C("_put_old") > 0), C("pcr") - C("_put_old") / C("_call_old"))
    level = F.when(C("pin_distance_pct") <= TIGHT_PIN, "high").when(C("pin_distance_pct") <= LOOSE_PIN, "moderate").when(C("pin_distance_pct").isNotNull(), "low")
    return t.withColumn("pcr_change", change).withColumn("pin_level", level).drop("_call_old", "_put_old")


def oi_expiry_matrix(chain: DataFrame) -> DataFrame:
    """(underlying, strike, expiry): open interest and change per side for chains of more than one expiry, with the number of their expiries.

    Long form: one row for each cell of the strike x expiry matrix, whatever the number of expiries.
    """
    kind = lambda k, c: F.sum(F.when(C("option_type") == k, c))
    change = C("open_interest") - C("previous_open_interest")
    cells = chain.where("expiry is not null").groupBy("underlying", "strike", "expiry").agg(
        *[kind(k, C("open_interest")).alias(f"{k}_oi") for k in ("call", "put")], *[kind(k, change).alias(f"{k}_change") for k in ("call", "put")])
    many = cells.groupBy("underlying").agg(F.count_distinct("expiry").alias("expiries")).where("expiries > 1")
    return cells.join(many, "underlying")


def atm_iv(rows: DataFrame) -> DataFrame:
    """rows(underlying, spot, strike, ce_iv, pe_iv): mean usable IV at the strike nearest spot within 5%."""
    ok = lambda c: F.when(C(c).between(IV_MIN, IV_MAX), C(c))
    d = rows.withColumn("c", ok("ce_iv")).withColumn("p", ok("pe_iv")).where((F.abs(C("strike") - C("spot")) / C("spot") <= ATM_FRACTION) & (C("c").isNotNull() | C("p").isNotNull()))
    d = d.withColumn("iv", (F.coalesce("c", "p") + F.coalesce("p", "c")) / 2).withColumn("sides", C("c").isNotNull().cast("int") + C("p").isNotNull().cast("int"))
    return d.groupBy("underlying").agg(F.min_by(F.struct("strike", "iv", "sides"), F.struct(F.abs(C("strike") - C("spot")), "strike")).alias("r")).select("underlying", "r.*")


# The model range is tighter below this share of the one-sigma band, wider above this share of the two-sigma band.
NARROW, WIDE = 0.80, 1.00


def scenario_half_width(reference: Column, days: Column, realized: Column, implied: Column) -> Column:
    """Half width of the expiry-bounded scenario interval: the mean of realised and implied volatility over 1 to 365 days."""
    horizon = F.least(F.greatest(days, F.lit(1)), F.lit(365))
    return reference * (realized + F.coalesce(implied, realized)) / 2 * F.sqrt(horizon / 365.0)


def expected_move(rows: DataFrame) -> DataFrame:
    """rows(underlying, spot, iv, days, model_width_pct, realized): 1 and 2 sigma bands, how the model range compares with them, and the scenario interval to expiry."""
    one = C("spot") * C("iv") * F.sqrt(C("days") / 252.0)
    d = rows.withColumn("sigma", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("move", one * C("sigma"))
    width, half = C("model_width_pct") / 100 * C("spot"), scenario_half_width(C("spot"), C("days"), C("realized"), C("iv"))
    flag = F.when(width < NARROW * 2 * one, "model_tighter_than_implied").when(width > WIDE * 4 * one, "model_wider_than_implied").otherwise("aligned")
    return d.select("underlying", "sigma", "move", (C("spot") - C("move")).alias("low"), (C("spot") + C("move")).alias("high"), flag.alias("flag"), F.greatest(F.lit(0.01), C("spot") - half).alias("scenario_low"), (C("spot") + half).alias("scenario_high"))


def chain_reprice(rows: DataFrame) -> DataFrame:
    """rows(spot, strike, days, vol, option_type): theoretical price and greeks."""
    return with_greeks(rows, C("spot"), C("strike"), C("days"), C("vol"), C("option_type") == CALL, names=("price", "delta", "gamma", "theta", "vega", "rho"))


def chain_implied_vol(rows: DataFrame, steps: int = 60) -> DataFrame:
    """Bisection in [1e-4, 5] for every quoted row as a higher-order fold."""
    call = C("option_type") == CALL
    val = lambda v: price(C("spot"), C("strike"), C("days"), v, call)
    start = F.struct(F.lit(0.0001).alias("lo"), F.lit(5.0).alias("hi"))

    def step(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        low = val(mid) < C("premium")
        return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

    inside = (C("premium") > 0) & (C("premium") >= val(F.lit(0.0001)) - 1e-6) & (C("premium") <= val(F.lit(5.0)) + 1e-6)
    s = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    d = rows.withColumn("_s", F.when(inside, s))
    return d.withColumn("implied_vol", (C("_s.lo") + C("_s.hi")) / 2).drop("_s")


def scenario_reprice(rows: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Each row under the (small, fixed-size) scenario list."""
    call = C("option_type") == CALL
    base = with_greeks(rows, C("spot"), C("strike"), C("days"), C("vol"), call).withColumnRenamed("price", "_base")
    d = base.crossJoin(F.broadcast(scenarios))
    d = with_greeks(d, C("spot") * (1 + C("spot_shock")), C("strike"), F.greatest(F.lit(1), C("days") - C("days_passed")), F.greatest(F.lit(1e-4), C("vol") + C("vol_shock")), call, rate=F.lit(RATE) + C("rate_shock"))
    return d.withColumnRenamed("price", "scenario_price").withColumn("change", C("scenario_price") - C("_base")).drop("_base")


def atm_straddle_move(quotes: DataFrame, origin: Column, max_age_minutes: int = 15) -> DataFrame:
    """quotes(underlying, ts, expiry, strike, option_type, premium, spot): (call + put) / spot / sqrt(days) at the nearest strike."""
    q = quotes.where((C("ts") <= origin) & (C("ts") >= origin - F.expr(f"INTERVAL {max_age_minutes} MINUTES")) & (C("expiry") > F.to_date(origin)))
    near = q.groupBy("underlying").agg(F.min("expiry").alias("expiry"))
    last = q.join(near, ["underlying", "expiry"]).groupBy("underlying", "expiry", "strike", "option_type").agg(F.max_by(F.struct("premium", "spot"), "ts").alias("r"))
    s = last.groupBy("underlying", "expiry", "strike").agg(F.max(F.when(C("option_type") == "call", C("r.premium"))).alias("c"), F.max(F.when(C("option_type") == "put", C("r.premium"))).alias("p"), F.max("r.spot").alias("spot")).where("c is not null and p is not null")
    a = s.groupBy("underlying", "expiry").agg(F.min_by(F.struct("strike", "c", "p", "spot"), F.struct(F.abs(C("strike") - C("spot")), "strike")).alias("r"))
    days = F.datediff("expiry", F.to_date(origin))
    return a.select("underlying", "expiry", "r.strike", ((C("r.c") + C("r.p")) / C("r.spot") / F.sqrt(days.cast("double"))).alias("implied_move"))


def iv_rank(history: DataFrame, lookback_days: int, min_samples: int = 5) -> DataFrame:
    """history(underlying, ts, iv): rank in range and percentile (ties half) of the newest value; joins one row per key back."""
    last = history.groupBy("underlying").agg(F.max_by("iv", F.struct("ts", "event_id")).alias("cur"), F.max("ts").alias("mx"))
    d = history.join(last, "underlying").where(C("ts") >= C("mx") - F.expr(f"INTERVAL {lookback_days} DAYS"))
    g = d.groupBy("underlying").agg(F.count("*").alias("samples"), F.first("cur").alias("current"), F.min("iv").alias("lo"), F.max("iv").alias("hi"), F.avg("iv").alias("mean"), F.count_if(C("iv") < C("cur")).alias("below"), F.count_if(C("iv") == C("cur")).alias("ties"))
    return g.where(C("samples") >= min_samples).select("underlying", "samples", "current", "lo", "hi", "mean", F.when(C("hi") > C("lo"), (C("current") - C("lo")) / (C("hi") - C("lo"))).alias("iv_rank"), ((C("below") + 0.5 * C("ties")) / C("samples")).alias("iv_percentile"))


def iv_dedupe(history: DataFrame, key: str = "underlying") -> DataFrame:
    """Keep an observation only when none was kept in the 30 minutes before it (greedy), values in range."""
    d = chunks.greedy_anchors(history.where(C("iv").between(IV_MIN, IV_MAX)), [key], "ts", IV_DEDUPE_SECONDS)
    return d.where("is_anchor").drop("anchor", "is_anchor")


def oi_classification(price_pct: Column, oi_pct: Column, band: float = 0.25) -> Column:
    return (F.when((F.abs(price_pct) < band) | (F.abs(oi_pct) < band), "neutral").when((price_pct > 0) & (oi_pct > 0), "long_buildup").when((price_pct < 0) & (oi_pct > 0), "short_buildup")
            .when((price_pct > 0) & (oi_pct < 0), "short_covering").otherwise("long_unwinding"))


def fair_value(spot: Column, days: Column, rate=RATE, div=0.0) -> Column:
    return spot * F.exp((rate - div) * days / 365.0)


def futures_analysis(rows: DataFrame, shocks: tuple[float, ...] = (-0.05, 0.0, 0.05)) -> DataFrame:
    """rows(underlying, spot, days, futures_price, open_interest, previous_open_interest, previous_price)."""
    f, s, t = C("futures_price"), C("spot"), C("days")
    d = rows.select("*", (f - s).alias("basis"), (ratio(f - s, s) * 100).alias("basis_pct"), (ratio(f - s, s) * 365 / t * 100).alias("annualised_basis_pct"), fair_value(s, t).alias("fair_value"),
                    (f - fair_value(s, t)).alias("mispricing"), (ratio(f - C("previous_price"), "previous_price") * 100).alias("price_pct"), (ratio(C("open_interest") - C("previous_open_interest"), "previous_open_interest") * 100).alias("oi_pct"))
    d = d.withColumn("positioning", oi_classification(C("price_pct"), C("oi_pct")))
    return d.withColumn("shock", F.explode(F.array(*[F.lit(x) for x in shocks]))).withColumn("shocked_fair_value", fair_value(s * (1 + C("shock")), t))


def term_structure(futures: DataFrame, spots: DataFrame) -> DataFrame:
    """Basis, open-interest share, adjacent roll cost and curve state per underlying; one row per listed expiry."""
    sp = Span(("underlying",), ("days_to_expiry",))
    d = futures.join(spots, "underlying").withColumn("oi_share", C("open_interest") / F.sum("open_interest").over(sp.whole))
    d = d.select("*", (C("futures_price") - C("spot")).alias("basis"), fair_value(C("spot"), C("days_to_expiry")).alias("fair_value"), sp.lead("futures_price").alias("_n"), sp.lead("days_to_expiry").alias("_nd"))
    d = d.withColumn("roll_cost", C("_n") - C("futures_price")).withColumn("roll_yield_pct", ratio("roll_cost", "futures_price") * 365 / (C("_nd") - C("days_to_expiry")) * 100)
    st = F.when(C("roll_cost") > 0, "contango").when(C("roll_cost") < 0, "backwardation").when(C("roll_cost") == 0, "flat")
    d = d.withColumn("_s", F.collect_set(st).over(sp.whole))
    return d.withColumn("curve", F.when(F.size("_s") == 1, C("_s")[0]).otherwise("mixed")).drop("_s", "_n", "_nd")


# ---- books ---------------------------------------------------------------------------

def signed() -> Column:
    return F.when(C("side") == "buy", 1.0).otherwise(-1.0) * C("contracts")


def sweep(points: DataFrame, base: DataFrame) -> DataFrame:
    """Add `value` at each point of a piecewise-linear curve per book.

    points(book_id, x, bend) may repeat an x; bend is the change of slope there. base(book_id, at_zero, slope) is the value
    and slope at a price of zero. One pass along the sorted points: a point costs the same however many legs there are.
    """
    p = points.groupBy("book_id", "x").agg(F.sum("bend").alias("bend"))  # legs of one strike are one point
    along = Window.partitionBy("book_id").orderBy("x").rowsBetween(UP, 0)
    d = p.join(base, "book_id").select("*", F.sum("bend").over(along).alias("_d"), F.sum(C("bend") * C("x")).over(along).alias("_k"))
    return d.withColumn("value", C("at_zero") + C("slope") * C("x") + C("_d") * C("x") - C("_k")).drop("_d", "_k")


def crossings() -> Column:
    """Price at which the straight line from this point to the next is zero, if it is."""
    along = Window.partitionBy("book_id").orderBy("x")
    n, nx = F.lead("value").over(along), F.lead("x").over(along)
    return F.when(C("value") == 0, C("x")).when(C("value") * n < 0, C("x") - C("value") * (nx - C("x")) / (n - C("value")))


def payoff_grid(legs: DataFrame, span_pct: float = 0.5) -> DataFrame:
    """Expiry payoff of every book: extremes, break-evens and tail slopes, all exact.

    The curve bends at strikes only, so it is swept along them; no grid. Extremes are those of all prices from zero on, null
    where the upper tail makes them unbounded; break-evens are those within `span_pct` of the mean strike.
    """
    opt, q = C("type").isin("call", "put"), signed()
    at_zero = F.when(C("type") == "call", -C("premium")).when(C("type") == "put", C("strike") - C("premium")).otherwise(-C("strike"))
    base = legs.groupBy("book_id").agg(F.sum(q * at_zero).alias("at_zero"), F.sum(F.when(C("type") == "put", -q).when(C("type") == "call", 0.0).otherwise(q)).alias("slope"),
                                       F.sum(F.when(C("type") == "put", 0.0).otherwise(q)).alias("up_slope"), F.avg("strike").alias("centre"))
    lo, hi = C("centre") * (1 - span_pct), C("centre") * (1 + span_pct)
    ends = base.select("book_id", F.explode(F.array(F.lit(0.0), lo, hi)).alias("x"), F.lit(0.0).alias("bend"))
    kinks = legs.where(opt).select("book_id", C("strike").alias("x"), q.alias("bend"))
    d = sweep(kinks.unionByName(ends), base).withColumn("be", crossings())
    inside = C("be").between(lo, hi)
    g = d.groupBy("book_id").agg(F.first("up_slope").alias("up_slope"), F.first("slope").alias("down_slope"), F.max("value").alias("best"), F.min("value").alias("worst"),
                                 F.count(F.when(inside, C("be"))).alias("breakevens"), F.min(F.when(inside, C("be"))).alias("first_breakeven"), F.max(F.when(inside, C("be"))).alias("last_breakeven"))
    return g.withColumn("max_profit", F.when(C("up_slope") <= 1e-9, C("best"))).withColumn("max_loss", F.when(C("up_slope") >= -1e-9, C("worst"))).drop("best", "worst")


def lists(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists, NaN as null."""
    n, width = values.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, pa.array(values.ravel(), mask=np.isnan(values).ravel()))


def columns_of(*arrays: pa.Array) -> list[np.ndarray]:
    """Arrays as columns of doubles that spread over the points of a matrix."""
    return [a.cast(pa.float64()).to_numpy(zero_copy_only=False)[:, None] for a in arrays]


def calendar_spread_grid(legs: DataFrame, near_days: int, far_days: int, vol: float, points: int = 41, span_pct: float = 0.2) -> DataFrame:
    """Near legs at intrinsic, far legs at model value over a grid around the mean strike, for every calendar book.

    Legs of one strike and type become one before they meet the grid. A leg's values at all points are one list and a
    book's are one row, so points never travel.
    """
    q, call, near = signed(), C("type") == "call", C("leg") == "near"
    step = lambda i: 1 - span_pct + 2 * span_pct * i / (points - 1)

    @F.arrow_udf("array<double>")
    def over_grid(centre: pa.Array, strike: pa.Array, q: pa.Array, near: pa.Array, call: pa.Array) -> pa.Array:
        c, k, q, near, call = columns_of(centre, strike, q, near, call)
        x, call, floor = c * step(np.arange(points)), call == 1, np.nan_to_num(k)
        intrinsic = np.maximum(0.0, np.where(call, x - floor, floor - x))
        return lists(q * np.where(near == 1, intrinsic, np.where(near == 0, price_array(x, k, far_days - near_days, vol, call), np.nan)))

    base = legs.groupBy("book_id").agg(F.sum(q * C("premium")).alias("paid"), F.avg("strike").alias("centre"), F.count_if(~near).alias("far"))
    one = legs.groupBy("book_id", near.alias("near"), call.alias("call"), "strike").agg(F.sum(q).alias("q"))
    d = one.join(base.where("centre is not null or far > 0"), "book_id")
    d = d.select("book_id", "centre", "paid", over_grid("centre", "strike", "q", "near", "call").alias("v"))
    v = [F.coalesce(F.sum(C("v")[i]), F.lit(0.0)) - F.first("paid") for i in range(points)]
    g = d.groupBy("book_id").agg(F.first("centre").alias("centre"), F.array(*v).alias("v"))
    at = lambda i: C("centre") * step(i)
    d = g.select("book_id", "centre", F.posexplode(F.arrays_zip("v", F.slice("v", 2, points - 1).alias("n")))).select("book_id", "col.*", at(C("pos")).alias("x"), at(C("pos") + 1).alias("nx"))
    cross = F.when(C("v") == 0, C("x")).when(C("v") * C("n") < 0, C("x") - C("v") * (C("nx") - C("x")) / (C("n") - C("v")))
    d = d.withColumn("be", F.when(C("n").isNotNull(), cross))
    return d.groupBy("book_id").agg(F.max("v").alias("max_profit"), F.min("v").alias("max_loss"), F.count("be").alias("breakevens"), F.min("be").alias("first_breakeven"), F.max("be").alias("last_breakeven"))


def strategy_legs(spots: DataFrame, template: DataFrame, step: float, days: int, vol: float) -> DataFrame:
    """Template legs (a small list) for every underlying with rounded strikes and model premiums."""
    d = spots.crossJoin(F.broadcast(template)).withColumn("strike", F.greatest(F.lit(step), F.floor(C("spot") * (1 + C("offset_pct") / 100) / step + 0.5) * step))
    return d.withColumn("premium", price(C("spot"), C("strike"), F.lit(days), F.lit(vol), C("type") == CALL))


def scenario_margin(legs: DataFrame, spots: DataFrame, vol: float, days: int) -> DataFrame:
    """Worst loss of every book over the spot x vol scan, floored by short premium.

    A leg's values in all scenarios are one list and a book's are one row, so scenarios never travel.
    """
    scan = [(s, v) for s in SPOT_SHOCKS for v in VOL_SHOCKS]
    opt = C("type").isin("call", "put")

    @F.arrow_udf("array<double>")
    def over_scan(spot: pa.Array, strike: pa.Array, q: pa.Array, paid: pa.Array, option: pa.Array, call: pa.Array) -> pa.Array:
        spot, k, q, paid, option, call = columns_of(spot, strike, q, paid, option, call)
        shock, vrel = np.array(scan).T
        s, vols = spot * (1 + shock / 100), np.maximum(1e-4, vol * (1 + vrel))
        return lists(q * np.where(option == 1, price_array(s, k, days, vols, call == 1), s) - paid)

    # Legs of one strike and type are one before they meet the scenarios; futures do not depend on their strike.
    one = legs.where("type is not null").groupBy("book_id", opt.alias("option"), (C("type") == CALL).alias("call"), F.when(opt, C("strike")).otherwise(0.0).alias("strike")).agg(
        F.sum(signed()).alias("q"), F.sum(signed() * C("premium")).alias("paid"), F.sum(F.when((C("side") == "sell") & opt, C("premium") * C("contracts")).otherwise(0.0)).alias("short"))
    d = one.join(spots, "book_id").select("book_id", "short", over_scan("spot", "strike", "q", "paid", "option", "call").alias("v"))
    v = [F.sum(C("v")[i]) for i in range(len(scan))]
    g = d.groupBy("book_id").agg(v[scan.index((0.0, 0.0))].alias("base_value"), F.least(*v).alias("worst"), F.sum("short").alias("short_premium"))
    return g.withColumn("total_margin", F.greatest(C("base_value") - C("worst"), C("short_premium"), F.lit(0.0)))


def bracket_trigger_scan(orders: DataFrame, bars: DataFrame, band: float, horizon_days: int) -> DataFrame:
    """First bar after the order that crosses its level inside the circuit band.

    The time range is met through month buckets: an order lists the few months it can live in,
    so the join is an equi-join on (symbol, month).
    """
    o = orders.withColumn("_end", F.date_add("ts", horizon_days)).withColumn("_m", F.explode(F.sequence(F.trunc("ts", "month"), F.trunc("_end", "month"), F.expr("INTERVAL 1 MONTH"))))
    b = bars.select("symbol", F.trunc("ts", "month").alias("_m"), C("ts").alias("bar_ts"), "high", "low")
    hit = F.when((C("side") == "BUY") == (C("kind") == "limit"), C("low") <= C("level")).otherwise(C("high") >= C("level"))
    inside = C("level").between(C("price") * (1 - band), C("price") * (1 + band))
    j = o.join(b, ["symbol", "_m"]).where((C("bar_ts") > C("ts")) & (C("bar_ts") <= C("_end")) & hit & inside)
    return j.groupBy("order_id").agg(F.min("bar_ts").alias("triggered_at"))
