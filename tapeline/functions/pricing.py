"""Option value and sensitivities as column expressions, with the same formulas as SQL text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mathx import norm_cdf, norm_cdf_array, norm_cdf_sql, norm_pdf

RATE = 0.065


def greeks(spot: Column, strike: Column, days: Column, vol: Column, call: Column, rate=RATE, div=0.0) -> dict[str, Column]:
    """Price, delta, gamma, theta per day, vega and rho per point (European, continuous yield)."""
    r, q = F.lit(rate) if not isinstance(rate, Column) else rate, F.lit(div)
    t = days.cast("double") / 365.0
    rt = F.sqrt(t)
    d1 = (F.log(spot / strike) + (r - q + 0.5 * vol * vol) * t) / (vol * rt)
    d2 = d1 - vol * rt
    s = F.when(call, 1.0).otherwise(-1.0)
    dr, dq = F.exp(-r * t), F.exp(-q * t)
    n1, n2, pdf = norm_cdf(s * d1), norm_cdf(s * d2), norm_pdf(d1)
    return {
        "price": s * (spot * dq * n1 - strike * dr * n2), "delta": s * dq * n1, "gamma": dq * pdf / (spot * vol * rt),
        "theta": (-(spot * dq * pdf * vol) / (2 * rt) - s * (r * strike * dr * n2 - q * spot * dq * n1)) / 365.0,
        "vega": spot * dq * pdf * rt / 100.0, "rho": s * strike * t * dr * n2 / 100.0}


def price(*args, **kw) -> Column:
    return greeks(*args, **kw)["price"]


def with_greeks(df: DataFrame, spot: Column, strike: Column, days: Column, vol: Column, call: Column, rate=RATE, names=("price",)) -> DataFrame:
    """Add greeks in stages, so each intermediate (d1, the two CDF values) is computed once per row.

    One nested expression would repeat d1 some dozens of times and outgrow generated code.
    """
    keep = df.columns
    c = F.col
    r = rate if isinstance(rate, Column) else F.lit(rate)
    d = df.select("*", spot.alias("_gs"), strike.alias("_gk"), (days.cast("double") / 365.0).alias("_gt"), vol.alias("_gv"), F.when(call, 1.0).otherwise(-1.0).alias("_gg"), r.alias("_gr"))
    d = d.select("*", ((F.log(c("_gs") / c("_gk")) + (c("_gr") + 0.5 * c("_gv") * c("_gv")) * c("_gt")) / (c("_gv") * F.sqrt("_gt"))).alias("_gd"))
    d = d.select("*", (c("_gg") * c("_gd")).alias("_ga"), (c("_gg") * (c("_gd") - c("_gv") * F.sqrt("_gt"))).alias("_gb"))
    d = d.select("*", norm_cdf(c("_ga")).alias("_n1"), norm_cdf(c("_gb")).alias("_n2"), norm_pdf(c("_gd")).alias("_np"), F.exp(-c("_gr") * c("_gt")).alias("_df"))
    g, rt = c("_gg"), F.sqrt("_gt")
    out = {"price": g * (c("_gs") * c("_n1") - c("_gk") * c("_df") * c("_n2")), "delta": g * c("_n1"), "gamma": c("_np") / (c("_gs") * c("_gv") * rt),
           "theta": (-(c("_gs") * c("_np") * c("_gv")) / (2 * rt) - g * c("_gr") * c("_gk") * c("_df") * c("_n2")) / 365.0,
           "vega": c("_gs") * c("_np") * rt / 100.0, "rho": g * c("_gk") * c("_gt") * c("_df") * c("_n2") / 100.0}
    return d.select(*keep, *[out[n].alias(n) for n in names])


def price_array(spot, strike, days: float, vol, call, rate: float = RATE) -> np.ndarray:
    """The same price for numpy arrays inside tasks; NaN where it has none."""
    t = days / 365.0
    rt = np.sqrt(t)
    with np.errstate(all="ignore"):
        d1 = (np.log(spot / strike) + (rate + 0.5 * vol * vol) * t) / (vol * rt)
        s = np.where(call, 1.0, -1.0)
        return s * (spot * norm_cdf_array(s * d1) - strike * np.exp(-rate * t) * norm_cdf_array(s * (d1 - vol * rt)))


def greeks_sql(spot: str, strike: str, days: str, vol: str, call: str, rate: str = repr(RATE)) -> dict[str, str]:
    t = f"({days}/365e0)"
    d1 = f"((ln({spot}/{strike})+({rate}+0.5e0*{vol}*{vol})*{t})/({vol}*sqrt({t})))"
    d2 = f"({d1}-{vol}*sqrt({t}))"
    s = f"(CASE WHEN {call} THEN 1e0 ELSE -1e0 END)"
    n1, n2 = norm_cdf_sql(f"({s}*{d1})"), norm_cdf_sql(f"({s}*{d2})")
    pdf = f"(exp(-{d1}*{d1}/2)/sqrt(2*pi()))"
    dr = f"exp(-{rate}*{t})"
    return {"price": f"({s}*({spot}*{n1}-{strike}*{dr}*{n2}))", "delta": f"({s}*{n1})", "gamma": f"({pdf}/({spot}*{vol}*sqrt({t})))",
            "theta": f"((-({spot}*{pdf}*{vol})/(2*sqrt({t}))-{s}*{rate}*{strike}*{dr}*{n2})/365)", "vega": f"({spot}*{pdf}*sqrt({t})/100)",
            "rho": f"({s}*{strike}*{t}*{dr}*{n2}/100)"}
