"""Forecast evaluation: conformal calibration, scores, gates, folds and the pooled linear model."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathx import norm_cdf, norm_pdf
from ..functions.orderstat import OrderTree
from ..functions.ranks import conformal_rank, conformal_width, ecdf, percentiles
from ..functions.span import BARS as S
from ..functions.span import UP, ratio
from ..session import cut
from .ledger import winkler, with_earlier
from .replay import origins, replay_records, replay_summary

C = F.col

# Drift look-back, minimum sessions and scored points, coverage tolerance, online step.
DRIFT_WINDOW, MIN_SESSIONS, MIN_SCORED, COVERAGE_TOL, ONLINE_STEP = 20, 180, 40, 0.05, 0.1
# Price-band limits, tick and minimum widths.
CIRCUIT = {"default": 0.20, "derivative": 0.10, "surveillance": 0.05}
TICK = 0.05


def with_baselines(bars: DataFrame, horizon: int = 1) -> DataFrame:
    """Persistence and damped-drift forecasts made at each bar for `horizon` bars ahead."""
    d = bars.select("symbol", "ts", "close", (F.log("close") - F.log(S.lag("close"))).alias("_lr"))
    med = F.percentile("_lr", F.lit(0.5)).over(S.trailing(DRIFT_WINDOW))
    n = F.count("_lr").over(S.trailing(DRIFT_WINDOW))
    return d.select("symbol", "ts", "close", C("close").alias("persistence"), F.when(n >= 2, C("close") * F.exp(med * 0.5 * horizon)).otherwise(C("close")).alias("damped_drift"))


def walk_forward_residuals(bars: DataFrame, horizon: int) -> DataFrame:
    """Each origin uses only earlier rows; the scored close lies h bars after the last known one."""
    d = with_baselines(bars, horizon).select("*", S.rn().alias("rn"), S.lead("close", horizon).alias("actual"))
    d = d.where((C("rn") >= DRIFT_WINDOW + 5) & C("actual").isNotNull())
    return d.select("symbol", "ts", "actual", "persistence", "damped_drift", (C("actual") - C("damped_drift")).alias("residual"), (C("actual") - C("persistence")).alias("base_residual"),
                    (F.log("actual") - F.log("damped_drift")).alias("log_residual"), (F.log("actual") - F.log("persistence")).alias("base_log_residual"))


def measured_coverage(residuals: DataFrame, widths: DataFrame, keys: list[str], value: str) -> DataFrame:
    return residuals.join(widths.select(*keys, "half_width"), keys).groupBy(*keys).agg(F.avg((F.abs(value) <= C("half_width") + 1e-12).cast("double")).alias("coverage"), F.count("*").alias("scored"))


def calibrate_symbol(bars: DataFrame, horizon: int, confidence: float, model: str = "damped_drift", newest: int | None = None) -> DataFrame:
    """60/40 split conformal calibration per symbol with the evidence state; `newest` calibrates on that many residuals only."""
    base = model == "persistence"
    lr, rs = ("base_log_residual", "base_residual") if base else ("log_residual", "residual")
    r = walk_forward_residuals(bars, horizon).select("symbol", "ts", C(lr).alias("lr"), C(rs).alias("rs"), C("base_residual").alias("br"))
    r = r.select("*", S.rn().alias("k"), S.size().alias("m"))
    split = F.greatest(F.floor(C("m") * 0.6), F.lit(1))
    split = F.when(C("m") - split < 5, F.greatest(C("m") - 5, F.lit(1))).otherwise(split)
    r = cut(r.withColumn("split", split))
    cal = r.where(C("k") <= C("split"))
    if newest is not None:
        cal = cal.where(C("k") > C("split") - newest)
    w = conformal_width(cal, ["symbol"], "lr", confidence)
    cov = measured_coverage(r.where(C("k") > C("split")), w, ["symbol"], "lr")
    err = r.groupBy("symbol").agg(F.avg(F.abs("rs")).alias("mae"), F.sqrt(F.avg(C("rs") * C("rs"))).alias("rmse"), F.avg(F.abs("br")).alias("baseline_mae"))
    last = bars.groupBy("symbol").agg(F.count("*").alias("sessions"), F.max_by("close", "ts").alias("last_close")).where(C("sessions") >= MIN_SESSIONS)
    d = last.join(err, "symbol").join(w.select("symbol", "half_width"), "symbol").join(cov, "symbol")
    d = d.withColumn("skill", F.when(C("baseline_mae") > 0, (C("baseline_mae") - C("mae")) / C("baseline_mae")).otherwise(0.0)).withColumn("proportion", F.expm1("half_width"))
    state = (F.when(C("scored") < MIN_SCORED, "low_evidence").when(C("coverage") + COVERAGE_TOL < confidence, "abstained").when(C("skill") <= 0, "baseline_only").otherwise("model_supported"))
    tier = F.when(C("state").isin("low_evidence", "baseline_only"), "C").when(C("state") == "abstained", "none").when((C("skill") >= 0.05) & (C("scored") >= 4 * MIN_SCORED), "A").otherwise("B")
    return d.withColumn("state", state).withColumn("tier", tier)


def calibrated_range(bars: DataFrame, horizon: int, confidence: float) -> DataFrame:
    """Published range: refused, random-walk fallback, or the model's."""
    m = calibrate_symbol(bars, horizon, confidence)
    b = calibrate_symbol(bars, horizon, confidence, "persistence").select("symbol", C("proportion").alias("bp"))
    now = with_baselines(bars, horizon).groupBy("symbol").agg(F.max_by("damped_drift", "ts").alias("dd"))
    d = m.join(b, "symbol").join(now, "symbol")
    base = C("state") == "baseline_only"
    centre, p = F.when(base, C("last_close")).otherwise(C("dd")), F.when(base, C("bp")).otherwise(C("proportion"))
    refused = C("state") == "abstained"
    return d.select("symbol", "state", refused.alias("refused"), F.when(~refused, centre / (1 + p)).alias("low"), F.when(~refused, centre * (1 + p)).alias("high"))


def calibration_report(calibrated: DataFrame, universe: DataFrame) -> DataFrame:
    j = universe.select("symbol").join(calibrated, "symbol", "left")
    return j.groupBy(F.coalesce("state", F.lit("skipped")).alias("state")).agg(F.count("*").alias("symbols"), F.avg("coverage").alias("mean_coverage"), F.avg("skill").alias("mean_skill"))


def cqr_offsets(rows: DataFrame, keys: list[str], confidence: float) -> DataFrame:
    s = rows.select(*keys, F.greatest(C("forecast_low") - C("actual_price"), C("actual_price") - C("forecast_high"), F.lit(0.0)).alias("s"))
    return conformal_width(s, keys, "s", confidence).select(*keys, "n", C("half_width").alias("offset"))


ONLINE_STATE = "symbol string, gamma double, hits long, steps long, half_width double, seen array<double>"


def adaptive_state(residuals: DataFrame, confidence: float, state: DataFrame | None = None) -> DataFrame:
    """Online level per symbol: the width at each step is an order statistic of all residuals so far.

    Path dependent, so each symbol's bar-bounded residuals go through one grouped task; a step costs the logarithm of the
    number of residuals. The result is the state after the last step: stored and given back with later residuals, it goes
    on as if it had seen the whole series.
    """
    import numpy as np

    def fold(key, new, old):
        gamma, hit, steps, width, seen = 0.0, 0, 0, 0.0, np.zeros(0)
        if len(old):
            r = old.iloc[0]
            gamma, hit, steps, width, seen = float(r["gamma"]), int(r["hits"]), int(r["steps"]), float(r["half_width"]), np.asarray(r["seen"], float)
        a = new.sort_values("ts")["residual"].abs().to_numpy()
        tree = OrderTree(np.concatenate([seen, a]))
        tree.fill(seen)
        for r, place in zip(a.tolist(), tree.places(a), strict=True):
            tree.insert(place)
            level = min(0.99, max(0.5, confidence - gamma))
            rank = math.ceil((tree.size + 1) * level)
            width = tree.select(min(max(rank, 1), tree.size))
            ok = r <= width
            hit += ok
            steps += 1
            gamma += ONLINE_STEP * (float(ok) - confidence)
        return pd.DataFrame([(key[0], gamma, hit, steps, width, np.sort(np.concatenate([seen, a])))], columns=["symbol", "gamma", "hits", "steps", "half_width", "seen"])

    rows = residuals.select("symbol", "ts", "residual")
    old = rows.sparkSession.createDataFrame([], ONLINE_STATE) if state is None else state
    return rows.groupBy("symbol").cogroup(old.groupBy("symbol")).applyInPandas(fold, ONLINE_STATE)


def adaptive_conformal(residuals: DataFrame, confidence: float, state: DataFrame | None = None) -> DataFrame:
    """(symbol, half_width, gamma, coverage, steps) after the last residual."""
    return adaptive_state(residuals, confidence, state).select("symbol", "half_width", "gamma", (C("hits") / C("steps")).alias("coverage"), "steps")


def mondrian_conformal(rows: DataFrame, group: str, value: str, confidence: float, min_group: int) -> DataFrame:
    """Half width per group, the global one where a group is small; coverage measured with the width used."""
    g = conformal_width(rows, [group], value, confidence).select(group, "n", C("half_width").alias("gw"))
    a = conformal_width(rows.withColumn("_all", F.lit(0)), ["_all"], value, confidence).select(C("half_width").alias("aw"))
    w = g.crossJoin(F.broadcast(a)).select(group, "n", F.when(C("n") >= min_group, C("gw")).otherwise(C("aw")).alias("half_width"), (C("n") < min_group).alias("fallback"))
    return w.join(measured_coverage(rows, w, [group], value).select(group, "coverage"), group)


def circuit_clip(rows: DataFrame) -> DataFrame:
    """Clip to the price band, then restore a minimum width."""
    limit = F.when(C("surveillance"), CIRCUIT["surveillance"]).when(C("is_derivative"), CIRCUIT["derivative"]).otherwise(CIRCUIT["default"])
    d = rows.withColumn("cl", F.greatest(F.lit(TICK), C("price") * (1 - limit))).withColumn("ch", C("price") * (1 + limit))
    d = d.withColumn("a", F.greatest("low", "cl")).withColumn("b", F.least("high", "ch")).withColumn("mw", F.greatest(F.lit(TICK * 2), C("price") * 0.0005))
    thin = C("b") - C("a") < C("mw")
    mid = (C("a") + C("b")) / 2
    return d.withColumn("clipped_low", F.when(thin, F.greatest("cl", mid - C("mw") / 2)).otherwise(C("a"))).withColumn("clipped_high", F.when(thin, F.least("ch", mid + C("mw") / 2)).otherwise(C("b"))).drop("cl", "ch", "a", "b", "mw")


def weighted_quantile(rows: DataFrame, q: float) -> DataFrame:
    """rows(symbol, ts, value, scale, recent_scale): recency x similarity weighted quantile per symbol."""
    age = S.rn_desc() - 1
    sim = F.when((C("scale") > 0) & (C("recent_scale") > 0), F.exp(-F.abs(F.log(C("scale") / C("recent_scale"))))).otherwise(1.0)
    d = rows.select("symbol", "ts", "value", (F.pow(F.lit(0.98), age) * F.greatest(sim, F.lit(0.1))).alias("w"))
    order = Window.partitionBy("symbol").orderBy("value", "ts").rowsBetween(UP, 0)
    d = d.select("*", F.sum("w").over(order).alias("cum"), F.sum("w").over(S.whole).alias("tot"))
    return d.where(C("cum") >= q * C("tot") * (1 - 1e-12)).groupBy("symbol").agg(F.min("value").alias("quantile"))


def interval_width(conformal: Column, sigma: Column, z: float, floor: Column) -> Column:
    return F.greatest(conformal, z * sigma, floor)


def published_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    a, m, lo, hi = C("actual_price"), C("forecast_median"), C("forecast_low"), C("forecast_high")
    up, pu = F.signum(a - C("origin_price")), F.signum(m - C("origin_price"))
    hit_up, hit_dn = F.avg(F.when(up > 0, (pu > 0).cast("double"))), F.avg(F.when(up < 0, (pu < 0).cast("double")))
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(a.between(lo, hi).cast("double")).alias("coverage"), F.avg(winkler(a, lo, hi, C("confidence_level"))).alias("winkler"), F.avg(F.abs(a - m)).alias("mae"),
                                   F.sqrt(F.avg((a - m) * (a - m))).alias("rmse"), (F.avg(F.abs(a - m) / a) * 100).alias("mae_pct"),
                                   ((F.coalesce(hit_up, hit_dn) + F.coalesce(hit_dn, hit_up)) / 2).alias("balanced_direction"), F.avg(hi - lo).alias("mean_width"))
    return g.join(percentiles(rows.select(*keys, F.abs(a - m).alias("_e")), keys, "_e", {"median_ae": 0.5}), keys, "left")


def point_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Zero against zero counts as the right direction here."""
    a, p, o = C("actual_price"), C("forecast_median"), C("origin_price")
    e = p - a
    g = rows.groupBy(*keys).agg(F.sum(e * e).alias("sse"), (F.var_pop(a) * F.count("*")).alias("sst"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.avg(F.abs(e) / F.abs(a)) * 100).alias("mape"),
                                (F.avg((F.signum(a - o) == F.signum(p - o)).cast("double")) * 100).alias("direction_pct"), F.avg(e).alias("bias"))
    g = g.join(percentiles(rows.select(*keys, F.abs(e).alias("_e")), keys, "_e", {"median_ae": 0.5, "p80": 0.8, "p95": 0.95}), keys, "left")
    return g.withColumn("r2", 1 - ratio("sse", "sst"))


def pinball_loss(y: Column, q: Column, level: float) -> Column:
    e = y - q
    return F.greatest(level * e, (level - 1) * e)


def crps_gaussian(y: Column, mu: Column, sigma: Column) -> Column:
    z = (y - mu) / sigma
    return sigma * (z * (2 * norm_cdf(z) - 1) + 2 * norm_pdf(z) - 0.5641895835477563)


def crps_ensemble(y: Column, members: Column) -> Column:
    """Energy form through the sorted array, O(m log m)."""
    s = F.array_sort(members)
    m = F.size(s).cast("double")
    own = F.aggregate(s, F.lit(0.0), lambda a, v: a + F.abs(v - y)) / m
    spread = F.aggregate(F.transform(s, lambda v, i: v * (2.0 * i - m + 1)), F.lit(0.0), lambda a, v: a + v) / (m * m)
    return own - spread


def pit_ks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Kolmogorov distance of the clipped PIT to uniform; the p-value is the asymptotic series."""
    w = F.when(C("forecast_high") > C("forecast_low"), C("forecast_high") - C("forecast_low")).otherwise(1.0)
    d = rows.select(*keys, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (C("actual_price") - C("forecast_low")) / w)).alias("x"))
    e = ecdf(d, keys, "x")
    g = e.groupBy(*keys).agg(F.max("n").alias("n"), F.max(F.greatest((C("below") + C("c")) / C("n") - C("v"), C("v") - C("below") / C("n"))).alias("ks"))
    lam = C("ks") * F.sqrt(C("n").cast("double"))
    p = reduce(lambda a, b: a + b, [2 * (-1.0) ** (k - 1) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, 21)])
    return g.withColumn("p_value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def mase(rows: DataFrame, season: int) -> DataFrame:
    d = with_earlier(rows, ["symbol"], {"_e": season}).withColumn("_b", F.abs(C("actual_price") - C("_e")))
    g = d.groupBy("symbol").agg(F.avg(F.abs(C("actual_price") - C("forecast_median"))).alias("mae"), F.avg("_b").alias("base"))
    return g.select("symbol", F.when(C("base") > 0, C("mae") / C("base")).otherwise(float("inf")).alias("mase"))


def directional_accuracy(rows: DataFrame, keys: list[str]) -> DataFrame:
    a, p = F.signum(C("actual_price") - C("origin_price")), F.signum(C("forecast_median") - C("origin_price"))
    ok = (a != 0) & (p != 0)
    return rows.groupBy(*keys).agg(F.count_if(ok).alias("decidable"), F.avg(F.when(ok, (a == p).cast("double"))).alias("accuracy"))


def diebold_mariano(rows: DataFrame) -> DataFrame:
    """rows(symbol, ts, l1, l2): HAC statistic with Bartlett lags; autocovariances from lags of one ordered pass."""
    d = rows.select("symbol", "ts", (C("l1") - C("l2")).alias("d"))
    g = d.groupBy("symbol").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.var_pop("d").alias("g0"))
    g = g.withColumn("lags", F.least(F.floor(1.5 * F.pow(C("n").cast("double"), F.lit(1 / 3)) + 1e-12), C("n") - 1))
    x = d.join(g, "symbol").select("symbol", "ts", (C("d") - C("mean")).alias("e"), "n", "lags", S.rn().alias("i"))
    lagged = x.select("symbol", "e", "i", "n", "lags", F.explode(F.sequence(F.lit(1), C("lags"))).alias("lag"))
    other = x.select("symbol", C("e").alias("e2"), C("i").alias("i2"))
    j = lagged.join(other, (lagged["symbol"] == other["symbol"]) & (C("i2") == C("i") - C("lag"))).select(lagged["symbol"], "e", "e2", "n", "lags", "lag")
    ac = j.groupBy("symbol", "lag").agg((F.sum(C("e") * C("e2")) / (F.first("n") - C("lag")) * (1 - C("lag") / (F.first("lags") + 1))).alias("a")).groupBy("symbol").agg(F.sum("a").alias("ac"))
    r = g.join(ac, "symbol", "left")
    var = C("g0") + 2 * F.coalesce("ac", F.lit(0.0))
    se = F.sqrt(F.when(var <= 0, C("g0")).otherwise(var) / C("n"))
    stat = F.when((C("n") >= 10) & (se > 0), C("mean") / se).otherwise(0.0)
    r = r.withColumn("dm", stat)
    return r.select("symbol", "n", "dm", F.when(C("n") < 10, 1.0).otherwise(2 * norm_cdf(-F.abs("dm"))).alias("p_value"))


def conditional_coverage(rows: DataFrame, min_n: int = 5) -> DataFrame:
    """Overall, per regime and for event / non-event rows, in one pass of grouping sets."""
    g = rows.groupingSets([[], ["regime"], ["is_event"]], "regime", "is_event").agg(F.count("*").alias("n"), F.avg(C("coverage_hit").cast("double")).alias("coverage"))
    return g.where(C("n") >= min_n)


# Levels of the pinball set of a tier report.
LEVELS = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)


def interval_quantile(level: float, confidence: float) -> Column:
    """A quantile read off the interval: between its lower end and median, or median and upper end."""
    lo, mid, hi = C("forecast_low"), C("forecast_median"), C("forecast_high")
    return lo + (mid - lo) * (level / (1 - confidence) * 2) if level <= 0.5 else mid + (hi - mid) * ((level - 0.5) / 0.5)


def tier_distribution(rows: DataFrame, confidence: float, event: Column | None = None, min_n: int = 6) -> DataFrame:
    """Per tier: pinball set, CRPS, PIT test, worst coverage of a regime, and coverage on event and other days."""
    hit, count = C("coverage_hit").cast("double"), lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    event = F.lit(False) if event is None else event
    parts = [F.avg(pinball_loss(C("actual_price"), interval_quantile(q, confidence), q)).alias(f"pinball_{round(q * 100):02d}") for q in LEVELS]
    parts.append(F.avg(crps_gaussian(C("actual_price"), C("forecast_median"), (C("forecast_high") - C("forecast_low")) / 4)).alias("crps"))
    parts += [F.when(count(cond) >= min_n, F.avg(F.when(cond, hit))).alias(name) for name, cond in (("event_coverage", event), ("non_event_coverage", ~event))]
    by_regime = rows.groupBy("tier", "regime").agg(F.count("*").alias("n"), F.avg(hit).alias("c")).where(C("n") >= min_n)
    worst = by_regime.groupBy("tier").agg(F.min("c").alias("worst_regime_coverage"))
    pit = pit_ks(rows, ["tier"]).select("tier", C("ks").alias("pit_ks"), C("p_value").alias("pit_p_value"))
    return rows.groupBy("tier").agg(*parts).join(pit, "tier").join(worst, "tier", "left")


def evaluate_tier(rows: DataFrame, min_n: int, confidence: float = 0.8, event: Column | None = None) -> DataFrame:
    """Coverage, interval score, error, pinball, CRPS, PIT and direction per tier with eligibility."""
    p = published_metrics(rows, ["tier"]).join(tier_distribution(rows, confidence, event), "tier")
    pb = rows.groupBy("tier").agg(F.avg((pinball_loss(C("actual_price"), C("forecast_low"), 0.1) + pinball_loss(C("actual_price"), C("forecast_high"), 0.9)) / 2).alias("pinball"),
                                  F.avg(F.abs(C("actual_price") - C("origin_price"))).alias("base"))
    return p.join(pb, "tier").withColumn("mase", ratio("mae", "base")).withColumn("eligible", C("n") >= min_n)


def purged_fold_sizes(rows: DataFrame, horizon: int) -> DataFrame:
    """(origin, group) folds of a panel: own past plus other groups' rows whose labels ended before the origin.

    Membership is a predicate, so sizes come from cumulative counts per date instead of listing rows.
    """
    dates = rows.groupBy("ts").agg(F.count("*").alias("n")).withColumn("_g", F.lit(0))
    w = Window.partitionBy("_g").orderBy("ts")
    dates = dates.select("ts", F.row_number().over(w).alias("pos"), F.sum("n").over(w.rowsBetween(UP, 0)).alias("upto"), F.sum("n").over(Window.partitionBy("_g")).alias("total"))
    # Rows at or before the date `horizon` positions back; for the first dates the whole strict past.
    d = dates.select("ts", "pos", "total", F.when(C("pos") > horizon, F.lag("upto", horizon).over(w1())).otherwise(F.coalesce(F.lag("upto", 1).over(w1()), F.lit(0))).alias("other_all"))
    own = rows.select("symbol", "ts", (S.rn() - 1).alias("own_past"))
    o = own.join(d, "ts")
    # The group's own rows inside the others' cut are removed again through its position count.
    cut = dates.select((C("pos") + horizon).alias("pos"), C("ts").alias("cut_ts"))
    o = o.join(F.broadcast(cut), "pos", "left")
    mine = rows.select("symbol", C("ts").alias("cut_ts"), S.rn().alias("own_cut"))
    from .context import asof_backward
    have = asof_backward(o.where("cut_ts is not null").select("symbol", "ts", "cut_ts"), mine.select("symbol", C("cut_ts").alias("m_ts"), "own_cut"), "symbol", "cut_ts", "m_ts", ["own_cut"])
    j = o.join(have.select("symbol", "ts", "own_cut"), ["symbol", "ts"], "left")
    overlap = F.when(C("cut_ts").isNull(), C("own_past")).otherwise(F.coalesce("own_cut", F.lit(0)))
    return j.select("symbol", "ts", (C("own_past") + C("other_all") - overlap).alias("train_rows"), "total").withColumn("purged", C("total") - C("train_rows") - 1)


def w1():
    return Window.partitionBy(F.lit(0)).orderBy("ts")


walk_forward_origins = origins


def range_replay(bars: DataFrame, horizon: int, band: float, abstain: Column | None = None) -> DataFrame:
    """Replay of the damped drift with a fixed band at every origin; it abstains where `abstain` holds."""
    f = with_baselines(bars, horizon).join(origins(bars, horizon).select("symbol", "ts"), ["symbol", "ts"], "left_semi")
    m = C("damped_drift") if abstain is None else F.when(~abstain, C("damped_drift"))
    return replay_summary(replay_records(bars, f.select("symbol", "ts", (m * (1 - band)).alias("low"), m.alias("median"), (m * (1 + band)).alias("high")), horizon))


def naive_beat_gate(metrics: DataFrame, floor_pct: float = 0.0, min_samples: int = 8, nominal: float = 0.8, tol: float = 0.15, usable_min: float = 0.6) -> DataFrame:
    """metrics(symbol, improvement_pct, coverage, usable, origins)."""
    fails = F.array_compact(F.array(F.when(C("improvement_pct") < floor_pct, F.lit("improvement")), F.when(~C("coverage").between(nominal - tol, nominal + tol), F.lit("coverage")),
                                    F.when(C("usable") < min_samples, F.lit("samples")), F.when(C("usable") / F.greatest(F.lit(1), C("origins")) < usable_min, F.lit("usable_fraction"))))
    return metrics.withColumn("reasons", F.concat_ws(",", fails)).withColumn("passed", F.size(fails) == 0)


def promotion_gate(tiers: DataFrame, nominal: float, max_winkler_ratio: float) -> DataFrame:
    """tiers(tier, n, coverage, winkler, baseline_winkler, worst_regime_coverage, eligible)."""
    checks = {"coverage": F.abs(C("coverage") - nominal) <= 0.05, "winkler": C("winkler") <= C("baseline_winkler") * max_winkler_ratio, "conditional": C("worst_regime_coverage") >= nominal - 0.15, "eligible": C("eligible")}
    fails = F.array_compact(F.array(*[F.when(~c, F.lit(k)) for k, c in checks.items()]))
    return tiers.withColumn("reasons", F.concat_ws(",", fails)).withColumn("promoted", F.size(fails) == 0)


# ---- pooled linear model -------------------------------------------------------------

def gram(panel: DataFrame, features: list[str], target: str, keys: list[str]) -> DataFrame:
    """Sums for ridge by group: counts, first and second moments. One combined aggregate; rows never move."""
    cols = [*features, target]
    aggs = [F.count("*").alias("n")] + [F.sum(c).alias(f"s_{i}") for i, c in enumerate(cols)]
    aggs += [F.sum(C(a) * C(b)).alias(f"q_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j]
    return panel.groupBy(*keys).agg(*aggs)


def _fit(row, k: int, ridge: float):
    import numpy as np
    n = row["n"]
    s = np.array([row[f"s_{i}"] for i in range(k + 1)], dtype=float)
    q = np.zeros((k + 1, k + 1))
    for i in range(k + 1):
        for j in range(i, k + 1):
            q[i, j] = q[j, i] = row[f"q_{i}_{j}"]
    mu = s / n
    cov = q / n - np.outer(mu, mu)
    sd = np.sqrt(np.clip(np.diag(cov)[:k], 1e-24, None))
    z = cov[:k, :k] / np.outer(sd, sd)
    b = cov[:k, k] / sd
    beta = np.linalg.solve(z + ridge / n * np.eye(k), b)
    return beta / sd, float(mu[k] - (beta / sd) @ mu[:k]), beta


def pooled_ridge(panel: DataFrame, features: list[str], target: str, ridge: float = 1.0) -> DataFrame:
    """Standardised coefficients and in-sample skill from one row of moments."""
    k = len(features)
    g = gram(panel, features, target, [])

    def solve(batches):
        import numpy as np
        for p in batches:
            for _, r in p.iterrows():
                raw, icpt, beta = _fit(r, k, ridge)
                q = np.array([[r[f"q_{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
                s = np.array([r[f"s_{i}"] for i in range(k + 1)])
                sse = q[k, k] - 2 * (raw @ q[:k, k] + icpt * s[k]) + raw @ q[:k, :k] @ raw + 2 * icpt * raw @ s[:k] + r["n"] * icpt**2
                out = [(f, float(b), float(w)) for f, b, w in zip(features, beta, raw)] + [("intercept", float(icpt), float(icpt)), ("skill_vs_zero", float(1 - np.sqrt(sse / q[k, k])), float(r["n"]))]
                yield pd.DataFrame(out, columns=["term", "standardised", "raw"])

    return g.mapInPandas(solve, "term string, standardised double, raw double")


# Sessions up to which an instrument counts as newly listed, and the median turnover below which it is illiquid.
NEWLY_LISTED_SESSIONS, ILLIQUID_TURNOVER = 120, 1.0e7


def cohorts(panel: DataFrame, illiquid: float = ILLIQUID_TURNOVER) -> DataFrame:
    """(symbol, cohort) by the sessions and turnover at the last row of each instrument."""
    last = panel.groupBy("symbol").agg(F.max_by(F.struct("sessions_available", F.expm1("liquidity_log_turnover").alias("turnover")), "ts").alias("r"))
    return last.select("symbol", F.when(C("r.sessions_available") <= NEWLY_LISTED_SESSIONS, "newly_listed").when(C("r.turnover") < illiquid, "illiquid").otherwise("established").alias("cohort"))


def leave_instrument_out(panel: DataFrame, features: list[str], target: str, ridge: float = 1.0, groups: DataFrame | None = None) -> DataFrame:
    """Error and skill on each held-out symbol; its fold's moments are the totals minus its own (no refit scan).

    With `groups` (symbol, cohort) each fold also carries its cohort and the error and skill of all folds of it.
    """
    k = len(features)
    own = gram(panel, features, target, ["symbol"])
    names = [c for c in own.columns if c != "symbol"]
    tot = own.agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    d = own.crossJoin(F.broadcast(tot))

    def solve(batches):
        import numpy as np
        for p in batches:
            out = []
            for _, r in p.iterrows():
                rest = {c: r[f"t_{c}"] - r[c] for c in names}
                raw, icpt, _ = _fit(rest, k, ridge)
                q = np.array([[r[f"q_{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
                s = np.array([r[f"s_{i}"] for i in range(k + 1)])
                sse = q[k, k] - 2 * (raw @ q[:k, k] + icpt * s[k]) + raw @ q[:k, :k] @ raw + 2 * icpt * raw @ s[:k] + r["n"] * icpt**2
                out.append((r["symbol"], int(r["n"]), float(max(sse, 0)), float(q[k, k])))
            yield pd.DataFrame(out, columns=["symbol", "rows", "sse", "base"])

    f = d.mapInPandas(solve, "symbol string, rows long, sse double, base double")
    skill = lambda sse, base: 1 - F.sqrt(sse / base)
    f = f.withColumn("rmse", F.sqrt(C("sse") / C("rows"))).withColumn("skill", skill(C("sse"), C("base")))
    if groups is None:
        return f.drop("sse", "base")
    f = f.join(groups, "symbol")
    by = f.groupBy("cohort").agg(F.count("*").alias("cohort_folds"), F.sqrt(F.sum("sse") / F.sum("rows")).alias("cohort_rmse"), skill(F.sum("sse"), F.sum("base")).alias("cohort_skill"))
    return f.join(by, "cohort").drop("sse", "base")


def forward_time_validation(panel: DataFrame, features: list[str], target: str, fractions: tuple[float, ...], embargo: int, ridge: float = 1.0) -> DataFrame:
    """Rolling cuts of the distinct origins with an embargo; moments per origin date serve every cut."""
    k = len(features)
    by_day = gram(panel, features, target, ["ts"])
    names = [c for c in by_day.columns if c != "ts"]
    d = by_day.withColumn("_g", F.lit(0))
    pos = (F.row_number().over(Window.partitionBy("_g").orderBy("ts")) - 1).alias("pos")
    d = d.select("*", pos, F.count("*").over(Window.partitionBy("_g")).alias("days"))
    d = d.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions]))).withColumn("cut", F.floor(C("days") * C("fraction") + 1e-9))
    train, test = C("pos") <= F.greatest(F.lit(0), C("cut") - embargo), C("pos") > C("cut")
    g = d.groupBy("fraction").agg(*[F.sum(F.when(train, C(c))).alias(f"t_{c}") for c in names], *[F.sum(F.when(test, C(c))).alias(c) for c in names])
    g = g.where("t_n >= 30 and n > 0")

    def solve(batches):
        import numpy as np
        for p in batches:
            out = []
            for _, r in p.iterrows():
                raw, icpt, _ = _fit({c: r[f"t_{c}"] for c in names}, k, ridge)
                q = np.array([[r[f"q_{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
                s = np.array([r[f"s_{i}"] for i in range(k + 1)])
                sse = q[k, k] - 2 * (raw @ q[:k, k] + icpt * s[k]) + raw @ q[:k, :k] @ raw + 2 * icpt * raw @ s[:k] + r["n"] * icpt**2
                out.append((r["fraction"], int(r["t_n"]), int(r["n"]), float(np.sqrt(max(sse, 0) / r["n"])), float(1 - np.sqrt(max(sse, 0) / q[k, k]))))
            yield pd.DataFrame(out, columns=["fraction", "train_rows", "test_rows", "rmse", "skill"])

    return g.mapInPandas(solve, "fraction double, train_rows long, test_rows long, rmse double, skill double")


def shrinkage_weights(rows: DataFrame, half: float = 250.0) -> DataFrame:
    """rows(symbol, stock, sector, cap, pooled, n_stock, n_sector, n_cap): evidence-weighted blend of levels."""
    w1, w2, w3 = [C(f"n_{x}") / (C(f"n_{x}") + half) for x in ("stock", "sector", "cap")]
    d = rows.withColumn("w_stock", w1).withColumn("w_sector", (1 - w1) * w2).withColumn("w_cap", (1 - w1) * (1 - w2) * w3)
    d = d.withColumn("w_pooled", 1 - C("w_stock") - C("w_sector") - C("w_cap"))
    return d.withColumn("blend", sum((C(f"w_{x}") * C(x) for x in ("stock", "sector", "cap", "pooled")), F.lit(0.0)))


def model_ranking(scores: DataFrame, baseline: str) -> DataFrame:
    """Rank by (rmse, mae, -direction, -r2); inverse-RMSE weights over those beating the baseline, or over all models if none does."""
    w = Window.partitionBy("symbol")
    d = scores.withColumn("rank", F.row_number().over(w.orderBy("rmse", "mae", F.desc("direction"), F.desc("r2"), "model")))
    d = d.withColumn("_b", F.max(F.when(C("model") == baseline, C("rmse"))).over(w))
    model = C("model") != baseline
    d = d.withColumn("_beats", model & (C("_b") > 0) & (C("rmse") < C("_b"))).withColumn("_any", F.max("_beats").over(w))
    d = d.withColumn("_i", F.when(model & (C("_beats") | ~F.coalesce("_any", F.lit(False))), 1 / F.greatest("rmse", F.lit(1e-9))))
    return d.withColumn("weight", F.coalesce(C("_i") / F.sum("_i").over(w), F.lit(0.0))).drop("_b", "_beats", "_any", "_i")


def fold_assign(bars: DataFrame, folds: int, gap: int = 1) -> DataFrame:
    """Expanding folds: equal test blocks at the end of each series; training ends `gap` rows before."""
    d = bars.select("symbol", "ts", (S.rn() - 1).alias("i"), S.size().alias("n"))
    size = F.floor(C("n") / (folds + 1))
    start = C("n") - size * folds
    d = d.withColumn("fold", F.when(C("i") >= start, F.floor((C("i") - start) / size)))
    return d.withColumn("train_rows", F.when(C("fold").isNotNull(), start + C("fold") * size - gap))


def chronological_splits(bars: DataFrame) -> DataFrame:
    d = bars.select("symbol", "ts", (S.rn() - 1).alias("i"), S.size().alias("n")).where("n >= 30")
    part = F.when(C("n") >= 120, F.greatest(F.lit(18), F.floor(C("n") * 0.15))).otherwise(F.greatest(F.lit(5), F.floor(C("n") * 0.15)))
    left = C("n") - C("i")
    return d.select("symbol", "ts", F.when(left <= part, "test").when(left <= 2 * part, "calibration").when(left <= 3 * part, "meta").otherwise("train").alias("split"))


def supported_horizons(bars: DataFrame, horizons: list[int], minimum: int) -> DataFrame:
    n = bars.groupBy("symbol").agg(F.count("*").alias("rows"))
    return n.select("symbol", "rows", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon")).where(C("rows") - C("horizon") >= minimum)


def volatility_classes(rows: DataFrame, value: str, is_train: Column) -> DataFrame:
    """Terciles from training rows only; left-closed bins; equal thresholds are nudged apart."""
    q = rows.where(is_train).groupBy("symbol").agg(F.percentile(value, F.lit(1 / 3)).alias("lo"), F.percentile(value, F.lit(2 / 3)).alias("hi"))
    q = q.withColumn("hi", F.when(C("hi") <= C("lo"), C("lo") + 1e-9).otherwise(C("hi")))
    return rows.join(q, "symbol").withColumn("vol_class", F.when(C(value) < C("lo"), 0).when(C(value) < C("hi"), 1).otherwise(2))


def classification_metrics(rows: DataFrame, keys: list[str], classes: list) -> DataFrame:
    """Accuracy, balanced accuracy, weighted F1 and the confusion matrix, a row of counts by predicted class for each actual class of `classes`."""
    m = rows.groupBy(*keys, "actual", "predicted").agg(F.count("*").alias("c"))
    tp = F.sum(F.when(C("actual") == C("predicted"), C("c")))
    a = m.groupBy(*keys, C("actual").alias("k")).agg(F.sum("c").alias("support"), F.coalesce(tp, F.lit(0)).alias("tp"))
    p = m.groupBy(*keys, C("predicted").alias("k")).agg(F.sum("c").alias("called"))
    j = a.join(p, [*keys, "k"], "left").withColumn("f1", 2 * C("tp") / (C("support") + F.coalesce("called", F.lit(0))))
    g = j.groupBy(*keys).agg(F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(C("tp") / C("support")).alias("balanced_accuracy"), (F.sum(C("f1") * C("support")) / F.sum("support")).alias("weighted_f1"))
    cell = lambda x, y: F.coalesce(F.sum(F.when((C("actual") == x) & (C("predicted") == y), C("c"))), F.lit(0))
    return g.join(m.groupBy(*keys).agg(F.array(*[F.array(*[cell(x, y) for y in classes]) for x in classes]).alias("confusion")), keys)


def regime_tilt_eval(rows: DataFrame, multiplier: Column, min_n: int = 5) -> DataFrame:
    """Base against widened coverage per regime; `moved` means the tilted coverage is higher."""
    m, a = C("forecast_median"), C("actual_price")
    lo, hi = m - (m - C("forecast_low")) * multiplier, m + (C("forecast_high") - m) * multiplier
    g = rows.groupBy("regime").agg(F.count("*").alias("n"), F.avg(a.between(C("forecast_low"), C("forecast_high")).cast("double")).alias("base_coverage"), F.avg(a.between(lo, hi).cast("double")).alias("tilted_coverage")).where(C("n") >= min_n)
    return g.withColumn("moved", C("tilted_coverage") > C("base_coverage"))


def backtest_rows(predictions: DataFrame, models: list[str], weights: DataFrame | None = None) -> DataFrame:
    """predictions(symbol, target_date, fold, actual, model, value) to complete wide rows; with weights (symbol, model, weight) also their consensus."""
    wide = predictions.groupBy("symbol", "target_date", "fold", "actual").pivot("model", models).agg(F.first("value")).dropna(subset=models)
    if weights is None:
        return wide
    w = weights.groupBy("symbol").agg(*[F.sum(F.when(C("model") == m, C("weight"))).alias(f"_w_{m}") for m in models])
    total = reduce(lambda x, y: x + y, [F.coalesce(f"_w_{m}", F.lit(0.0)) * C(m) for m in models])
    return wide.join(w, "symbol").withColumn("consensus", total).drop(*[f"_w_{m}" for m in models])
