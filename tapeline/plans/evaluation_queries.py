"""Evaluation and panel-model queries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mathx import norm_cdf_sql
from ..functions.ranks import conformal_width
from ..operators import context as cx
from ..operators import evaluation as ev
from ..operators import replay as rp
from ..operators import risk as rk
from .context_queries import FEAT
from .indicator_queries import W, fr, full
from .registry import query

C = F.col
BASE = f"""bl0 AS (SELECT symbol, ts, close, ln(close) - ln(lag(close) OVER w) AS lr FROM bars {W}), bl AS (SELECT symbol, ts, close, CASE WHEN count(lr) OVER {fr(20)} >= 2 THEN close * exp(quantile_cont(lr, 0.5) OVER {fr(20)} * 0.5 * H) ELSE close END AS dd, row_number() OVER w AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bl0 {W}),
  wf AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, count(*) OVER (PARTITION BY symbol) AS m FROM (SELECT symbol, ts, dd, close AS ps, lead(close, H) OVER w AS act, rn FROM bl {W}) WHERE rn >= 25 AND act IS NOT NULL)"""


def base(h):
    return BASE.replace("* H)", f"* {h})").replace(", H)", f", {h})")


def cw(src, keys, val, conf, name):
    """Conformal half width per group as SQL."""
    return f"""{name} AS (SELECT {keys}, max(n) AS n, min(a) FILTER (WHERE r >= least(n, ceil((n + 1) * {conf} - 1e-12))) AS half_width FROM (SELECT {keys}, abs({val}) AS a, row_number() OVER (PARTITION BY {keys} ORDER BY abs({val})) AS r, count(*) OVER (PARTITION BY {keys}) AS n FROM {src}) GROUP BY {keys})"""


@query("baseline_estimators", "symbol:s ts:d persistence:f damped_drift:f", f"WITH {base(5)} SELECT symbol, ts, close AS persistence, dd AS damped_drift FROM bl")
def _(t):
    return ev.with_baselines(t.bars, 5)


@query("walk_forward_residuals", "symbol:s ts:d actual:f residual:f log_residual:f6 base_log_residual:f6", f"WITH {base(5)} SELECT symbol, ts, act AS actual, act - dd AS residual, ln(act) - ln(dd) AS log_residual, ln(act) - ln(ps) AS base_log_residual FROM wf")
def _(t):
    return ev.walk_forward_residuals(t.bars, 5)


@query("conformal_half_width", "symbol:s n:i half_width:f6", f"WITH {base(1)}, r AS (SELECT symbol, ln(act) - ln(dd) AS lr FROM wf), {cw('r', 'symbol', 'lr', '0.8', 'h')} SELECT * FROM h")
def _(t):
    return conformal_width(ev.walk_forward_residuals(t.bars, 1), ["symbol"], "log_residual", 0.8)


@query("measured_coverage", "symbol:s coverage:f6 scored:i", f"WITH {base(1)}, r AS (SELECT symbol, ts, ln(act) - ln(dd) AS lr FROM wf), c AS (SELECT * FROM r WHERE year(ts) < 1999), {cw('c', 'symbol', 'lr', '0.8', 'h')} SELECT symbol, avg(CASE WHEN abs(lr) <= half_width + 1e-12 THEN 1e0 ELSE 0 END) AS coverage, count(*) AS scored FROM r JOIN h USING (symbol) WHERE year(ts) >= 1999 GROUP BY symbol")
def _(t):
    r = ev.walk_forward_residuals(t.bars, 1)
    return ev.measured_coverage(r.where(F.year("ts") >= 1999), conformal_width(r.where(F.year("ts") < 1999), ["symbol"], "log_residual", 0.8), ["symbol"], "log_residual")


def cal(h, conf, lr, rs, p):
    return f"""{p}r AS (SELECT symbol, k, m, {lr} AS lr, {rs} AS rs, act - ps AS br, CASE WHEN m - greatest(floor(m * 0.6), 1) < 5 THEN greatest(m - 5, 1) ELSE greatest(floor(m * 0.6), 1) END AS sp FROM wf), {p}c AS (SELECT * FROM {p}r WHERE k <= sp), {cw(p + 'c', 'symbol', 'lr', conf, p + 'h')},
  {p}v AS (SELECT symbol, avg(CASE WHEN abs(lr) <= half_width + 1e-12 THEN 1e0 ELSE 0 END) AS coverage, count(*) AS scored FROM {p}r JOIN {p}h USING (symbol) WHERE k > sp GROUP BY symbol), {p}e AS (SELECT symbol, avg(abs(rs)) AS mae, sqrt(avg(rs * rs)) AS rmse, avg(abs(br)) AS baseline_mae FROM {p}r GROUP BY symbol),
  {p}s AS (SELECT *, (baseline_mae - mae) / baseline_mae AS skill, exp(half_width) - 1 AS proportion FROM {p}e JOIN {p}h USING (symbol) JOIN {p}v USING (symbol)),
  {p}t AS (SELECT *, CASE WHEN scored < 40 THEN 'low_evidence' WHEN coverage + 0.05 < {conf} THEN 'abstained' WHEN skill <= 0 THEN 'baseline_only' ELSE 'model_supported' END AS state FROM {p}s),
  {p}u AS (SELECT *, CASE WHEN state IN ('low_evidence', 'baseline_only') THEN 'C' WHEN state = 'abstained' THEN 'none' WHEN skill >= 0.05 AND scored >= 160 THEN 'A' ELSE 'B' END AS tier FROM {p}t)"""


MODEL = cal(5, "0.8", "ln(act) - ln(dd)", "act - dd", "m")


@query("calibrate_symbol", "symbol:s mae:f rmse:f baseline_mae:f skill:f6 coverage:f6 scored:i proportion:f6 state:s tier:s", f"WITH {base(5)}, {MODEL} SELECT * FROM mu")
def _(t):
    return ev.calibrate_symbol(t.bars, 5, 0.8)


@query("calibrated_range", "symbol:s state:s refused:b low:f high:f",
       f"""WITH {base(5)}, {MODEL}, {cal(5, '0.8', 'ln(act) - ln(ps)', 'act - ps', 'b')}, l AS (SELECT symbol, arg_max(close, ts) AS c, arg_max(dd, ts) AS dd FROM bl GROUP BY symbol)
       SELECT symbol, mu.state, mu.state = 'abstained' AS refused, CASE mu.state WHEN 'abstained' THEN NULL WHEN 'baseline_only' THEN c / (1 + bu.proportion) ELSE dd / (1 + mu.proportion) END AS low, CASE mu.state WHEN 'abstained' THEN NULL WHEN 'baseline_only' THEN c * (1 + bu.proportion) ELSE dd * (1 + mu.proportion) END AS high FROM mu JOIN bu USING (symbol) JOIN l USING (symbol)""")
def _(t):
    return ev.calibrated_range(t.bars, 5, 0.8)


@query("calibration_report", "state:s symbols:i mean_coverage:f6 mean_skill:f6", f"WITH {base(5)}, {MODEL} SELECT coalesce(state, 'skipped') AS state, count(*) AS symbols, avg(coverage) AS mean_coverage, avg(skill) AS mean_skill FROM (SELECT symbol FROM instruments UNION ALL SELECT 'NONE') LEFT JOIN mu USING (symbol) GROUP BY 1", "bars instruments")
def _(t):
    u = t.instruments.select("symbol").unionByName(t.raw("region").where("r_regionkey = 0").select(F.lit("NONE").alias("symbol")))
    return ev.calibration_report(ev.calibrate_symbol(t.bars, 5, 0.8), u)


@query("cqr_offsets", "tier:s n:i width_offset:f", f"WITH s AS (SELECT tier, greatest(forecast_low - actual_price, actual_price - forecast_high, 0) AS s FROM settled), {cw('s', 'tier', 's', '0.7', 'h')} SELECT tier, n, half_width AS width_offset FROM h", "settled")
def _(t):
    return ev.cqr_offsets(t.settled, ["tier"], 0.7).withColumnRenamed("offset", "width_offset")


@query("adaptive_conformal", "symbol:s half_width:f gamma:f6 coverage:f6 steps:i",
       f"""WITH RECURSIVE {base(1)}, l AS (SELECT symbol, list(abs(ln(act) - ln(dd)) ORDER BY ts) AS l FROM wf GROUP BY symbol),
       s AS (SELECT symbol, 1 AS i, l[1] AS width, 0.1e0 * (1e0 - 0.8e0) AS gamma, 1 AS hit FROM l
       UNION ALL SELECT symbol, i + 1, w, gamma + 0.1e0 * (CAST(r <= w AS DOUBLE) - 0.8e0), hit + CAST(r <= w AS INT) FROM (SELECT *, CASE WHEN k > i THEN v[i + 1] ELSE v[greatest(k, 1)] END AS w FROM (
         SELECT s.symbol, i, gamma, hit, l[i + 1] AS r, list_sort(l[1 : i + 1]) AS v, CAST(ceil((i + 2) * least(0.99e0, greatest(0.5e0, 0.8e0 - gamma))) AS BIGINT) AS k FROM s JOIN l ON l.symbol = s.symbol WHERE i < len(l))))
       SELECT s.symbol, width AS half_width, gamma, hit / i AS coverage, i AS steps FROM s JOIN l ON l.symbol = s.symbol WHERE i = len(l)""")
def _(t):
    return ev.adaptive_conformal(ev.walk_forward_residuals(t.bars, 1).select("symbol", "ts", C("log_residual").alias("residual")), 0.8)


@query("mondrian_conformal", "regime:s n:i half_width:f fallback:b coverage:f6",
       f"""WITH r AS (SELECT CASE WHEN symbol = 'Brand#4' THEN 'tiny' ELSE regime END AS regime, 0 AS al, actual_price - forecast_median AS r FROM settled), {cw('r', 'regime', 'r', '0.8', 'g')}, {cw('r', 'al', 'r', '0.8', 'a')}, w AS (SELECT regime, g.n, CASE WHEN g.n >= 3000 THEN g.half_width ELSE a.half_width END AS half_width, g.n < 3000 AS fallback FROM g CROSS JOIN a)
       SELECT regime, any_value(w.n) AS n, any_value(half_width) AS half_width, any_value(fallback) AS fallback, avg(CASE WHEN abs(r) <= half_width + 1e-12 THEN 1e0 ELSE 0 END) AS coverage FROM r JOIN w USING (regime) GROUP BY regime""", "settled")
def _(t):
    r = t.settled.select(F.when(C("symbol") == "Brand#4", "tiny").otherwise(C("regime")).alias("regime"), (C("actual_price") - C("forecast_median")).alias("r"))
    return ev.mondrian_conformal(r, "regime", "r", 0.8, 3000)


@query("circuit_clip", "symbol:s id:i clipped_low:f clipped_high:f",
       """WITH x AS (SELECT symbol, id, forecast_low AS lo, CASE WHEN id % 13 = 0 THEN forecast_low ELSE forecast_high END AS hi, forecast_low / 0.6e0 AS p, CASE WHEN id % 5 = 0 THEN 0.05e0 WHEN id % 3 = 0 THEN 0.1e0 ELSE 0.2e0 END AS l FROM ledger), y AS (SELECT *, greatest(0.05, p * (1 - l)) AS cl, p * (1 + l) AS ch, greatest(0.1, p * 0.0005e0) AS mw FROM x), z AS (SELECT *, greatest(lo, cl) AS a, least(hi, ch) AS b FROM y)
       SELECT symbol, id, CASE WHEN b - a < mw THEN greatest(cl, (a + b) / 2 - mw / 2) ELSE a END AS clipped_low, CASE WHEN b - a < mw THEN least(ch, (a + b) / 2 + mw / 2) ELSE b END AS clipped_high FROM z""", "ledger")
def _(t):
    i = C("id")
    return ev.circuit_clip(t.ledger.select("symbol", "id", C("forecast_low").alias("low"), F.when(i % 13 == 0, C("forecast_low")).otherwise(C("forecast_high")).alias("high"), (C("forecast_low") / 0.6).alias("price"), (i % 5 == 0).alias("surveillance"), (i % 3 == 0).alias("is_derivative")))


@query("weighted_quantile", "symbol:s quantile:f6",
       f"""WITH {base(1)}, v AS (SELECT wf.symbol, wf.ts, abs(ln(act) - ln(dd)) AS v, b.high - b.low + 1 AS sc FROM wf JOIN bars b USING (symbol, ts)), l AS (SELECT symbol, arg_max(sc, ts) AS rs FROM v GROUP BY symbol),
       w AS (SELECT symbol, ts, v, pow(0.98, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) - 1) * greatest(exp(-abs(ln(sc / rs))), 0.1) AS w FROM v JOIN l USING (symbol)), c AS (SELECT *, sum(w) OVER (PARTITION BY symbol ORDER BY v, ts ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY symbol) AS tot FROM w)
       SELECT symbol, min(v) AS quantile FROM c WHERE cum >= 0.8 * tot * (1 - 1e-12) GROUP BY symbol""")
def _(t):
    r = ev.walk_forward_residuals(t.bars, 1).join(t.bars.select("symbol", "ts", (C("high") - C("low") + 1).alias("scale")), ["symbol", "ts"])
    last = r.groupBy("symbol").agg(F.max_by("scale", "ts").alias("recent_scale"))
    return ev.weighted_quantile(r.join(last, "symbol").select("symbol", "ts", F.abs("log_residual").alias("value"), "scale", "recent_scale"), 0.8)


@query("interval_width", "symbol:s ts:d width:f", f"SELECT symbol, ts, greatest(close * 0.1e0, 1.28e0 * coalesce({full(20, 'stddev_pop(close)')}, 0), greatest(close * 0.0025e0, 0.05)) AS width FROM bars")
def _(t):
    sd = F.coalesce(ev.S.full(20, F.stddev_pop("close"), "close"), F.lit(0.0))
    return t.bars.select("symbol", "ts", ev.interval_width(C("close") * 0.1, sd, 1.28, F.greatest(C("close") * 0.0025, F.lit(0.05))).alias("width"))


# The origin price: the median of the shifted rows is pinned to it so that direction signs are exact.
OP = "op AS (SELECT *, CASE WHEN id % 11 = 5 THEN forecast_median ELSE forecast_low / 0.6e0 END AS origin_price FROM settled)"


def scored(t):
    return t.settled.withColumn("origin_price", F.when(C("id") % 11 == 5, C("forecast_median")).otherwise(C("forecast_low") / 0.6))


PUB = """SELECT {k}, count(*) AS n, avg(CAST(coverage_hit AS DOUBLE)) AS coverage, avg(winkler) AS winkler, avg(abs(actual_price - forecast_median)) AS mae, sqrt(avg(pow(actual_price - forecast_median, 2))) AS rmse, avg(abs(actual_price - forecast_median) / actual_price) * 100 AS mae_pct, quantile_cont(abs(actual_price - forecast_median), 0.5) AS median_ae,
  (avg(CAST(forecast_median > origin_price AS DOUBLE)) FILTER (WHERE actual_price > origin_price) + avg(CAST(forecast_median < origin_price AS DOUBLE)) FILTER (WHERE actual_price < origin_price)) / 2 AS balanced_direction, avg(forecast_high - forecast_low) AS mean_width FROM op GROUP BY {k}"""


@query("published_metrics", "symbol:s n:i coverage:f6 winkler:f2 mae:f2 rmse:f2 mae_pct:f2 median_ae:f2 balanced_direction:f6 mean_width:f2", f"WITH {OP} {PUB.format(k='symbol')}", "settled")
def _(t):
    return ev.published_metrics(scored(t), ["symbol"])


@query("point_metrics", "symbol:s r2:f6 mae:f2 rmse:f2 mape:f2 direction_pct:f bias:f2 median_ae:f2 p80:f2 p95:f2",
       f"""WITH {OP}, e AS (SELECT *, forecast_median - actual_price AS e FROM op) SELECT symbol, 1 - sum(e * e) / (var_pop(actual_price) * count(*)) AS r2, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, avg(abs(e) / abs(actual_price)) * 100 AS mape, avg(CAST(sign(actual_price - origin_price) = sign(forecast_median - origin_price) AS DOUBLE)) * 100 AS direction_pct, avg(e) AS bias,
       quantile_cont(abs(e), 0.5) AS median_ae, quantile_cont(abs(e), 0.8) AS p80, quantile_cont(abs(e), 0.95) AS p95 FROM e GROUP BY symbol""", "settled")
def _(t):
    return ev.point_metrics(scored(t), ["symbol"])


@query("pinball", "tier:s loss:f", "SELECT tier, avg(greatest(0.1 * (actual_price - forecast_low), -0.9 * (actual_price - forecast_low))) AS loss FROM settled GROUP BY tier", "settled")
def _(t):
    return t.settled.groupBy("tier").agg(F.avg(ev.pinball_loss(C("actual_price"), C("forecast_low"), 0.1)).alias("loss"))


Z = "((actual_price - forecast_median) / ((forecast_high - forecast_low) / 2.56e0))"


@query("crps", "symbol:s id:i gaussian:f ensemble:f",
       f"""SELECT symbol, id, (forecast_high - forecast_low) / 2.56e0 * ({Z} * (2 * {norm_cdf_sql(Z)} - 1) + 2 * exp(-{Z} * {Z} / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())) AS gaussian,
       (abs(forecast_low - actual_price) + abs(forecast_median - actual_price) + abs(forecast_high - actual_price)) / 3 - (abs(forecast_low - forecast_median) + abs(forecast_low - forecast_high) + abs(forecast_median - forecast_high)) / 9 AS ensemble FROM settled""", "settled")
def _(t):
    return t.settled.select("symbol", "id", ev.crps_gaussian(C("actual_price"), C("forecast_median"), (C("forecast_high") - C("forecast_low")) / 2.56).alias("gaussian"), ev.crps_ensemble(C("actual_price"), F.array("forecast_low", "forecast_median", "forecast_high")).alias("ensemble"))


@query("pit_ks", "tier:s n:i ks:f6 p_value:f6",
       f"""WITH x AS (SELECT tier, greatest(0, least(1, (actual_price - forecast_low) / (forecast_high - forecast_low))) AS x FROM settled), r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY x) AS i, count(*) OVER (PARTITION BY tier) AS n FROM x), g AS (SELECT tier, max(n) AS n, max(greatest(i / n - x, x - (i - 1) / n)) AS ks FROM r GROUP BY tier)
       SELECT *, greatest(0, least(1, {' + '.join(f'{2 * (-1) ** (k - 1)} * exp(-2.0 * {k * k} * ks * ks * n)' for k in range(1, 21))})) AS p_value FROM g""", "settled")
def _(t):
    return ev.pit_ks(t.settled, ["tier"])


@query("mase", "symbol:s mase:f6", "SELECT symbol, avg(abs(actual_price - forecast_median)) / avg(abs(actual_price - l)) AS mase FROM (SELECT *, lag(actual_price, 5) OVER (PARTITION BY symbol ORDER BY target_date) AS l FROM settled) GROUP BY symbol", "settled")
def _(t):
    return ev.mase(t.settled, 5)


@query("directional_accuracy", "tier:s decidable:i accuracy:f6", f"WITH {OP} SELECT tier, count(*) AS decidable, avg(CAST(sign(actual_price - origin_price) = sign(forecast_median - origin_price) AS DOUBLE)) AS accuracy FROM op WHERE actual_price <> origin_price AND forecast_median <> origin_price GROUP BY tier", "settled")
def _(t):
    return ev.directional_accuracy(scored(t), ["tier"])


@query("diebold_mariano", "symbol:s n:i dm:f p_value:f6",
       f"""WITH {base(1)}, d AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, pow((act - dd) / ps, 2) - pow((act - ps) / ps, 2) AS d FROM wf), g AS (SELECT symbol, count(*) AS n, avg(d) AS mu, var_pop(d) AS g0, least(floor(1.5 * pow(count(*), 1 / 3e0) + 1e-12), count(*) - 1) AS ml FROM d GROUP BY symbol),
       a AS (SELECT symbol, sum(s / (n - lag) * (1 - lag / (ml + 1))) AS ac FROM (SELECT x.symbol, l.lag, sum((x.d - mu) * (y.d - mu)) AS s, any_value(n) AS n, any_value(ml) AS ml FROM d x JOIN g USING (symbol) JOIN (SELECT unnest(range(1, 40)) AS lag) l ON l.lag <= ml JOIN d y ON y.symbol = x.symbol AND y.i = x.i - l.lag GROUP BY x.symbol, l.lag) GROUP BY symbol),
       z AS (SELECT symbol, n, mu / sqrt(CASE WHEN g0 + 2 * ac <= 0 THEN g0 ELSE g0 + 2 * ac END / n) AS dm FROM g JOIN a USING (symbol)) SELECT *, 2 * {norm_cdf_sql('(-abs(dm))')} AS p_value FROM z""")
def _(t):
    r = ev.walk_forward_residuals(t.bars, 1)
    return ev.diebold_mariano(r.select("symbol", "ts", F.pow(C("residual") / C("persistence"), 2).alias("l1"), F.pow(C("base_residual") / C("persistence"), 2).alias("l2")))


@query("conditional_coverage", "regime:s is_event:b n:i coverage:f6", "SELECT regime, is_event, count(*) AS n, avg(CAST(coverage_hit AS DOUBLE)) AS coverage FROM (SELECT *, day(target_date) = 15 AS is_event FROM settled) GROUP BY GROUPING SETS ((), (regime), (is_event)) HAVING count(*) >= 5", "settled")
def _(t):
    return ev.conditional_coverage(t.settled.withColumn("is_event", F.dayofmonth("target_date") == 15))


Z4 = "((actual_price - forecast_median) / ((forecast_high - forecast_low) / 4e0))"


def iq(q):
    return f"(forecast_low + (forecast_median - forecast_low) * {q / (1 - 0.8) * 2!r}e0)" if q <= 0.5 else f"(forecast_median + (forecast_high - forecast_median) * {(q - 0.5) / 0.5!r}e0)"


TIER = f"""{OP}, pm AS ({PUB.format(k='tier')}), tb AS (SELECT tier, avg((greatest(0.1 * (actual_price - forecast_low), -0.9 * (actual_price - forecast_low)) + greatest(0.9 * (actual_price - forecast_high), -0.1 * (actual_price - forecast_high))) / 2) AS pinball, avg(abs(actual_price - origin_price)) AS base FROM op GROUP BY tier),
  tq AS (SELECT tier, {', '.join(f"avg(greatest({q} * (actual_price - {iq(q)}), ({q} - 1) * (actual_price - {iq(q)}))) AS pinball_{round(q * 100):02d}" for q in ev.LEVELS)}, avg((forecast_high - forecast_low) / 4e0 * ({Z4} * (2 * {norm_cdf_sql(Z4)} - 1) + 2 * exp(-{Z4} * {Z4} / 2) / sqrt(2 * pi()) - 1 / sqrt(pi()))) AS crps,
    avg(CAST(coverage_hit AS DOUBLE)) FILTER (WHERE day(target_date) = 15) AS event_coverage, avg(CAST(coverage_hit AS DOUBLE)) FILTER (WHERE day(target_date) <> 15) AS non_event_coverage FROM op GROUP BY tier),
  tg AS (SELECT tier, min(c) AS worst_regime_coverage FROM (SELECT tier, regime, avg(CAST(coverage_hit AS DOUBLE)) AS c FROM op GROUP BY tier, regime HAVING count(*) >= 6) GROUP BY tier),
  tx AS (SELECT tier, greatest(0, least(1, (actual_price - forecast_low) / (forecast_high - forecast_low))) AS x FROM op), ty AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY x) AS i, count(*) OVER (PARTITION BY tier) AS n FROM tx), tk AS (SELECT tier, max(n) AS kn, max(greatest(i / n - x, x - (i - 1) / n)) AS pit_ks FROM ty GROUP BY tier),
  te AS (SELECT pm.*, pinball, mae / base AS mase, n >= 7600 AS eligible, tq.* EXCLUDE (tier), worst_regime_coverage, pit_ks, greatest(0, least(1, {' + '.join(f'{2 * (-1) ** (k - 1)} * exp(-2.0 * {k * k} * pit_ks * pit_ks * kn)' for k in range(1, 21))})) AS pit_p_value FROM pm JOIN tb USING (tier) JOIN tq USING (tier) JOIN tg USING (tier) JOIN tk USING (tier))"""


@query("evaluate_tier", "tier:s n:i coverage:f6 winkler:f2 mae:f2 pinball:f2 mase:f6 balanced_direction:f6 eligible:b " + " ".join(f"pinball_{round(q * 100):02d}:f2" for q in ev.LEVELS) + " crps:f2 event_coverage:f6 non_event_coverage:f6 worst_regime_coverage:f6 pit_ks:f6 pit_p_value:f6", f"WITH {TIER} SELECT * FROM te", "settled")
def _(t):
    return ev.evaluate_tier(scored(t), 7600, event=F.dayofmonth("target_date") == 15)


@query("purged_folds", "symbol:s ts:d train_rows:i purged:i",
       """WITH d AS (SELECT ts, row_number() OVER (ORDER BY ts) AS pos FROM (SELECT DISTINCT ts FROM bars)), r AS (SELECT symbol, ts, pos FROM bars JOIN d USING (ts)), n AS (SELECT count(*) AS total FROM r),
       g AS (SELECT s.symbol, d.pos, count(r.ts) OVER (PARTITION BY s.symbol ORDER BY d.pos ROWS UNBOUNDED PRECEDING) AS cum FROM d CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN r ON r.symbol = s.symbol AND r.pos = d.pos),
       s AS (SELECT o.symbol, o.ts, o.pos, sum(CASE WHEN g.symbol = o.symbol AND g.pos = o.pos - 1 THEN cum WHEN g.symbol <> o.symbol AND g.pos = CASE WHEN o.pos > 5 THEN o.pos - 5 ELSE o.pos - 1 END THEN cum ELSE 0 END) AS train_rows FROM r o LEFT JOIN g ON g.pos = o.pos - 1 OR g.pos = o.pos - 5 GROUP BY o.symbol, o.ts, o.pos)
       SELECT symbol, ts, train_rows, total - train_rows - 1 AS purged FROM s, n""".replace("LEFT JOIN g ON g.pos = o.pos - 1 OR g.pos = o.pos - 5", "LEFT JOIN (SELECT g.*, g.pos + 1 AS p FROM g UNION ALL SELECT g.*, g.pos + 5 FROM g) g ON g.p = o.pos"))
def _(t):
    return ev.purged_fold_sizes(t.bars.select("symbol", "ts"), 5)


ORI = "ori AS (SELECT symbol, ts FROM (SELECT symbol, ts, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)) WHERE i >= 40 AND i < n - 5)"


@query("walk_forward_origins", "symbol:s ts:d", f"WITH {ORI} SELECT * FROM ori")
def _(t):
    return rp.origins(t.bars, 5)


def replay_sql(forecasts: str, h: int = 5) -> str:
    """Scored origins `rq` and their summary `rr`, from bars `rb` and a query of (symbol, ts, low, median, high)."""
    return f"""rb AS (SELECT symbol, ts, close, lead(close, {h}) OVER w AS act, max(high) OVER f AS mx, min(low) OVER f AS mn, lead(open) OVER w AS en, lag(close, {h}) OVER w AS pr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts), f AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)),
  rf AS ({forecasts}), rg AS (SELECT rb.*, low, median, high, low IS NOT NULL AND median IS NOT NULL AND high > low AS ok FROM rf JOIN rb USING (symbol, ts)), rh AS (SELECT *, CASE WHEN ok THEN sign(median - close) END AS side, sign(act - close) AS mv, sign(close - pr) AS dr FROM rg),
  rq AS (SELECT *, CASE WHEN side <> 0 THEN side * (act * (1 - side * 0.00045e0) - en * (1 + side * 0.00045e0)) END AS net FROM rh),
  re AS (SELECT *, net / en * 100 AS ret, CASE WHEN net IS NOT NULL THEN sum(net) OVER w END AS eq FROM rq WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)), rd AS (SELECT *, max(eq) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pk FROM re),
  rr AS (SELECT symbol, count(*) AS origins, count(*) FILTER (WHERE ok) AS usable, count(*) FILTER (WHERE NOT ok) AS abstained, avg(CAST(act BETWEEN low AND high AS DOUBLE)) FILTER (WHERE ok) AS coverage, avg(CAST(mx <= high AND mn >= low AS DOUBLE)) FILTER (WHERE ok) AS path_containment,
    avg(CAST(mv = side AS DOUBLE)) FILTER (WHERE side <> 0) AS direction, avg(CAST(mv = dr AND mv <> 0 AS DOUBLE)) FILTER (WHERE dr <> 0) AS naive_direction, avg(abs(act - median)) FILTER (WHERE ok) AS mae, avg(abs(act - close)) AS naive_mae, count(net) AS trades, count(*) FILTER (WHERE net > 0) AS wins,
    coalesce(sum(abs(act - en)) FILTER (WHERE net IS NOT NULL), 0) AS gross_pnl, coalesce(sum(net), 0) AS net_pnl, avg(ret) AS mean_return_pct, CASE WHEN count(net) > 1 AND stddev_pop(ret) > 0 THEN avg(ret) / stddev_pop(ret) * sqrt(count(net)) END AS sharpe,
    CASE WHEN count(eq) > 0 THEN least(0, coalesce(min((eq - pk) / pk * 100) FILTER (WHERE pk > 0), 0)) END AS max_drawdown_pct FROM rd GROUP BY symbol)"""


REPLAY = f"""{base(5)}, {ORI}, {replay_sql("SELECT symbol, ts, CASE WHEN day(ts) <> 13 THEN dd * 0.4e0 END AS low, CASE WHEN day(ts) <> 13 THEN dd END AS median, CASE WHEN day(ts) <> 13 THEN dd * 1.6e0 END AS high FROM bl JOIN ori USING (symbol, ts)")}"""
REPLAYED = "symbol:s origins:i usable:i abstained:i coverage:f6 path_containment:f6 direction:f6 naive_direction:f6 mae:f2 naive_mae:f2 mase:f6 trades:i wins:i gross_pnl:f2 costs:f2 net_pnl:f2 mean_return_pct:f sharpe:f max_drawdown_pct:f2"


def replayed(t):
    return ev.range_replay(t.bars, 5, 0.6, F.dayofmonth("ts") == 13)


@query("range_replay", REPLAYED, f"WITH {REPLAY} SELECT *, mae / naive_mae AS mase, gross_pnl - net_pnl AS costs FROM rr")
def _(t):
    return replayed(t)


@query("naive_beat_gate", "symbol:s passed:b reasons:s",
       f"""WITH {REPLAY} SELECT symbol, (1 - mae / naive_mae) * 100 >= 0 AND coverage BETWEEN 0.65 AND 0.95 AS passed, concat_ws(',', CASE WHEN (1 - mae / naive_mae) * 100 < 0 THEN 'improvement' END, CASE WHEN NOT coverage BETWEEN 0.65 AND 0.95 THEN 'coverage' END) AS reasons FROM rr""")
def _(t):
    return ev.naive_beat_gate(replayed(t).select("symbol", ((1 - C("mase")) * 100).alias("improvement_pct"), "coverage", "usable", "origins"))


@query("promotion_gate", "tier:s promoted:b reasons:s",
       f"""WITH {TIER}, wr AS (SELECT tier, min(c) AS w FROM (SELECT tier, regime, avg(CAST(coverage_hit AS DOUBLE)) AS c FROM settled GROUP BY tier, regime) GROUP BY tier), bw AS (SELECT avg(winkler) AS b FROM settled)
       SELECT tier, abs(coverage - 0.27) <= 0.05 AND winkler <= b AND w >= 0.12 AND eligible AS promoted, concat_ws(',', CASE WHEN abs(coverage - 0.27) > 0.05 THEN 'coverage' END, CASE WHEN winkler > b THEN 'winkler' END, CASE WHEN w < 0.12 THEN 'conditional' END, CASE WHEN NOT eligible THEN 'eligible' END) AS reasons FROM te JOIN wr USING (tier) CROSS JOIN bw""", "settled")
def _(t):
    te = ev.evaluate_tier(scored(t), 7600)
    b = t.settled.agg(F.avg("winkler").alias("baseline_winkler"))
    return ev.promotion_gate(te.crossJoin(F.broadcast(b)), 0.27, 1.0)


def panel(t):
    return cx.instrument_features(t.bars, t.index_bars, 5)


TWO = ["momentum_5", "volatility_20"]
RIDGE = f"""{FEAT}, mo AS (SELECT count(*) AS n, avg(momentum_5) AS m1, avg(volatility_20) AS m2, avg(target) AS my, var_pop(momentum_5) AS a, var_pop(volatility_20) AS b, covar_pop(momentum_5, volatility_20) AS c, covar_pop(momentum_5, target) AS y1, covar_pop(volatility_20, target) AS y2 FROM feat),
  sd AS (SELECT *, 1 + 1e0 / n AS d, c / sqrt(a * b) AS r, y1 / sqrt(a) AS b1, y2 / sqrt(b) AS b2 FROM mo), be AS (SELECT *, (b1 * d - r * b2) / (d * d - r * r) AS k1, (d * b2 - r * b1) / (d * d - r * r) AS k2 FROM sd), co AS (SELECT *, k1 / sqrt(a) AS w1, k2 / sqrt(b) AS w2, my - k1 / sqrt(a) * m1 - k2 / sqrt(b) * m2 AS ic FROM be)"""


@query("pooled_ridge", "term:s standardised:f6 raw:f6",
       f"""WITH {RIDGE} SELECT 'momentum_5' AS term, k1 AS standardised, w1 AS raw FROM co UNION ALL SELECT 'volatility_20', k2, w2 FROM co UNION ALL SELECT 'intercept', ic, ic FROM co UNION ALL SELECT 'skill_vs_zero', 1 - sqrt(sum(pow(target - w1 * momentum_5 - w2 * volatility_20 - ic, 2)) / sum(target * target)), any_value(n) FROM feat, co""", "bars index_bars")
def _(t):
    return ev.pooled_ridge(panel(t), TWO, "target")


@query("leave_instrument_out", "symbol:s rows:i rmse:f6 skill:f6 cohort:s cohort_folds:i cohort_rmse:f6 cohort_skill:f6",
       f"""WITH {FEAT}, s AS (SELECT DISTINCT symbol AS h FROM feat), mo AS (SELECT h, count(*) AS n, avg(momentum_5) AS m1, avg(volatility_20) AS m2, avg(target) AS my, var_pop(momentum_5) AS a, var_pop(volatility_20) AS b, covar_pop(momentum_5, volatility_20) AS c, covar_pop(momentum_5, target) AS y1, covar_pop(volatility_20, target) AS y2 FROM s JOIN feat ON feat.symbol <> h GROUP BY h),
       sd AS (SELECT *, 1 + 1e0 / n AS d, c / sqrt(a * b) AS r, y1 / sqrt(a) AS b1, y2 / sqrt(b) AS b2 FROM mo), be AS (SELECT *, (b1 * d - r * b2) / (d * d - r * r) / sqrt(a) AS w1, (d * b2 - r * b1) / (d * d - r * r) / sqrt(b) AS w2 FROM sd), co AS (SELECT *, my - w1 * m1 - w2 * m2 AS ic FROM be)
       , fo AS (SELECT symbol, count(*) AS rows, sum(pow(target - w1 * momentum_5 - w2 * volatility_20 - ic, 2)) AS sse, sum(target * target) AS base, CASE WHEN arg_max(exp(liquidity_log_turnover) - 1, ts) < 150000 THEN 'illiquid' ELSE 'established' END AS cohort FROM feat JOIN co ON h = symbol GROUP BY symbol)
       SELECT symbol, rows, sqrt(sse / rows) AS rmse, 1 - sqrt(sse / base) AS skill, cohort, count(*) OVER c AS cohort_folds, sqrt(sum(sse) OVER c / sum(rows) OVER c) AS cohort_rmse, 1 - sqrt(sum(sse) OVER c / sum(base) OVER c) AS cohort_skill FROM fo WINDOW c AS (PARTITION BY cohort)""", "bars index_bars")
def _(t):
    p = panel(t)
    return ev.leave_instrument_out(p, TWO, "target", groups=ev.cohorts(p, 150_000.0))


@query("forward_time_validation", "fraction:f6 train_rows:i test_rows:i rmse:f6 skill:f6",
       f"""WITH {FEAT}, p AS (SELECT *, dense_rank() OVER (ORDER BY ts) - 1 AS pos FROM feat), m AS (SELECT max(pos) + 1 AS days FROM p), c AS (SELECT fr, CAST(floor(days * fr + 1e-9) AS BIGINT) AS cut FROM m CROSS JOIN (SELECT unnest([0.55e0, 0.725e0, 0.9e0]) AS fr)),
       mo AS (SELECT fr, count(*) AS n, avg(momentum_5) AS m1, avg(volatility_20) AS m2, avg(target) AS my, var_pop(momentum_5) AS a, var_pop(volatility_20) AS b, covar_pop(momentum_5, volatility_20) AS cc, covar_pop(momentum_5, target) AS y1, covar_pop(volatility_20, target) AS y2 FROM p JOIN c ON pos <= cut - 5 GROUP BY fr),
       sd AS (SELECT *, 1 + 1e0 / n AS d, cc / sqrt(a * b) AS r, y1 / sqrt(a) AS b1, y2 / sqrt(b) AS b2 FROM mo), be AS (SELECT *, (b1 * d - r * b2) / (d * d - r * r) / sqrt(a) AS w1, (d * b2 - r * b1) / (d * d - r * r) / sqrt(b) AS w2 FROM sd), co AS (SELECT *, my - w1 * m1 - w2 * m2 AS ic FROM be)
       SELECT fr AS fraction, any_value(co.n) AS train_rows, count(*) AS test_rows, sqrt(avg(pow(target - w1 * momentum_5 - w2 * volatility_20 - ic, 2))) AS rmse, 1 - sqrt(sum(pow(target - w1 * momentum_5 - w2 * volatility_20 - ic, 2)) / sum(target * target)) AS skill FROM p JOIN c ON pos > cut JOIN co USING (fr) GROUP BY fr""", "bars index_bars")
def _(t):
    return ev.forward_time_validation(panel(t), TWO, "target", (0.55, 0.725, 0.9), 5)


@query("shrinkage_blend", "symbol:s w_stock:f6 w_sector:f6 w_cap:f6 w_pooled:f6 blend:f",
       """WITH x AS (SELECT symbol, coalesce(sector, 'none') AS sec, cap_bucket AS cap, avg(close) AS stock, count(*) AS ns FROM bars JOIN instruments USING (symbol) GROUP BY ALL), y AS (SELECT *, avg(stock) OVER (PARTITION BY sec) AS sector, sum(ns) OVER (PARTITION BY sec) AS nse, avg(stock) OVER (PARTITION BY cap) AS capm, sum(ns) OVER (PARTITION BY cap) AS nc, avg(stock) OVER () AS pooled FROM x),
       z AS (SELECT *, ns / (ns + 2500e0) AS a, nse / (nse + 2500e0) AS b, nc / (nc + 2500e0) AS c FROM y), w AS (SELECT *, a AS w_stock, (1 - a) * b AS w_sector, (1 - a) * (1 - b) * c AS w_cap FROM z) SELECT symbol, w_stock, w_sector, w_cap, 1 - w_stock - w_sector - w_cap AS w_pooled, w_stock * stock + w_sector * sector + w_cap * capm + (1 - w_stock - w_sector - w_cap) * pooled AS blend FROM w""", "bars instruments")
def _(t):
    x = t.bars.join(t.instruments, "symbol").groupBy("symbol", F.coalesce("sector", F.lit("none")).alias("sec"), C("cap_bucket").alias("capb")).agg(F.avg("close").alias("stock"), F.count("*").alias("n_stock"))
    s = x.groupBy("sec").agg(F.avg("stock").alias("sector"), F.sum("n_stock").alias("n_sector"))
    c = x.groupBy("capb").agg(F.avg("stock").alias("cap"), F.sum("n_stock").alias("n_cap"))
    return ev.shrinkage_weights(x.join(s, "sec").join(c, "capb").crossJoin(F.broadcast(x.agg(F.avg("stock").alias("pooled")))), 2500.0)


SCORES = """sc AS (SELECT symbol, m AS model, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, 0 AS direction, 0 AS r2 FROM (SELECT symbol, unnest(['base', 'high', 'mid']) AS m, unnest([actual_price - forecast_median, actual_price - forecast_high, actual_price - (forecast_low + forecast_median) / 2]) AS e FROM settled) GROUP BY symbol, m)"""


@query("model_ranking", "symbol:s model:s rank:i rmse:f2 weight:f6",
       f"""WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY rmse, mae, model) AS rank, max(CASE WHEN model = 'base' THEN rmse END) OVER (PARTITION BY symbol) AS b FROM sc), q AS (SELECT *, max(CAST(rmse < b AND model <> 'base' AS INT)) OVER (PARTITION BY symbol) AS beaten FROM r), i AS (SELECT *, CASE WHEN model <> 'base' AND (rmse < b OR beaten = 0) THEN 1 / rmse END AS iv FROM q) SELECT symbol, model, rank, rmse, coalesce(iv / sum(iv) OVER (PARTITION BY symbol), 0) AS weight FROM i""", "settled")
def _(t):
    a = C("actual_price")
    e = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), x.alias("e")) for m, x in (("base", a - C("forecast_median")), ("high", a - C("forecast_high")), ("mid", a - (C("forecast_low") + C("forecast_median")) / 2))]))
    s = t.settled.select("symbol", e.alias("x")).select("symbol", "x.*").groupBy("symbol", "model").agg(F.sqrt(F.avg(C("e") * C("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae")).withColumn("direction", F.lit(0)).withColumn("r2", F.lit(0))
    return ev.model_ranking(s, "base")


@query("fold_assign", "symbol:s ts:d fold:i train_rows:i", """SELECT symbol, ts, CASE WHEN i >= n - z * 5 THEN (i - (n - z * 5)) // z END AS fold, CASE WHEN i >= n - z * 5 THEN n - z * 5 + (i - (n - z * 5)) // z * z - 1 END AS train_rows FROM (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, count(*) OVER (PARTITION BY symbol) // 6 AS z FROM bars)""")
def _(t):
    return ev.fold_assign(t.bars, 5)


@query("chronological_splits", "symbol:s ts:d split:s", """SELECT symbol, ts, CASE WHEN n - i <= p THEN 'test' WHEN n - i <= 2 * p THEN 'calibration' WHEN n - i <= 3 * p THEN 'meta' ELSE 'train' END AS split FROM (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n, greatest(18, floor(count(*) OVER (PARTITION BY symbol) * 0.15e0)) AS p FROM bars)""")
def _(t):
    return ev.chronological_splits(t.bars)


@query("supported_horizons", "symbol:s rows:i horizon:i", "SELECT symbol, n AS rows, h AS horizon FROM (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol) CROSS JOIN (SELECT unnest([1, 5, 20, 60, 120]) AS h) WHERE n - h >= 1480")
def _(t):
    return ev.supported_horizons(t.bars, [1, 5, 20, 60, 120], 1480)


VC = f"vc0 AS (SELECT symbol, ts, abs(close / lag(close) OVER w - 1) AS v FROM bars {W}), vq AS (SELECT symbol, quantile_cont(v, 1/3e0) AS lo, quantile_cont(v, 2/3e0) AS hi FROM vc0 WHERE year(ts) < 1999 AND v IS NOT NULL GROUP BY symbol), vc AS (SELECT symbol, ts, v, CASE WHEN v < lo THEN 0 WHEN v < hi THEN 1 ELSE 2 END AS k FROM vc0 JOIN vq USING (symbol) WHERE v IS NOT NULL)"


def vol_rows(t):
    return ev.volatility_classes(rk.price_returns(t.bars).select("symbol", "ts", F.abs("ret").alias("v")), "v", F.year("ts") < 1999)


@query("volatility_classes", "symbol:s ts:d vol_class:i", f"WITH {VC} SELECT symbol, ts, k AS vol_class FROM vc")
def _(t):
    return vol_rows(t)


@query("classification_metrics", "symbol:s n:i accuracy:f6 balanced_accuracy:f6 weighted_f1:f6 confusion:s",
       f"""WITH {VC}, p AS (SELECT symbol, k AS a, lag(k) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM vc), c AS (SELECT symbol, cls, count(*) FILTER (WHERE a = cls) AS sup, count(*) FILTER (WHERE p = cls) AS cal, count(*) FILTER (WHERE a = cls AND p = cls) AS tp FROM p CROSS JOIN (SELECT unnest([0, 1, 2]) AS cls) WHERE p IS NOT NULL GROUP BY symbol, cls),
       x AS (SELECT symbol, concat_ws(' ', {', '.join(f"count(*) FILTER (WHERE a = {i} AND p = {j})" for i in range(3) for j in range(3))}) AS confusion FROM p WHERE p IS NOT NULL GROUP BY symbol)
       SELECT symbol, sum(sup) AS n, sum(tp) / sum(sup) AS accuracy, avg(tp / sup) AS balanced_accuracy, sum(2 * tp / (sup + cal) * sup) / sum(sup) AS weighted_f1, any_value(confusion) AS confusion FROM c JOIN x USING (symbol) GROUP BY symbol""")
def _(t):
    d = vol_rows(t).select("symbol", C("vol_class").alias("actual"), ev.S.lag("vol_class").alias("predicted")).where("predicted is not null")
    return ev.classification_metrics(d, ["symbol"], [0, 1, 2]).withColumn("confusion", F.concat_ws(" ", F.transform(F.flatten("confusion"), lambda x: x.cast("string"))))


@query("regime_tilt_eval", "regime:s n:i base_coverage:f6 tilted_coverage:f6 moved:b",
       """WITH x AS (SELECT *, CASE regime WHEN 'calm' THEN 0.93e0 WHEN 'stressed' THEN 1.4e0 ELSE 1e0 END AS k FROM settled), g AS (SELECT regime, count(*) AS n, avg(CAST(coverage_hit AS DOUBLE)) AS base_coverage, avg(CAST(actual_price BETWEEN forecast_median - (forecast_median - forecast_low) * k AND forecast_median + (forecast_high - forecast_median) * k AS DOUBLE)) AS tilted_coverage FROM x GROUP BY regime) SELECT *, tilted_coverage > base_coverage AS moved FROM g WHERE n >= 5""", "settled")
def _(t):
    return ev.regime_tilt_eval(t.settled, F.when(C("regime") == "calm", 0.93).when(C("regime") == "stressed", 1.4).otherwise(1.0))


@query("backtest_rows", "symbol:s target_date:d fold:i actual:f persistence:f drift:f consensus:f",
       f"""WITH {base(1)}, e AS (SELECT symbol, sqrt(avg(pow(act - ps, 2))) AS rp, sqrt(avg(pow(act - dd, 2))) AS rd, sqrt(avg(pow(act - (ps + dd) / 2, 2))) AS rb FROM wf GROUP BY symbol), w AS (SELECT symbol, CASE WHEN rp < rb OR NOT (rp < rb OR rd < rb) THEN 1 / rp ELSE 0 END AS ip, CASE WHEN rd < rb OR NOT (rp < rb OR rd < rb) THEN 1 / rd ELSE 0 END AS id FROM e)
       SELECT symbol, ts AS target_date, k % 5 AS fold, act AS actual, ps AS persistence, dd AS drift, (ip * ps + id * dd) / (ip + id) AS consensus FROM wf JOIN w USING (symbol) WHERE day(ts) <> 9""")
def _(t):
    """Two models, weighed against the mean of both as the baseline."""
    r = ev.walk_forward_residuals(t.bars, 1).select("*", (ev.S.rn() % 5).alias("fold"))
    base_ = ["symbol", C("ts").alias("target_date"), "fold", "actual"]
    p = r.select(*base_, F.lit("persistence").alias("model"), C("persistence").alias("value")).unionByName(r.where(F.dayofmonth("ts") != 9).select(*base_, F.lit("drift").alias("model"), C("damped_drift").alias("value")))
    e = {"persistence": C("base_residual"), "drift": C("residual"), "mean": C("actual") - (C("persistence") + C("damped_drift")) / 2}
    each = r.select("symbol", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), x.alias("e")) for m, x in e.items()])).alias("x")).select("symbol", "x.*")
    scores = each.groupBy("symbol", "model").agg(F.sqrt(F.avg(C("e") * C("e"))).alias("rmse"), F.avg(F.abs("e")).alias("mae")).withColumn("direction", F.lit(0)).withColumn("r2", F.lit(0))
    return ev.backtest_rows(p, ["persistence", "drift"], ev.model_ranking(scores, "mean"))
