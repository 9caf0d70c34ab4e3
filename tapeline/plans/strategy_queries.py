"""Screen, strategy and backtest queries."""

from pyspark.sql import functions as F

from ..functions.pricing import greeks_sql
from ..operators import strategy as st
from ..operators.risk import performance_metrics
from ..functions.span import Span
from .indicator_queries import MACD_CTES, TR, W, fr, full, rsi_ctes
from .registry import query
from .risk_queries import PERF_COLS, perf_sql

C = F.col

WIL = rsi_ctes(14)


def pct(a, b):
    return f"round(({a} - {b}) / abs({b}) * 100, 2)"


SCREEN = f"""{WIL}, s0 AS (SELECT b.*, count(*) OVER (PARTITION BY symbol) AS sessions, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS d, lag(close) OVER w AS c1, lag(close, 5) OVER w AS c5, lag(close, 20) OVER w AS c20,
  max(close) OVER {fr(250)} AS hi, min(close) OVER {fr(250)} AS lo, avg(close) OVER {fr(14)} AS m14, round(avg(close) OVER {fr(20)}, 2) AS m20, round(avg(close) OVER {fr(50)}, 2) AS m50, round(avg(close) OVER {fr(200)}, 2) AS m200, avg(volume) OVER {fr(20)} AS v20, avg(high - low) OVER {fr(14)} AS r14 FROM bars b {W}),
  scr AS (SELECT symbol, ts, sessions, round(close, 2) AS last_close, {pct('close', 'c1')} AS change_pct_1d, {pct('close', 'c5')} AS change_pct_5d, {pct('close', 'c20')} AS change_pct_20d, round(y, 2) AS rsi_14, m20 AS sma_20, m50 AS sma_50, CASE WHEN sessions >= 200 THEN m200 END AS sma_200,
  {pct('close', 'hi')} AS distance_from_52w_high_pct, {pct('close', 'lo')} AS distance_from_52w_low_pct, round(volume, 0) AS volume, round(volume / v20, 3) AS volume_vs_20d_avg, round(r14 / m14 * 100, 2) AS realized_range_pct_14d, {pct('open', 'c1')} AS gap_pct,
  {pct('close', 'm20')} AS close_vs_sma20_pct, {pct('close', 'm50')} AS close_vs_sma50_pct, CASE WHEN sessions >= 200 THEN {pct('close', 'm200')} END AS close_vs_sma200_pct FROM s0 LEFT JOIN rsi14 USING (symbol, ts) WHERE d = 1 AND sessions >= 60)"""
METRICS = "last_close change_pct_1d change_pct_5d change_pct_20d rsi_14 sma_20 sma_50 sma_200 distance_from_52w_high_pct distance_from_52w_low_pct volume volume_vs_20d_avg realized_range_pct_14d gap_pct close_vs_sma20_pct close_vs_sma50_pct close_vs_sma200_pct".split()


@query("screen_metrics", "symbol:s ts:d sessions:i " + " ".join(f"{m}:f" for m in METRICS), f"WITH {SCREEN} SELECT * FROM scr")
def _(t):
    return st.screen_metrics(t.bars)


R1 = [{"field": "close_vs_sma20_pct", "op": "gt", "value": -60}, {"field": "rsi_14", "op": "between", "low": 45, "high": 60}, {"field": "volume_vs_20d_avg", "op": "lte", "value": 1.8}]


@query("filter_predicates", "symbol:s matched:b missing:i", f"WITH {SCREEN} SELECT symbol, close_vs_sma20_pct > -60 AND rsi_14 BETWEEN 45 AND 60 AND volume_vs_20d_avg <= 1.8 AS matched, 0 AS missing FROM scr")
def _(t):
    return st.screen_status(st.screen_metrics(t.bars), R1).withColumn("missing", F.size("missing"))


@query("run_screen", "symbol:s status:s change_pct_5d:f rsi_14:f sma_20:f",
       f"WITH {SCREEN} SELECT symbol, 'match' AS status, change_pct_5d, rsi_14, sma_20 FROM (SELECT * FROM scr WHERE close_vs_sma20_pct > -60 AND rsi_14 BETWEEN 45 AND 60 AND volume_vs_20d_avg <= 1.8 ORDER BY change_pct_5d DESC, symbol LIMIT 10) UNION ALL SELECT symbol, 'insufficient_history', NULL, NULL, NULL FROM bars GROUP BY symbol HAVING count(*) < 60")
def _(t):
    hits, excluded = st.run_screen(t.bars, R1, "change_pct_5d", True, 10)
    e = excluded.select("symbol", C("reason").alias("status"), *[F.lit(None).cast("double").alias(c) for c in ("change_pct_5d", "rsi_14", "sma_20")])
    return hits.select("symbol", F.lit("match").alias("status"), "change_pct_5d", "rsi_14", "sma_20").unionByName(e)


SCREENS = [(1, "rsi_14", "gt", 50.0, None, None), (1, "gap_pct", "gt", 0.0, None, None), (2, "rsi_14", "between", None, 40.0, 50.0), (3, "volume_vs_20d_avg", "lt", 1.0, None, None), (3, "change_pct_1d", "lte", 0.0, None, None), (4, "sma_200", "gte", 100.0, None, None)]


@query("saved_screen_run", "screen_id:i symbol:s matched:b incomplete:b",
       f"""WITH {SCREEN} SELECT 1 AS screen_id, symbol, rsi_14 > 50 AND gap_pct > 0 AS matched, false AS incomplete FROM scr UNION ALL SELECT 2, symbol, rsi_14 BETWEEN 40 AND 50, false FROM scr
       UNION ALL SELECT 3, symbol, volume_vs_20d_avg < 1 AND change_pct_1d <= 0, false FROM scr UNION ALL SELECT 4, symbol, coalesce(sma_200 >= 100, false), sma_200 IS NULL FROM scr""")
def _(t):
    r = t.spark.createDataFrame(SCREENS, "screen_id int, field string, op string, value double, low double, high double")
    return st.saved_screen_run(st.screen_metrics(t.bars), r, METRICS)


SM = f"""{WIL}, {MACD_CTES}, sm AS (SELECT b.symbol, b.ts, open, close, volume, (close / lag(close) OVER w - 1) * 100 AS change_pct_1d, (close / lag(close, 5) OVER w - 1) * 100 AS change_pct_5d, (close / lag(close, 20) OVER w - 1) * 100 AS change_pct_20d, (open / lag(close) OVER w - 1) * 100 AS gap_pct,
  {full(20, 'avg(close)')} AS sma_20, {full(50, 'avg(close)')} AS sma_50, {full(200, 'avg(close)')} AS sma_200, CASE WHEN rl14.y = 0 THEN 100 ELSE 100 - 100 / (1 + rg14.y / rl14.y) END AS rsi_14,
  {full(14, 'avg(tr)', 'tr')} / close * 100 AS atr_pct_14, volume / {full(20, 'avg(volume)')} AS volume_vs_20d_avg, macd_histogram AS macd_hist, (close / CASE WHEN count(*) OVER {fr(252)} >= 60 THEN max(close) OVER {fr(252)} END - 1) * 100 AS distance_from_52w_high_pct
  FROM (SELECT *, {TR} AS tr FROM bars {W}) b LEFT JOIN rg14 USING (symbol, ts) LEFT JOIN rl14 USING (symbol, ts) LEFT JOIN macd USING (symbol, ts) {W})"""
SM = SM.replace("LEFT JOIN macd USING (symbol, ts) WINDOW", "LEFT JOIN macd USING (symbol, ts) WINDOW")
SM_COLS = "change_pct_1d change_pct_5d change_pct_20d gap_pct sma_20 sma_50 sma_200 rsi_14 atr_pct_14 volume_vs_20d_avg macd_hist distance_from_52w_high_pct".split()


@query("strategy_metrics", "symbol:s ts:d " + " ".join(f"{m}:f" for m in SM_COLS), f"WITH {SM} SELECT * FROM sm")
def _(t):
    return st.strategy_metrics(t.bars)


def side(join, *groups):
    return {"join": join, "groups": [{"join": j, "conditions": c} for j, c in groups]}


ENTRY = side("or", ("and", [{"metric": "close", "operator": "cross_above", "compare_metric": "sma_20"}, {"metric": "rsi_14", "operator": "gt", "value": 45}]), ("or", [{"metric": "rsi_14", "operator": "lt", "value": 38}, {"metric": "gap_pct", "operator": "lte", "value": -90}]))
EXIT = side("and", ("or", [{"metric": "rsi_14", "operator": "gte", "value": 54}, {"metric": "close", "operator": "cross_below", "compare_metric": "sma_50"}]))
RULE_SQL = """rr0 AS (SELECT *, lag(close) OVER w AS pc, lag(sma_20) OVER w AS p20, lag(sma_50) OVER w AS p50 FROM sm WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  rr AS (SELECT symbol, ts, close, close AS price, coalesce((pc <= p20 AND close > sma_20) AND rsi_14 > 45, false) OR coalesce(rsi_14 < 38, false) OR coalesce(gap_pct <= -90, false) AS en, coalesce(rsi_14 >= 54, false) OR coalesce(pc >= p50 AND close < sma_50, false) AS ex, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM rr0)"""


@query("rule_conditions", "symbol:s ts:d x:b y:b z:b", f"WITH {SM} SELECT symbol, ts, coalesce(lag(close) OVER w <= lag(sma_20) OVER w AND close > sma_20, false) AS x, coalesce(rsi_14 BETWEEN 40 AND 50, false) AS y, coalesce(lag(macd_hist) OVER w >= 0 AND macd_hist < 0, false) AS z FROM sm {W}")
def _(t):
    m = st.strategy_metrics(t.bars)
    return m.select("symbol", "ts", st.condition(ENTRY["groups"][0]["conditions"][0]).alias("x"), st.condition({"metric": "rsi_14", "operator": "between", "values": [40, 50]}).alias("y"),
                    st.condition({"metric": "macd_hist", "operator": "cross_below", "value": 0}).alias("z"))


@query("rule_groups", "symbol:s ts:d en:b ex:b", f"WITH {SM}, {RULE_SQL} SELECT symbol, ts, en, ex FROM rr")
def _(t):
    return st.strategy_metrics(t.bars).select("symbol", "ts", st.side(ENTRY).alias("en"), st.side(EXIT).alias("ex"))


def sig_sql(stop, target):
    why = f"CASE WHEN ex THEN 'exit_rules_matched' WHEN {stop} > 0 AND price <= held * (1 - {stop} / 100e0) THEN 'stop_loss' WHEN {target} > 0 AND price >= held * (1 + {target} / 100e0) THEN 'target' END"
    return f"""walk AS (SELECT symbol, k, ts, price, CASE WHEN en THEN price END AS held, CASE WHEN en THEN 'BUY' END AS action, CASE WHEN en THEN 'entry_rules_matched' END AS reason FROM rrm WHERE k = 1
  UNION ALL SELECT symbol, k, ts, price, CASE WHEN held IS NOT NULL THEN CASE WHEN why IS NULL THEN held END WHEN en THEN price END, CASE WHEN held IS NOT NULL THEN CASE WHEN why IS NOT NULL THEN 'SELL' END WHEN en THEN 'BUY' END,
   CASE WHEN held IS NOT NULL THEN why WHEN en THEN 'entry_rules_matched' END FROM (SELECT r.symbol, r.k, r.ts, r.price, r.en, walk.held, {why.replace('ex', 'r.ex', 1).replace('price', 'r.price')} AS why FROM walk JOIN rrm r ON r.symbol = walk.symbol AND r.k = walk.k + 1)),
  sig AS (SELECT symbol, ts, action, price, reason FROM walk WHERE action IS NOT NULL)"""


def with_rule(stop, target):
    return f"WITH RECURSIVE {SM}, {RULE_SQL}, rrm AS MATERIALIZED (SELECT * FROM rr), {sig_sql(stop, target)}"


STRAT = {"entry": ENTRY, "exit": EXIT, "stop_loss_pct": 70, "target_pct": 80}
PLAIN = {"entry": ENTRY, "exit": EXIT}
SIG_COLS = "symbol:s ts:d action:s price:f reason:s"


@query("evaluate_strategy", SIG_COLS, with_rule(70, 80) + " SELECT * FROM sig")
def _(t):
    return st.signals(st.strategy_metrics(t.bars), STRAT)


@query("run_strategy_universe", SIG_COLS, with_rule(0, 0) + " SELECT * FROM sig UNION ALL SELECT symbol, NULL, 'EXCLUDED', count(*), 'insufficient_history' FROM bars GROUP BY symbol HAVING count(*) < 1500".replace("SELECT * FROM sig", "SELECT * FROM sig WHERE symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 1500)"))
def _(t):
    s, ex = st.run_strategy_universe(t.bars, PLAIN, 1500)
    return s.unionByName(ex.select("symbol", F.lit(None).cast("date").alias("ts"), F.lit("EXCLUDED").alias("action"), C("sessions").cast("double").alias("price"), "reason"))


@query("backtest_strategy", "symbol:s trades:i wins:i win_rate_pct:f gross_pnl:f1 costs:f2 net_pnl:f1 avg_return_pct:f best:f2 worst:f2 max_drawdown_pct:f",
       with_rule(70, 80) + """, p AS (SELECT *, lead(ts) OVER w AS xt, lead(price) OVER w AS xp FROM sig WINDOW w AS (PARTITION BY symbol ORDER BY ts)), tr AS (SELECT symbol, ts, (xp - price) * 10 AS gross, (xp * (1 - 0.0004e0) - price * (1 + 0.0004e0)) * 10 AS net, (xp * (1 - 0.0004e0) / (price * (1 + 0.0004e0)) - 1) * 100 AS r FROM p WHERE action = 'BUY' AND xt IS NOT NULL),
       e AS (SELECT *, sum(net) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM tr), f AS (SELECT *, max(run) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM e)
       SELECT symbol, count(*) AS trades, count(*) FILTER (WHERE net > 0) AS wins, count(*) FILTER (WHERE net > 0) / count(*) * 100 AS win_rate_pct, sum(gross) AS gross_pnl, sum(gross - net) AS costs, sum(net) AS net_pnl, avg(r) AS avg_return_pct, max(net) AS best, min(net) AS worst, min(CASE WHEN peak > 0 THEN (run - peak) / peak * 100 ELSE 0 END) AS max_drawdown_pct FROM f GROUP BY symbol""")
def _(t):
    return st.backtest_summary(st.backtest_trades(st.signals(st.strategy_metrics(t.bars), STRAT), 10.0, 4.0, 2.0))


MAX_ = f"mac AS (SELECT symbol, ts, close, lag(sg, 1, 0e0) OVER w AS position FROM (SELECT symbol, ts, close, coalesce(CAST({full(20, 'avg(close)')} > {full(50, 'avg(close)')} AS DOUBLE), 0) AS sg FROM bars) {W})"
RSR = f"""{WIL}, rs0 AS (SELECT symbol, ts, close, coalesce(100 - 100 / (1 + rg14.y / nullif(rl14.y, 0)), 50) AS rsi FROM bars LEFT JOIN rg14 USING (symbol, ts) LEFT JOIN rl14 USING (symbol, ts)),
  rs1 AS (SELECT *, coalesce(last_value(CASE WHEN rsi <= 45 THEN 1e0 WHEN rsi >= 55 THEN 0e0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS sg FROM rs0), rsp AS (SELECT symbol, ts, close, rsi, lag(sg, 1, 0e0) OVER w AS position FROM rs1 {W})"""


@query("ma_crossover", "symbol:s ts:d position:f", f"WITH {MAX_} SELECT symbol, ts, position FROM mac")
def _(t):
    return st.ma_crossover(t.bars)


@query("rsi_reversion", "symbol:s ts:d rsi:f position:f", f"WITH {RSR} SELECT symbol, ts, rsi, position FROM rsp")
def _(t):
    return st.rsi_reversion(t.bars, 45, 55)


PU = "(PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def prod(r):
    return f"(CASE WHEN sum(CASE WHEN 1 + {r} = 0 THEN 1 ELSE 0 END) OVER {PU} > 0 THEN 0 ELSE exp(sum(CASE WHEN 1 + {r} <> 0 THEN ln(abs(1 + {r})) ELSE 0 END) OVER {PU}) * CASE WHEN sum(CASE WHEN 1 + {r} < 0 THEN 1 ELSE 0 END) OVER {PU} % 2 = 1 THEN -1 ELSE 1 END END)"


def eq_sql(src, n):
    return f"""{n}0 AS (SELECT *, coalesce(close / lag(close) OVER w - 1, 0) AS r, abs(position - coalesce(lag(position) OVER w, 0)) AS tn FROM {src} {W}), {n} AS (SELECT symbol, ts, close, position, 100000 * {prod('(position * r - tn * 0.001e0)')} AS se, 100000 * {prod('(position * r)')} AS ge, 100000 * {prod('r')} AS be, tn * 0.001e0 AS cost FROM {n}0)"""


@query("equity_curve", "symbol:s ts:d position:f log_strategy:f log_gross:f benchmark_equity:f2 cost_share:f6",
       f"WITH {MAX_}, {eq_sql('mac', 'eq')} SELECT symbol, ts, position, CASE WHEN se > 0 THEN ln(se) END AS log_strategy, CASE WHEN ge > 0 THEN ln(ge) END AS log_gross, be AS benchmark_equity, cost * coalesce(lag(se) OVER w, 100000) / coalesce(lag(se) OVER w, 100000) AS cost_share FROM eq {W}")
def _(t):
    d = st.equity_curve(st.ma_crossover(t.bars))
    lg = lambda c: F.when(C(c) > 0, F.log(c))
    return d.select("symbol", "ts", "position", lg("strategy_equity").alias("log_strategy"), lg("gross_equity").alias("log_gross"), "benchmark_equity", C("cost").alias("cost_share"))


@query("trade_log", "symbol:s entry_ts:d entry_price:f exit_ts:d exit_price:f open_at_end:b ret:f6",
       f"""WITH {RSR}, ch AS (SELECT *, position - coalesce(lag(position) OVER w, 0) AS c, last_value(ts) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lt, last_value(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lc FROM rsp {W}),
       ev AS (SELECT *, lead(ts) OVER w AS xt, lead(close) OVER w AS xp FROM ch WHERE c <> 0 {W}) SELECT symbol, ts AS entry_ts, close AS entry_price, coalesce(xt, lt) AS exit_ts, coalesce(xp, lc) AS exit_price, xt IS NULL AS open_at_end, coalesce(xp, lc) / close - 1 AS ret FROM ev WHERE c > 0""")
def _(t):
    return st.trade_log(st.rsi_reversion(t.bars, 45, 55)).withColumnRenamed("return", "ret")


@query("compare_strategies", "symbol:s strategy:s sharpe:f log_return:f max_drawdown:f6 rank:i",
       f"""WITH {MAX_}, {RSR}, u AS (SELECT 'ma' AS strategy, symbol, ts, close, position FROM mac UNION ALL SELECT 'rsi', symbol, ts, close, position FROM rsp), r AS (SELECT *, coalesce(close / lag(close) OVER s - 1, 0) * position AS r FROM u WINDOW s AS (PARTITION BY strategy, symbol ORDER BY ts)),
       v AS (SELECT strategy, symbol, ts, exp(sum(ln(1 + 0.01e0 * r)) OVER (PARTITION BY strategy, symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)) AS v FROM r), m AS ({perf_sql('v', ['symbol', 'strategy'], 'v')})
       SELECT symbol, strategy, sharpe, ln(1 + total_return) AS log_return, max_drawdown, rank() OVER (PARTITION BY symbol ORDER BY sharpe DESC, total_return DESC) AS rank FROM m""")
def _(t):
    sp = Span(("symbol", "strategy"), ("ts",))
    u = st.ma_crossover(t.bars).select("symbol", "ts", "close", "position", F.lit("ma").alias("strategy")).unionByName(st.rsi_reversion(t.bars, 45, 55).select("symbol", "ts", "close", "position", F.lit("rsi").alias("strategy")))
    r = u.withColumn("r", F.coalesce(C("close") / sp.lag("close") - 1, F.lit(0.0)) * C("position") * 0.01)
    v = r.withColumn("v", F.exp(F.sum(F.log1p("r")).over(sp.running)))
    return st.rank_strategies(performance_metrics(v, "v", sp)).withColumn("log_return", F.log1p("total_return"))


def forward(t):
    s = st.signals(st.strategy_metrics(t.bars), PLAIN)
    tests = t.instruments.select("symbol", F.lit(1).alias("test_id"), F.lit("1998-01-01").cast("date").alias("started")).unionByName(
        t.instruments.where("exchange = 'X1'").select("symbol", F.lit(2).alias("test_id"), F.lit("2000-01-01").cast("date").alias("started")))
    return s, tests


FWD = "tests AS (SELECT symbol, 1 AS test_id, DATE '1998-01-01' AS started FROM instruments UNION ALL SELECT symbol, 2, DATE '2000-01-01' FROM instruments WHERE exchange = 'X1'), obs AS (SELECT test_id, symbol, ts, action, price, reason FROM sig JOIN tests USING (symbol) WHERE ts >= started)"


@query("forward_events", "test_id:i symbol:s ts:d action:s price:f", with_rule(0, 0) + f", {FWD} SELECT test_id, symbol, ts, action, price FROM obs WHERE NOT (year(ts) = 1999 AND test_id = 1)", "bars instruments")
def _(t):
    s, tests = forward(t)
    old = s.where(F.year("ts") == 1999).withColumn("test_id", F.lit(1))
    return st.forward_events(s, tests, old)


@query("forward_scorecard", "test_id:i closed_trades:i wins:i win_rate_pct:f avg_return_pct:f best_return_pct:f worst_return_pct:f max_drawdown_pct:f log_compounded:f open_positions:i",
       with_rule(0, 0) + f""", {FWD}, p AS (SELECT *, lead(price) OVER w AS xp FROM obs WINDOW w AS (PARTITION BY test_id, symbol ORDER BY ts)), tr AS (SELECT *, xp / price - 1 AS r FROM p WHERE action = 'BUY'),
       q AS (SELECT *, sum(ln(1 + r)) OVER (PARTITION BY test_id ORDER BY symbol, ts ROWS UNBOUNDED PRECEDING) AS le FROM tr WHERE r IS NOT NULL), z AS (SELECT *, greatest(0, max(le) OVER (PARTITION BY test_id ORDER BY symbol, ts ROWS UNBOUNDED PRECEDING)) AS pk FROM q)
       SELECT test_id, count(*) AS closed_trades, count(*) FILTER (WHERE r > 0) AS wins, count(*) FILTER (WHERE r > 0) / count(*) * 100 AS win_rate_pct, avg(r) * 100 AS avg_return_pct, max(r) * 100 AS best_return_pct, min(r) * 100 AS worst_return_pct, min(exp(le - pk) - 1) * 100 AS max_drawdown_pct, sum(ln(1 + r)) AS log_compounded,
       (SELECT count(*) FROM tr x WHERE x.test_id = z.test_id AND x.r IS NULL) AS open_positions FROM z GROUP BY test_id""", "bars instruments")
def _(t):
    s, tests = forward(t)
    none = s.where("false").withColumn("test_id", F.lit(1))
    return st.forward_scorecard(st.forward_events(s, tests, none))


LEGS = [("call", "sell", 5.0, 1.0), ("put", "sell", -5.0, 1.0), ("call", "buy", 10.0, 1.0), ("put", "buy", -10.0, 1.0)]
G = greeks_sql("close", "k", "30", "0.2e0", "(type = 'call')")["price"]


@query("expiry_cycle_rollup", "symbol:s ts:d exit_ts:d gross:f net:f",
       f"""WITH c AS (SELECT symbol, ts, close, row_number() OVER w - 1 AS n, lead(close, 30) OVER w AS x, lead(ts, 30) OVER w AS xt FROM bars {W}), l AS (SELECT c.*, type, side, round(close * (1 + off / 100) + 1e-7, 2) AS k FROM c CROSS JOIN (VALUES ('call', 'sell', 5e0), ('put', 'sell', -5e0), ('call', 'buy', 10e0), ('put', 'buy', -10e0)) v(type, side, off) WHERE n % 20 = 0 AND x IS NOT NULL)
       SELECT symbol, ts, xt AS exit_ts, sum(CASE side WHEN 'buy' THEN 1 ELSE -1 END * (greatest(0, CASE type WHEN 'call' THEN x - k ELSE k - x END) - {G})) AS gross, sum(CASE side WHEN 'buy' THEN 1 ELSE -1 END * (greatest(0, CASE type WHEN 'call' THEN x - k ELSE k - x END) - {G})) - 5 AS net FROM l GROUP BY symbol, ts, xt""")
def _(t):
    legs = t.spark.createDataFrame(LEGS, "type string, side string, offset_pct double, contracts double")
    return st.expiry_cycle_rollup(t.bars, legs, 30, 20, 0.2, 5.0)
