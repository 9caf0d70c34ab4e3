"""Risk, accounting, volatility and chart-structure queries."""

import math

from pyspark.sql import functions as F

from ..operators import patterns as pt
from ..operators import risk as rk
from ..operators.indicators import with_atr
from .indicator_queries import ATR_CTES, W, ewm_sql, fr, full
from .registry import query

C = F.col
P = "(PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"
RET = f"ret AS (SELECT symbol, ts, close, close / lag(close) OVER w - 1 AS ret FROM bars {W})"


@query("price_returns", "symbol:s ts:d ret:f6", f"WITH {RET} SELECT symbol, ts, ret FROM ret WHERE ret IS NOT NULL")
def _(t):
    return rk.price_returns(t.bars)


@query("drawdown", "symbol:s ts:d drawdown:f6", f"SELECT symbol, ts, close / max(close) OVER {P} - 1 AS drawdown FROM bars")
def _(t):
    return rk.drawdown(t.bars)


@query("var_cvar", "symbol:s var:f6 cvar:f6",
       f"WITH {RET}, q AS (SELECT symbol, quantile_cont(ret, 0.05e0) AS q FROM ret WHERE ret IS NOT NULL GROUP BY symbol) SELECT symbol, greatest(0, -any_value(q)) AS var, greatest(0, -avg(ret)) AS cvar FROM ret JOIN q USING (symbol) WHERE ret <= q + 1e-15 GROUP BY symbol")
def _(t):
    return rk.var_cvar(rk.price_returns(t.bars), ["symbol"], 0.95)


def perf_sql(src, keys, val, order="ts"):
    """Metrics of each series in `src` as SQL."""
    k = ", ".join(keys)
    w = f"(PARTITION BY {k} ORDER BY {order})"
    prf = (1.06) ** (1 / 252) - 1
    s = math.sqrt(252)
    return f"""SELECT {k}, observations, v1 / v0 - 1 AS total_return, ann AS annualized_return, sd * {s!r} AS annualized_volatility, CASE WHEN sd > 0 THEN ex / sd * {s!r} ELSE 0 END AS sharpe,
  CASE WHEN down > 0 THEN ex * 252 / (sqrt(down) * {s!r}) ELSE 0 END AS sortino, mdd AS max_drawdown, CASE WHEN mdd > 0 THEN ann / mdd ELSE 0 END AS calmar, pos / n AS hit_rate, pos AS positive, neg AS negative,
  CASE WHEN losses > 0 THEN gains / losses WHEN gains > 0 THEN 9999 ELSE 0 END AS profit_factor, greatest(0, -q) AS var_95, greatest(0, -list_avg(list_filter(l, lambda r: r <= q + 1e-15))) AS cvar_95 FROM (
  SELECT *, pow(v1 / v0, 1 / greatest(n / 252, 1 / 252e0)) - 1 AS ann FROM (SELECT {k}, count(*) AS observations, count(ret) AS n, arg_min(v, {order}) AS v0, arg_max(v, {order}) AS v1, coalesce(stddev_samp(ret), 0) AS sd,
   avg(ret) - {prf!r} AS ex, avg(pow(least(ret - {prf!r}, 0), 2)) FILTER (WHERE ret IS NOT NULL) AS down, abs(min(dd)) AS mdd, count(*) FILTER (WHERE ret > 0) AS pos, count(*) FILTER (WHERE ret < 0) AS neg,
   coalesce(sum(ret) FILTER (WHERE ret > 0), 0) AS gains, coalesce(-sum(ret) FILTER (WHERE ret < 0), 0) AS losses, quantile_cont(ret, 0.05e0) AS q, list(ret) FILTER (WHERE ret IS NOT NULL) AS l
   FROM (SELECT *, v / lag(v) OVER {w} - 1 AS ret, v / max(v) OVER (PARTITION BY {k} ORDER BY {order} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM (SELECT {k}, {order}, {val} AS v FROM {src})) GROUP BY {k}) WHERE n >= 1)"""


PERF_COLS = "observations:i total_return:f annualized_return:f annualized_volatility:f sharpe:f sortino:f max_drawdown:f6 calmar:f hit_rate:f6 positive:i negative:i profit_factor:f var_95:f6 cvar_95:f6"


@query("performance_metrics", "symbol:s " + PERF_COLS, perf_sql("bars", ["symbol"], "close"))
def _(t):
    return rk.performance_metrics(t.bars)


@query("position_size", "symbol:s ts:d shares:i notional:f2 cash_risk:f2 allocation:f6 risk:f6",
       f"""SELECT symbol, ts, shares, shares * close AS notional, shares * (close - sl) AS cash_risk, shares * close / 1e6 AS allocation, shares * (close - sl) / 1e6 AS risk FROM (
       SELECT *, greatest(0, least(floor(1e6 * 0.01 / (close - sl)), floor(1e6 * 0.25 / close))) AS shares FROM (SELECT *, min(low) OVER {fr(20)} * 0.98e0 AS sl FROM bars) WHERE sl < close AND sl > 0)""")
def _(t):
    d = t.bars.select("symbol", "ts", C("close").alias("entry_price"), F.lit(1e6).alias("account_value"), (F.min("low").over(rk.S.trailing(20)) * 0.98).alias("stop_loss"))
    return rk.position_size(d)


AVERAGE_COST = """ac_t AS (SELECT *, row_number() OVER (PARTITION BY user_id, symbol ORDER BY id) AS k FROM transactions), ac_r AS (
  SELECT user_id, symbol, k, side = 'BUY' AS ok, CASE WHEN side = 'BUY' THEN shares ELSE 0e0 END AS q, CASE WHEN side = 'BUY' THEN price ELSE 0e0 END AS a FROM ac_t WHERE k = 1
  UNION ALL SELECT t.user_id, t.symbol, t.k, t.side = 'BUY' OR r.q + 1e-9 >= t.shares, CASE WHEN t.side = 'BUY' THEN r.q + t.shares WHEN r.q + 1e-9 < t.shares THEN r.q WHEN r.q - t.shares <= 1e-9 THEN 0 ELSE r.q - t.shares END,
   CASE WHEN t.side = 'BUY' THEN (r.q * r.a + t.shares * t.price) / (r.q + t.shares) WHEN r.q + 1e-9 >= t.shares AND r.q - t.shares <= 1e-9 THEN 0 ELSE r.a END FROM ac_r r JOIN ac_t t ON t.user_id = r.user_id AND t.symbol = r.symbol AND t.k = r.k + 1),
  ac AS (SELECT user_id, symbol, count(*) AS fills, count(*) FILTER (WHERE ok) AS accepted, arg_max(q, k) AS quantity, arg_max(a, k) AS average_price FROM ac_r GROUP BY user_id, symbol)"""
POS = AVERAGE_COST + ", pos AS (SELECT user_id, symbol, quantity, average_price FROM ac WHERE quantity > 0)"


def positions(t):
    """What is still held after all fills, at average cost."""
    held = rk.average_cost_positions(t.transactions, ["user_id", "symbol"], rk.FILL_ORDER, rk.fill_chunk())
    return held.where("quantity > 0").select("user_id", "symbol", "quantity", "average_price")


@query("portfolio_valuation", "user_id:i symbol:s market_value:f2 unrealized_pnl:f2 allocation_pct:f return_pct:f total_pnl:f2 total_return_pct:f",
       f"""WITH RECURSIVE {POS}, v AS (SELECT pos.*, coalesce(c, average_price) AS price FROM (FROM pos UNION ALL SELECT c_custkey, 'UNLISTED', 10e0, 1000 + c_acctbal / 100 FROM customer) pos LEFT JOIN (SELECT symbol, arg_max(close, ts) AS c FROM bars GROUP BY symbol) USING (symbol)),
       u AS (SELECT *, sum(quantity * price) OVER (PARTITION BY user_id) AS tv, sum(quantity * average_price) OVER (PARTITION BY user_id) AS tc FROM v)
       SELECT user_id, symbol, quantity * price AS market_value, (price - average_price) * quantity AS unrealized_pnl, quantity * price / tv * 100 AS allocation_pct, (price / average_price - 1) * 100 AS return_pct, tv - tc AS total_pnl, (tv / tc - 1) * 100 AS total_return_pct FROM u""", "transactions bars")
def _(t):
    last = t.bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))
    unlisted = t.raw("customer").select(C("c_custkey").alias("user_id"), F.lit("UNLISTED").alias("symbol"), F.lit(10.0).alias("quantity"), (1000 + C("c_acctbal") / 100).alias("average_price"))
    return rk.portfolio_valuation(positions(t).unionByName(unlisted), last)


@query("average_cost_positions", "user_id:i symbol:s fills:i accepted:i quantity:f average_price:f",
       f"WITH RECURSIVE {AVERAGE_COST} SELECT * FROM ac", "transactions")
def _(t):
    return rk.average_cost_positions(t.transactions, ["user_id", "symbol"], rk.FILL_ORDER, rk.fill_chunk())


@query("fifo_realized_gains", "symbol:s ts:d buy_ts:d shares_closed:f cost_basis:f2 proceeds:f2 gain:f2 return_pct:f holding_days:i unmatched_shares:f",
       """WITH t AS (SELECT *, CASE WHEN side = 'BUY' THEN shares ELSE -shares END AS d FROM transactions), s AS (SELECT *, sum(d) OVER (PARTITION BY symbol ORDER BY id ROWS UNBOUNDED PRECEDING) AS s FROM t),
       u AS (SELECT *, greatest(0, -min(s) OVER (PARTITION BY symbol ORDER BY id ROWS UNBOUNDED PRECEDING)) AS u FROM s), e AS (SELECT *, u - coalesce(lag(u) OVER (PARTITION BY symbol ORDER BY id), 0) AS un FROM u),
       f AS (SELECT *, CASE WHEN side = 'BUY' THEN shares ELSE shares - un END AS eff FROM e), c AS (SELECT *, sum(eff) OVER (PARTITION BY symbol, side ORDER BY id ROWS UNBOUNDED PRECEDING) AS hi FROM f), v AS (SELECT *, hi - eff AS lo FROM c),
       m AS (SELECT s.id, s.symbol, s.ts, s.price, s.un, least(s.hi, b.hi) - greatest(s.lo, b.lo) AS q, b.price AS bp, b.ts AS bts FROM v s JOIN v b ON b.symbol = s.symbol AND b.side = 'BUY' AND s.side = 'SELL' AND b.lo < s.hi - 1e-12 AND b.hi > s.lo + 1e-12 WHERE least(s.hi, b.hi) - greatest(s.lo, b.lo) > 1e-12)
       SELECT symbol, ts, min(bts) AS buy_ts, sum(q) AS shares_closed, sum(q * bp) AS cost_basis, sum(q) * price AS proceeds, sum(q) * price - sum(q * bp) AS gain, (sum(q) * price - sum(q * bp)) / sum(q * bp) * 100 AS return_pct,
       greatest(0, date_diff('day', min(bts), ts)) AS holding_days, un AS unmatched_shares FROM m GROUP BY id, symbol, ts, price, un""", "transactions")
def _(t):
    return rk.fifo_realized_gains(t.transactions, ["symbol"], rk.FILL_ORDER, rk.fill_chunk())


ACC = "acc AS (SELECT c_custkey AS user_id, 100000e0 AS initial, 100000 + c_acctbal AS cash, c_nationkey % 3 <> 0 AS opted_in FROM customer)"


@query("equity_leaderboard", "user_id:i equity:f2 return_pct:f",
       f"WITH RECURSIVE {POS}, {ACC} SELECT user_id, cash + coalesce(pc, 0) AS equity, ((cash + coalesce(pc, 0)) / initial - 1) * 100 AS return_pct FROM acc LEFT JOIN (SELECT user_id, sum(quantity * average_price) AS pc FROM pos GROUP BY user_id) USING (user_id) WHERE opted_in ORDER BY return_pct DESC, user_id LIMIT 25", "transactions customer")
def _(t):
    acc = t.raw("customer").select(C("c_custkey").alias("user_id"), F.lit(1e5).alias("initial"), (C("c_acctbal") + 1e5).alias("cash"), (C("c_nationkey") % 3 != 0).alias("opted_in"))
    return rk.equity_leaderboard(acc, positions(t).withColumn("lot", F.lit(1.0)), 25)


@query("milestone_counts", "user_id:i milestone:s progress:i",
       """WITH f AS (SELECT user_id, count(*) AS a, count(*) FILTER (WHERE linenumber = 3) AS b, count(*) FILTER (WHERE price > 5000) AS c FROM transactions GROUP BY user_id)
       SELECT user_id, 'FIRST_TRADE' AS milestone, a AS progress FROM f WHERE a >= 1 UNION ALL SELECT user_id, 'FIVE_TRADES', a FROM f WHERE a >= 5 UNION ALL SELECT user_id, 'FIRST_OPTION', b FROM f WHERE b >= 1 UNION ALL SELECT user_id, 'FIVE_PROFITABLE_EXITS', c FROM f WHERE c >= 5""", "transactions")
def _(t):
    return rk.milestone_counts(t.transactions.select("user_id", F.lit("FILLED").alias("status"), F.when(C("linenumber") == 3, "OPTION").otherwise("EQUITY").alias("instrument_type"), (C("price") - 5000).alias("realized_pnl")))


@query("transaction_history", "user_id:i position:i symbol:s side:s shares:f price:f ts:d", "SELECT user_id, position, symbol, side, shares, price, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS position FROM transactions) WHERE position <= 20", "transactions")
def _(t):
    return rk.transaction_history(t.transactions, rk.FILL_ORDER, 20)


@query("margin_rule", "user_id:i margin:f2 positions:i",
       """SELECT user_id, sum(shares * price * CASE WHEN linenumber % 3 = 0 THEN 1 WHEN linenumber % 3 = 1 THEN 0.18e0 WHEN side = 'BUY' THEN 1 ELSE 0.22e0 END) AS margin, count(*) AS positions FROM transactions GROUP BY user_id""", "transactions")
def _(t):
    k = C("linenumber") % 3
    kind = F.when(k == 0, "EQUITY").when(k == 1, "FUTURE").otherwise("OPTION")
    return t.transactions.groupBy("user_id").agg(F.sum(rk.margin_rule(kind, C("side"), C("shares") * C("price"))).alias("margin"), F.count("*").alias("positions"))


LR = f"lr AS (SELECT *, ln(close) - ln(lag(close) OVER w) AS lr, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS d, count(*) OVER (PARTITION BY symbol) AS n FROM bars {W})"
ANN = repr(math.sqrt(252) * 100)


@query("realized_vol", "symbol:s ts:d realized_vol:f", f"WITH {LR} SELECT symbol, ts, {full(20, 'stddev_samp(lr)', 'lr')} * {ANN} AS realized_vol FROM lr")
def _(t):
    return rk.with_log_return(t.bars).select("symbol", "ts", rk.realized_vol().alias("realized_vol"))


RANGE = f"""rng AS (SELECT symbol, greatest(0.01, sqrt(avg(hl * hl) / (4 * ln(2))) * {ANN}) AS parkinson, greatest(0.01, sqrt(greatest(0, avg(0.5 * hl * hl - (2 * ln(2) - 1) * co * co))) * {ANN}) AS garman_klass,
  greatest(0.01, sqrt(greatest(0, avg(rs))) * {ANN}) AS rogers_satchell, greatest(0.01, sqrt(greatest(0, var_samp(o) + 0.34 / (1.34 + (count(*) + 1) / (count(*) - 1)) * var_samp(co) + (1 - 0.34 / (1.34 + (count(*) + 1) / (count(*) - 1))) * avg(rs))) * {ANN}) AS yang_zhang,
  greatest(0.01, stddev_samp(cc) * {ANN}) AS close_to_close FROM (SELECT symbol, ln(high / low) AS hl, ln(close / open) AS co, ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs, ln(open / lag(close) OVER w) AS o, ln(close / lag(close) OVER w) AS cc FROM bars {W}) GROUP BY symbol)"""


@query("range_estimators", "symbol:s parkinson:f garman_klass:f rogers_satchell:f yang_zhang:f close_to_close:f", f"WITH {RANGE} SELECT * FROM rng")
def _(t):
    return rk.range_estimators(t.bars)


@query("intraday_rv", "symbol:s day:d rv:f bars:i",
       """WITH b AS (SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS ts, arg_max(price, ts) AS close FROM (SELECT 'all' AS symbol, ts, price FROM ticks) GROUP BY ALL),
       x AS (SELECT symbol, CAST(ts AS DATE) AS day, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS lr FROM b) SELECT symbol, day, sum(lr * lr) AS rv, count(*) AS bars FROM x GROUP BY symbol, day HAVING count(*) >= 75""", "ticks")
def _(t):
    from ..operators.sessions import resample_bars
    return rk.intraday_rv(resample_bars(t.ticks.withColumn("symbol", F.lit("all")), "5 minutes"))


def har_sql():
    det = "(a11*(a22*a33-a23*a23) - a12*(a12*a33-a23*a13) + a13*(a12*a23-a22*a13))"
    b1 = "(c1*(a22*a33-a23*a23) - a12*(c2*a33-a23*c3) + a13*(c2*a23-a22*c3))"
    b2 = "(a11*(c2*a33-a23*c3) - c1*(a12*a33-a23*a13) + a13*(a12*c3-c2*a13))"
    b3 = "(a11*(a22*c3-c2*a23) - a12*(a12*c3-c2*a13) + c1*(a12*a23-a22*a13))"
    return f"""h1 AS (SELECT symbol, ts, lr * lr AS rv FROM lr WHERE lr IS NOT NULL), h2 AS (SELECT symbol, ts, rv, {full(22, 'avg(rv)', 'rv')} AS m0, {full(66, 'avg(rv)', 'rv')} AS m1, {full(264, 'avg(rv)', 'rv')} AS m2 FROM h1),
  h3 AS (SELECT symbol, ts, m0, m1, m2, rv, CASE WHEN rv > 0 THEN ln(rv) END AS y, ln(lag(m0) OVER w) AS x1, ln(lag(m1) OVER w) AS x2, ln(lag(m2) OVER w) AS x3 FROM h2 WHERE m2 IS NOT NULL {W}),
  h4 AS (SELECT symbol, count(*) AS n, count(*) FILTER (WHERE rv <= 0 AND x1 IS NOT NULL) AS zeros, arg_max(rv, ts) AS rv, arg_max(ln(m0), ts) AS z1, arg_max(ln(m1), ts) AS z2, arg_max(ln(m2), ts) AS z3, avg(y) FILTER (WHERE x1 IS NOT NULL) AS my, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3,
    covar_pop(x1, x1) AS a11, covar_pop(x1, x2) AS a12, covar_pop(x1, x3) AS a13, covar_pop(x2, x2) AS a22, covar_pop(x2, x3) AS a23, covar_pop(x3, x3) AS a33, covar_pop(y, x1) AS c1, covar_pop(y, x2) AS c2, covar_pop(y, x3) AS c3 FROM h3 GROUP BY symbol HAVING count(*) >= 11),
  har AS (SELECT symbol, CASE WHEN zeros = 0 AND n >= 30 THEN sqrt(exp(my + ({b1} * (z1 - m1) + {b2} * (z2 - m2) + {b3} * (z3 - m3)) / {det})) * {ANN} ELSE rv * {ANN} END AS har_rv FROM h4)"""


@query("har_rv", "symbol:s har_rv:f3", f"WITH {LR}, {har_sql()} SELECT * FROM har")
def _(t):
    return rk.har_rv(t.bars)


EWMA = f"r2 AS (SELECT symbol, ts, lr * lr AS r2 FROM lr), ev AS ({ewm_sql('r2', 'r2', 1 - 0.94, 1)})"


@query("ewma_vol", "symbol:s ts:d ewma_vol:f", f"WITH {LR}, {EWMA} SELECT symbol, ts, sqrt(y) * {ANN} AS ewma_vol FROM bars LEFT JOIN ev USING (symbol, ts)")
def _(t):
    return rk.ewma_vol(t.bars)


COMP = f"""{LR}, {EWMA}, {RANGE}, {har_sql()}, lv AS (SELECT symbol, ts, {full(20, 'stddev_samp(lr)', 'lr')} * {ANN} AS c20, d, n FROM lr),
  mem AS (SELECT symbol, ts, c20 AS close_to_close, parkinson, garman_klass, yang_zhang, sqrt(ev.y) * {ANN} AS ewma, har_rv FROM lv JOIN ev USING (symbol, ts) JOIN rng USING (symbol) LEFT JOIN har USING (symbol) WHERE d = 1 AND n >= 30),
  comp AS (SELECT *, list_median(list_filter([c20x, parkinson, garman_klass, yang_zhang, ewma, har_rv], lambda x: x > 0)) AS expected_vol_pct FROM (SELECT *, close_to_close AS c20x FROM mem))"""


@query("composite_vol", "symbol:s close_to_close:f parkinson:f garman_klass:f yang_zhang:f ewma:f har_rv:f3 expected_vol_pct:f3 expected_range_pct:f3", f"WITH {COMP} SELECT *, expected_vol_pct * 1.28 AS expected_range_pct FROM comp")
def _(t):
    return rk.composite_vol(t.bars, 1, 0.80)


@query("vol_scorecard", "symbol:s horizon:i expected_vol_pct:f3 expected_range_pct:f3", f"WITH {COMP} SELECT symbol, h AS horizon, expected_vol_pct, expected_vol_pct * sqrt(h) AS expected_range_pct FROM comp CROSS JOIN (SELECT unnest([1, 5, 10, 20]) AS h)")
def _(t):
    return rk.vol_scorecard(t.bars)


@query("rv_percentile", "symbol:s current:f6 lo:f6 hi:f6 percentile:f6 observations:i",
       f"""WITH {RET}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS d FROM ret WHERE ret IS NOT NULL) WHERE d <= 252), v AS (SELECT symbol, ts, {full(21, 'stddev_samp(ret)', 'ret')} * sqrt(252) AS v FROM l)
       SELECT symbol, arg_max(v, ts) AS current, min(v) AS lo, max(v) AS hi, (arg_max(v, ts) - min(v)) / (max(v) - min(v)) AS percentile, count(v) AS observations FROM v GROUP BY symbol""")
def _(t):
    return rk.rv_percentile(t.bars)


@query("robust_sigma", "symbol:s ts:d sigma:f",
       f"""SELECT symbol, ts, CASE WHEN n < 3 THEN 0 WHEN greatest(md / 0.6745, sd) > 0 THEN greatest(md / 0.6745, sd) ELSE sd END AS sigma FROM (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n, quantile_cont(m, 0.5) OVER {fr(89)} AS md, stddev_pop(m) OVER {fr(89)} AS sd
       FROM (SELECT symbol, ts, abs(close - lag(close) OVER w) AS m FROM bars {W}))""")
def _(t):
    return rk.with_robust_sigma(t.bars)


@query("vol_percentile", "symbol:s ts:d vol_percentile:f6",
       f"""WITH {ATR_CTES}, p AS (SELECT symbol, ts, atr.y / close * 100 AS x FROM bars LEFT JOIN atr USING (symbol, ts)), l AS (SELECT symbol, ts, x, list(x) FILTER (WHERE x IS NOT NULL) OVER {fr(90)} AS l FROM p)
       SELECT symbol, ts, CASE WHEN len(l) >= 5 AND x IS NOT NULL THEN len(list_filter(l, lambda v: v < x)) / len(l) END AS vol_percentile FROM l""")
def _(t):
    return rk.with_vol_percentile(with_atr(t.bars).withColumn("atr_pct", C("atr") / C("close") * 100), "atr_pct")


PIV = f"""piv AS (SELECT *, n = 7 AND high >= mh AS ph, n = 7 AND low <= ml AS pl FROM (SELECT *, count(*) OVER c AS n, max(high) OVER c AS mh, min(low) OVER c AS ml, row_number() OVER w AS rn FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts), c AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)))"""


@query("pivots", "symbol:s ts:d pivot_high:b pivot_low:b", f"WITH {PIV} SELECT symbol, ts, ph AS pivot_high, pl AS pivot_low FROM piv WHERE ph OR pl")
def _(t):
    return pt.with_pivots(t.bars).where("pivot_high or pivot_low")


def dbl(flag, lev, oth, agg, cmp, name, side, n):
    return f"""{n}0 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS r FROM piv WHERE {flag}), {n}1 AS (SELECT a.symbol, a.rn AS ra, b.rn AS rb, b.ts AS ts, abs(a.{lev} - b.{lev}) / greatest(a.{lev}, b.{lev}) AS sim FROM {n}0 a JOIN {n}0 b ON a.symbol = b.symbol AND a.r = 2 AND b.r = 1 AND b.rn - a.rn >= 4),
  {n} AS (SELECT symbol, '{name}' AS pattern, '{side}' AS direction, CASE WHEN lc {cmp} nk THEN least(1, greatest(0, 1 - sim / 0.4e0) + 0.15) ELSE greatest(0, 1 - sim / 0.4e0) END AS quality, lc {cmp} nk AS confirmed, ts, nk AS level FROM
   (SELECT {n}1.symbol, any_value(sim) AS sim, any_value({n}1.ts) AS ts, {agg}(p.{oth}) FILTER (WHERE p.rn BETWEEN ra AND rb) AS nk, arg_max(p.close, p.ts) AS lc FROM {n}1 JOIN piv p USING (symbol) WHERE sim <= 0.4e0 GROUP BY {n}1.symbol))"""


def pats(tol):
    return f"{PIV}, {dbl('ph', 'high', 'low', 'min', '<', 'Double Top', 'Bearish', 'dt')}, {dbl('pl', 'low', 'high', 'max', '>', 'Double Bottom', 'Bullish', 'db')}".replace("0.4e0", tol)


PAT_COLS = "symbol:s pattern:s direction:s quality:f confirmed:b ts:d level:f"


@query("double_top_bottom", PAT_COLS, f"WITH {pats('0.4e0')} SELECT * FROM dt UNION ALL SELECT * FROM db")
def _(t):
    return pt.double_patterns(t.bars, 3, 0.4)


def tri_sql(k):
    return f"""tg{k} AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS d, count(*) OVER (PARTITION BY symbol) AS nn FROM bars), ts{k} AS (SELECT symbol, regr_slope(high, -d) / avg(close) AS h, regr_slope(low, -d) / avg(close) AS l,
  avg(high - low) FILTER (WHERE d > least(nn, {k}) - 5) AS w0, avg(high - low) FILTER (WHERE d <= 5) AS w1, max(ts) AS ts FROM tg{k} WHERE d <= {k} GROUP BY symbol),
  tri{k} AS (SELECT symbol, p AS pattern, CASE p WHEN 'Symmetrical Triangle' THEN 'Neutral / breakout pending' WHEN 'Ascending Triangle' THEN 'Bullish bias' ELSE 'Bearish bias' END AS direction, 0.45 + 0.5 * greatest(0, least(1, 1 - w1 / greatest(w0, 1e-9))) AS quality, false AS confirmed, ts, NULL AS level FROM
  (SELECT *, CASE WHEN h < -0.0002 AND l > 0.0002 THEN 'Symmetrical Triangle' WHEN abs(h) <= 0.0002 AND l > 0.0002 THEN 'Ascending Triangle' WHEN h < -0.0002 AND abs(l) <= 0.0002 THEN 'Descending Triangle' END AS p FROM ts{k}) WHERE p IS NOT NULL AND w1 < w0 * 0.85)"""


@query("triangle", "lookback:i " + PAT_COLS.replace(" level:f", ""), "WITH " + ", ".join(tri_sql(k) for k in (20, 30, 40, 60, 80, 100)) + " " + " UNION ALL ".join(f"SELECT {k} AS lookback, * FROM tri{k}" for k in (20, 30, 40, 60, 80, 100)))
def _(t):
    out = None
    for k in (20, 30, 40, 60, 80, 100):
        d = pt.triangle(t.bars, k).withColumn("lookback", F.lit(k))
        out = d if out is None else out.unionByName(d)
    return out


FVG = f"""fvg AS (SELECT * FROM (SELECT symbol, ts, CASE WHEN low > fh THEN 'Bullish Fair Value Gap' ELSE 'Bearish Fair Value Gap' END AS pattern, CASE WHEN low > fh THEN 'Bullish' ELSE 'Bearish' END AS direction, least(1, CASE WHEN low > fh THEN (low - fh) / fh ELSE (fl - high) / fl END * 20) AS quality,
  CASE WHEN low > fh THEN fh ELSE high END AS zone_low, CASE WHEN low > fh THEN low ELSE fl END AS zone_high, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rank FROM (SELECT *, lag(high, 2) OVER w AS fh, lag(low, 2) OVER w AS fl FROM bars {W}) WHERE low > fh OR high < fl))"""


@query("fair_value_gap", "symbol:s ts:d pattern:s direction:s quality:f6 zone_low:f zone_high:f rank:i", f"WITH {FVG} SELECT * FROM fvg")
def _(t):
    return pt.fair_value_gaps(t.bars)


@query("breakout", PAT_COLS + " rank:i",
       f"""WITH {pats('0.025e0')}, {tri_sql(40)}, {FVG}, bl AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS d FROM (SELECT symbol, ts, close, max(high) OVER p AS r, min(low) OVER p AS s FROM bars WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))),
       al AS (SELECT * FROM dt UNION ALL SELECT * FROM db UNION ALL SELECT * FROM tri40 UNION ALL SELECT symbol, pattern, direction, quality, true, ts, zone_low FROM fvg
       UNION ALL SELECT symbol, CASE WHEN close > r THEN 'Bullish breakout' ELSE 'Bearish breakdown' END, CASE WHEN close > r THEN 'Bullish' ELSE 'Bearish' END, least(1, 0.6 + CASE WHEN close > r THEN close / r - 1 ELSE s / close - 1 END * 20), true, ts, CASE WHEN close > r THEN r ELSE s END FROM bl WHERE d = 1 AND (close > r OR close < s))
       SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY quality DESC, pattern, ts) AS rank FROM al""")
def _(t):
    return pt.breakout(t.bars)
