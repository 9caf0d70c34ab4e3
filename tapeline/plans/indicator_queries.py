"""Indicator queries."""

from pyspark.sql import functions as F

from ..operators import indicators as ind
from .registry import query

C = F.col
W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


def fr(n):
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(n, agg, x="close"):
    return f"CASE WHEN count({x}) OVER {fr(n)} = {n} THEN {agg} OVER {fr(n)} END"


def ewm_sql(src, x, alpha, warm):
    """Direct weighted sum over all earlier values, as (symbol, ts, y)."""
    import math
    reach = math.ceil(38 / -math.log(1 - alpha))
    return f"""SELECT t.symbol, t.ts, CASE WHEN t.k >= {max(1, warm)} THEN
      sum(i.x * pow({1 - alpha!r}, t.k - i.k) * CASE WHEN i.k = 1 THEN 1e0 ELSE {alpha!r} END) END AS y
      FROM (SELECT symbol, ts, {x} AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM {src} WHERE {x} IS NOT NULL) t
      JOIN (SELECT symbol, ts, {x} AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM {src} WHERE {x} IS NOT NULL) i
        ON i.symbol = t.symbol AND i.k <= t.k AND i.k > t.k - {reach} GROUP BY t.symbol, t.ts, t.k"""


def rsi_ctes(n):
    return f"""gl{n}0 AS (SELECT symbol, ts, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM bars),
  gl{n} AS (SELECT symbol, ts, CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0e0 END AS g,
     CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0e0 END AS l FROM gl{n}0),
  rg{n} AS ({ewm_sql(f'gl{n}', 'g', 1 / n, n)}), rl{n} AS ({ewm_sql(f'gl{n}', 'l', 1 / n, n)}),
  rsi{n} AS (SELECT symbol, ts, CASE WHEN rg{n}.y IS NULL THEN NULL WHEN rg{n}.y = 0 AND rl{n}.y = 0 THEN 50 WHEN rg{n}.y = 0 THEN 0
     WHEN rl{n}.y = 0 THEN 100 ELSE 100 - 100 / (1 + rg{n}.y / rl{n}.y) END AS y FROM rg{n} JOIN rl{n} USING (symbol, ts))"""


MACD_CTES = f"""mf AS ({ewm_sql('bars', 'close', 2 / 13, 12)}), ms AS ({ewm_sql('bars', 'close', 2 / 27, 26)}),
  mm AS (SELECT symbol, ts, mf.y - ms.y AS macd FROM mf JOIN ms USING (symbol, ts)),
  mg AS ({ewm_sql('mm', 'macd', 2 / 10, 9)}),
  macd AS (SELECT symbol, ts, macd, y AS macd_signal, macd - y AS macd_histogram FROM mm LEFT JOIN mg USING (symbol, ts))"""

TR = "greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w))"
ATR_CTES = f"""tr AS (SELECT symbol, ts, {TR} AS x FROM bars {W}), atr AS ({ewm_sql('tr', 'x', 1 / 14, 14)})"""

ADX_CTES = f"""dm0 AS (SELECT symbol, ts, high - lag(high) OVER w AS up, lag(low) OVER w - low AS dn FROM bars {W}),
  dm AS (SELECT symbol, ts, CASE WHEN up > dn AND up > 0 THEN up ELSE 0e0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0e0 END AS m FROM dm0),
  ep AS ({ewm_sql('dm', 'p', 1 / 14, 14)}), em AS ({ewm_sql('dm', 'm', 1 / 14, 14)}),
  di AS (SELECT symbol, ts, 100 * ep.y / nullif(atr.y, 0) AS plus_di, 100 * em.y / nullif(atr.y, 0) AS minus_di
     FROM ep JOIN em USING (symbol, ts) JOIN atr USING (symbol, ts)),
  dx AS (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS x FROM di),
  ea AS ({ewm_sql('dx', 'x', 1 / 14, 14)}),
  adx AS (SELECT symbol, ts, ea.y AS adx, plus_di, minus_di FROM di LEFT JOIN ea USING (symbol, ts))"""

ANNUAL_CASE = """CASE WHEN m IS NULL OR n < 3 THEN 252 WHEN m <= 2 THEN 252*375 WHEN m <= 7 THEN 252*75 WHEN m <= 20 THEN 252*25
  WHEN m <= 90 THEN 252*6.25 WHEN m <= 300 THEN 252*1.55 WHEN m <= 1800 THEN 252 ELSE 52 END"""
ANNUAL_CTE = f"""ann AS (SELECT symbol, m, CAST({ANNUAL_CASE} AS DOUBLE) AS periods FROM (SELECT symbol, quantile_cont(g, 0.5) AS m, count(*) AS n FROM
  (SELECT symbol, CAST(date_diff('minute', lag(ts) OVER (PARTITION BY symbol ORDER BY ts), ts) AS DOUBLE) AS g FROM bars) GROUP BY symbol))"""


@query("sma", "symbol:s ts:d sma_20:f sma_50:f", f"SELECT symbol, ts, {full(20, 'avg(close)')} AS sma_20, {full(50, 'avg(close)')} AS sma_50 FROM bars")
def _(t):
    return t.bars.select("symbol", "ts", ind.sma(20).alias("sma_20"), ind.sma(50).alias("sma_50"))


@query("ema", "symbol:s ts:d ema_12:f ema_50:f",
       f"SELECT symbol, ts, a.y AS ema_12, b.y AS ema_50 FROM ({ewm_sql('bars', 'close', 2 / 13, 12)}) a JOIN ({ewm_sql('bars', 'close', 2 / 51, 50)}) b USING (symbol, ts)")
def _(t):
    return ind.with_ema(t.bars, (12, 50))


@query("rsi", "symbol:s ts:d rsi_14:f", f"WITH {rsi_ctes(14)} SELECT symbol, ts, y AS rsi_14 FROM bars LEFT JOIN rsi14 USING (symbol, ts)")
def _(t):
    return ind.with_rsi(t.bars)


@query("macd", "symbol:s ts:d macd:f macd_signal:f macd_histogram:f", f"WITH {MACD_CTES} SELECT * FROM macd")
def _(t):
    return ind.with_macd(t.bars)


@query("bollinger", "symbol:s ts:d bb_upper:f bb_middle:f bb_lower:f",
       f"""SELECT symbol, ts, m + 2 * s AS bb_upper, m AS bb_middle, m - 2 * s AS bb_lower FROM
       (SELECT symbol, ts, {full(20, 'avg(close)')} AS m, {full(20, 'stddev_pop(close)')} AS s FROM bars)""")
def _(t):
    return t.bars.select("symbol", "ts", *[c.alias(k) for k, c in ind.bollinger().items()])


@query("true_range", "symbol:s ts:d true_range:f", f"SELECT symbol, ts, {TR} AS true_range FROM bars {W}")
def _(t):
    return t.bars.select("symbol", "ts", ind.true_range().alias("true_range"))


@query("atr", "symbol:s ts:d atr:f", f"WITH {ATR_CTES} SELECT symbol, ts, y AS atr FROM atr")
def _(t):
    return ind.with_atr(t.bars)


@query("roc", "symbol:s ts:d roc_12:f", f"SELECT symbol, ts, (close - lag(close, 12) OVER w) / nullif(lag(close, 12) OVER w, 0) * 100 AS roc_12 FROM bars {W}")
def _(t):
    return t.bars.select("symbol", "ts", ind.roc(12).alias("roc_12"))


OBV = f"SELECT symbol, ts, sum(s) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS obv FROM (SELECT symbol, ts, coalesce(sign(close - lag(close) OVER w), 0) * volume AS s FROM bars {W})"


@query("obv", "symbol:s ts:d obv:f2", OBV)
def _(t):
    return ind.with_obv(t.bars)


STOCH = f"""SELECT symbol, ts, stoch_k, CASE WHEN count(stoch_k) OVER {fr(3)} = 3 THEN avg(stoch_k) OVER {fr(3)} END AS stoch_d FROM (
  SELECT symbol, ts, CASE WHEN hi = lo THEN 50e0 ELSE (close - lo) / (hi - lo) * 100 END AS stoch_k FROM (
  SELECT symbol, ts, close, {full(14, 'max(high)')} AS hi, {full(14, 'min(low)')} AS lo FROM bars))"""


@query("stochastic", "symbol:s ts:d stoch_k:f stoch_d:f", STOCH)
def _(t):
    return ind.with_stochastic(t.bars)


@query("daily_return", "symbol:s ts:d daily_return:f", f"SELECT symbol, ts, (close / nullif(lag(close) OVER w, 0) - 1) * 100 AS daily_return FROM bars {W}")
def _(t):
    return t.bars.select("symbol", "ts", (ind.change() * 100).alias("daily_return"))


VOL = f"""SELECT symbol, ts, ret, {', '.join(f"{full(n, 'stddev_pop(ret)', 'ret')} * sqrt(periods) * 100 AS volatility_{n}" for n in (5, 10, 20, 30, 60))}
  FROM (SELECT symbol, ts, close / lag(close) OVER w - 1 AS ret FROM bars {W}) JOIN ann USING (symbol)"""


@query("volatility", "symbol:s ts:d volatility_20:f", f"WITH {ANNUAL_CTE} {VOL}")
def _(t):
    return ind.with_volatility(t.bars)


@query("annualisation_factor", "symbol:s median_gap:f periods:f", f"WITH {ANNUAL_CTE} SELECT symbol, m AS median_gap, periods FROM ann")
def _(t):
    return ind.annualisation(t.bars)


@query("traded_volume_flag", "symbol:s has_volume:b", "SELECT symbol, bool_or(volume > 0) AS has_volume FROM bars GROUP BY symbol")
def _(t):
    return ind.traded_volume_flag(t.bars)


VWAP = "SELECT symbol, ts, sum((high + low + close) / 3 * volume) OVER p / nullif(sum(volume) OVER p, 0) AS vwap FROM bars WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"


@query("vwap", "symbol:s ts:d vwap:f", VWAP)
def _(t):
    return ind.with_vwap(t.bars)


CMF = f"""SELECT symbol, ts, {full(20, 'sum(coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume)')}
  / nullif(sum(volume) OVER {fr(20)}, 0) AS cmf FROM bars"""


@query("cmf", "symbol:s ts:d cmf:f", CMF)
def _(t):
    return ind.with_cmf(t.bars)


MFI = f"""SELECT symbol, ts, CASE WHEN p IS NULL THEN NULL WHEN p = 0 THEN 0 WHEN n = 0 THEN 100 ELSE 100 - 100 / (1 + p / n) END AS mfi FROM (
  SELECT symbol, ts, {full(14, 'sum(CASE WHEN d > 0 THEN tp * volume ELSE 0 END)', 'tp')} AS p,
  {full(14, 'sum(CASE WHEN d < 0 THEN tp * volume ELSE 0 END)', 'tp')} AS n FROM (
  SELECT *, tp - lag(tp) OVER w AS d FROM (SELECT symbol, ts, volume, (high + low + close) / 3 AS tp FROM bars) {W}))"""


@query("mfi", "symbol:s ts:d mfi:f", MFI)
def _(t):
    return ind.with_mfi(t.bars)


@query("adx", "symbol:s ts:d adx:f plus_di:f minus_di:f", f"WITH {ATR_CTES}, {ADX_CTES} SELECT * FROM adx")
def _(t):
    return ind.with_adx(t.bars)


CCI = f"""SELECT symbol, ts, CASE WHEN m IS NOT NULL THEN (tp - m) / nullif(0.015e0 * list_sum(list_transform(l, lambda x: abs(x - m))) / 20, 0) END AS cci FROM (
  SELECT symbol, ts, tp, {full(20, 'avg(tp)', 'tp')} AS m, list(tp) OVER {fr(20)} AS l FROM (SELECT symbol, ts, (high + low + close) / 3 AS tp FROM bars))"""


@query("cci", "symbol:s ts:d cci:f", CCI)
def _(t):
    return ind.with_cci(t.bars)


@query("williams_r", "symbol:s ts:d williams_r:f", f"SELECT symbol, ts, -100 * (h - close) / nullif(h - l, 0) AS williams_r FROM (SELECT symbol, ts, close, {full(14, 'max(high)')} AS h, {full(14, 'min(low)')} AS l FROM bars)")
def _(t):
    return t.bars.select("symbol", "ts", ind.williams_r().alias("williams_r"))


@query("donchian", "symbol:s ts:d donchian_upper:f donchian_middle:f donchian_lower:f",
       f"SELECT symbol, ts, h AS donchian_upper, (h + l) / 2 AS donchian_middle, l AS donchian_lower FROM (SELECT symbol, ts, {full(20, 'max(high)')} AS h, {full(20, 'min(low)')} AS l FROM bars)")
def _(t):
    return t.bars.select("symbol", "ts", *[c.alias(k) for k, c in ind.donchian().items()])


PANEL_EMAS = ", ".join(f"ema{n} AS ({ewm_sql('bars', 'close', 2 / (n + 1), n)})" for n in (10, 20, 50, 100))
PANEL_SQL = f"""WITH {ANNUAL_CTE}, {PANEL_EMAS}, {', '.join(rsi_ctes(n) for n in (7, 14, 21))}, {MACD_CTES}, {ATR_CTES}, {ADX_CTES},
  stoch AS ({STOCH}), obv AS ({OBV}), vw AS ({VWAP}), cmf AS ({CMF}), mfi AS ({MFI}), cci AS ({CCI}), vol AS ({VOL}),
  base AS (SELECT *, {', '.join(f"{full(n, 'avg(close)')} AS sma_{n}" for n in (10, 20, 50, 100, 200))},
    {full(20, 'stddev_pop(close)')} AS sd, {full(20, 'max(high)')} AS dh, {full(20, 'min(low)')} AS dl, {full(14, 'max(high)')} AS wh,
    {full(14, 'min(low)')} AS wl, {full(20, 'avg(volume)')} AS vs, {full(20, 'stddev_pop(volume)')} AS vd, {full(20, 'max(close)')} AS m20,
    {full(60, 'max(close)')} AS m60, lag(close) OVER w AS pc, lag(volume) OVER w AS pv,
    {', '.join(f'lag(close, {n}) OVER w AS c{n}' for n in (2, 5, 10, 12, 20, 60))} FROM bars {W})
  SELECT b.symbol, b.ts, sma_10, sma_20, sma_50, sma_100, sma_200, {', '.join(f'ema{n}.y AS ema_{n}' for n in (10, 20, 50, 100))},
    {', '.join(f'rsi{n}.y AS rsi_{n}' for n in (7, 14, 21))}, macd.macd, macd_signal, macd_histogram, sma_20 + 2 * sd AS bb_upper, sma_20 - 2 * sd AS bb_lower,
    4 * sd / sma_20 * 100 AS bb_width, atr.y AS atr, atr.y / close * 100 AS atr_pct, (close - c12) / c12 * 100 AS roc_12, obv.obv, stoch_k, stoch_d, vwap, cmf.cmf, mfi.mfi,
    adx.adx, plus_di, minus_di, cci.cci, -100 * (wh - close) / nullif(wh - wl, 0) AS williams_r, dh AS donchian_upper, (dh + dl) / 2 AS donchian_middle,
    dl AS donchian_lower, (close - dl) / nullif(dh - dl, 0) AS donchian_position, ret * 100 AS daily_return,
    {', '.join(f'(close / c{n} - 1) * 100 AS return_{n}' for n in (2, 5, 10, 20, 60))}, {', '.join(f'close - c{n} AS momentum_{n}' for n in (5, 10, 20))},
    volatility_5, volatility_10, volatility_20, volatility_30, volatility_60, (volume / pv - 1) * 100 AS volume_change, volume / vs AS volume_ratio_20,
    (volume - vs) / nullif(vd, 0) AS volume_zscore_20, (high - low) / close * 100 AS range_pct, (open / pc - 1) * 100 AS gap_pct,
    (close / sma_20 - 1) * 100 AS close_to_sma20_pct, (close / sma_50 - 1) * 100 AS close_to_sma50_pct,
    CASE WHEN high = low THEN 0.5e0 ELSE (close - low) / (high - low) END AS close_location,
    {full(20, 'skewness(ret)', 'ret')} AS return_skew_20, {full(20, 'kurtosis(ret)', 'ret')} AS return_kurt_20,
    close / m20 - 1 AS drawdown_20, close / m60 - 1 AS drawdown_60, (close / vwap - 1) * 100 AS close_to_vwap_pct,
    coalesce(close > sma_20, false) AS above_sma20, coalesce(close > sma_50, false) AS above_sma50, coalesce(sma_50 > sma_200, false) AS golden_cross
  FROM base b {' '.join(f'LEFT JOIN {t} USING (symbol, ts)' for t in ['ema10', 'ema20', 'ema50', 'ema100', 'rsi7', 'rsi14', 'rsi21', 'macd', 'atr', 'adx', 'stoch', 'obv', 'vw', 'cmf', 'mfi', 'cci', 'vol'])}"""
PANEL_COLS = """symbol:s ts:d sma_10:f sma_20:f sma_50:f sma_100:f sma_200:f ema_10:f ema_20:f ema_50:f ema_100:f rsi_7:f rsi_14:f rsi_21:f macd:f
 macd_signal:f macd_histogram:f bb_upper:f bb_lower:f bb_width:f atr:f atr_pct:f roc_12:f obv:f2 stoch_k:f stoch_d:f vwap:f cmf:f mfi:f adx:f plus_di:f
 minus_di:f cci:f williams_r:f donchian_upper:f donchian_middle:f donchian_lower:f donchian_position:f daily_return:f return_2:f return_5:f return_10:f
 return_20:f return_60:f momentum_5:f momentum_10:f momentum_20:f volatility_5:f volatility_10:f volatility_20:f volatility_30:f volatility_60:f
 volume_change:f volume_ratio_20:f volume_zscore_20:f range_pct:f gap_pct:f close_to_sma20_pct:f close_to_sma50_pct:f close_location:f
 return_skew_20:f return_kurt_20:f drawdown_20:f drawdown_60:f close_to_vwap_pct:f above_sma20:b above_sma50:b golden_cross:b"""


@query("indicator_panel", PANEL_COLS, PANEL_SQL)
def _(t):
    return ind.panel(t.bars)


LAST_CTES = f"""ema20 AS ({ewm_sql('bars', 'close', 2 / 21, 20)}), {rsi_ctes(14)}, {MACD_CTES},
  lb AS (SELECT b.*, ema20.y AS ema_20, rsi14.y AS rsi_14, macd, macd_signal FROM
    (SELECT *, {full(20, 'avg(close)')} AS sma_20, {full(50, 'avg(close)')} AS sma_50, lag(close) OVER w AS pc,
      row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS d FROM bars {W}) b
    LEFT JOIN ema20 USING (symbol, ts) LEFT JOIN rsi14 USING (symbol, ts) LEFT JOIN macd USING (symbol, ts) WHERE d = 1)"""


@query("technical_signal", "symbol:s ts:d score:i signal:s",
       f"""WITH {LAST_CTES} SELECT *, CASE WHEN score >= 3 THEN 'STRONG BUY' WHEN score >= 1 THEN 'BUY' WHEN score <= -3 THEN 'STRONG SELL'
       WHEN score <= -1 THEN 'SELL' ELSE 'NEUTRAL' END AS signal FROM (SELECT symbol, ts,
       CASE WHEN sma_20 IS NULL THEN 0 WHEN close > sma_20 THEN 1 ELSE -1 END + CASE WHEN sma_50 IS NULL THEN 0 WHEN sma_20 > sma_50 THEN 1 ELSE -1 END
       + CASE WHEN rsi_14 IS NULL THEN 0 WHEN rsi_14 >= 70 THEN -1 WHEN rsi_14 >= 50 THEN 1 WHEN rsi_14 > 30 THEN -1 ELSE 1 END
       + CASE WHEN macd_signal IS NULL THEN 0 WHEN macd > macd_signal THEN 1 ELSE -1 END AS score FROM lb)""")
def _(t):
    return ind.technical_signal(t.bars)


@query("indicator_status", "symbol:s ts:d rsi_status:s macd_status:s sma_status:s ema_status:s score:i overall:s",
       f"""WITH {LAST_CTES} SELECT *, CASE WHEN score >= 75 THEN '{ind.STATUS['buy']}' WHEN score >= 50 THEN '{ind.STATUS['hold']}' ELSE '{ind.STATUS['sell']}' END AS overall FROM (
       SELECT symbol, ts, CASE WHEN rsi_14 IS NULL THEN '{ind.NO_DATA}' WHEN rsi_14 < 30 THEN '{ind.STATUS['oversold']}' WHEN rsi_14 > 70 THEN '{ind.STATUS['overbought']}' ELSE '{ind.STATUS['neutral']}' END AS rsi_status,
       CASE WHEN macd_signal IS NULL THEN '{ind.NO_DATA}' WHEN macd > macd_signal THEN '{ind.STATUS['bull']}' ELSE '{ind.STATUS['bear']}' END AS macd_status,
       CASE WHEN sma_50 IS NULL THEN '{ind.NO_DATA}' WHEN sma_20 > sma_50 THEN '{ind.STATUS['bull']}' ELSE '{ind.STATUS['bear']}' END AS sma_status,
       CASE WHEN ema_20 IS NULL THEN '{ind.NO_DATA}' WHEN close > ema_20 THEN '{ind.STATUS['above']}' ELSE '{ind.STATUS['below']}' END AS ema_status,
       CASE WHEN rsi_14 < 30 THEN 25 WHEN rsi_14 <= 60 THEN 15 ELSE 0 END + CASE WHEN macd > macd_signal THEN 25 ELSE 0 END
       + CASE WHEN sma_20 > sma_50 THEN 25 ELSE 0 END + CASE WHEN close > ema_20 THEN 25 ELSE 0 END AS score FROM lb)""")
def _(t):
    return ind.indicator_status(t.bars)


@query("quote_snapshot", "symbol:s ts:d close:f previous_close:f change:f change_pct:f rsi_14:f macd:f macd_signal:f sma_20:f sma_50:f vwap:f volatility_20:f",
       f"""WITH {LAST_CTES}, {ANNUAL_CTE}, vw AS ({VWAP}), vol AS ({VOL}) SELECT symbol, ts, close, pc AS previous_close, close - pc AS change, (close - pc) / pc * 100 AS change_pct,
       rsi_14, macd, macd_signal, sma_20, sma_50, vwap, volatility_20 FROM lb JOIN vw USING (symbol, ts) JOIN vol USING (symbol, ts)""")
def _(t):
    return ind.quote_snapshot(t.bars)
