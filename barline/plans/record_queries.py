"""Queries of the records of last bars: risk, indicators, signals and the fallback for short histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import record
from ..operators.evaluate import SQUEEZE_ON
from ..operators.score import HORIZONS
from ..sources.bars import derive_bars, held_bars, held_market, market
from . import indicator_sql as sql
from .backtest_queries import rounded
from .composite_queries import as_text
from .score_queries import PSAR, all_needs, score_ctes

SHOWN = ("rsi", "bbp", "stoch_k", "stoch_d", "adx", "obv", "ma_crossover", "psar", "zscore", "atr_pct", "realized_vol", "momentum", "momentum_tstat", "momentum_12_1", "linreg_r2", "dist_52wk_high", "mfi", "cmf", "obv_zscore", "vwap_dev", "rel_volume", "donchian_pos")


def risk_query(spark, sf_dir) -> DataFrame:
    got = record.risk_record(held_bars(spark, sf_dir), market(spark, sf_dir))
    return rounded(as_text(got, "calmar"), 4)


def indicators_query(spark, sf_dir) -> DataFrame:
    got = record.indicator_record(derive_bars(spark, sf_dir))
    scaled = {"macd": F.tanh(F.col("macd") / 1000), "kama": F.log10("kama"), "linreg_slope": F.tanh(F.col("linreg_slope") / 40)}
    return rounded(got.withColumns(scaled), 4)


def signals_query(spark, sf_dir) -> DataFrame:
    got = record.signal_record(held_bars(spark, sf_dir), held_market(spark, sf_dir))
    return got.select("symbol", "period", F.array_join("signals", "; ").alias("signals"))


def record_query(spark, sf_dir) -> DataFrame:
    """The whole record, a part of each struct."""
    got = record.evaluate(held_bars(spark, sf_dir), held_market(spark, sf_dir))
    parts = ("factors.trend", "regime.trend_state", "risk.beta", "risk.var_95", "indicators.rsi", "indicators.psar")
    return rounded(got.select("symbol", "date", "period", "last_price", "score", "confidence", "recommendation", *parts, F.size("signals").alias("n_signals")), 4)


def fallback_query(spark, sf_dir) -> DataFrame:
    return rounded(record.legacy_analyze(derive_bars(spark, sf_dir)), 4)


def build() -> tuple[dict, dict]:
    spans = ", ".join(f"('{n}', {h.risk}, {record.VOL_WINDOWS[n]})" for n, h in HORIZONS.items())
    risk = f"""hz AS (SELECT * FROM (VALUES {spans}) t(period, w, v)),
rr AS MATERIALIZED (SELECT b.symbol, b.date, b.close, ret, lr, rb, row_number() OVER (PARTITION BY b.symbol ORDER BY b.date DESC) AS back FROM (SELECT *, close / lag(close) OVER ({sql.BY}) - 1 AS ret, ln(close / lag(close) OVER ({sql.BY})) AS lr FROM bars) b
  LEFT JOIN (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS rb FROM mkt) m USING (date)),
own AS (SELECT symbol, period, w, v, date, back, close, ret, lr, rb, max(close) OVER (PARTITION BY symbol, period ORDER BY date) AS peak FROM rr JOIN hz ON back <= w),
cut AS (SELECT symbol, period, CASE WHEN count(ret) >= 60 THEN quantile_cont(ret, 0.05) END AS q FROM own GROUP BY ALL),
yr AS (SELECT symbol, avg(power((ret - m) / sd, 3)) AS skew, avg(power((ret - m) / sd, 4)) - 3 AS kurt FROM (SELECT symbol, ret, avg(ret) OVER (PARTITION BY symbol) AS m, stddev_pop(ret) OVER (PARTITION BY symbol) AS sd FROM rr WHERE back <= 252) GROUP BY symbol),
risk AS MATERIALIZED (SELECT o.symbol, o.period, CASE WHEN count(ret) >= 20 THEN avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252) END AS sharpe,
  CASE WHEN count(ret) >= 20 THEN avg(ret) / nullif(sqrt(avg(CASE WHEN ret < 0 THEN ret * ret END)), 0) * sqrt(252) END AS sortino, 100 * min(close / peak - 1) AS max_drawdown,
  (power(min_by(close, back) / max_by(close, back), 252.0::DOUBLE / count(*)) - 1) * 100 / nullif(abs(100 * min(close / peak - 1)), 0) AS calmar, 100 * any_value(q) AS var_95, 100 * avg(CASE WHEN ret <= q THEN ret END) AS cvar_95,
  covar_samp(ret, rb) / nullif(var_pop(rb), 0) AS beta, (avg(ret) - covar_samp(ret, rb) / nullif(var_pop(rb), 0) * avg(rb)) * 252 * 100 AS alpha, 100 * stddev_samp(CASE WHEN back <= v THEN lr END) * sqrt(252) AS ann_vol, any_value(skew) AS skew, any_value(kurt) AS kurtosis
  FROM own o JOIN cut USING (symbol, period) JOIN yr ON yr.symbol = o.symbol GROUP BY o.symbol, o.period)"""
    extra = ("bb_up", "bb_low", "don_break", "half_life126", "rel_vol", "rv21", "obv_z")
    names = tuple(dict.fromkeys((*all_needs(), *extra)))
    state = f"""g AS (SELECT *, {SQUEEZE_ON} AS squeeze_on FROM f),
g2 AS (SELECT *, coalesce(lag(squeeze_on) OVER ({sql.BY}), false) AND NOT squeeze_on AS fired, CASE WHEN macd_hist < 0 THEN 1 ELSE 0 END AS neg, CASE WHEN macd_hist > 0 THEN 1 ELSE 0 END AS pos FROM g),
last_bars AS MATERIALIZED (SELECT *, max(fired::INT) {sql.over(3)} = 1 AS fired3, max(neg) {sql.over(3)} = 1 AS below3, max(pos) {sql.over(3)} = 1 AS above3 FROM g2 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)"""
    scored = [score_ctes(h, "last_bars", f"s_{n}") for n, h in HORIZONS.items()]

    def union(columns) -> str:
        return " UNION ALL ".join(f"SELECT symbol, date, '{n}' AS period, {columns(h)} FROM s_{n}" for n, h in HORIZONS.items())

    def shown(h) -> str:
        return f"""rsi{h.rsi} AS rsi, bbp20 AS bbp, tanh(macd_hist / 1000) AS macd, stoch_k, stoch_d, adx14 AS adx, 50 + 25 * tanh(obv_z / 2) AS obv, tanh(15 * (sma{h.fast} / sma_slow{h.slow} - 1)) AS ma_crossover, (SELECT tanh(5 * (s_{h.name}.close - stop) / s_{h.name}.close) FROM stops WHERE stops.symbol = s_{h.name}.symbol AND stops.date = s_{h.name}.date) AS psar,
zscore{h.z} AS zscore, 100 * atr14 / close AS atr_pct, rv21 AS realized_vol, mom{h.mom} AS momentum, mom_tstat{h.mom} AS momentum_tstat, mom_12_1 AS momentum_12_1, log10(kama10) AS kama, tanh(linreg_slope{h.linreg} / 40) AS linreg_slope, linreg_r2_{h.linreg} AS linreg_r2,
dist_52 AS dist_52wk_high, mfi14 AS mfi, cmf20 AS cmf, obv_z AS obv_zscore, vwap_dev, rel_vol AS rel_volume, don_pos AS donchian_pos, don_break AS donchian_breakout, squeeze_on"""

    def texts(h) -> str:
        z, rsi = f"zscore{h.z}", f"rsi{h.rsi}"
        parts = [
            "CASE WHEN fired3 THEN 'volatility squeeze released ' || CASE WHEN coalesce(macd_hist / nullif(atr14, 0), 0) >= 0 THEN 'upward' ELSE 'downward' END WHEN squeeze_on THEN 'volatility squeeze building' END",
            "CASE WHEN don_break = 1 THEN 'close above the 20-bar channel' WHEN don_break = -1 THEN 'close below the 20-bar channel' END",
            f"CASE WHEN {z} <= -2 THEN printf('%.1f deviations under its mean', abs({z})) WHEN {z} >= 2 THEN printf('%.1f deviations over its mean', {z}) END",
            f"CASE WHEN {rsi} <= 30 THEN printf('RSI low at %.0f', {rsi}) WHEN {rsi} >= 70 THEN printf('RSI high at %.0f', {rsi}) END",
            "CASE WHEN dist_52 >= -1 THEN 'at its high of 52 weeks' WHEN dist_52 >= -5 THEN printf('%.1f%% off its high of 52 weeks', abs(dist_52)) WHEN dist_52 <= -40 THEN printf('%.0f%% off its high of 52 weeks', abs(dist_52)) END",
            "CASE WHEN macd_hist > 0 AND below3 THEN 'MACD turned positive' WHEN macd_hist < 0 AND above3 THEN 'MACD turned negative' END",
            "CASE WHEN trend_state = 'mean-reverting' AND half_life126 < 25 THEN printf('reverts with a half-life of %.0f bars', half_life126) WHEN trend_state = 'trending' AND hurst504 > 0.58 THEN printf('persistent, Hurst %.2f', hurst504) END",
            "CASE WHEN vol_state = 'high' THEN printf('volatile, percentile %.0f', vol_pctile) WHEN vol_state = 'low' THEN printf('calm, percentile %.0f', vol_pctile) END",
            f"(SELECT CASE WHEN beta >= 1.6 THEN printf('moves with the market by %.1f', beta) END FROM risk WHERE risk.symbol = s_{h.name}.symbol AND risk.period = '{h.name}')",
        ]
        return f"array_to_string(list_filter([{', '.join(parts)}], lambda t: t IS NOT NULL)[1:5], '; ') AS signals, len(list_filter([{', '.join(parts)}], lambda t: t IS NOT NULL)[1:5])::INT AS n_signals"

    r = lambda *c: ", ".join(f"round({x}, 4) AS {x}" for x in c)
    numbers = (*SHOWN, "macd", "kama", "linreg_slope")
    whole = ",\n".join((sql.MARKET, risk, state, *scored))
    days = ", ".join(f"('{p}', {d})" for p, d in record.FALLBACK_DAYS.items())
    queries = {"record_risk": risk_query, "record_indicators": indicators_query, "record_signals": signals_query, "record_whole": record_query, "legacy_analyze": fallback_query}
    oracles = {
        "record_risk": f"WITH {sql.BARS}, {sql.MARKET}, {risk} SELECT symbol, period, {r('sharpe', 'sortino', 'max_drawdown', 'var_95', 'cvar_95', 'beta', 'alpha', 'ann_vol', 'skew', 'kurtosis')}, CASE WHEN isfinite(calmar) THEN printf('%.3e', calmar) END AS calmar FROM risk",
        "record_indicators": sql.with_bars(names, f"SELECT symbol, date, period, {r(*numbers)}, donchian_breakout, squeeze_on FROM ({union(shown)})", True, ",\n".join((PSAR, state, *scored))),
        "record_signals": sql.with_bars(names, f"SELECT symbol, period, signals FROM ({union(texts)})", True, whole),
        "record_whole": sql.with_bars(names, f"""SELECT x.symbol, x.date, x.period, round(last_price, 4) AS last_price, round(score, 4) AS score, confidence, recommendation, trend, trend_state, round(beta, 4) AS beta, round(var_95, 4) AS var_95, round(rsi, 4) AS rsi, round(psar, 4) AS psar, n_signals
FROM ({union(lambda h: f"close AS last_price, score, confidence, recommendation, trend, trend_state, {texts(h)}, {shown(h)}")}) x JOIN risk ON risk.symbol = x.symbol AND risk.period = x.period""", True, ",\n".join((PSAR, whole))),
        "legacy_analyze": f"""WITH RECURSIVE {sql.BARS}, fd AS (SELECT * FROM (VALUES {days}) t(period, d)),
b AS MATERIALIZED (SELECT symbol, period, date, close, row_number() OVER w AS i, close - lag(close) OVER w AS df, count(*) OVER (PARTITION BY symbol, period) AS n FROM (SELECT *, max(date) OVER (PARTITION BY symbol) AS last FROM bars) JOIN fd ON date_diff('day', date, last) <= d WINDOW w AS (PARTITION BY symbol, period ORDER BY date)),
m AS (SELECT symbol, period, date, i, n, close AS e12, close AS e26, 0.0::DOUBLE AS sig FROM b WHERE i = 1
  UNION ALL SELECT b.symbol, b.period, b.date, b.i, b.n, e12 + (close - e12) * 2 / 13, e26 + (close - e26) * 2 / 27, sig + (((e12 + (close - e12) * 2 / 13) - (e26 + (close - e26) * 2 / 27)) - sig) * 2 / 10 FROM m JOIN b ON b.symbol = m.symbol AND b.period = m.period AND b.i = m.i + 1),
x AS (SELECT symbol, period, max(date) AS date, max_by(close, i) AS price, 100 - 100 / (1 + coalesce(avg(CASE WHEN i > n - 14 THEN greatest(coalesce(df, 0), 0) END) / nullif(avg(CASE WHEN i > n - 14 THEN greatest(coalesce(-df, 0), 0) END), 0), 0)) AS rsi,
  CASE WHEN any_value(n) >= 20 THEN coalesce((max_by(close, i) - avg(CASE WHEN i > n - 20 THEN close END) + 2 * stddev_samp(CASE WHEN i > n - 20 THEN close END)) / nullif(4 * stddev_samp(CASE WHEN i > n - 20 THEN close END), 0), 0.5) ELSE 0.5 END AS bbp FROM b WHERE n >= 2 GROUP BY symbol, period),
y AS (SELECT x.*, e12 - e26 - sig AS macd FROM x JOIN m USING (symbol, period) WHERE m.i = m.n)
SELECT symbol, period, date, round(price, 4) AS price, round(rsi, 4) AS rsi, round(bbp, 4) AS bbp, round(macd, 4) AS macd, round(least(100, greatest(-100, (-(rsi - 50) / 50 * 20 - (bbp - 0.5) * 30 + 20 * tanh(5 * macd)) * 0.75 * 100)), 4) AS score,
  CASE WHEN v >= 2 THEN 'BUY (Strong)' WHEN v = 1 THEN 'BUY (Weak)' WHEN v = 0 THEN 'HOLD' WHEN v = -1 THEN 'SELL (Weak)' ELSE 'SELL (Strong)' END AS recommendation
FROM (SELECT *, CASE WHEN rsi < 30 THEN 1 WHEN rsi > 70 THEN -1 ELSE 0 END + CASE WHEN bbp < 0.2 THEN 1 WHEN bbp > 0.8 THEN -1 ELSE 0 END + CASE WHEN macd > 0 THEN 1 ELSE -1 END AS v FROM y)""",
    }
    return queries, oracles
