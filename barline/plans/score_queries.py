"""Queries over the scores: every bar of each horizon, the scan of last bars, and its cross-sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import add
from ..functions.recursive import add_recursive
from ..operators import cross
from ..operators.score import HORIZONS, LOOK_BACK, SLEEVES, WEIGHTS, Horizon, features, legacy_score, manual_vote, scan, score, tilted
from ..sources.bars import derive_bars
from . import indicator_sql as sql

#: mean of what isn't null, within -1 and 1; 0 if nothing is (least and greatest skip nulls, so the guard stands inside)
MEAN = "least(1, greatest(-1, coalesce(list_avg(list_filter([{}], lambda v: v IS NOT NULL)), 0)))"


def clip(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN least(1, greatest(-1, {x})) END"


def score_ctes(h: Horizon, source: str = "f", out: str = "s", weights: dict | None = None) -> str:
    """CTEs from a table with features to one with sleeves, states, score and confidence."""
    w = tilted(weights or WEIGHTS, h.tilt)

    def mean(*parts: str) -> str:
        return f"round({MEAN.format(', '.join(parts))}, 3)"

    momentum = [f"tanh(mom_tstat{h.mom} / 2.5)", f"tanh(mom{h.mom} * 3 * sqrt(252.0 / {h.mom}))", "tanh(2 * macd_hist / nullif(atr14, 0))", clip("1 + dist_52 / 25")]
    if h.use_12_1:
        momentum.append("tanh(2 * mom_12_1)")
    state = {k: "CASE trend_state " + " ".join(f"WHEN '{s}' THEN {row[k]!r}::DOUBLE" for s, row in w.items()) + " END" for k in SLEEVES}
    agree = " + ".join(f"CASE WHEN abs({k}) < 0.05 THEN 0.5 * ({state[k]}) WHEN sign({k}) = sign(score) OR score = 0 THEN ({state[k]}) ELSE 0 END" for k in SLEEVES)
    return f"""{out}1 AS (SELECT *,
  coalesce(2.5 * (hurst504 - 0.5), 0) + coalesce((adx14 - 22) / 25, 0) + coalesce(er{h.er} - 0.30, 0) + coalesce(0.5 * (variance_ratio - 1), 0) AS evidence,
  CASE WHEN vol_pctile IS NULL THEN 'unknown' WHEN vol_pctile >= 80 THEN 'high' WHEN vol_pctile <= 20 THEN 'low' ELSE 'normal' END AS vol_state,
  {mean(f"tanh(15 * (sma{h.fast} / sma_slow{h.slow} - 1))", "tanh(10 * (close / kama10 - 1))", f"tanh(linreg_slope{h.linreg} / 40) * linreg_r2_{h.linreg}", "0.8 * don_pos")} AS trend,
  {mean(*momentum)} AS momentum,
  {mean(f"-tanh(zscore{h.z} / 2)", clip(f"-(rsi{h.rsi} - 50) / 50"), clip("-(bbp20 - 0.5) * 2"), clip("-((stoch_k + stoch_d) / 2 - 50) / 50"))} AS mean_reversion,
  {mean(clip("(mfi14 - 50) / 50"), "tanh(4 * cmf20)", "tanh(obv_z / 2)", "tanh(1.5 * vwap_dev / coalesce(nullif(100 * atr14 / close, 0), 2))")} AS volume_flow,
  {mean(f"tanh(sharpe{h.risk} / 1.5)", clip(f"1 + max_drawdown{h.risk} / 25"), "(50 - vol_pctile) / 100")} AS quality
FROM {source}),
{out}2 AS (SELECT *, CASE WHEN evidence > 0.40 THEN 'trending' WHEN evidence < -0.35 THEN 'mean-reverting' ELSE 'mixed' END AS trend_state FROM {out}1),
{out}3 AS (SELECT *, least(100, greatest(-100, 100 * ({" + ".join(f"({state[k]}) * {k}" for k in SLEEVES)}) * CASE WHEN vol_pctile >= 85 THEN 0.8 ELSE 1 END)) AS score FROM {out}2),
{out} AS (SELECT *, CAST(round_even(round(100 * ({agree}), 6), 0) AS INT) AS confidence,
  CASE WHEN score >= 40 THEN 'BUY (Strong)' WHEN score >= 15 THEN 'BUY (Weak)' WHEN score > -15 THEN 'HOLD' WHEN score > -40 THEN 'SELL (Weak)' ELSE 'SELL (Strong)' END AS recommendation
FROM {out}3)"""


def all_needs() -> tuple[str, ...]:
    return tuple(dict.fromkeys(n for h in HORIZONS.values() for n in h.needs()))


COLUMNS = ", ".join((*SLEEVES, "trend_state", "vol_state", "confidence", "recommendation"))


def scan_sql(select: str, more: str = "") -> str:
    last = "last_bars AS MATERIALIZED (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1)"
    parts = [score_ctes(h, "last_bars", f"s_{n}") for n, h in HORIZONS.items()]
    union = " UNION ALL ".join(f"SELECT symbol, sector, date, '{n}' AS period, {COLUMNS}, evidence, score FROM s_{n}" for n in HORIZONS)
    return sql.with_bars(all_needs(), select, True, ",\n".join([last, *parts, f"scan AS MATERIALIZED ({union})"]) + (f",\n{more}" if more else ""))


RANKED = """ranked AS MATERIALIZED (SELECT *, CASE WHEN n <= 1 THEN 5 ELSE CAST(least(10, greatest(1, floor((100 - 100 * (rk + (ties - 1) / 2.0::DOUBLE) / n) / 10) + 1)) AS INT) END AS rank
  FROM (SELECT *, count(*) OVER (PARTITION BY period) AS n, rank() OVER (PARTITION BY period ORDER BY score) AS rk, count(*) OVER (PARTITION BY period, score) AS ties FROM scan))"""
#: A cheap earlier ranking to compare with: by the 21-bar change of the closes 63 bars before the last one.
BEFORE = """before AS (SELECT symbol, period, CAST(least(10, greatest(1, floor((100 - 100 * (rk + (ties - 1) / 2.0::DOUBLE) / n) / 10) + 1)) AS INT) AS rank
  FROM (SELECT symbol, period, count(*) OVER (PARTITION BY period) AS n, rank() OVER (PARTITION BY period ORDER BY m) AS rk, count(*) OVER (PARTITION BY period, m) AS ties
    FROM (SELECT symbol, mom21 AS m FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 64) CROSS JOIN (SELECT DISTINCT period FROM scan)))"""


#: Stop-and-reverse points over each symbol's last 252 bars, bar by bar: up, the next stop before the turn is tested, extreme and step.
PSAR = """tail AS MATERIALIZED (SELECT symbol, date, high, low, row_number() OVER w AS i, lag(high) OVER w AS h1, lag(high, 2) OVER w AS h2, lag(low) OVER w AS l1, lag(low, 2) OVER w AS l2
  FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 252) WINDOW w AS (PARTITION BY symbol ORDER BY date)),
stops AS (
  SELECT symbol, date, i, true AS up, low AS stop, high AS ep, 0.02::DOUBLE AS af FROM tail WHERE i = 1
  UNION ALL
  SELECT symbol, date, i, CASE WHEN up THEN low >= s ELSE high > s END AS up,
    CASE WHEN (up AND low < s) OR (NOT up AND high > s) THEN ep ELSE s END AS stop,
    CASE WHEN up AND low < s THEN low WHEN up THEN greatest(high, ep) WHEN high > s THEN high ELSE least(low, ep) END AS ep,
    CASE WHEN (up AND low < s) OR (NOT up AND high > s) THEN 0.02::DOUBLE WHEN (up AND high > ep) OR (NOT up AND low < ep) THEN least(af + 0.02::DOUBLE, 0.2::DOUBLE) ELSE af END AS af
  FROM (SELECT t.*, p.up, p.ep, p.af, CASE WHEN p.up THEN least(p.stop + p.af * (p.ep - p.stop), l1, l2) ELSE greatest(p.stop + p.af * (p.ep - p.stop), h1, CASE WHEN t.i > 2 THEN h2 END) END AS s
    FROM (SELECT * REPLACE (CASE WHEN i > 2 THEN l1 END AS l1, CASE WHEN i > 2 THEN h1 END AS h1) FROM tail) t JOIN stops p ON p.symbol = t.symbol AND t.i = p.i + 1)
)"""


def _scan(spark, sf_dir) -> DataFrame:
    return scan(derive_bars(spark, sf_dir))


def _ranked(spark, sf_dir) -> DataFrame:
    return cross.percentile_rank(_scan(spark, sf_dir))


def scan_query(spark, sf_dir) -> DataFrame:
    return _scan(spark, sf_dir).withColumns({"score": F.round("score", 5), "evidence": F.round("evidence", 5)})


def score_query(h: Horizon):
    def run(spark, sf_dir) -> DataFrame:
        table = score(features(derive_bars(spark, sf_dir), h), h)
        return table.select("symbol", "date", *SLEEVES, "trend_state", "vol_state", "confidence", F.round("score", 5).alias("score"))

    text = sql.with_bars(h.needs(), f"SELECT symbol, date, {', '.join(SLEEVES)}, trend_state, vol_state, confidence, round(score, 5) AS score FROM s", True, score_ctes(h))
    return run, text


def ranks_query(spark, sf_dir) -> DataFrame:
    return _ranked(spark, sf_dir).select("symbol", "period", "rank", cross.rank_label(F.col("rank")).alias("label"))


def percentiles_query(spark, sf_dir) -> DataFrame:
    return cross.percentiles(_scan(spark, sf_dir)).select("symbol", "period", "universe_pct", "sector_pct")


def _before(spark, sf_dir, periods: DataFrame) -> DataFrame:
    bars = add(derive_bars(spark, sf_dir), "mom21").withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))))
    old = bars.where("back = 64").select("symbol", F.col("mom21").alias("m"), F.explode(F.array(*map(F.lit, HORIZONS))).alias("period"))
    return cross.percentile_rank(old, "m").select("symbol", "period", "rank")


def movers_query(spark, sf_dir) -> DataFrame:
    now = _ranked(spark, sf_dir)
    return cross.movers(now, _before(spark, sf_dir, now))


def filter_query(spark, sf_dir) -> DataFrame:
    return cross.filtered(_ranked(spark, sf_dir), only_buys=True, ranks_above=4).select("symbol", "period", "rank", "recommendation")


def actions_query(spark, sf_dir) -> DataFrame:
    return cross.actions(_ranked(spark, sf_dir))


def legacy_query(spark, sf_dir) -> DataFrame:
    """The old score of each symbol's last 252 bars: as far as its stop-and-reverse points reach."""
    bars = add(add_recursive(derive_bars(spark, sf_dir), last=LOOK_BACK), "rsi14", "bbp20", "stoch_k", "stoch_d", "adx14", "obv_scaled", "ma_crossover")
    bars = bars.withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))).where("back <= 252")
    return bars.select("symbol", "date", F.round("psar_score", 5).alias("psar_score"), F.round(legacy_score(), 4).alias("legacy_score"), manual_vote().alias("vote"))


def scan_min_query(spark, sf_dir) -> DataFrame:
    """Source, windows, cross-section and labels in one: the smallest whole scan."""
    from ..operators.score import latest

    table = latest(add(derive_bars(spark, sf_dir), "zscore20", "rsi14", "mom21")).withColumn("period", F.lit("1m"))
    ranked = cross.percentile_rank(table, "mom21")
    return ranked.select("symbol", "date", F.round("zscore20", 5).alias("zscore20"), F.round("rsi14", 5).alias("rsi14"), F.round("mom21", 5).alias("mom21"), "rank", cross.rank_label(F.col("rank")).alias("label"))


def build() -> tuple[dict, dict]:
    label = "CASE WHEN rank = 1 THEN 'STRONG BUY' WHEN rank IN (2, 3) THEN 'BUY' WHEN rank = 4 THEN 'WEAK BUY' WHEN rank = 7 THEN 'WEAK SELL' WHEN rank IN (8, 9) THEN 'SELL' WHEN rank = 10 THEN 'STRONG SELL' ELSE 'HOLD' END"
    queries = {"scan_min": scan_min_query, "scan": scan_query, "cross_ranks": ranks_query, "cross_percentiles": percentiles_query, "cross_movers": movers_query, "cross_filter": filter_query, "cross_actions": actions_query, "legacy_scores": legacy_query}
    oracles = {
        "scan_min": sql.with_bars(("zscore20", "rsi14", "mom21"), f"SELECT symbol, date, round(zscore20, 5) AS zscore20, round(rsi14, 5) AS rsi14, round(mom21, 5) AS mom21, rank, {label} AS label FROM ranked", more="scan AS (SELECT *, '1m' AS period, mom21 AS score FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1),\n" + RANKED),
        "scan": scan_sql(f"SELECT symbol, sector, date, period, {COLUMNS}, round(evidence, 5) AS evidence, round(score, 5) AS score FROM scan"),
        "cross_ranks": scan_sql(f"SELECT symbol, period, rank, {label} AS label FROM ranked", RANKED),
        "cross_percentiles": scan_sql("""SELECT symbol, period, CASE WHEN count(*) OVER (PARTITION BY period) >= 2 THEN round(100 * cume_dist() OVER (PARTITION BY period ORDER BY score), 1) END AS universe_pct,
  CASE WHEN count(*) OVER (PARTITION BY period, sector) >= 3 THEN round(100 * cume_dist() OVER (PARTITION BY period, sector ORDER BY score), 1) END AS sector_pct FROM scan"""),
        "cross_movers": scan_sql("SELECT r.symbol, r.period, r.rank AS rank_to, b.rank AS rank_from FROM ranked r JOIN before b ON r.symbol = b.symbol AND r.period = b.period WHERE abs(r.rank - b.rank) >= 3 ORDER BY abs(r.rank - b.rank) DESC, r.symbol, r.period LIMIT 10", RANKED + ",\n" + BEFORE),
        "cross_filter": scan_sql("SELECT symbol, period, rank, recommendation FROM ranked WHERE symbol IN (SELECT symbol FROM good) OR NOT EXISTS (SELECT 1 FROM good)", RANKED + ",\ngood AS (SELECT symbol FROM ranked WHERE recommendation LIKE '%BUY%' AND rank < 4)"),
        "cross_actions": scan_sql("""SELECT symbol, short_rank, medium_rank,
  CASE WHEN short_rank <= 3 AND medium_rank <= 3 THEN 'STRONG BUY' WHEN short_rank <= 3 OR medium_rank <= 3 THEN 'BUY' WHEN short_rank >= 8 AND medium_rank >= 8 THEN 'STRONG SELL' WHEN short_rank >= 8 OR medium_rank >= 8 THEN 'SELL' ELSE 'HOLD' END AS action,
  CASE WHEN s >= 15 THEN 'enter' WHEN s <= -15 THEN 'wait' ELSE 'ok' END AS timing
FROM (SELECT symbol, min(CASE WHEN period IN ('1w', '1m') THEN rank END) AS short_rank, min(CASE WHEN period IN ('6m', '1y') THEN rank END) AS medium_rank, coalesce(max(CASE WHEN period = '1d' THEN score END), max(CASE WHEN period = '1w' THEN score END)) AS s FROM ranked GROUP BY symbol)""", RANKED),
        "legacy_scores": sql.with_bars(("rsi14", "bbp20", "stoch_k", "stoch_d", "adx14", "obv_scaled", "ma_crossover"), """SELECT symbol, date, round(ps, 5) AS psar_score,
  round(least(100, greatest(-100, 100 * (0.5 + adx14 / 100) * (-20 * (rsi14 - 50) / 50 - 15 * (bbp20 - 0.5) * 2 + 20 * tanh(macd_hist * 5) - 10 * ((stoch_k + stoch_d) / 2 - 50) / 50 + 5 * (obv_scaled - 50) / 50 + 15 * ma_crossover + 15 * ps))), 4) AS legacy_score,
  CASE WHEN v >= 2 THEN 'BUY (Strong)' WHEN v = 1 THEN 'BUY (Weak)' WHEN v = 0 THEN 'HOLD' WHEN v = -1 THEN 'SELL (Weak)' ELSE 'SELL (Strong)' END AS vote
FROM (SELECT f.*, tanh(5 * (f.close - stops.stop) / f.close) AS ps, CASE WHEN rsi14 < 30 THEN 1 WHEN rsi14 > 70 THEN -1 ELSE 0 END + CASE WHEN bbp20 < 0.2 THEN 1 WHEN bbp20 > 0.8 THEN -1 ELSE 0 END + CASE WHEN macd_hist > 0 THEN 1 ELSE -1 END AS v FROM f JOIN stops USING (symbol, date))""", True, PSAR),
    }
    for name, h in HORIZONS.items():
        queries[f"score_{name}"], oracles[f"score_{name}"] = score_query(h)
    return queries, oracles
