"""The walk-forward backtest of the composite score and its sleeves, with benchmarks, gate, weights, regimes and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import add
from ..operators import backtest as bt
from ..operators import calibrate
from ..operators import evaluate as ev
from ..operators.regime import learned_weights
from ..operators.score import HORIZONS, SLEEVES, WEIGHTS, features, score
from ..sources.bars import derive_bars, held_market, market
from ..sources.scratch import held
from . import indicator_sql as sql
from .backtest_queries import CAL, STEP, YEARS, ic_sql, panel_sql, returns_sql, rounded
from .score_queries import score_ctes

STRATEGIES = ["composite", *SLEEVES]
TRIALS, PERMUTATIONS, SHARE = 35, 200, 0.6
#: The largest Sharpe ratio to expect of 35 strategies without skill, for a spread of 1, from the published formula and tables of the normal quantiles.
BEST_OF_TRIALS = "2.136207220364099::DOUBLE"
H = HORIZONS["1m"]


def bars_and_dates(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Both written once: the panel reads the bars three times, and the dates are asked for each name."""
    return held(add(derive_bars(spark, sf_dir), "n_bar")), held(bt.calendar(market(spark, sf_dir), STEP, YEARS))


def composite_panel(bars: DataFrame, dates: DataFrame) -> DataFrame:
    """(k, date, symbol, composite, sleeves, vol, trend_state, fwd)."""
    scored = score(features(bars, H, more=("rv21",)), H).withColumns({"composite": F.col("score"), "vol": F.col("rv21")})
    scored = scored.select("symbol", "date", "close", "n_bar", *STRATEGIES, "vol", "trend_state")
    return bt.panel(scored, dates, [*STRATEGIES, "vol", "trend_state"], bars)


def _panel(spark, sf_dir) -> DataFrame:
    """Written once: k dates of each symbol are small beside the history that they come from, and are read in every branch."""
    return held(composite_panel(*bars_and_dates(spark, sf_dir)))


def _returns(spark, sf_dir, **options) -> DataFrame:
    return bt.strategy_returns(_panel(spark, sf_dir), STRATEGIES, **options)


def _with_benchmarks(spark, sf_dir) -> DataFrame:
    bars, dates = bars_and_dates(spark, sf_dir)
    table = held(composite_panel(bars, dates))
    return bt.strategy_returns(table, STRATEGIES).unionByName(bt.benchmarks(table, dates))


def as_text(df: DataFrame, *names: str) -> DataFrame:
    """Growth rates of noise prices span hundreds of powers of ten: four digits and the power."""
    return df.withColumns({n: F.when(F.abs(n) < float("inf"), F.format_string("%.3e", n)) for n in names})


def panel_query(spark, sf_dir) -> DataFrame:
    return rounded(composite_panel(*bars_and_dates(spark, sf_dir)))


def stats_query(spark, sf_dir) -> DataFrame:
    return rounded(as_text(bt.stats(_with_benchmarks(spark, sf_dir), STEP), "cagr", "total"), 4)


def gated_query(spark, sf_dir) -> DataFrame:
    got = _returns(spark, sf_dir, weighting="inv_vol", exposure=bt.exposures(market(spark, sf_dir)))
    return rounded(got)


def exposure_query(spark, sf_dir) -> DataFrame:
    mkt = held_market(spark, sf_dir)
    return bt.exposures(mkt).join(F.broadcast(bt.calendar(mkt, STEP, YEARS).select("date", "k")), "date")


def regimes_query(spark, sf_dir) -> DataFrame:
    got = bt.by_regime(_with_benchmarks(spark, sf_dir), bt.regime_labels(market(spark, sf_dir)), STEP)
    return rounded(got.select("strategy", "label", "log_cagr", "vol", "sharpe", "max_dd", "hit", "log_total", "n"), 4)


def verdict_query(spark, sf_dir) -> DataFrame:
    return rounded(as_text(bt.verdict(bt.stats(_with_benchmarks(spark, sf_dir), STEP)), "end_value", "points"), 4)


def ic_query(spark, sf_dir) -> DataFrame:
    return rounded(bt.ic_stats(bt.information_coefficients(_panel(spark, sf_dir), STRATEGIES)), 4)


def hurdle_query(spark, sf_dir) -> DataFrame:
    stats = bt.ic_stats(bt.information_coefficients(_panel(spark, sf_dir), STRATEGIES))
    return rounded(ev.deflated_t(stats.select("strategy", "t"), TRIALS), 4)


def null_query(spark, sf_dir) -> DataFrame:
    return rounded(ev.null_ic(_panel(spark, sf_dir), STRATEGIES, PERMUTATIONS))


def deflated_query(spark, sf_dir) -> DataFrame:
    return rounded(ev.deflated_sharpe(_returns(spark, sf_dir), TRIALS), 4)


def table_query(spark, sf_dir) -> DataFrame:
    """The fixed weights as a table to be judged: IC and return of its composite at each date."""
    return rounded(calibrate.table_scores(_panel(spark, sf_dir), WEIGHTS, "trend_state"))


def gram_query(spark, sf_dir) -> DataFrame:
    """What the learned weights rest on: for each state, centered sums of the sleeves and the forward return."""
    return rounded(calibrate.centered_sums(_panel(spark, sf_dir).withColumnRenamed("trend_state", "state")), 4)


def weights_query(spark, sf_dir) -> DataFrame:
    """Sleeve weights learned for each state from the earlier dates."""
    panel = _panel(spark, sf_dir)
    cut = int((panel.agg(F.max("k")).first()[0] or 0) * SHARE)
    return learned_weights(panel.where(F.col("k") < cut).withColumnRenamed("trend_state", "state"), WEIGHTS)


def calibration_query(spark, sf_dir) -> DataFrame:
    return rounded(calibrate.calibration(_panel(spark, sf_dir), WEIGHTS, "trend_state", SHARE, STEP)["report"], 4)


def normal_sql(z: str) -> str:
    """The normal distribution function in DuckDB: Simpson's rule over 2,000 intervals of its density; written apart from the library's series."""
    x = f"greatest(-40.0, least(40.0, {z}))::DOUBLE"
    weight = "CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"greatest(0.0, 0.5 + {x} / 6000 / sqrt(2 * pi()) * list_sum(list_transform(range(2001), lambda i: {weight} * exp(-power({x} * i / 2000, 2) / 2))))"


def weights_sql(shrinkage: float = 0.5, ridge: float = 1.0, least: int = 60) -> str:
    """CTEs up to ``lw`` (weights learned for each state) and ``both_tables`` (composites by the fixed and the learned weights): a Cholesky factor column by column."""
    k = range(len(SLEEVES))
    sums = ", ".join([f"sum({s}) AS s{i}, sum({s} * fwd) AS y{i}" for i, s in enumerate(SLEEVES)] + [f"sum({SLEEVES[i]} * {SLEEVES[j]}) AS x{i}{j}" for i in k for j in range(i + 1)])
    less = lambda start, parts: " - ".join([start, *parts])
    entry = lambda i, j: f"(x{i}{j} - s{i} * s{j} / n{f' + {ridge}' if i == j else ''})"
    parts, last = [], "g0"
    for j in k:
        parts.append(f"l{j} AS (SELECT *, sqrt({less(entry(j, j), [f'l{j}{m} * l{j}{m}' for m in range(j)])}) AS l{j}{j} FROM {last})")
        rest = "".join(f", ({less(entry(i, j), [f'l{i}{m} * l{j}{m}' for m in range(j)])}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, len(k)))
        parts.append(f"m{j} AS (SELECT *{rest} FROM l{j})")
        last = f"m{j}"
    for i in k:
        parts.append(f"z{i} AS (SELECT *, ({less(f'(y{i} - s{i} * y / n)', [f'l{i}{m} * r{m}' for m in range(i)])}) / l{i}{i} AS r{i} FROM {last})")
        last = f"z{i}"
    for i in reversed(k):
        parts.append(f"o{i} AS (SELECT *, ({less(f'r{i}', [f'l{m}{i} * b{m}' for m in range(i + 1, len(k))])}) / l{i}{i} AS b{i} FROM {last})")
        last = f"o{i}"
    share = ", ".join(f"('{s}', " + ", ".join(f"{row[x] / sum(row.values())!r}::DOUBLE" for x in SLEEVES) + ")" for s, row in WEIGHTS.items())
    fixed = ", ".join(f"('{s}', " + ", ".join(f"{row[x]!r}::DOUBLE" for x in SLEEVES) + ")" for s, row in WEIGHTS.items())
    total = " + ".join(f"greatest(b{i}, 0)" for i in k)
    drawn = ", ".join(f"round(CASE WHEN n >= {least} AND {total} > 0 THEN {shrinkage} * greatest(b{i}, 0) / ({total}) + {1 - shrinkage} * p{i} ELSE p{i} END, 4) AS {s}" for i, s in enumerate(SLEEVES))
    dot = " + ".join(f"w.{s} * p.{s}" for s in SLEEVES)
    return f"""ct AS (SELECT CAST(floor(max(k) * {SHARE}) AS INT) AS cut FROM panel),
g0 AS (SELECT trend_state AS state, count(*) AS n, sum(fwd) AS y, {sums} FROM panel WHERE k < (SELECT cut FROM ct) AND trend_state IS NOT NULL AND fwd IS NOT NULL GROUP BY trend_state),
{", ".join(parts)},
bp(state, {", ".join(f"p{i}" for i in k)}) AS (VALUES {share}), fw(state, {", ".join(SLEEVES)}) AS (VALUES {fixed}),
lw AS MATERIALIZED (SELECT bp.state, {drawn} FROM bp LEFT JOIN {last} q ON q.state = bp.state),
full_dates AS (SELECT k FROM panel GROUP BY k HAVING count(*) >= 8),
both_tables AS MATERIALIZED (SELECT t.tbl, p.k, p.symbol, p.fwd, {dot} AS c FROM panel p JOIN full_dates USING (k), (SELECT 'prior' AS tbl, * FROM fw UNION ALL SELECT 'calibrated', * FROM lw) t, LATERAL (SELECT t.*) w WHERE w.state = coalesce(p.trend_state, 'mixed'))"""


def build() -> tuple[dict, dict]:
    signals = {"composite": "score", **{s: s for s in SLEEVES}, "vol": "rv21", "trend_state": "trend_state"}
    names = tuple(dict.fromkeys((*H.needs(), "rv21", "n_bar")))

    def query(select: str, *more: str) -> str:
        return sql.with_bars(names, select, True, ",\n".join((score_ctes(H), panel_sql(signals, STRATEGIES, "s"), *more)))

    per = 252 / STEP
    bench = f"""bench AS (SELECT 'equal_weight' AS strategy, c.k, c.date, coalesce(avg(fwd), 0) AS ret, 0.0::DOUBLE AS turnover FROM cal c LEFT JOIN panel p ON p.k = c.k GROUP BY c.k, c.date
  UNION ALL SELECT 'market', k, cal.date, CASE WHEN a.close > 0 THEN b.close / a.close - 1 ELSE 0 END, 0.0::DOUBLE FROM cal JOIN mkt a ON a.date = cal.date JOIN mkt b ON b.date = cal.next_date),
whole AS MATERIALIZED (SELECT strategy, k, date, ret, turnover FROM ret UNION ALL SELECT * FROM bench)"""

    def stats(by: str, source: str, out: str = "st") -> str:
        return f"""eq_{out} AS (SELECT *, sum(ln(1 + ret)) OVER (PARTITION BY {by} ORDER BY k) AS le FROM {source}),
pk_{out} AS (SELECT *, max(le) OVER (PARTITION BY {by} ORDER BY k) AS lp FROM eq_{out}),
{out} AS MATERIALIZED (SELECT {by}, max_by(le, k) * {per} / count(*) AS log_cagr, 100 * stddev_pop(ret) * sqrt({per}) AS vol, avg(ret) / nullif(stddev_pop(ret), 0) * sqrt({per}) AS sharpe, 100 * min(exp(le - lp) - 1) AS max_dd,
  100 * avg((ret > 0)::INT) AS hit, max_by(le, k) AS log_total, avg(CASE WHEN k > 0 THEN turnover END) AS turnover, count(*) AS n, 100 * (exp(max_by(le, k) * {per} / count(*)) - 1) AS cagr, 100 * (exp(max_by(le, k)) - 1) AS total FROM pk_{out} GROUP BY {by})"""

    regimes = """lab AS (SELECT date, CASE WHEN count(close) OVER w < 100 THEN 'unknown' WHEN close >= avg(close) OVER w THEN 'bull' ELSE 'bear' END AS label FROM mkt WINDOW w AS (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
split AS (SELECT w.*, label FROM whole w JOIN lab USING (date) WHERE label IN ('bull', 'bear'))"""
    gate = """ga AS (SELECT date, close, ln(close / lag(close) OVER (ORDER BY date)) AS r, count(*) OVER w AS n, avg(close) OVER w AS m FROM mkt WINDOW w AS (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
gb AS (SELECT *, CASE WHEN count(r) OVER w >= 21 THEN stddev_samp(r) OVER w END AS vol FROM ga WINDOW w AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
gc AS (SELECT *, list(vol) FILTER (vol IS NOT NULL) OVER (ORDER BY date ROWS BETWEEN 1259 PRECEDING AND CURRENT ROW) AS s, count(vol) OVER (ORDER BY date) AS known FROM gb),
gd AS (SELECT date, CASE WHEN n >= 100 THEN close > m END AS above, CASE WHEN vol IS NOT NULL AND known > 252 THEN 100.0::DOUBLE * len(list_filter(s, lambda v: v <= vol)) / len(s) END AS p FROM gc),
gate AS MATERIALIZED (SELECT date, CASE WHEN above IS NULL AND p IS NULL THEN 1.0::DOUBLE WHEN above = false AND p >= 80 THEN 0.3::DOUBLE WHEN above = false OR p >= 80 THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END AS exposure FROM gd)"""
    r = lambda *c, d=4: ", ".join(f"round({x}, {d}) AS {x}" for x in c)
    text = lambda x, name=None: f"CASE WHEN isfinite({x}) THEN printf('%.3e', {x}) END AS {name or x}"
    whole = (returns_sql(STRATEGIES), bench)
    ranked = """pr AS MATERIALIZED (SELECT k, symbol, """ + ", ".join(f"row_number() OVER (PARTITION BY k ORDER BY {s}, symbol) AS r_{s}" for s in STRATEGIES) + """ FROM panel QUALIFY count(*) OVER (PARTITION BY k) >= 8),
dealt AS (SELECT pr.*, perm, row_number() OVER (PARTITION BY perm, k ORDER BY md5(concat_ws('|', 1, perm, k, symbol)), symbol) AS y FROM pr CROSS JOIN (SELECT unnest(range(1, """ + str(PERMUTATIONS + 1) + """)) AS perm)),
ics AS (SELECT perm, k, """ + ", ".join(f"corr(r_{s}, y) AS i_{s}" for s in STRATEGIES) + """ FROM dealt GROUP BY perm, k),
best AS (SELECT perm, greatest(""" + ", ".join(f"avg(i_{s})" for s in STRATEGIES) + """) AS ic FROM ics GROUP BY perm)"""
    states = "CASE trend_state " + " ".join(f"WHEN '{s}' THEN " + " + ".join(f"{w[k]!r}::DOUBLE * {k}" for k in SLEEVES) for s, w in WEIGHTS.items()) + " END"
    table = f"""tc AS (SELECT k, date, symbol, fwd, {states} AS c FROM panel QUALIFY count(*) OVER (PARTITION BY k) >= 8),
tr AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY c) + (count(*) OVER (PARTITION BY k, c) - 1) / 2.0::DOUBLE AS rv, rank() OVER (PARTITION BY k ORDER BY fwd) + (count(*) OVER (PARTITION BY k, fwd) - 1) / 2.0::DOUBLE AS rf,
  row_number() OVER (PARTITION BY k ORDER BY c DESC, symbol) AS i, count(*) OVER (PARTITION BY k) AS n FROM tc)"""
    ranked_ics = """ks AS (SELECT *, rank() OVER (PARTITION BY tbl, k ORDER BY c) + (count(*) OVER (PARTITION BY tbl, k, c) - 1) / 2.0::DOUBLE AS rv, rank() OVER (PARTITION BY tbl, k ORDER BY fwd) + (count(*) OVER (PARTITION BY tbl, k, fwd) - 1) / 2.0::DOUBLE AS rf,
  row_number() OVER (PARTITION BY tbl, k ORDER BY c DESC, symbol) AS i, count(*) OVER (PARTITION BY tbl, k) AS m FROM both_tables),
kd AS MATERIALIZED (SELECT tbl, k, CASE WHEN k < (SELECT cut FROM ct) THEN 'discovery' ELSE 'validation' END AS split, CASE WHEN stddev_pop(rv) > 0 AND stddev_pop(rf) > 0 THEN corr(rv, rf) END AS ic, avg(CASE WHEN i <= greatest(1, floor(m * 0.2)) THEN fwd END) AS ret, 0.0::DOUBLE AS turnover FROM ks GROUP BY tbl, k),
ki AS (SELECT tbl, split, avg(ic) AS ic, avg(ic) / nullif(stddev_pop(ic), 0) * sqrt(count(*)) AS t FROM kd WHERE ic IS NOT NULL GROUP BY tbl, split)"""
    centered = ", ".join(f"round(sum(({a}) * ({b})) - sum({a}) * sum({b}) / count(*), 4) AS {a[0]}{i}{b[0]}{j}" for i, a in enumerate(SLEEVES) for j, b in enumerate((*SLEEVES, "fwd")) if j >= i)
    queries = {
        "bt_composite_panel": panel_query, "bt_composite_stats": stats_query, "bt_composite_gated": gated_query, "bt_exposure": exposure_query, "bt_composite_regimes": regimes_query, "bt_verdict": verdict_query,
        "bt_composite_ic": ic_query, "audit_ic_hurdle": hurdle_query, "audit_null_ic": null_query, "audit_deflated_sharpe": deflated_query, "regime_table": table_query, "regime_gram": gram_query, "regime_weights": weights_query, "regime_calibration": calibration_query,
    }
    oracles = {
        "bt_composite_panel": query(f"SELECT k, date, symbol, {r(*STRATEGIES, 'vol', 'fwd', d=5)}, trend_state FROM panel"),
        "bt_composite_stats": query(f"SELECT strategy, {r('log_cagr', 'vol', 'sharpe', 'max_dd', 'hit', 'log_total', 'turnover')}, n, {text('cagr')}, {text('total')} FROM st", *whole, stats("strategy", "whole")),
        "bt_composite_gated": query(f"SELECT strategy, k, date, round(ret * exposure, 5) AS ret, round(turnover, 5) AS turnover FROM ret JOIN gate USING (date)", returns_sql(STRATEGIES, "inv_vol"), gate),
        "bt_exposure": f"WITH {sql.MARKET}, {CAL}, {gate} SELECT date, exposure, k FROM gate JOIN cal USING (date)",
        "bt_composite_regimes": query(f"SELECT strategy, label, {r('log_cagr', 'vol', 'sharpe', 'max_dd', 'hit', 'log_total')}, n FROM st WHERE n >= 8", *whole, regimes, stats("strategy, label", "split")),
        "bt_verdict": query(f"SELECT strategy, {text('10000 * (1 + total / 100)', 'end_value')}, round(max_dd, 4) AS max_dd, {text('CASE WHEN strategy <> ' + repr('composite') + ' THEN own - total END', 'points')} FROM (SELECT *, max(CASE WHEN strategy = 'composite' THEN total END) OVER () AS own FROM st) WHERE strategy IN ('composite', 'equal_weight', 'market')", *whole, stats("strategy", "whole")),
        "bt_composite_ic": query("SELECT strategy, round(avg(ic), 4) AS mean, round(stddev_pop(ic), 4) AS sd, round(avg(ic) / stddev_pop(ic), 4) AS ir, round(avg(ic) / stddev_pop(ic) * sqrt(count(*)), 4) AS t, round(100 * avg((round(ic, 9) > 0)::INT), 4) AS positive, count(*) AS n FROM ic GROUP BY strategy", ic_sql()),
        "audit_ic_hurdle": query(f"SELECT strategy, round(t, 4) AS t, round(h, 4) AS hurdle, abs(t) > h AS passes, t > h AS clears_positive FROM (SELECT strategy, avg(ic) / stddev_pop(ic) * sqrt(count(*)) AS t, sqrt(2 * ln({TRIALS}.0::DOUBLE)) AS h FROM ic GROUP BY strategy)", ic_sql()),
        "audit_null_ic": query("SELECT count(*) AS permutations, round(avg(ic), 5) AS mean, round(quantile_cont(ic, 0.95), 5) AS p95, round(quantile_cont(ic, 0.99), 5) AS p99, round(max(ic), 5) AS most FROM best", ranked),
        "audit_deflated_sharpe": query(f"""SELECT strategy, round(sharpe, 4) AS sharpe, round(spread * {BEST_OF_TRIALS}, 4) AS sr0, round({normal_sql('z')}, 4) AS deflated, {normal_sql('z')} >= 0.95 AS passes
FROM (SELECT *, (sharpe - spread * {BEST_OF_TRIALS}) * sqrt(n - 1) / sqrt(base) AS z FROM (SELECT *, greatest(abs(sharpe), 1e-9) AS spread, CASE WHEN 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe > 0 THEN 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe END AS base FROM (
  SELECT strategy, count(*) AS n, any_value(m) / any_value(sd) AS sharpe, avg(power((ret - m) / sd, 3)) AS skew, avg(power((ret - m) / sd, 4)) AS kurt FROM (SELECT strategy, ret, avg(ret) OVER (PARTITION BY strategy) AS m, stddev_samp(ret) OVER (PARTITION BY strategy) AS sd FROM ret) GROUP BY strategy)))""", returns_sql(STRATEGIES)),
        "regime_table": query("SELECT k, any_value(date) AS date, round(CASE WHEN stddev_pop(rv) > 0 AND stddev_pop(rf) > 0 THEN corr(rv, rf) END, 5) AS ic, round(avg(CASE WHEN i <= greatest(1, floor(n * 0.2)) THEN fwd END), 5) AS ret FROM tr GROUP BY k", table),
        "regime_calibration": query("""SELECT tbl AS "table", split, round(ic, 4) AS ic, round(t, 4) AS t, round(sharpe, 4) AS sharpe, round(log_cagr, 4) AS log_cagr, round(max_dd, 4) AS max_dd, n,
  (SELECT coalesce(bool_and(a.ic > b.ic AND x.sharpe >= 0.95 * y.sharpe), false) FROM ki a JOIN ki b ON a.split = b.split JOIN kt x ON x.tbl = a.tbl AND x.split = a.split JOIN kt y ON y.tbl = b.tbl AND y.split = b.split WHERE a.split = 'validation' AND a.tbl = 'calibrated' AND b.tbl = 'prior') AS accepted
FROM kt LEFT JOIN ki USING (tbl, split)""", weights_sql(), ranked_ics, stats("tbl, split", "kd", "kt")),
        "regime_weights": query("SELECT state, " + ", ".join(SLEEVES) + " FROM lw", weights_sql()),
        "regime_gram": query(f"SELECT trend_state AS state, count(*) AS n, {centered} FROM panel WHERE trend_state IS NOT NULL GROUP BY trend_state"),
    }
    return queries, oracles
