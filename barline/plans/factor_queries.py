"""Queries of factor report cards and of the search."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..functions import factors
from ..operators import backtest as bt
from ..operators import search
from ..operators.score import HORIZONS, SLEEVES
from ..sources import store
from ..sources.bars import derive_bars, held_bars, held_market, market
from . import factor_sql
from . import indicator_sql as sql
from .backtest_queries import cal_sql, panel_sql, rounded
from .book_queries import EXPRESSIONS
from .score_queries import score_ctes

H, STEP, YEARS = HORIZONS["1m"], 21, 10
ENDS = ("1996-06-28", "1997-12-31")
DRAWN = 6
SURVIVORS = ("reversal", "squashed_flow", "calm_momentum")
#: All operands and all functions of the language.
LANGUAGE = {
    "x1": "tanh(ts_mean(mfi14, 5) / 50) * sign(ts_delta(obv_z, 3))",
    "x2": "zscore(absv(vwap_dev), 20) + clip(rel_vol - 1, -2, 2)",
    "x3": "ts_rank(don_pos + dist_52 / 100, 10) - ts_rank(bbp20, 21)",
    "x4": "logv(ts_max(high, 20) / ts_min(low, 20)) / (ts_std(ret1, 42) + 0.01)",
    "x5": "pct_change(close, 63) - mom_12_1 / 12",
    "x6": "ts_sum(cmf20 * sign(macd_hist), 5) - (stoch_k - stoch_d) / 100",
    "x7": "-(close - kama10) / atr14 * (adx14 / 25)",
    "x8": "tanh(zscore(ts_sum(volume, 3), 10)) - tanh(rv21 / 100)",
}


def report_query(spark, sf_dir) -> DataFrame:
    """Each expression's report card against the sleeves, with the verdict of the gate."""
    return rounded(search.scored(held_bars(spark, sf_dir), bt.calendar(market(spark, sf_dir), STEP, YEARS), H, EXPRESSIONS), 4)


def search_query(spark, sf_dir) -> DataFrame:
    """A round of six drawn proposals over frozen windows."""
    found = search.search(held_bars(spark, sf_dir), held_market(spark, sf_dir), H, count=DRAWN, step=STEP, ends=ENDS)
    rows = [(r["expression"], r["verdict"], (r.get("discovery") or {}).get("t"), found["hurdle"]) for r in found["rows"]]
    return rounded(spark.createDataFrame(rows, "expression string, verdict string, t double, hurdle double"), 3)


def holdout_query(spark, sf_dir) -> DataFrame:
    """Survivors of a log in which one line comes twice, one is broken and two expressions failed: the sealed window is opened."""
    lines = [{"expression": t, "canonical": factors.canonical(t), "verdict": "survivor" if n in SURVIVORS else "weak"} for n, t in EXPRESSIONS.items()]
    texts = [json.dumps(r) for r in (*lines, lines[0])] + ['{"expression": "close', '{"verdict": "survivor"}', json.dumps({"expression": "close +", "verdict": "survivor"}), ""]
    log = spark.createDataFrame([(t,) for t in texts], "value string")
    return rounded(search.review(log, held_bars(spark, sf_dir), held_market(spark, sf_dir), H, STEP, ENDS), 4)


def language_query(spark, sf_dir) -> DataFrame:
    """Every operand and every function of the language, at every bar."""
    table = factors.prepared(derive_bars(spark, sf_dir), *LANGUAGE.values())
    for name, text in LANGUAGE.items():
        table = factors.add_factor(table, text, name)
    return rounded(table.select("symbol", "date", *LANGUAGE), 4)


def card_sql(exprs: dict[str, str], source: str, cal: str) -> str:
    """A select of the report card of each expression of ``source`` over the dates of ``cal``: a whole WITH of its own."""
    panel = panel_sql({n: n for n in (*SLEEVES, *exprs)}, list(exprs), source, cal).replace("fwd, strategy, value", f"fwd, {', '.join(SLEEVES)}, strategy, value")
    day = "OVER (PARTITION BY strategy, k{})"
    ranks = ", ".join(f"row_number() {day.format(f' ORDER BY {c}, symbol')} AS r_{c}" for c in ("value", "fwd", *SLEEVES))
    varies = ", ".join(f"max({c}) {day.format('')} > min({c}) {day.format('')} AS v_{c}" for c in ("value", *SLEEVES))
    corrs = ", ".join(f"CASE WHEN any_value(v_value AND v_{s}) THEN corr(r_value, r_{s}) END AS c_{s}" for s in SLEEVES)
    verdict = "CASE WHEN n_dates < 5 THEN 'unscored' WHEN abs(t) < 2.5 OR t IS NULL THEN 'weak' WHEN coverage < 0.5 THEN 'thin' WHEN decay < 0.5 THEN 'decays' WHEN CASE WHEN t > 0 THEN pct_positive ELSE 1 - pct_positive END < 0.55 THEN 'unsteady' WHEN max_sleeve_corr > 0.6 THEN 'redundant' ELSE 'pass' END"
    return f"""WITH {panel},
rk AS MATERIALIZED (SELECT strategy, k, {ranks}, {varies}, count(*) {day.format("")} AS n FROM long),
ics AS (SELECT strategy, k, corr(r_value, r_fwd) AS ic, {corrs} FROM rk WHERE n >= 8 GROUP BY strategy, k),
hv AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY k) > floor(count(*) OVER (PARTITION BY strategy) / 2) AS late FROM ics),
cd AS (SELECT strategy AS expression, avg(ic) AS mean_ic, avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(*)) AS t, avg((ic > 0)::INT) AS pct_positive, avg(ic) FILTER (NOT late) AS first_half, avg(ic) FILTER (late) AS second_half, count(*) AS n_dates, greatest({", ".join(f"abs(avg(c_{s}))" for s in SLEEVES)}) AS max_sleeve_corr FROM hv GROUP BY strategy),
ce AS (SELECT cd.*, CASE WHEN abs(first_half) > 1e-9 THEN second_half / first_half ELSE 0 END AS decay, held / ((SELECT count(*) FROM cal) * (SELECT count(DISTINCT symbol) FROM bars))::DOUBLE AS coverage FROM cd JOIN (SELECT strategy AS expression, count(*) AS held FROM long GROUP BY strategy) USING (expression))
SELECT *, {verdict} AS verdict FROM ce"""


def between_sql(step: int, begin: str | None, end: str | None) -> str:
    """The calendar from the last date up to ``begin`` (bar 300 if None) to the last one up to ``end``."""
    place = lambda day: f"(count(*) FILTER (date <= DATE '{day}') OVER () - 1)"
    return f"""cal AS MATERIALIZED (SELECT CAST((pos - first) / {step} AS INT) AS k, date, next_date FROM (
  SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, lead(date, {step}) OVER (ORDER BY date) AS next_date, {300 if begin is None else place(begin)} AS first, {"count(*) OVER ()" if end is None else place(end)} AS stop FROM mkt)
  WHERE pos >= first AND pos < stop - {step} AND (pos - first) % {step} = 0)"""


def with_factors(exprs: dict[str, str], select: str, more: str) -> str:
    names = tuple(dict.fromkeys((*H.needs(), "n_bar", *factor_sql.needs(exprs))))
    return sql.with_bars(names, select, True, ",\n".join((score_ctes(H), factor_sql.factor_ctes(exprs, "s", "x"), more)))


def search_sql() -> str:
    """The drawn proposals, which need no table, judged on the first window and, if they pass, on the second."""
    exprs = {f"e{i}": t for i, t in enumerate(factors.propose_random(DRAWN, 0))}
    quoted = ", ".join(f"('{n}', '{t}')" for n, t in exprs.items())
    more = f"""tx(expression, words) AS (VALUES {quoted}),
c1 AS MATERIALIZED ({card_sql(exprs, "x", between_sql(STEP, None, ENDS[0]))}),
c2 AS MATERIALIZED ({card_sql(exprs, "x", between_sql(STEP, *ENDS))})"""
    hurdle = f"round(sqrt(2 * ln({max(2, len(exprs))}.0::DOUBLE)), 3)"
    return with_factors(exprs, f"""SELECT words AS expression, CASE WHEN c1.verdict IS NULL THEN 'unscored' WHEN c1.verdict <> 'pass' THEN c1.verdict WHEN abs(c2.t) >= 1.5 AND (c2.t > 0) = (c1.t > 0) THEN 'survivor' ELSE 'failed validation' END AS verdict,
  round(c1.t, 3) AS t, {hurdle} AS hurdle FROM tx LEFT JOIN c1 USING (expression) LEFT JOIN c2 USING (expression)""", more)


def holdout_sql() -> str:
    exprs = {n: EXPRESSIONS[n] for n in SURVIVORS}
    quoted = ", ".join(f"('{n}', '{t}')" for n, t in exprs.items())
    windows = {"c1": (None, ENDS[0]), "c2": ENDS, "c3": (ENDS[1], None)}
    more = f"tx(expression, words) AS (VALUES {quoted}),\n" + ",\n".join(f"{c} AS MATERIALIZED ({card_sql(exprs, 'x', between_sql(STEP, *w))})" for c, w in windows.items())
    hurdle = f"sqrt(2 * ln({len(EXPRESSIONS)}.0::DOUBLE))"
    return with_factors(exprs, f"""SELECT words AS expression, round(c1.t, 4) AS discovery_t, round(c2.t, 4) AS validation_t, round(c3.mean_ic, 4) AS holdout_ic, round(c3.t, 4) AS holdout_t, c3.n_dates AS holdout_dates, round({hurdle}, 4) AS hurdle,
  coalesce(abs(c1.t) > {hurdle}, false) AS clears, coalesce(sign(c3.mean_ic) = sign(c1.mean_ic), false) AS holds FROM tx LEFT JOIN c1 USING (expression) LEFT JOIN c2 USING (expression) LEFT JOIN c3 USING (expression)""", more)


def build() -> tuple[dict, dict]:
    r = ", ".join(f"round({c}, 4) AS {c}" for c in ("mean_ic", "t", "pct_positive", "first_half", "second_half", "decay", "coverage", "max_sleeve_corr"))
    gate = with_factors(EXPRESSIONS, f"SELECT expression, {r}, n_dates, verdict FROM card", f"card AS ({card_sql(EXPRESSIONS, 'x', cal_sql(STEP, YEARS))})")
    every = ", ".join(f"round({n}, 4) AS {n}" for n in LANGUAGE)
    language = sql.with_bars(factor_sql.needs(LANGUAGE), f"SELECT symbol, date, {every} FROM fx", True, factor_sql.factor_ctes(LANGUAGE))
    return {"factor_gate": report_query, "factor_search": search_query, "factor_language": language_query, "factor_holdout": holdout_query}, {"factor_gate": gate, "factor_search": search_sql(), "factor_language": language, "factor_holdout": holdout_sql()}
