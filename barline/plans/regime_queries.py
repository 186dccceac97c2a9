"""Queries of the jump model: states between given centers, with an SQL twin, and states of models fitted walk-forward."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import regime
from ..operators.regime import FEATURES, STRIDE
from ..sources.bars import derive_bars
from . import indicator_sql as sql
from .backtest_queries import rounded

#: In deviations of each feature: persistent, indifferent, and reverting.
CENTERS = {"trending": [0.5, 0.5, 0.0, 0.0, 1.0, 1.0, 1.0], "mixed": [0.0] * 7, "mean-reverting": [-0.5, -0.5, 0.5, 0.5, -1.0, -1.0, -1.0]}
PENALTY, REFIT = 4.0, 63


def features_query(spark, sf_dir) -> DataFrame:
    return rounded(regime.regime_features(derive_bars(spark, sf_dir)).drop("close"))


def path_query(spark, sf_dir) -> DataFrame:
    return regime.jump_paths(regime.regime_features(derive_bars(spark, sf_dir)), CENTERS, PENALTY)


def states_query(spark, sf_dir) -> DataFrame:
    """A model for each symbol, fitted again every REFIT bars; bars before the first fit have no state."""
    return regime.jump_states(regime.regime_features(derive_bars(spark, sf_dir)), refit=REFIT)


NEEDS = ("n_bar", "simple_ret", "log_ret", "er20", "q5", "hurst252")


def features_sql(out: str = "rf") -> str:
    """CTEs from ``f`` with NEEDS to the model's features."""
    held = f"OVER ({sql.BY} ROWS UNBOUNDED PRECEDING)"
    sampled = lambda x, w: f"CASE WHEN n_bar - 1 >= {w} AND (n_bar - 1 - {w}) % {STRIDE} = 0 THEN {x} END"
    return f"""{out}1 AS (SELECT *, close / {sql.lag("close", 20)} - 1 AS ret_20, close / {sql.lag("close", 60)} - 1 AS ret_60, ({sql.roll("stddev_samp", "simple_ret", 21, 10)}) * sqrt(252.0) AS vol_21,
  CASE WHEN simple_ret < 0 THEN simple_ret ELSE 0 END AS down, var_samp(q5) {sql.over(121)} / nullif(5 * var_samp(log_ret) {sql.over(125)}, 0) AS vr FROM f),
{out}2 AS (SELECT *, ({sql.roll("stddev_samp", "down", 21, 10)}) * sqrt(252.0) AS downside_21, {sampled("hurst252", 252)} AS hs, {sampled("vr", 126)} AS vs FROM {out}1),
{out} AS MATERIALIZED (SELECT symbol, date, n_bar, ret_20, ret_60, vol_21, downside_21, last_value(hs IGNORE NULLS) {held} AS hurst, last_value(vs IGNORE NULLS) {held} AS variance_ratio_126, er20 FROM {out}2)"""


def path_sql() -> str:
    z = ", ".join(f"coalesce(({x} - avg({x}) OVER s) / nullif(stddev_pop({x}) OVER s, 0), 0) AS {x}" for x in FEATURES)
    cost = ", ".join(" + ".join(f"power({x} - ({c!r}), 2)" for x, c in zip(FEATURES, row, strict=True)) + f" AS c{k}" for k, row in enumerate(CENTERS.values()))
    k = range(len(CENTERS))
    low = "least(" + ", ".join(f"w.t{i}" for i in k) + ")"
    first = "CASE " + " ".join(f"WHEN w.t{i} = {low} THEN {i}" for i in k) + " END"
    step = ", ".join(f"least(w.t{i}, {low} + {PENALTY}) + c{i}" for i in k)
    came = ", ".join(f"CASE WHEN w.t{i} <= {low} + {PENALTY} THEN {i} ELSE {first} END" for i in k)
    last = "CASE " + " ".join(f"WHEN t{i} = least(" + ", ".join(f"t{j}" for j in k) + f") THEN {i} END" if i == max(k) else f"WHEN t{i} = least(" + ", ".join(f"t{j}" for j in k) + f") THEN {i}" for i in k)
    back = "CASE b.s " + " ".join(f"WHEN {i} THEN w.b{i}" for i in k) + " END"
    name = "CASE s " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(CENTERS)) + " END"
    more = f"""{features_sql()},
z AS (SELECT symbol, date, n_bar, {z} FROM rf WINDOW s AS (PARTITION BY symbol)),
c AS MATERIALIZED (SELECT symbol, date, n_bar, {cost} FROM z),
walk AS MATERIALIZED (SELECT symbol, n_bar, {", ".join(f"c{i} AS t{i}" for i in k)}, {", ".join(f"0 AS b{i}" for i in k)} FROM c WHERE n_bar = 1
  UNION ALL SELECT c.symbol, c.n_bar, {step}, {came} FROM walk w JOIN c ON c.symbol = w.symbol AND c.n_bar = w.n_bar + 1),
ends AS (SELECT symbol, n_bar, {last} AS s FROM walk QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n_bar DESC) = 1),
path AS (SELECT symbol, n_bar, s FROM ends UNION ALL SELECT b.symbol, b.n_bar - 1, {back} FROM path b JOIN walk w ON w.symbol = b.symbol AND w.n_bar = b.n_bar WHERE b.n_bar > 1)"""
    return sql.with_bars(NEEDS, f"SELECT symbol, date, {name} AS state FROM path JOIN c USING (symbol, n_bar)", True, more)


def build() -> tuple[dict, dict]:
    queries = {"regime_features": features_query, "regime_path": path_query, "regime_jump_states": states_query}
    listed = ", ".join(f"round({x}, 5) AS {x}" for x in FEATURES)
    return queries, {"regime_features": sql.with_bars(NEEDS, f"SELECT symbol, date, {listed} FROM rf", True, features_sql()), "regime_path": path_sql()}
