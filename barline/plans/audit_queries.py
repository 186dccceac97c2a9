"""Queries of event studies, hurdles, the permutation null and runs of states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import add
from ..functions.recursive import add_recursive
from ..operators import evaluate as ev
from ..operators.score import HORIZONS, trend_evidence, trend_regime
from ..sources.bars import derive_bars
from . import indicator_sql as sql
from .backtest_queries import rounded
from .indicator_queries import SQUEEZE_ON, squeeze


def events_query(spark, sf_dir) -> DataFrame:
    bars = squeeze(add(add_recursive(derive_bars(spark, sf_dir)), "bb_up", "bb_low", "don_break", "zscore20"))
    return rounded(ev.event_study(bars), 4)


def states_query(spark, sf_dir) -> DataFrame:
    h = HORIZONS["1m"]
    bars = add(add_recursive(derive_bars(spark, sf_dir), "hurst504"), "variance_ratio", "adx14", f"er{h.er}")
    state = trend_regime(trend_evidence(F.col("hurst504"), F.col("variance_ratio"), F.col("adx14"), F.col(f"er{h.er}")))
    return rounded(ev.state_summary(bars.select("symbol", "date", state.alias("state"))), 4)


def build() -> tuple[dict, dict]:
    flags = {"donchian_breakout_up": "don_break = 1", "donchian_breakout_down": "don_break = -1", "squeeze_fired": "sqf", "zscore_below_-2": "zscore20 <= -2", "zscore_above_2": "zscore20 >= 2", "macd_flip_positive": "macd_hist > 0 AND pm <= 0"}
    parts = " UNION ALL ".join(f"SELECT '{n}' AS event, f5, f10, f21 FROM u WHERE {c}" for n, c in {"baseline": "true", **flags}.items())
    queries = {"event_study": events_query, "regime_states": states_query}
    oracles = {
        "event_study": sql.with_bars(("bb_up", "bb_low", "don_break", "zscore20"), "SELECT event, count(*) AS n, " + ", ".join(f"CASE WHEN count(*) >= 20 OR event = 'baseline' THEN round(100 * avg(f{h}), 4) END AS d{h}" for h in (5, 10, 21)) + " FROM al GROUP BY event", True, f"""s0 AS (SELECT *, {SQUEEZE_ON} AS sq FROM f),
t0 AS (SELECT *, coalesce(lag(sq) OVER w, false) AND NOT sq AS sqf, lag(macd_hist) OVER w AS pm, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS total, lead(close, 5) OVER w / close - 1 AS f5, lead(close, 10) OVER w / close - 1 AS f10, lead(close, 21) OVER w / close - 1 AS f21 FROM s0 WINDOW w AS (PARTITION BY symbol ORDER BY date)),
u AS (SELECT * FROM t0 WHERE i >= greatest(300, total - 756) AND i < total - 21), al AS ({parts})"""),
        "regime_states": sql.with_bars(("hurst504", "variance_ratio", "adx14", "er10"), """SELECT state, round(sum(size) / (SELECT sum(size) FROM rn)::DOUBLE, 4) AS share, count(*) AS n_runs, round(avg(size), 4) AS mean_run, round(quantile_cont(size, 0.5), 4) AS median_run FROM rn GROUP BY state""", more="""st AS (SELECT symbol, date, CASE WHEN e > 0.40 THEN 'trending' WHEN e < -0.35 THEN 'mean-reverting' ELSE 'mixed' END AS state FROM (SELECT *, coalesce(2.5 * (hurst504 - 0.5), 0) + coalesce((adx14 - 22) / 25, 0) + coalesce(er10 - 0.30, 0) + coalesce(0.5 * (variance_ratio - 1), 0) AS e FROM f)),
tn AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY symbol ORDER BY date) THEN 0 ELSE 1 END AS turn FROM st),
rn AS (SELECT symbol, state, run, count(*) AS size FROM (SELECT *, sum(turn) OVER (PARTITION BY symbol ORDER BY date) AS run FROM tn) GROUP BY ALL)"""),
    }
    return queries, oracles
