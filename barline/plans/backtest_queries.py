"""Queries of the walk-forward backtest and its audit, with three cheap signals as strategies."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import add
from ..operators import backtest as bt
from ..operators.asof import pad
from ..sources.bars import derive_bars, held_bars, market
from ..sources.scratch import held
from . import indicator_sql as sql

SIGNALS = ("mom21", "zscore20", "cmf20")
STRATEGIES = ["momentum", "reversion", "flow"]
STEP, YEARS, BLOCKS = 5, 10, 10
COSTS = (0, 5, 10, 20)


def _panel(spark, sf_dir) -> DataFrame:
    bars = add(held_bars(spark, sf_dir), "n_bar", *SIGNALS)
    bars = bars.withColumns({"momentum": F.col("mom21"), "reversion": -F.col("zscore20"), "flow": F.col("cmf20")})
    return bt.panel(bars, bt.calendar(market(spark, sf_dir), STEP, YEARS), STRATEGIES)


def _returns(spark, sf_dir) -> DataFrame:
    return bt.strategy_returns(held(_panel(spark, sf_dir)), STRATEGIES)


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def asof_query(spark, sf_dir) -> DataFrame:
    bars, mkt = held_bars(spark, sf_dir), bt.calendar(market(spark, sf_dir), STEP, YEARS)
    asked = bars.select("symbol").distinct().join(F.broadcast(mkt.select("date", "k")))
    return pad(bars, asked, ["close"]).select("symbol", "k", "date", "bar_date", "close", F.date_diff("date", "bar_date").alias("age"))


def panel_query(spark, sf_dir) -> DataFrame:
    return rounded(_panel(spark, sf_dir))


def returns_query(spark, sf_dir) -> DataFrame:
    return rounded(_returns(spark, sf_dir))


def stats_query(bps: int, spark, sf_dir) -> DataFrame:
    got = bt.stats(bt.after_costs(_returns(spark, sf_dir), bps), STEP)
    return rounded(got.drop("cagr", "total"), 4)


def ic_query(spark, sf_dir) -> DataFrame:
    return rounded(bt.information_coefficients(_panel(spark, sf_dir), STRATEGIES))


def ic_stats_query(spark, sf_dir) -> DataFrame:
    return rounded(bt.ic_stats(bt.information_coefficients(_panel(spark, sf_dir), STRATEGIES)), 4)


def deciles_query(spark, sf_dir) -> DataFrame:
    return rounded(bt.deciles(_panel(spark, sf_dir), "momentum", STEP), 3)


def regimes_query(spark, sf_dir) -> DataFrame:
    joined = _returns(spark, sf_dir).join(bt.regime_labels(market(spark, sf_dir)), "date")
    return rounded(joined.groupBy("strategy", "label").agg(F.count("*").alias("n"), F.avg("ret").alias("mean_ret"), F.stddev_pop("ret").alias("sd")).where("n >= 8"), 4)


def sharpe_parts_query(spark, sf_dir) -> DataFrame:
    return rounded(bt.sharpe_parts(_returns(spark, sf_dir)), 4)


def pbo_query(spark, sf_dir) -> DataFrame:
    return rounded(bt.overfitting(_returns(spark, sf_dir), BLOCKS), 5)


def cal_sql(step: int, years: int) -> str:
    return f"""cal AS MATERIALIZED (SELECT CAST((pos - first) / {step} AS INT) AS k, date, next_date FROM (
  SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, lead(date, {step}) OVER (ORDER BY date) AS next_date, greatest(300, count(*) OVER () - {years * 252}) AS first, count(*) OVER () AS n FROM mkt)
  WHERE pos >= first AND pos < n - {step} AND (pos - first) % {step} = 0)"""


CAL = cal_sql(STEP, YEARS)


def panel_sql(signals: dict[str, str], strategies: list[str], source: str = "f", cal: str = CAL) -> str:
    """CTEs up to ``panel`` and ``long``: named expressions over ``source`` at each date, with the return to the next one."""
    names = ", ".join(signals)
    made = ", ".join(f"{e} AS {n}" for n, e in signals.items())
    return f"""{sql.MARKET}, {cal},
sig AS MATERIALIZED (SELECT symbol, date, close, n_bar, {made} FROM {source}),
ask AS (SELECT s.symbol, c.* FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN cal c),
p0 AS (SELECT a.k, a.date, a.symbol, a.next_date, b.date AS d0, b.n_bar AS n0, b.close AS c0, {names} FROM ask a ASOF JOIN sig b ON a.symbol = b.symbol AND a.date >= b.date),
panel AS MATERIALIZED (SELECT p.k, p.date, p.symbol, {", ".join(f"p.{n}" for n in signals)}, b.close / c0 - 1 AS fwd FROM p0 p ASOF JOIN sig b ON p.symbol = b.symbol AND p.next_date >= b.date
  WHERE n0 >= 300 AND date_diff('day', d0, p.date) <= 10 AND b.n_bar > n0 AND c0 > 0),
long AS MATERIALIZED (SELECT k, date, symbol, fwd, {"vol, " if "vol" in signals else ""}strategy, value FROM panel UNPIVOT (value FOR strategy IN ({", ".join(strategies)})))"""


def returns_sql(strategies: list[str], weighting: str = "equal") -> str:
    """CTEs up to ``ret``: each strategy's return and turnover at each date."""
    caps = ""
    mean = "avg(fwd)"
    if weighting == "inv_vol":
        by = "OVER (PARTITION BY strategy, k)"
        caps = f""",
w0 AS (SELECT *, greatest(0.15::DOUBLE, 1.0::DOUBLE / count(*) {by}) AS c, raw / sum(raw) {by} AS w FROM (SELECT *, 1 / greatest(coalesce(nullif(vol, 0), 20), 1e-6) AS raw FROM held))""" + "".join(
            f""",
e{j} AS (SELECT strategy, k, symbol, fwd, c, w, sum(CASE WHEN w > c THEN w - c ELSE 0 END) {by} AS x, sum(CASE WHEN w < c THEN w ELSE 0 END) {by} AS u FROM w{j}),
w{j + 1} AS (SELECT strategy, k, symbol, fwd, c, CASE WHEN x <= 1e-9 THEN w WHEN w > c THEN c WHEN u > 0 THEN w + x * w / u ELSE w END AS w FROM e{j})"""
            for j in range(5)
        )
        mean = "sum(fwd * w) / sum(w)"
    source = "w5" if caps else "held"
    more = ", vol" if caps else ""
    listed = ", ".join(f"'{s}'" for s in strategies)
    return f"""held AS MATERIALIZED (SELECT strategy, k, symbol, fwd{more} FROM (SELECT *, count(*) OVER (PARTITION BY strategy, k) AS n, row_number() OVER (PARTITION BY strategy, k ORDER BY value DESC, symbol) AS i FROM long)
  WHERE n >= 5 AND i <= greatest(1, floor(n * 0.2))){caps},
used AS (SELECT strategy, k, {mean} AS ret, list(symbol) AS names, lag(list(symbol)) OVER (PARTITION BY strategy ORDER BY k) AS old FROM {source} GROUP BY strategy, k),
ret AS MATERIALIZED (SELECT s.strategy, d.k, d.date, coalesce(u.ret, 0) AS ret, CASE WHEN u.old IS NULL THEN 0 ELSE len(list_filter(u.names, lambda x: NOT list_contains(u.old, x))) / len(u.names) END AS turnover
  FROM (SELECT DISTINCT k, date FROM panel) d CROSS JOIN (SELECT unnest([{listed}]) AS strategy) s LEFT JOIN used u ON u.k = d.k AND u.strategy = s.strategy)"""


def ic_sql() -> str:
    return """ic AS MATERIALIZED (SELECT strategy, k, corr(rv, rf) AS ic FROM (SELECT strategy, k,
    rank() OVER (PARTITION BY strategy, k ORDER BY value) + (count(*) OVER (PARTITION BY strategy, k, value) - 1) / 2.0::DOUBLE AS rv,
    rank() OVER (PARTITION BY strategy, k ORDER BY fwd) + (count(*) OVER (PARTITION BY strategy, k, fwd) - 1) / 2.0::DOUBLE AS rf FROM (SELECT strategy, k, round(value, 9) AS value, round(fwd, 9) AS fwd FROM long))
  GROUP BY strategy, k HAVING count(*) >= 8 AND stddev_pop(rv) > 0 AND stddev_pop(rf) > 0)"""


PANEL, RETURNS, IC = panel_sql({"momentum": "mom21", "reversion": "-zscore20", "flow": "cmf20"}, STRATEGIES), returns_sql(STRATEGIES), ic_sql()


def query(select: str, *more: str) -> str:
    return sql.with_bars(("n_bar", *SIGNALS), select, more=",\n".join((PANEL, *more)))


def stats_sql(bps: int) -> str:
    eq = f"""net AS (SELECT strategy, k, ret - 2 * turnover * {bps} / 10000.0::DOUBLE AS ret, turnover FROM ret),
eq AS (SELECT *, sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY k) AS le FROM net),
pk AS (SELECT *, max(le) OVER (PARTITION BY strategy ORDER BY k) AS lp FROM eq)"""
    per = 252 / STEP
    return query(
        f"""SELECT strategy, round(max_by(le, k) * {per} / count(*), 4) AS log_cagr, round(100 * stddev_pop(ret) * sqrt({per}), 4) AS vol, round(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt({per}), 4) AS sharpe,
  round(100 * min(exp(le - lp) - 1), 4) AS max_dd, round(100 * avg((ret > 0)::INT), 4) AS hit, round(max_by(le, k), 4) AS log_total, round(avg(CASE WHEN k > 0 THEN turnover END), 4) AS turnover, count(*) AS n FROM pk GROUP BY strategy""",
        RETURNS,
        eq,
    )


def pbo_sql() -> str:
    n = "(SELECT max(k) + 1 FROM ret)"
    return query(
        """SELECT round(avg((logit <= 0)::INT), 5) AS pbo, count(*) AS splits, round(quantile_cont(logit, 0.5), 5) AS median_logit FROM lg""",
        RETURNS,
        f"""blk AS (SELECT strategy, CASE WHEN k < ({n} % {BLOCKS}) * ({n} // {BLOCKS} + 1) THEN k // ({n} // {BLOCKS} + 1) ELSE {n} % {BLOCKS} + (k - ({n} % {BLOCKS}) * ({n} // {BLOCKS} + 1)) // ({n} // {BLOCKS}) END AS b, ret FROM ret),
masks AS (SELECT m FROM range(0, {1 << BLOCKS}) t(m) WHERE bit_count(m::INT) = {BLOCKS // 2}),
sh AS (SELECT m, strategy, (m >> b::BIGINT) & 1 AS inside, coalesce(avg(ret) / nullif(stddev_samp(ret), 0), 0) AS s FROM blk CROSS JOIN masks GROUP BY ALL),
wd AS (SELECT m, strategy, max(CASE WHEN inside = 1 THEN s END) AS a, max(CASE WHEN inside = 0 THEN s END) AS o FROM sh GROUP BY ALL),
rk AS (SELECT m, row_number() OVER (PARTITION BY m ORDER BY o, strategy) AS r, count(*) OVER (PARTITION BY m) AS c, row_number() OVER (PARTITION BY m ORDER BY a DESC, strategy) AS best FROM wd),
lg AS (SELECT ln((r / (c + 1)::DOUBLE) / (1 - r / (c + 1)::DOUBLE)) AS logit FROM rk WHERE best = 1)""",
    )


def build() -> tuple[dict, dict]:
    r5 = "round({0}, 5) AS {0}".format
    queries = {
        "asof_pad": asof_query, "bt_panel": panel_query, "bt_returns": returns_query, "bt_ic": ic_query, "bt_ic_stats": ic_stats_query, "bt_deciles": deciles_query, "bt_regimes": regimes_query,
        "audit_sharpe_parts": sharpe_parts_query, "audit_pbo": pbo_query,
    }
    oracles = {
        "asof_pad": f"""WITH {sql.BARS}, {sql.MARKET}, {CAL}
SELECT a.symbol, a.k, a.date, b.date AS bar_date, b.close AS close, CAST(date_diff('day', b.date, a.date) AS INT) AS age
FROM (SELECT s.symbol, c.k, c.date FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN cal c) a ASOF JOIN bars b ON a.symbol = b.symbol AND a.date >= b.date""",
        "bt_panel": query(f"SELECT k, date, symbol, {r5('momentum')}, {r5('reversion')}, {r5('flow')}, {r5('fwd')} FROM panel"),
        "bt_returns": query(f"SELECT strategy, k, date, {r5('ret')}, {r5('turnover')} FROM ret", RETURNS),
        "bt_ic": query(f"SELECT strategy, k, {r5('ic')} FROM ic", IC),
        "bt_ic_stats": query("SELECT strategy, round(avg(ic), 4) AS mean, round(stddev_pop(ic), 4) AS sd, round(avg(ic) / stddev_pop(ic), 4) AS ir, round(avg(ic) / stddev_pop(ic) * sqrt(count(*)), 4) AS t, round(100 * avg((round(ic, 9) > 0)::INT), 4) AS positive, count(*) AS n FROM ic GROUP BY strategy", IC),
        "bt_deciles": query(f"SELECT CAST(least(10, (i * 10) // n + 1) AS INT) AS decile, round(100 * avg(fwd) * 252 / {STEP}, 3) AS ann_return, count(*) AS n FROM (SELECT fwd, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY momentum, symbol) - 1 AS i FROM panel WHERE momentum IS NOT NULL) WHERE n >= 10 GROUP BY 1"),
        "bt_regimes": query("""SELECT strategy, label, count(*) AS n, round(avg(ret), 4) AS mean_ret, round(stddev_pop(ret), 4) AS sd FROM ret JOIN (
  SELECT date, CASE WHEN count(close) OVER w < 100 THEN 'unknown' WHEN close >= avg(close) OVER w THEN 'bull' ELSE 'bear' END AS label FROM mkt WINDOW w AS (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)) USING (date) GROUP BY ALL HAVING count(*) >= 8""", RETURNS),
        "audit_sharpe_parts": query("""SELECT strategy, count(*) AS n, round(any_value(m) / any_value(sd), 4) AS sharpe, round(avg(power((ret - m) / sd, 3)), 4) AS skew, round(avg(power((ret - m) / sd, 4)), 4) AS kurt
FROM (SELECT strategy, ret, avg(ret) OVER (PARTITION BY strategy) AS m, stddev_samp(ret) OVER (PARTITION BY strategy) AS sd FROM ret) GROUP BY strategy""", RETURNS),
        "audit_pbo": pbo_sql(),
    }
    for bps in COSTS:
        queries[f"bt_stats_{bps}bps"], oracles[f"bt_stats_{bps}bps"] = partial(stats_query, bps), stats_sql(bps)
    return queries, oracles
