"""Queries of detailed advice at every bar, and of the sorted table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import add
from ..functions.recursive import add_recursive
from ..operators import advice, cross
from ..sources.bars import derive_bars
from . import indicator_sql as sql

TERMS = {"short": "zscore20", "medium": "mom126"}
PERIODS = {"1w": "mom5", "1m": "mom21", "6m": "mom126"}
WITHOUT = ("NATION_3", "NATION_12")


def detailed_query(spark, sf_dir) -> DataFrame:
    """Each date's names ranked by two measures stand for the two terms, so that every rule is met."""
    t = add(add_recursive(derive_bars(spark, sf_dir)), *TERMS.values(), "rsi14", "bbp20", "adx14").where(" AND ".join(f"{v} IS NOT NULL" for v in TERMS.values()))
    for term, value in TERMS.items():
        t = cross.percentile_rank(t.withColumn(value, F.round(value, 9)), value, ("date",)).withColumnRenamed("rank", f"{term}_rank")
    t = t.select("symbol", "date", "short_rank", "medium_rank", F.col("rsi14").alias("rsi"), F.col("bbp20").alias("bbp"), F.col("macd_hist").alias("macd"), F.col("adx14").alias("adx"))
    return advice.detailed(t).drop("rsi", "bbp", "macd", "adx")


def sort_query(spark, sf_dir) -> DataFrame:
    """Every order of the last bars' table, both ways; two symbols lack a period."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("date"))
    last = add(derive_bars(spark, sf_dir), *PERIODS.values()).withColumn("at", F.row_number().over(newest)).where("at = 1")
    long = last.select("symbol", F.inline(F.array(*[F.struct(F.lit(p).alias("period"), F.round(v, 9).alias("score")) for p, v in PERIODS.items()])))
    ranks = cross.percentile_rank(long.where("score IS NOT NULL").where(~(F.col("symbol").isin(*WITHOUT) & (F.col("period") == "1m"))))
    parts = [advice.sorted_table(ranks, c, up).select(F.lit(c).alias("by"), F.lit(up).alias("ascending"), "symbol", "place") for c in ("symbol", "action", "1m", "6m") for up in (True, False)]
    return reduce(DataFrame.unionByName, parts)


def rank_sql(value: str, by: str) -> str:
    n = f"count(*) OVER (PARTITION BY {by})"
    mean = f"(rank() OVER (PARTITION BY {by} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2.0::DOUBLE)"
    return f"CAST(CASE WHEN {n} <= 1 THEN 5 ELSE least(10, greatest(1, floor((100 - 100 * {mean} / {n}) / 10) + 1)) END AS INT)"


def build() -> tuple[dict, dict]:
    ladders = {
        "sell": ("s >= 9 AND m >= 8", "at once", [("rsi > 70", "overbought by RSI"), ("bbp > 0.85", "at the upper band"), ("macd < 0", "MACD falls"), ("true", "most measures are weak")], "close the position"),
        "reduce": ("s >= 7 AND m >= 6", "1-4 weeks", [("rsi > 60 AND rsi < 70", "nearly overbought by RSI"), ("bbp > 0.7", "nears the upper band"), ("macd < 0 AND adx >= 20 AND adx < 40", "MACD falls in a moderate trend"), ("true", "a turn is likely")], "sell a part, or tighten the stop"),
        "buy": ("s <= 2 AND m <= 3", "up to 2 weeks", [("rsi < 30", "oversold by RSI"), ("bbp < 0.15", "at the lower band"), ("macd > 0 AND adx >= 40", "MACD rises in a strong trend"), ("true", "most measures are strong")], "add in steps of equal value"),
        "accumulate": ("s <= 4 AND m <= 5", "2-6 weeks", [("rsi > 30 AND rsi < 40", "RSI recovers"), ("bbp > 0.3 AND bbp < 0.5", "crosses the middle band from below"), ("macd > 0", "MACD rises"), ("true", "the pattern points up")], "buy a part first"),
        "watch": ("s >= 6 AND m <= 4", "1-3 months", [("true", "weak now, better later")], "wait for the low before adding"),
        "trade": ("s <= 4 AND m >= 6", "1-4 weeks", [("true", "strength may not last")], "trade with a near stop"),
        "hold": ("true", "3-6 months", [("abs(macd) < 0.001", "MACD near zero"), ("rsi > 40 AND rsi < 60", "RSI is neutral"), ("bbp > 0.4 AND bbp < 0.6", "near the middle band"), ("true", "mixed measures")], ""),
    }
    action = "CASE " + " ".join(f"WHEN {c} THEN '{a}'" for a, (c, *_) in ladders.items()) + " END"
    per = lambda k: "CASE action " + " ".join(f"WHEN '{a}' THEN '{row[k]}'" for a, row in ladders.items()) + " END"
    reason = "CASE action " + " ".join(f"WHEN '{a}' THEN CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t in row[2]) + " END" for a, row in ladders.items()) + " END"
    strategy = f"CASE reason WHEN 'MACD near zero' THEN 'wait for a breakout either way' WHEN 'RSI is neutral' THEN 'look again in 2-4 weeks' WHEN 'near the middle band' THEN 'wait for a direction' WHEN 'mixed measures' THEN 'write covered calls' ELSE {per(3)} END"
    detailed = sql.with_bars(("zscore20", "mom126", "rsi14", "bbp20", "adx14"), f"SELECT symbol, date, s AS short_rank, m AS medium_rank, action, horizon, reason, {strategy} AS strategy FROM d3", True, f"""d0 AS (SELECT *, round(zscore20, 9) AS z, round(mom126, 9) AS mo FROM f WHERE zscore20 IS NOT NULL AND mom126 IS NOT NULL),
d1 AS (SELECT symbol, date, {rank_sql("z", "date")} AS s, {rank_sql("mo", "date")} AS m, coalesce(nullif(rsi14, 0), 50) AS rsi, coalesce(nullif(bbp20, 0), 0.5) AS bbp, coalesce(macd_hist, 0) AS macd, coalesce(nullif(adx14, 0), 25) AS adx FROM d0),
d2 AS (SELECT *, {action} AS action FROM d1), d3 AS (SELECT *, {per(1)} AS horizon, {reason} AS reason FROM d2)""")
    scored = " UNION ALL ".join(f"SELECT symbol, '{p}' AS period, round({v}, 9) AS score FROM l WHERE {v} IS NOT NULL{' AND symbol NOT IN (' + ', '.join(map(repr, WITHOUT)) + ')' if p == '1m' else ''}" for p, v in PERIODS.items())
    orders = []
    for up in (True, False):
        orders.append(f"SELECT 'symbol' AS by, {up} AS ascending, symbol, CAST(row_number() OVER (ORDER BY symbol {'ASC' if up else 'DESC'}) AS INT) AS place FROM w")
        orders += [f"SELECT '{c}', {up}, symbol, CAST(row_number() OVER (ORDER BY r{p} {'ASC' if up else 'DESC'} NULLS LAST, symbol) AS INT) FROM w" for c, p in (("action", "1w"), ("1m", "1m"), ("6m", "6m"))]
    pivot = ", ".join(f"max(CASE WHEN period = '{p}' THEN r END) AS r{p}" for p in PERIODS)
    table = sql.with_bars(tuple(PERIODS.values()), " UNION ALL ".join(orders), more=f"""l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1),
u AS ({scored}), k AS (SELECT symbol, period, {rank_sql("score", "period")} AS r FROM u), w AS MATERIALIZED (SELECT symbol, {pivot} FROM k GROUP BY symbol)""")
    return {"actions_detailed": detailed_query, "table_sorted": sort_query}, {"actions_detailed": detailed, "table_sorted": table}
