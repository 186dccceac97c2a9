"""Cross-sections: ranks, percentiles, movers, filters and actions over a scan (symbol, sector, period, score, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, *by: str) -> Column:
    """Rank from the smallest; ties share their mean rank."""
    order = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return F.rank().over(order) + (F.count("*").over(ties) - 1) / F.lit(2.0)


def percentile_rank(table: DataFrame, value: str = "score", by: tuple[str, ...] = ("period",)) -> DataFrame:
    """Adds rank: 1 for the top tenth to 10 for the bottom one; 5 for a lone name."""
    n = F.count(value).over(Window.partitionBy(*by))
    pct = 100 * average_rank(value, *by) / n
    rank = F.least(F.greatest(F.floor((100 - pct) / 10) + 1, F.lit(1)), F.lit(10))
    return table.withColumn("rank", F.when(n <= 1, 5).otherwise(rank).cast("int"))


def rank_label(rank: Column) -> Column:
    return (
        F.when(rank == 1, "STRONG BUY").when(rank.isin(2, 3), "BUY").when(rank == 4, "WEAK BUY").when(rank == 7, "WEAK SELL")
        .when(rank.isin(8, 9), "SELL").when(rank == 10, "STRONG SELL").otherwise("HOLD")
    )


def percentiles(table: DataFrame, value: str = "score") -> DataFrame:
    """Adds universe_pct (needs 2 names) and sector_pct (needs 3 peers): share with a score no higher, one decimal."""
    whole, own = Window.partitionBy("period"), Window.partitionBy("period", "sector")
    at = F.round(F.cume_dist().over(whole.orderBy(value)) * 100, 1)
    peer = F.round(F.cume_dist().over(own.orderBy(value)) * 100, 1)
    return table.withColumns({"universe_pct": F.when(F.count("*").over(whole) >= 2, at), "sector_pct": F.when(F.col("sector").isNotNull() & (F.count("*").over(own) >= 3), peer)})


def movers(now: DataFrame, before: DataFrame, least: int = 3, top: int = 10) -> DataFrame:
    """Names whose rank changed by ``least`` or more, largest change first."""
    both = now.select("symbol", "period", F.col("rank").alias("rank_to")).join(before.select("symbol", "period", F.col("rank").alias("rank_from")), ["symbol", "period"])
    return both.where(F.abs(F.col("rank_to") - F.col("rank_from")) >= least).orderBy(F.desc(F.abs(F.col("rank_to") - F.col("rank_from"))), "symbol", "period").limit(top)


def filtered(table: DataFrame, only_buys: bool = False, ranks_above: int = 0) -> DataFrame:
    """All periods of the symbols that have one good period; everything if no symbol has."""
    good = F.lit(True)
    if only_buys:
        good = good & F.col("recommendation").contains("BUY")
    if ranks_above:
        good = good & (F.col("rank") < ranks_above)
    kept = table.where(good).select("symbol").distinct()
    any_left = kept.agg((F.count("*") > 0).alias("any"))
    marked = table.join(kept.withColumn("hit", F.lit(True)), "symbol", "left").join(F.broadcast(any_left))  # one row
    return marked.where(F.coalesce("hit", F.lit(False)) | ~F.col("any")).drop("hit", "any")


def actions(table: DataFrame) -> DataFrame:
    """(symbol, short_rank, medium_rank, action, timing): the better of two ranks for each term, 5 where there is none; timing by the shortest score there is."""
    ranks = [F.max(F.when(F.col("period") == p, F.col("rank"))).alias(f"r{p}") for p in ("1w", "1m", "6m", "1y")]
    scores = [F.max(F.when(F.col("period") == p, F.col("score"))).alias(f"s{p}") for p in ("1d", "1w")]
    wide = table.groupBy("symbol").agg(*ranks, *scores)
    short, medium = (F.least(F.coalesce(F.col(f"r{a}"), F.lit(5)), F.coalesce(F.col(f"r{b}"), F.lit(5))) for a, b in (("1w", "1m"), ("6m", "1y")))
    wide = wide.select("symbol", short.cast("int").alias("short_rank"), medium.cast("int").alias("medium_rank"), entry_timing(F.coalesce("s1d", "s1w")).alias("timing"))
    s, m = F.col("short_rank"), F.col("medium_rank")
    action = F.when((s <= 3) & (m <= 3), "STRONG BUY").when((s <= 3) | (m <= 3), "BUY").when((s >= 8) & (m >= 8), "STRONG SELL").when((s >= 8) | (m >= 8), "SELL").otherwise("HOLD")
    return wide.withColumn("action", action)


def entry_timing(score: Column) -> Column:
    return F.when(score >= 15, "enter").when(score <= -15, "wait").otherwise("ok")


def positions_value(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, value, cost, pnl, pnl_pct) of (symbol, shares, entry_price) at the last close."""
    last = bars.groupBy("symbol").agg(F.max_by("close", "date").alias("last"))
    value, cost = F.col("shares") * F.col("last"), F.col("shares") * F.col("entry_price")
    return positions.join(last, "symbol").select("symbol", value.alias("value"), cost.alias("cost"), (value - cost).alias("pnl"), (100 * F.try_divide(value - cost, cost)).alias("pnl_pct"))
