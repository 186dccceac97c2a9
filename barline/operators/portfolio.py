"""Portfolio construction and risk over long returns (symbol, date, ret); pairs by join, weights by windows."""

from __future__ import annotations

from collections.abc import Callable
from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import by, ratio
from ..sources.scratch import held
from .cross import entry_timing

RET_WINDOW, MIN_PAIR, MAX_CORR, KEEP, CAP, MAX_NAMES = 126, 40, 0.92, 1.5, 0.15, 20


def recent_returns(bars: DataFrame, window: int = RET_WINDOW) -> DataFrame:
    """(symbol, date, ret) of the last ``window`` dates on which any symbol has a return."""
    r = bars.select("symbol", "date", (ratio(F.col("close"), F.lag("close").over(by())) - 1).alias("ret")).where("ret IS NOT NULL")
    dates = r.select("date").distinct().orderBy(F.desc("date")).limit(window)
    return r.join(F.broadcast(dates), "date").select("symbol", "date", "ret")


def pair_correlations(returns: DataFrame, least: int = MIN_PAIR) -> DataFrame:
    """(a, b, corr) of symbol pairs with ``least`` common dates: a join on date of one bounded window of returns."""
    right = returns.select(F.col("symbol").alias("b"), "date", F.col("ret").alias("rb"))
    both = returns.select(F.col("symbol").alias("a"), "date", "ret").join(right, "date").where("a < b")
    got = both.groupBy("a", "b").agg(F.count("*").alias("n"), F.covar_pop("ret", "rb").alias("c"), F.stddev_pop("ret").alias("sa"), F.stddev_pop("rb").alias("sb"))
    return got.where(F.col("n") >= least).select("a", "b", F.try_divide("c", F.col("sa") * F.col("sb")).alias("corr"))


def select_names(scores: DataFrame, pairs: DataFrame | Callable[[list[str]], DataFrame], incumbents: list[str] = (), most: int = MAX_NAMES, limit: float = MAX_CORR, page: int = 0) -> list[str]:
    """Greedy choice by score: incumbents that still rank well first, then the rest; none too close to a chosen one.

    The choice is sequential by nature, so the driver takes the positive scores page by page (``page`` names, six times ``most`` by
    default), best first, each with its pairs among itself and the chosen, until the book is full or no score is left. ``pairs``:
    (a, b, corr), or what gives them for some names.
    """
    of = pairs if callable(pairs) else lambda names: pairs.where(F.col("a").isin(names) & F.col("b").isin(names))
    positive, page = scores.where(F.col("score") > 0).select("symbol", "score"), page or 6 * most
    chosen: list[str] = []
    last, first = None, True
    while len(chosen) < most:
        rest = positive if last is None else positive.where((F.col("score") < last.score) | ((F.col("score") == last.score) & (F.col("symbol") > last.symbol)))
        rows = rest.orderBy(F.desc("score"), "symbol").limit(max(page, int(most * KEEP))).collect()
        if not rows:
            break
        order, last = [r.symbol for r in rows], rows[-1]
        close = {frozenset((r.a, r.b)) for r in of(order + chosen).where(F.col("corr") > limit).select("a", "b").collect()}
        kept = [s for s in order[: int(most * KEEP)] if s in set(incumbents)] if first else []
        for s in (*kept, *order):
            if len(chosen) < most and s not in chosen and not any(frozenset((s, c)) in close for c in chosen):
                chosen.append(s)
        first = False
    return chosen


def inverse_vol(returns: DataFrame, names: DataFrame) -> DataFrame:
    """(symbol, raw): tilt over volatility for (symbol, score); 0.02 where there are fewer than 20 returns."""
    vol = returns.groupBy("symbol").agg(F.count("ret").alias("n"), F.stddev_samp("ret").alias("sd"))
    sd = F.when((F.col("n") >= 20) & (F.col("sd") > 0), F.col("sd")).otherwise(0.02)
    return names.join(vol, "symbol", "left").select("symbol", ((1 + F.greatest(F.lit(0.0), F.col("score")) / 200) / sd).alias("raw"))


def capped(table: DataFrame, by: tuple[str, ...] = (), passes: int = 5, cap: float = CAP) -> DataFrame:
    """Adds weight: ``raw`` to sum 1, at most the cap (an equal split at least), the excess dealt by weight in a few passes."""
    w = Window.partitionBy(*by)
    table = table.withColumns({"cap": F.greatest(F.lit(cap), 1 / F.count("*").over(w)), "weight": F.col("raw") / F.sum("raw").over(w)})
    for _ in range(passes):
        over, under = F.col("weight") > F.col("cap"), F.col("weight") < F.col("cap")
        table = table.withColumns({"excess": F.sum(F.when(over, F.col("weight") - F.col("cap")).otherwise(0.0)).over(w), "room": F.sum(F.when(under, F.col("weight")).otherwise(0.0)).over(w)})
        moved = F.when(over, F.col("cap")).when(F.col("room") > 0, F.col("weight") + F.col("excess") * F.col("weight") / F.col("room")).otherwise(F.col("weight"))
        table = table.withColumn("weight", F.when(F.col("excess") <= 1e-9, F.col("weight")).otherwise(moved))
    return table.withColumn("weight", F.col("weight") / F.sum("weight").over(w)).drop("cap", "excess", "room")


def book(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, shares, price, value) at the last close."""
    last = bars.groupBy("symbol").agg(F.max_by("close", "date").alias("price"))
    return positions.join(last, "symbol").select("symbol", "shares", "price", (F.col("shares") * F.col("price")).alias("value"))


def rebalance(target: DataFrame, held: DataFrame, prices: DataFrame, base: float) -> DataFrame:
    """Trades from (symbol, weight) and (symbol, shares, value): small ones skipped, full exits by the held shares."""
    both = target.join(held.drop("price"), "symbol", "full").join(prices, "symbol", "left")
    both = both.select("symbol", "price", "shares", F.coalesce("value", F.lit(0.0)).alias("current_value"), (F.coalesce("weight", F.lit(0.0)) * base).alias("target_value"))
    both = both.withColumn("delta_value", F.col("target_value") - F.col("current_value")).where(F.abs("delta_value") >= max(0.01 * base, 25.0))
    shares = F.when((F.col("target_value") == 0) & F.col("shares").isNotNull(), -F.col("shares")).otherwise(F.try_divide("delta_value", "price"))
    return both.withColumns({"delta_shares": shares, "action": F.when(F.col("delta_value") > 0, "buy").otherwise("sell")}).drop("shares")


def fit(returns: DataFrame) -> DataFrame:
    """The returns of names that have one on 60 % of the dates or more."""
    n = returns.select("date").distinct().agg(F.count("*").alias("dates"))
    names = returns.groupBy("symbol").agg(F.count("ret").alias("n")).join(F.broadcast(n)).where(F.col("n") >= F.floor(F.col("dates") * 0.6)).select("symbol")  # one row
    return returns.join(names, "symbol", "left_semi")


def portfolio_returns(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """(date, ret) of fixed weights; names with under 60 % of the dates go, the rest are reweighted, gaps return 0."""
    known = fit(returns)
    used = weights.join(known.select("symbol").distinct(), "symbol")
    used = used.withColumn("weight", ratio(F.col("weight"), F.sum("weight").over(Window.partitionBy())))  # one row for each name
    return returns.join(used, "symbol").groupBy("date").agg(F.sum(F.col("ret") * F.col("weight")).alias("ret"))


def risk(port: DataFrame, bench: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: ann_vol, var_95, cvar_95, beta, hhi, effective_positions."""
    cut = port.agg(F.percentile("ret", F.lit(0.05)).alias("cut"))
    tail = port.join(F.broadcast(cut)).agg((100 * F.stddev_samp("ret") * sqrt(252)).alias("ann_vol"), (100 * F.first("cut")).alias("var_95"), (100 * F.avg(F.when(F.col("ret") <= F.col("cut"), F.col("ret")))).alias("cvar_95"))
    joint = port.join(bench.select("date", F.col("ret").alias("rb")), "date").agg(F.when(F.count("*") >= 20, F.try_divide(F.covar_samp("ret", "rb"), F.var_pop("rb"))).alias("beta"))
    size = weights.agg(F.sum(F.col("weight") * F.col("weight")).alias("hhi"))
    return tail.join(joint).join(size).withColumn("effective_positions", ratio(F.lit(1.0), F.col("hhi")))  # one row each


def market_state(mkt: DataFrame) -> DataFrame:
    """(date, above_200, dist_200, vol_pctile, risk, exposure, multiplier) of the benchmark; its realized volatility stands in for an index of it."""
    w = Window.orderBy("date")  # one benchmark series
    ret = F.ln(ratio(F.col("close"), F.lag("close").over(w)))
    m = mkt.select("date", "close", ret.alias("r"), F.count("close").over(w.rowsBetween(-199, 0)).alias("n"), F.avg("close").over(w.rowsBetween(-199, 0)).alias("mean"))
    m = m.withColumn("vol", F.when(F.count("r").over(w.rowsBetween(-20, 0)) >= 21, F.stddev_samp("r").over(w.rowsBetween(-20, 0))))
    m = m.withColumn("seen", F.collect_list("vol").over(w.rowsBetween(-1259, 0)))
    pct = F.when(F.col("vol").isNotNull() & (F.size("seen") >= 252), 100 * F.size(F.filter("seen", lambda v: v <= F.col("vol"))) / F.size("seen"))
    m = m.select("date", F.when(F.col("n") >= 200, F.col("close") > F.col("mean")).alias("above_200"), F.when(F.col("n") >= 200, 100 * (F.col("close") / F.col("mean") - 1)).alias("dist_200"), pct.alias("vol_pctile"))
    m = m.withColumn("risk", classify_risk(F.col("above_200"), F.col("vol_pctile")))
    return m.withColumns({"exposure": by_risk(1.0, 0.6, 0.3, 1.0), "multiplier": by_risk(1.0, 0.95, 0.85, 1.0)})


def classify_risk(above: Column, pctile: Column) -> Column:
    hot = pctile >= 80
    return F.when(above.isNull() & pctile.isNull(), "unknown").when(~F.coalesce(above, F.lit(True)) & F.coalesce(hot, F.lit(False)), "off").when(~F.coalesce(above, F.lit(True)) | F.coalesce(hot, F.lit(False)), "neutral").otherwise("on")


def by_risk(on: float, neutral: float, off: float, unknown: float) -> Column:
    r = F.col("risk")
    return F.when(r == "on", on).when(r == "neutral", neutral).when(r == "off", off).otherwise(unknown)


def risk_summary(returns: DataFrame, bench: DataFrame, weights: DataFrame) -> DataFrame:
    """One row: :func:`risk`, and top_symbol, top_weight, avg_corr, pair_a, pair_b, pair_corr of a book (symbol, weight)."""
    top = weights.agg(F.max_by("symbol", F.struct("weight", "symbol")).alias("top_symbol"), F.max("weight").alias("top_weight"))
    held = fit(returns.join(weights.select("symbol"), "symbol", "left_semi"))
    pairs = pair_correlations(held, 2).where(F.col("corr").isNotNull())
    most = F.max_by(F.struct("a", "b", "corr"), F.struct("corr", "a", "b"))
    close = pairs.agg(F.avg("corr").alias("avg_corr"), most.alias("p")).select("avg_corr", F.col("p.a").alias("pair_a"), F.col("p.b").alias("pair_b"), F.col("p.corr").alias("pair_corr"))
    return risk(portfolio_returns(returns, weights), bench, weights).join(top).join(close)  # one row each


def portfolio_risk(positions: DataFrame, bars: DataFrame, bench: DataFrame) -> DataFrame:
    """:func:`risk_summary` of held shares (symbol, shares) at their last closes."""
    held = book(positions, bars)
    weights = held.select("symbol", (F.col("value") / F.sum("value").over(Window.partitionBy())).alias("weight"))  # one row for each name
    return risk_summary(recent_returns(bars), recent_returns(bench), weights)


def recommend(scan: DataFrame, bars: DataFrame, positions: DataFrame, exposure: float = 1.0, previous: tuple[str, ...] = (), base: float | None = None, most: int = MAX_NAMES, limit: float = MAX_CORR, period: str = "1m") -> dict:
    """The recommended book from a scan: holdings, trades and changes.

    holdings (symbol, weight, score, timing, price, target_value, target_shares); trades as :func:`rebalance`; base: the value that
    targets are sized by (that of the positions if not given), exposure, cash_weight (percent), added, dropped. Only the chosen
    names, 20 at most, and the book's value reach the driver.
    """
    spark = bars.sparkSession
    exposure = min(1.0, max(0.0, exposure))
    returns = recent_returns(bars)
    scores = scan.where(F.col("period") == period).select("symbol", "score")
    chosen = select_names(scores, lambda names: pair_correlations(returns.where(F.col("symbol").isin(names))), list(previous), most, limit)
    names = scores.where(F.col("symbol").isin(chosen))
    weights = held(capped(inverse_vol(returns, names)).select("symbol", "weight"))  # a book's names, read by all that follows
    own = book(positions, bars)
    base = base or own.agg(F.coalesce(F.sum("value"), F.lit(0.0))).first()[0]
    prices = bars.groupBy("symbol").agg(F.max_by("close", "date").alias("price"))
    short = scan.groupBy("symbol").agg(*[F.max(F.when(F.col("period") == p, F.col("score"))).alias(f"s{p}") for p in ("1d", "1w")])
    holdings = weights.join(names, "symbol").join(prices, "symbol", "left").join(short, "symbol", "left")
    value = F.col("weight") * base * exposure
    holdings = holdings.select("symbol", "weight", "score", entry_timing(F.coalesce("s1d", "s1w")).alias("timing"), "price", value.alias("target_value"), ratio(value, F.col("price")).alias("target_shares"))
    gone = sorted(set(previous) - set(chosen)) if previous else []
    new = sorted(set(chosen) - set(previous)) if previous else []
    return {
        "holdings": holdings if chosen else spark.createDataFrame([], holdings.schema), "trades": rebalance(weights, own, prices, base * exposure), "weights": weights, "base": base, "exposure": exposure,
        "cash_weight": 100 * (1 - exposure), "added": new, "dropped": gone,
    }
