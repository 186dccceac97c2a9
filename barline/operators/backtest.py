"""Walk-forward backtest over a long panel (k, date, symbol, values, fwd): no loop over dates, no dense matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import ratio
from .asof import pad
from .cross import average_rank
from .portfolio import by_risk, capped, classify_risk

START, STALE_DAYS, MIN_NAMES, MIN_IC, MIN_DECILE = 300, 10, 5, 8, 10


def calendar(mkt: DataFrame, step: int = 5, years: float = 10) -> DataFrame:
    """(k, date, next_date, bench_ret): every ``step``-th benchmark date of the last years, from bar 300 on, that has a next one; the benchmark's return to it."""
    n = F.count("*").over(Window.partitionBy())
    return _every(mkt, F.greatest(F.lit(START), n - int(years * 252)), n, step)


def calendar_between(mkt: DataFrame, step: int, begin: str | None = None, end: str | None = None) -> DataFrame:
    """As :func:`calendar`, from the last date up to ``begin`` (bar 300 if None) to the last one up to ``end`` (all if None)."""
    whole = Window.partitionBy()

    def place(day: str):
        return F.sum((F.col("date") <= F.to_date(F.lit(day))).cast("int")).over(whole) - 1

    return _every(mkt, F.lit(START) if begin is None else place(begin), F.count("*").over(whole) if end is None else place(end), step)


def _every(mkt: DataFrame, first, stop, step: int) -> DataFrame:
    # The benchmark is one short series; its windows are no skew.
    order = Window.orderBy("date")
    ahead = F.when(F.col("close") > 0, F.lead("close", step).over(order) / F.col("close") - 1).otherwise(0.0)
    at = mkt.select("date", (F.row_number().over(order) - 1).alias("pos"), F.lead("date", step).over(order).alias("next_date"), ahead.alias("bench_ret"), first.alias("first"), stop.alias("stop"))
    at = at.where((F.col("pos") >= F.col("first")) & (F.col("pos") < F.col("stop") - step) & ((F.col("pos") - F.col("first")) % step == 0))
    return at.select(((F.col("pos") - F.col("first")) / step).cast("int").alias("k"), "date", "next_date", "bench_ret")


def panel(features: DataFrame, dates: DataFrame, values: list[str], bars: DataFrame | None = None) -> DataFrame:
    """(k, date, symbol, values, fwd): what was known at each date, and the return to the next one.

    ``bars`` (symbol, date, close, n_bar): where costly features are derived from, so that names and next closes don't derive them again.
    """
    bars = features if bars is None else bars
    names = bars.select("symbol").distinct()
    asked = names.join(F.broadcast(dates))  # the calendar is bounded by trading days
    now = pad(features, asked.select("symbol", "date", "k", "next_date"), [*values, "close", "n_bar"])
    now = now.where((F.col("n_bar") >= START) & (F.date_diff("date", "bar_date") <= STALE_DAYS))
    ahead = pad(bars, now.select("symbol", F.col("next_date").alias("date"), "k"), ["close", "n_bar"], "next_")
    both = now.join(ahead.select("symbol", "k", "next_close", "next_n_bar"), ["symbol", "k"])
    both = both.where((F.col("next_n_bar") > F.col("n_bar")) & (F.col("close") > 0))
    return both.select("k", "date", "symbol", *values, (F.col("next_close") / F.col("close") - 1).alias("fwd"))


def melted(table: DataFrame, strategies: list[str]) -> DataFrame:
    """One row for each strategy's value."""
    return table.unpivot(["k", "date", "symbol", "fwd"], strategies, "strategy", "value").where("value IS NOT NULL")


def holdings(table: DataFrame, strategies: list[str], top: float = 0.2, more: tuple[str, ...] = ()) -> DataFrame:
    """(strategy, k, symbol, fwd, more) of the best ``top`` share of names, on dates with enough of them."""
    long = table.unpivot(["k", "date", "symbol", "fwd", *more], strategies, "strategy", "value").where("value IS NOT NULL")
    by = Window.partitionBy("strategy", "k")
    long = long.withColumns({"n": F.count("*").over(by), "at": F.row_number().over(by.orderBy(F.desc("value"), "symbol"))})
    return long.where((F.col("n") >= MIN_NAMES) & (F.col("at") <= F.greatest(F.lit(1), F.floor(F.col("n") * top)))).select("strategy", "k", "symbol", "fwd", *more)


def holding_weights(held: DataFrame) -> DataFrame:
    """Adds weight: inverse to ``vol`` (percent a year; 20 where it is missing), capped as a recommended book is."""
    vol = F.coalesce(F.nullif(F.col("vol"), F.lit(0.0)), F.lit(20.0))
    return capped(held.withColumn("raw", 1 / F.greatest(vol, F.lit(1e-6))), ("strategy", "k")).drop("raw")


def strategy_returns(table: DataFrame, strategies: list[str], top: float = 0.2, weighting: str = "equal", exposure: DataFrame | None = None) -> DataFrame:
    """(strategy, k, date, ret, turnover): dates without enough names return 0 and keep what was held.

    ``weighting``: "equal", or "inv_vol" by the panel's column ``vol``. ``exposure`` (date, exposure): the invested share at each date.
    """
    if weighting == "inv_vol":
        held = holding_weights(holdings(table, strategies, top, ("vol",)))
        used = held.groupBy("strategy", "k").agg(F.sum(F.col("fwd") * F.col("weight")).alias("ret"), F.count("*").alias("n"))
    else:
        held = holdings(table, strategies, top)
        used = held.groupBy("strategy", "k").agg(F.avg("fwd").alias("ret"), F.count("*").alias("n"))
    order = Window.partitionBy("strategy").orderBy("k")
    used = used.withColumn("before", F.lag("k").over(order))
    old = held.select("strategy", F.col("k").alias("before"), "symbol", F.lit(1).alias("kept"))
    kept = held.join(used.select("strategy", "k", "before"), ["strategy", "k"]).join(old, ["strategy", "before", "symbol"]).groupBy("strategy", "k").agg(F.sum("kept").alias("kept"))
    used = used.join(kept, ["strategy", "k"], "left")
    used = used.select("strategy", "k", "ret", F.when(F.col("before").isNull(), 0.0).otherwise((F.col("n") - F.coalesce("kept", F.lit(0))) / F.col("n")).alias("turnover"))
    every = table.select("k", "date").distinct().join(F.broadcast(table.sparkSession.createDataFrame([(s,) for s in strategies], "strategy string")))
    got = every.join(used, ["strategy", "k"], "left").select("strategy", "k", "date", F.coalesce("ret", F.lit(0.0)).alias("ret"), F.coalesce("turnover", F.lit(0.0)).alias("turnover"))
    if exposure is None:
        return got
    return got.join(exposure, "date", "left").withColumn("ret", F.col("ret") * F.coalesce("exposure", F.lit(1.0))).select("strategy", "k", "date", "ret", "turnover")


def benchmarks(table: DataFrame, dates: DataFrame) -> DataFrame:
    """(strategy, k, date, ret, turnover) of all names at equal weight, and of the benchmark itself: bought and held, without costs."""
    mean = table.groupBy("k").agg(F.avg("fwd").alias("ret"))
    equal = dates.select("k", "date").join(mean, "k", "left").select(F.lit("equal_weight").alias("strategy"), "k", "date", F.coalesce("ret", F.lit(0.0)).alias("ret"), F.lit(0.0).alias("turnover"))
    return equal.unionByName(dates.select(F.lit("market").alias("strategy"), "k", "date", F.col("bench_ret").alias("ret"), F.lit(0.0).alias("turnover")))


def exposures(mkt: DataFrame) -> DataFrame:
    """(date, exposure) by the benchmark's mean over 200 bars (100 needed) and its volatility's place in five years (253 values needed)."""
    w = Window.orderBy("date")  # one benchmark series
    m = mkt.select("date", "close", F.ln(ratio(F.col("close"), F.lag("close").over(w))).alias("r"), F.count("close").over(w.rowsBetween(-199, 0)).alias("n"), F.avg("close").over(w.rowsBetween(-199, 0)).alias("mean"))
    m = m.withColumn("vol", F.when(F.count("r").over(w.rowsBetween(-20, 0)) >= 21, F.stddev_samp("r").over(w.rowsBetween(-20, 0))))
    m = m.withColumns({"seen": F.collect_list("vol").over(w.rowsBetween(-1259, 0)), "known": F.count("vol").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    pct = F.when(F.col("vol").isNotNull() & (F.col("known") > 252), 100 * F.size(F.filter("seen", lambda v: v <= F.col("vol"))) / F.size("seen"))
    m = m.select("date", classify_risk(F.when(F.col("n") >= 100, F.col("close") > F.col("mean")), pct).alias("risk"))
    return m.select("date", by_risk(1.0, 0.6, 0.3, 1.0).alias("exposure"))


def after_costs(returns: DataFrame, bps: float) -> DataFrame:
    return returns.withColumn("ret", F.col("ret") - 2 * F.col("turnover") * bps / 1e4)


def equity(returns: DataFrame, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Adds log_equity and equity, the running product of 1 + ret; needs returns above -1. Logs keep long products in range."""
    order = Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("log_equity", F.sum(F.ln(1 + F.col("ret"))).over(order)).withColumn("equity", F.exp("log_equity"))


def stats(returns: DataFrame, step: int = 5, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """(by, log_cagr, log_total, cagr, vol, sharpe, max_dd, hit, total, turnover, n), rates in percent; the peak starts at the first equity."""
    order = Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    e = equity(returns, by).withColumn("peak", F.max("log_equity").over(order))
    per = 252 / step
    got = e.groupBy(*by).agg(
        F.max_by("log_equity", "k").alias("log_total"), F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_pop("ret").alias("sd"), F.min(F.exp(F.col("log_equity") - F.col("peak")) - 1).alias("dd"),
        F.avg((F.col("ret") > 0).cast("double")).alias("up"), F.avg(F.when(F.col("k") > 0, F.col("turnover"))).alias("turnover"),
    )
    got = got.withColumn("log_cagr", F.col("log_total") * per / F.col("n"))
    return got.select(
        *by, "log_cagr", "log_total", (100 * (F.exp("log_cagr") - 1)).alias("cagr"), (100 * F.col("sd") * per**0.5).alias("vol"), (F.try_divide("mean", "sd") * per**0.5).alias("sharpe"),
        (100 * F.col("dd")).alias("max_dd"), (100 * F.col("up")).alias("hit"), (100 * (F.exp("log_total") - 1)).alias("total"), "turnover", "n",
    )


def by_regime(returns: DataFrame, labels: DataFrame, step: int = 5, least: int = 8) -> DataFrame:
    """:func:`stats` for each strategy and label (bull, bear) of ``least`` periods or more, as if the label's periods followed each other."""
    joined = returns.join(labels.where(F.col("label").isin("bull", "bear")), "date")
    return stats(joined, step, ("strategy", "label")).where(F.col("n") >= least)


def verdict(found: DataFrame, base: float = 10_000.0) -> DataFrame:
    """(strategy, end_value, max_dd, points): what ``base`` became, and the composite's lead over each benchmark in points of total return."""
    rows = found.where(F.col("strategy").isin("composite", "equal_weight", "market"))
    own = F.max(F.when(F.col("strategy") == "composite", F.col("total"))).over(Window.partitionBy())  # three rows
    points = F.when(F.col("strategy") != "composite", own - F.col("total"))
    return rows.select("strategy", (base * (1 + F.col("total") / 100)).alias("end_value"), "max_dd", points.alias("points"))


def information_coefficients(table: DataFrame, strategies: list[str]) -> DataFrame:
    """(strategy, k, ic): rank correlation of value and forward return, average ties, on dates of enough names.

    Ranked are values of nine decimals, so that ties don't hang on the last bits of a sum."""
    long = melted(table, strategies).withColumns({c: F.round(c, 9) for c in ("value", "fwd")})
    ranked = long.withColumns({"rv": average_rank("value", "strategy", "k"), "rf": average_rank("fwd", "strategy", "k")})
    got = ranked.groupBy("strategy", "k").agg(F.count("*").alias("n"), F.stddev_pop("rv").alias("sv"), F.stddev_pop("rf").alias("sf"), F.covar_pop("rv", "rf").alias("cov"))
    got = got.withColumn("ic", F.try_divide("cov", F.col("sv") * F.col("sf")))
    return got.where((F.col("n") >= MIN_IC) & (F.col("sv") > 0) & (F.col("sf") > 0)).select("strategy", "k", "ic")


def ic_stats(ics: DataFrame) -> DataFrame:
    """(strategy, mean, sd, ir, t, positive, n); a correlation of zero is not positive, whatever the last bits of its sums are."""
    sd = F.stddev_pop("ic")
    return ics.groupBy("strategy").agg(
        F.avg("ic").alias("mean"), sd.alias("sd"), F.try_divide(F.avg("ic"), sd).alias("ir"), (F.try_divide(F.avg("ic"), sd) * F.sqrt(F.count("*"))).alias("t"), (100 * F.avg((F.round("ic", 9) > 0).cast("double"))).alias("positive"), F.count("*").alias("n")
    )


def deciles(table: DataFrame, value: str, step: int = 5) -> DataFrame:
    """(decile, ann_return, n): mean forward return of each tenth by value, on dates of enough names."""
    by = Window.partitionBy("k")
    at = table.where(F.col(value).isNotNull()).withColumns({"n": F.count("*").over(by), "i": F.row_number().over(by.orderBy(value, "symbol")) - 1})
    at = at.where(F.col("n") >= MIN_DECILE).withColumn("decile", F.least(F.lit(10), F.floor(F.col("i") * 10 / F.col("n")) + 1).cast("int"))
    return at.groupBy("decile").agg((100 * F.avg("fwd") * 252 / step).alias("ann_return"), F.count("*").alias("n"))


def regime_labels(mkt: DataFrame) -> DataFrame:
    """(date, label): bull where the close is at or above its 200-bar mean (100 needed), else bear."""
    w = Window.orderBy("date").rowsBetween(-199, 0)  # one benchmark series
    mean = F.when(F.count("close").over(w) >= 100, F.avg("close").over(w))
    return mkt.select("date", F.when(mean.isNull(), "unknown").when(F.col("close") >= mean, "bull").otherwise("bear").alias("label"))


def sharpe_parts(returns: DataFrame) -> DataFrame:
    """(strategy, n, sharpe, skew, kurt) per period; the moments are of z-scores with sample deviation, kurtosis not in excess."""
    r = (F.col("n") - 1) / F.col("n")
    got = returns.groupBy("strategy").agg(F.count("ret").alias("n"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"), F.skewness("ret").alias("g"), F.kurtosis("ret").alias("h"))
    return got.where("n >= 3 and sd > 0").select("strategy", "n", (F.col("m") / F.col("sd")).alias("sharpe"), (F.col("g") * F.pow(r, F.lit(1.5))).alias("skew"), ((F.col("h") + 3) * r * r).alias("kurt"))


def overfitting(returns: DataFrame, blocks: int = 10) -> DataFrame:
    """(pbo, splits, median_logit): combinatorially symmetric cross-validation from sums of each block.

    Blocks are of equal length up to one period, the longer ones first.
    """
    from itertools import combinations

    spark = returns.sparkSession
    n = returns.agg(F.max("k") + 1).first()[0] or 0
    short, longer = divmod(n, blocks)
    edge = longer * (short + 1)
    block = F.when(F.col("k") < edge, F.floor(F.col("k") / (short + 1))).otherwise(longer + F.floor((F.col("k") - edge) / max(short, 1)))
    sums = returns.groupBy("strategy", block.cast("int").alias("block")).agg(F.count("ret").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    picks = spark.createDataFrame([(i, b, b in c) for i, c in enumerate(combinations(range(blocks), blocks // 2)) for b in range(blocks)], "split int, block int, inside boolean")
    both = sums.join(F.broadcast(picks), "block").groupBy("split", "strategy", "inside").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    sd = F.sqrt((F.col("q") - F.col("n") * mean * mean) / (F.col("n") - 1))
    both = both.withColumn("sharpe", F.coalesce(F.try_divide(mean, sd), F.lit(0.0)))
    wide = both.groupBy("split", "strategy").agg(F.max(F.when(F.col("inside"), F.col("sharpe"))).alias("is_sharpe"), F.max(F.when(~F.col("inside"), F.col("sharpe"))).alias("oos"))
    by = Window.partitionBy("split")
    wide = wide.withColumns({"rank": F.row_number().over(by.orderBy("oos", "strategy")), "m": F.count("*").over(by), "best": F.row_number().over(by.orderBy(F.desc("is_sharpe"), "strategy"))})
    omega = F.col("rank") / (F.col("m") + 1)
    logits = wide.where("best = 1").select(F.ln(omega / (1 - omega)).alias("logit"))
    return logits.agg(F.avg((F.col("logit") <= 0).cast("double")).alias("pbo"), F.count("*").alias("splits"), F.percentile("logit", F.lit(0.5)).alias("median_logit"))
