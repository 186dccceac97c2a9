"""Checks of a recommended book: each is one row (id, status, value, detail), so all of them are one union; and their review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rolling import ratio
from .links import components
from .portfolio import CAP, pair_correlations

#: The thresholds of the checks.
CLUSTER_CORR, CLUSTER_NAMES, CLUSTER_DATES, CLUSTER_LEAST = 0.70, 3, 60, 40
HHI_WARN, TURNOVER_WARN, SEPARATION_WARN, SEPARATION_NAMES = 0.12, 0.4, 0.5, 10
EARNINGS_SESSIONS, CALENDAR_DAYS, EARNINGS_WARN, COST_BPS = 21, 1.4, 25.0, 10.0


def check(found: DataFrame, name: str, status: Column, value: Column, detail: Column) -> DataFrame:
    return found.select(F.lit(name).alias("id"), status.alias("status"), value.cast("double").alias("value"), detail.alias("detail"))


def concentration(weights: DataFrame) -> DataFrame:
    """The sum of squared weights; a name over the cap fails, an index over HHI_WARN warns."""
    got = weights.agg(F.count("*").alias("n"), F.sum(F.col("weight") * F.col("weight")).alias("hhi"), F.max("weight").alias("worst"), F.max_by("symbol", "weight").alias("top"))
    status = F.when(F.col("worst") > CAP + 1e-6, "fail").when(F.col("hhi") > HHI_WARN, "warn").otherwise("pass")
    return check(got, "concentration", status, F.col("hhi"), F.format_string("%d names, %.1f effective, most in %s", "n", ratio(F.lit(1.0), F.col("hhi")), "top"))


def clusters(returns: DataFrame, names: DataFrame | None = None, corr: float = CLUSTER_CORR) -> DataFrame:
    """(symbol, head, size) of the names that move together, by the pairs over ``corr`` of the last CLUSTER_DATES dates of (symbol, date, ret).

    ``names`` (symbol): only these are looked at. A group is called by its first name.
    """
    dates = returns.select("date").distinct().orderBy(F.desc("date")).limit(CLUSTER_DATES)
    recent = (returns if names is None else returns.join(names.select("symbol"), "symbol", "left_semi")).join(F.broadcast(dates), "date")
    seen = recent.groupBy("symbol").agg(F.count("ret").alias("n")).where(F.col("n") >= CLUSTER_LEAST).select("symbol")
    heads = components(pair_correlations(recent.join(seen, "symbol", "left_semi"), 2).where(F.col("corr") > corr))
    return heads.join(heads.groupBy("head").agg(F.count("*").cast("int").alias("size")), "head").select("symbol", "head", "size")


def correlated(returns: DataFrame, weights: DataFrame, corr: float = CLUSTER_CORR) -> DataFrame:
    """Groups of CLUSTER_NAMES or more warn; the value is the weight of the largest one (ties: the first), percent."""
    big = clusters(returns, weights, corr).where(F.col("size") >= CLUSTER_NAMES).join(weights, "symbol")
    groups = big.groupBy("head", "size").agg(F.sum("weight").alias("w"), F.array_join(F.array_sort(F.collect_list("symbol")), "/").alias("names"))  # a book's names are few
    got = groups.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("o"), "head", "w", "names"))).alias("g"))
    detail = F.concat(F.col("n").cast("string"), F.lit(" groups: "), F.array_join(F.transform("g", lambda x: x["names"]), "; "))
    return check(got, "correlation_clusters", F.when(F.col("n") > 0, "warn").otherwise("pass"), F.coalesce(F.get("g", F.lit(0))["w"] * 100, F.lit(0.0)), detail)


def earnings(weights: DataFrame, fundamentals: DataFrame, today: DataFrame) -> DataFrame:
    """Weight, percent, of names that report within the holding horizon; ``today``: one row (today)."""
    days = F.date_diff("next_earnings", "today")
    near = weights.join(fundamentals.select("symbol", "next_earnings"), "symbol").join(F.broadcast(today)).where((days >= 0) & (days <= EARNINGS_SESSIONS * CALENDAR_DAYS))  # one row
    got = near.agg(F.count("*").alias("n"), F.coalesce(F.sum("weight") * 100, F.lit(0.0)).alias("w"))
    return check(got, "earnings_proximity", F.when(F.col("w") > EARNINGS_WARN, "warn").otherwise("pass"), F.col("w"), F.format_string("%d names report within %d sessions", "n", F.lit(EARNINGS_SESSIONS)))


def regime_mix(weights: DataFrame, scan: DataFrame, period: str = "1m") -> DataFrame:
    """How many held names are in the commonest trend state (ties: the first in order)."""
    states = weights.select("symbol").join(scan.where(F.col("period") == period).select("symbol", "trend_state"), "symbol", "left")
    n = states.groupBy(F.coalesce("trend_state", F.lit("unknown")).alias("state")).agg(F.count("*").alias("n"))
    got = n.agg(F.min_by("state", F.struct(-F.col("n"), "state")).alias("state"), F.max("n").alias("most"), F.sum("n").alias("all"))
    return check(got, "regime_mix", F.lit("pass"), F.col("most"), F.format_string("%d of %d names are %s", "most", "all", "state"))


def turnover(trades: DataFrame, base: float, bps: float = COST_BPS) -> DataFrame:
    """Traded value as a share of the base, and what it costs."""
    got = trades.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.abs("delta_value")), F.lit(0.0)).alias("traded"))
    share = F.col("traded") / base if base else F.lit(0.0)
    return check(got, "turnover_cost", F.when(share > TURNOVER_WARN, "warn").otherwise("pass"), share, F.format_string("%d trades, cost %.0f", "n", F.col("traded") * bps / 1e4))


def exposure(state: DataFrame) -> DataFrame:
    """One row (exposure, risk): less than fully invested warns."""
    return check(state, "exposure", F.when(F.col("exposure") < 1, "warn").otherwise("pass"), F.col("exposure"), F.format_string("%.0f%% invested, market %s", F.col("exposure") * 100, "risk"))


def separation(scores: DataFrame, held: DataFrame) -> DataFrame:
    """How far the held names' mean score lies over the rest's, in deviations of all; needs SEPARATION_NAMES names."""
    marked = scores.join(held.select("symbol", F.lit(True).alias("held")), "symbol", "left").withColumn("held", F.coalesce("held", F.lit(False)))
    got = marked.agg(F.count("*").alias("n"), F.avg(F.when(F.col("held"), F.col("score"))).alias("inside"), F.avg(F.when(~F.col("held"), F.col("score"))).alias("outside"), F.stddev_pop("score").alias("sd"))
    gap = F.coalesce(F.try_divide(F.col("inside") - F.col("outside"), F.col("sd")), F.lit(0.0))
    enough = F.col("n") >= SEPARATION_NAMES
    status = F.when(~enough, "skip").when(gap < SEPARATION_WARN, "warn").otherwise("pass")
    return check(got, "score_separation", status, F.when(enough, gap), F.format_string("%d names", "n"))


def review(checks: list[DataFrame] | DataFrame) -> DataFrame:
    """One row (blocking, n_fail, n_warn, summary, concerns): failures first, then warnings, each by id. A failure blocks."""
    rows = checks if isinstance(checks, DataFrame) else reduce(DataFrame.unionByName, checks)
    bad = F.when(F.col("status").isin("fail", "warn"), F.struct((F.col("status") == "warn").alias("later"), "id", F.when(F.col("status") == "fail", "high").otherwise("medium").alias("severity"), "detail"))
    got = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("status") == "fail", 1)).alias("n_fail"), F.count(F.when(F.col("status") == "warn", 1)).alias("n_warn"), F.array_sort(F.collect_list(bad)).alias("concerns"))
    of = lambda late: F.array_join(F.transform(F.filter("concerns", lambda c: c["later"] == late), lambda c: c["id"]), "; ")
    summary = (
        F.when(F.col("n_fail") > 0, F.format_string("%d failed: %s", "n_fail", of(False))).when(F.col("n_warn") > 0, F.format_string("none failed, %d to look at: %s", "n_warn", of(True))).otherwise(F.format_string("all %d passed", "n"))
    )
    return got.select((F.col("n_fail") > 0).alias("blocking"), "n_fail", "n_warn", summary.alias("summary"), F.transform("concerns", lambda c: F.struct(c["id"].alias("id"), c["severity"].alias("severity"), c["detail"].alias("detail"))).alias("concerns"))


def kept_concerns(proposed: DataFrame, checks: DataFrame) -> DataFrame:
    """Of concerns (check_id, ...) written by someone else, those that name a known check."""
    return proposed.join(checks.select(F.col("id").alias("check_id")).distinct(), "check_id", "left_semi")


def flags(checks: DataFrame, weights: DataFrame, day: str) -> DataFrame:
    """One row (day, symbols, flags) to be appended to the log of flags, so that they can be judged later."""
    marked = checks.where(F.col("status").isin("warn", "fail")).agg(F.array_sort(F.collect_list(F.struct("id", "status"))).alias("flags"))
    return weights.agg(F.array_sort(F.collect_list("symbol")).alias("symbols")).join(marked).select(F.lit(day).alias("day"), "symbols", "flags")  # one row each


def log_flags(row: DataFrame, path: str) -> None:
    row.write.mode("append").json(path)


