"""Sleeve weights learned by state: judged against the fixed ones on dates that the fit never saw."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .backtest import MIN_IC, ic_stats, stats
from .cross import average_rank
from .regime import accepts, state_weights
from .score import SLEEVES


def table_composite(weights: dict, state: str, default: str = "mixed") -> Column:
    """The sleeves under a table of weights; states that it lacks count as ``default``."""
    dots = {s: reduce(lambda a, b: a + b, (F.lit(float(row[k])) * F.col(k) for k in SLEEVES)) for s, row in weights.items()}
    return reduce(lambda a, s: a.when(F.col(state) == s, dots[s]), dots, F).otherwise(dots[default])


def table_scores(panel: DataFrame, weights: dict, state: str, top: float = 0.2) -> DataFrame:
    """(k, date, ic, ret) of each date of MIN_IC names or more: rank correlation with the forward return, and the mean return of the best share."""
    by = Window.partitionBy("k")
    t = panel.withColumns({"composite": table_composite(weights, state), "n": F.count("*").over(by)}).where(F.col("n") >= MIN_IC)
    t = t.withColumns({"rv": average_rank("composite", "k"), "rf": average_rank("fwd", "k"), "at": F.row_number().over(by.orderBy(F.desc("composite"), "symbol"))})
    held = F.when(F.col("at") <= F.greatest(F.lit(1), F.floor(F.col("n") * top)), F.col("fwd"))
    return t.groupBy("k").agg(F.first("date").alias("date"), F.try_divide(F.covar_pop("rv", "rf"), F.stddev_pop("rv") * F.stddev_pop("rf")).alias("ic"), F.avg(held).alias("ret"))


def centered_sums(samples: DataFrame) -> DataFrame:
    """(state, n, products): sums of products of the sleeves and the forward return around their means."""
    names = {s: f"{s[0]}{i}" for i, s in enumerate(SLEEVES)} | {"fwd": "f5"}
    pairs = [(a, b) for i, a in enumerate(names) for b in list(names)[i:] if a != "fwd"]
    sums = [(F.sum(F.col(a) * F.col(b)) - F.sum(a) * F.sum(b) / F.count("*")).alias(names[a] + names[b]) for a, b in pairs]
    return samples.where("state IS NOT NULL AND fwd IS NOT NULL").groupBy("state").agg(F.count("*").alias("n"), *sums)


def calibration(panel: DataFrame, prior: dict, state: str, share: float = 0.6, step: int = 5, shrinkage: float = 0.5) -> dict:
    """Weights fitted on the first ``share`` of the dates, and both tables judged on the first and the last part.

    Returns weights, accepted, and report (table, split, ic, t, sharpe, log_cagr, max_dd, n, accepted). Only a few sums for each
    state and a few rows of statistics reach the driver.
    """
    cut = int((panel.agg(F.max("k")).first()[0] or 0) * share)
    learn = panel.where(F.col("k") < cut)
    weights = state_weights(learn.withColumnRenamed(state, "state"), prior, shrinkage)
    parts = []
    for name, table in (("prior", prior), ("calibrated", weights)):
        scored = table_scores(panel, table, state).withColumns({"split": F.when(F.col("k") < cut, "discovery").otherwise("validation"), "strategy": F.lit(name), "turnover": F.lit(0.0)})
        ics = ic_stats(scored.where("ic IS NOT NULL").withColumn("strategy", F.col("split"))).select(F.col("strategy").alias("split"), F.col("mean").alias("ic"), "t")
        got = stats(scored, step, ("split",)).join(ics, "split", "left")
        parts.append(got.select(F.lit(name).alias("table"), "split", "ic", "t", "sharpe", "log_cagr", "max_dd", "n"))
    report = reduce(DataFrame.unionByName, parts)
    late = {r["table"]: r for r in report.where("split = 'validation'").collect()}
    if len(late) == 2 and None not in (late["calibrated"]["ic"], late["prior"]["ic"]):
        ok = accepts(late["calibrated"]["ic"], late["prior"]["ic"], late["calibrated"]["sharpe"], late["prior"]["sharpe"])
    else:
        ok = False
    return {"weights": weights, "accepted": ok, "report": report.withColumn("accepted", F.lit(ok))}
