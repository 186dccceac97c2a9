"""Event studies, overfitting hurdles, the permutation null, and runs of states."""

from __future__ import annotations

import hashlib
import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rolling import by, ratio
from .backtest import MIN_IC, sharpe_parts

HORIZONS = (5, 10, 21)
LEAST_EVENTS = 20
SQUEEZE_ON = "coalesce(bb_up < ema20 + 1.5 * atr10 AND bb_low > ema20 - 1.5 * atr10, false)"
#: Fixed value: the Euler-Mascheroni constant.
GAMMA = 0.5772156649015329



def events() -> dict[str, Column]:
    """Name and condition at a bar; needs don_break, squeeze_fired, zscore20 and macd_hist."""
    before = F.lag("macd_hist").over(by())
    return {
        "donchian_breakout_up": F.col("don_break") == 1, "donchian_breakout_down": F.col("don_break") == -1, "squeeze_fired": F.col("squeeze_fired"), "zscore_below_-2": F.col("zscore20") <= -2,
        "zscore_above_2": F.col("zscore20") >= 2, "macd_flip_positive": (F.col("macd_hist") > 0) & (before <= 0),
    }


def squeeze(bars: DataFrame) -> DataFrame:
    """squeeze_on: Bollinger inside Keltner; squeeze_fired: on at the bar before and no longer."""
    bars = bars.withColumn("squeeze_on", F.expr(SQUEEZE_ON))
    return bars.withColumn("squeeze_fired", F.expr("coalesce(lag(squeeze_on) OVER (PARTITION BY symbol ORDER BY date), false) AND NOT squeeze_on"))


def event_study(bars: DataFrame, years: float = 3, start: int = 300) -> DataFrame:
    """(event, n, d5, d10, d21): mean forward returns in percent after each event, and of all bars as ``baseline``.

    Bars count from the later of ``start`` and the last ``years``, and only with all forward returns; events of fewer
    than 20 have no means.
    """
    ahead = {f"f{h}": ratio(F.lead("close", h).over(by()), F.col("close")) - 1 for h in HORIZONS}
    whole = Window.partitionBy("symbol")
    flags = F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in {"baseline": F.lit(True), **events()}.items()])
    t = bars.withColumns({"i": F.row_number().over(by()) - 1, "total": F.count("*").over(whole), "found": F.array_compact(flags), **ahead})
    t = t.where((F.col("i") >= F.greatest(F.lit(start), F.col("total") - int(years * 252))) & (F.col("i") < F.col("total") - max(HORIZONS)))
    got = t.select(F.explode("found").alias("event"), *ahead).groupBy("event").agg(F.count("*").alias("n"), *[(100 * F.avg(f"f{h}")).alias(f"d{h}") for h in HORIZONS])
    return got.select("event", "n", *[F.when((F.col("n") >= LEAST_EVENTS) | (F.col("event") == "baseline"), F.col(f"d{h}")).alias(f"d{h}") for h in HORIZONS])


def expected_max_sharpe(trials: int, spread: float = 1.0) -> float:
    """Largest Sharpe ratio to expect of ``trials`` strategies without skill."""
    n = max(2, trials)
    return spread * ((1 - GAMMA) * normal_ppf(1 - 1 / n) + GAMMA * normal_ppf(1 - 1 / (n * math.e)))


def expected_max_t(trials: int) -> float:
    return math.sqrt(2 * math.log(max(2, trials)))


def deflated_sharpe(returns: DataFrame, trials: int, spread: float | None = None) -> DataFrame:
    """(strategy, sharpe, sr0, deflated, passes): probability that the Sharpe ratio beats the best of the trials by skill.

    One row for each strategy.
    """
    parts = sharpe_parts(returns).withColumn("spread", F.lit(spread).cast("double") if spread else F.greatest(F.abs("sharpe"), F.lit(1e-9)))
    sr0 = F.col("spread") * expected_max_sharpe(trials)
    base = 1 - F.col("skew") * F.col("sharpe") + (F.col("kurt") - 1) / 4 * F.col("sharpe") * F.col("sharpe")
    z = F.when(base > 0, (F.col("sharpe") - sr0) * F.sqrt(F.col("n") - 1) / F.sqrt(base))
    t = parts.select("strategy", "sharpe", sr0.alias("sr0"), z.alias("z"))
    return t.withColumn("deflated", normal_cdf(F.col("z"))).withColumn("passes", F.col("deflated") >= 0.95).drop("z")


def normal_cdf(z: Column) -> Column:
    """The normal distribution function of a column: a series of positive terms near 0, a continued fraction in the tails."""
    x = F.abs(z) / math.sqrt(2)
    near, far = F.least(x, F.lit(3.0)), F.greatest(x, F.lit(3.0))
    # Folds over the terms' numbers: nested columns would repeat their operand in each term and outgrow a compiled method.
    down = lambda n: F.sequence(F.lit(n), F.lit(1), F.lit(-1))
    series = F.aggregate(down(60), F.lit(1.0), lambda got, k: 1 + 2 * near * near / (2 * k + 1) * got)
    fraction = F.aggregate(down(40), far, lambda got, k: far + k / 2 / got)
    upper = F.when(x <= 3, 0.5 * (1 - 2 / math.sqrt(math.pi) * near * F.exp(-near * near) * series)).otherwise(0.5 * F.exp(-far * far) / math.sqrt(math.pi) / fraction)
    return F.when(z < 0, upper).when(z.isNotNull(), 1 - upper)


def normal_ppf(p: float) -> float:
    """The inverse; ValueError outside (0, 1)."""
    return NormalDist().inv_cdf(p)


def deflated_t(stats: DataFrame, trials: int) -> DataFrame:
    """Adds hurdle, passes (two-sided) and clears_positive to (strategy, t): the largest t to expect of that many trials without signal."""
    hurdle = F.lit(expected_max_t(trials))
    return stats.select("strategy", "t", hurdle.alias("hurdle"), (F.abs("t") > hurdle).alias("passes"), (F.col("t") > hurdle).alias("clears_positive"))


def null_ic(panel: DataFrame, strategies: list[str], permutations: int = 200, seed: int = 1) -> DataFrame:
    """(permutations, mean, p95, p99, most) of the best strategy's mean IC when forward returns are shuffled within each date.

    The names of a date in the order of a hash are a permutation of its return ranks: repeatable, and the same for all strategies. A date
    is one array job: its rank vectors times all its permuted ranks. So the panel is shuffled once, by date, and each date gives
    one row for each permutation. Ranks are ordinal, ties by symbol.
    """
    few = [f"s{i}" for i in range(len(strategies))]

    def deal(table: pa.Table) -> pa.Table:
        table = table.sort_by("symbol")
        n, k = table.num_rows, table.column("k")[0].as_py() if table.num_rows else 0
        if n < MIN_IC:
            return pa.table({"perm": pa.array([], pa.int32()), "ics": pa.array([], pa.list_(pa.float64()))})
        ranks = np.stack([np.argsort(np.argsort(nulls_first(table.column(c)), kind="stable")) for c in few], 1) - (n - 1) / 2
        tails = [f"|{k}|{s}".encode() for s in table.column("symbol").to_pylist()]
        perms = range(1, permutations + 1)
        drawn = np.array([[hashlib.md5(b"%d|%d" % (seed, p) + t).digest() for t in tails] for p in perms], "S16").reshape(len(perms), n)
        dealt = np.argsort(np.argsort(fixed_bytes(drawn), axis=1, kind="stable"), axis=1) - (n - 1) / 2
        ics = dealt @ ranks / ((n * n - 1) * n / 12)
        return pa.table({"perm": pa.array(perms, pa.int32()), "ics": pa.array(list(ics), pa.list_(pa.float64()))})

    ranked = panel.select("k", "symbol", *[F.col(s).cast("double").alias(c) for s, c in zip(strategies, few, strict=True)])
    many = ranked.groupBy("k").applyInArrow(lambda table: deal(table), "perm int, ics array<double>")
    best = many.groupBy("perm").agg(F.greatest(*[F.avg(F.col("ics")[i]) for i in range(len(strategies))], F.lit(None)).alias("ic"))
    return best.agg(F.count("*").alias("permutations"), F.avg("ic").alias("mean"), F.percentile("ic", F.lit(0.95)).alias("p95"), F.percentile("ic", F.lit(0.99)).alias("p99"), F.max("ic").alias("most"))


def nulls_first(column: pa.ChunkedArray) -> np.ndarray:
    return np.nan_to_num(column.to_numpy().astype(float), nan=-np.inf)


def fixed_bytes(digests: np.ndarray) -> np.ndarray:
    """Digests as numbers in the same order; ends of zero bytes count too."""
    return digests.view(">u8").reshape(*digests.shape, 2)[..., 0]


def state_summary(labels: DataFrame) -> DataFrame:
    """(state, share, n_runs, mean_run, median_run) of (symbol, date, state); runs never cross symbols."""
    t = labels.where("state IS NOT NULL")
    t = t.withColumn("turn", F.coalesce((F.col("state") != F.lag("state").over(by())).cast("int"), F.lit(1)))
    t = t.withColumn("run", F.sum("turn").over(by().rowsBetween(Window.unboundedPreceding, 0)))
    runs = t.groupBy("symbol", "run", "state").agg(F.count("*").alias("size"))
    got = runs.groupBy("state").agg(F.sum("size").alias("bars"), F.count("*").alias("n_runs"), F.avg("size").alias("mean_run"), F.percentile("size", F.lit(0.5)).alias("median_run"))
    return got.select("state", (F.col("bars") / F.sum("bars").over(Window.partitionBy())).alias("share"), "n_runs", "mean_run", "median_run")  # a row for each state
