"""Detailed advice for a held name: an ordered table of rules, held as data. The first rule whose ranks match decides; its own ladder gives the reason."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Reason:
    """Applies where each measure lies inside its open range (None: no bound) and the trend's strength is as asked."""

    text: str
    within: tuple[tuple[str, float | None, float | None], ...] = ()
    trend: str = ""
    strategy: str = ""

    def holds(self) -> Column:
        parts = [F.col(m) > lo for m, lo, _ in self.within if lo is not None] + [F.col(m) < hi for m, _, hi in self.within if hi is not None]
        parts += [F.col("trend_strength") == self.trend] if self.trend else []
        return reduce(lambda a, b: a & b, parts, F.lit(True))


@dataclass(frozen=True)
class Rule:
    """Applies to ranks from ``low`` to ``high``, for each term."""

    action: str
    horizon: str
    short: tuple[int, int]
    medium: tuple[int, int]
    reasons: tuple[Reason, ...]
    strategy: str = ""

    def holds(self) -> Column:
        return F.col("short_rank").between(*self.short) & F.col("medium_rank").between(*self.medium)


# The ranks of each rule and the bounds of its reasons, in order; and what a missing (or zero) measure counts as.
RULES = (
    Rule("sell", "at once", (9, 10), (8, 10), (
        Reason("overbought by RSI", (("rsi", 70, None),)), Reason("at the upper band", (("bbp", 0.85, None),)), Reason("MACD falls", (("macd", None, 0),)), Reason("most measures are weak"),
    ), "close the position"),
    Rule("reduce", "1-4 weeks", (7, 10), (6, 10), (
        Reason("nearly overbought by RSI", (("rsi", 60, 70),)), Reason("nears the upper band", (("bbp", 0.7, None),)), Reason("MACD falls in a moderate trend", (("macd", None, 0),), "moderate"), Reason("a turn is likely"),
    ), "sell a part, or tighten the stop"),
    Rule("buy", "up to 2 weeks", (1, 2), (1, 3), (
        Reason("oversold by RSI", (("rsi", None, 30),)), Reason("at the lower band", (("bbp", None, 0.15),)), Reason("MACD rises in a strong trend", (("macd", 0, None),), "strong"), Reason("most measures are strong"),
    ), "add in steps of equal value"),
    Rule("accumulate", "2-6 weeks", (1, 4), (1, 5), (
        Reason("RSI recovers", (("rsi", 30, 40),)), Reason("crosses the middle band from below", (("bbp", 0.3, 0.5),)), Reason("MACD rises", (("macd", 0, None),)), Reason("the pattern points up"),
    ), "buy a part first"),
    Rule("watch", "1-3 months", (6, 10), (1, 4), (Reason("weak now, better later"),), "wait for the low before adding"),
    Rule("trade", "1-4 weeks", (1, 4), (6, 10), (Reason("strength may not last"),), "trade with a near stop"),
    Rule("hold", "3-6 months", (1, 10), (1, 10), (
        Reason("MACD near zero", (("macd", -0.001, 0.001),), strategy="wait for a breakout either way"), Reason("RSI is neutral", (("rsi", 40, 60),), strategy="look again in 2-4 weeks"),
        Reason("near the middle band", (("bbp", 0.4, 0.6),), strategy="wait for a direction"), Reason("mixed measures", strategy="write covered calls"),
    )),
)
MISSING = {"rsi": 50.0, "bbp": 0.5, "macd": 0.0, "adx": 25.0}
WEAK_TREND, STRONG_TREND = 20, 40


def detailed(table: DataFrame) -> DataFrame:
    """Adds action, horizon, reason and strategy to (short_rank, medium_rank, rsi, bbp, macd, adx, ...); ranks are 1 to 10."""
    known = {m: F.coalesce(F.nullif(F.nanvl(F.col(m), F.lit(None).cast("double")), F.lit(0.0)), F.lit(v)) for m, v in MISSING.items()}
    strength = F.when(F.col("adx") < WEAK_TREND, "weak").when(F.col("adx") < STRONG_TREND, "moderate").otherwise("strong")
    t = table.withColumns({f"_{m}": F.col(m) for m in MISSING}).withColumns(known).withColumn("trend_strength", strength)
    cases = [(rule.holds() & reason.holds(), F.struct(*[F.lit(v).alias(k) for k, v in (("action", rule.action), ("horizon", rule.horizon), ("reason", reason.text), ("strategy", reason.strategy or rule.strategy))])) for rule in RULES for reason in rule.reasons]
    t = t.withColumn("_found", reduce(lambda a, c: a.when(*c), cases, F))
    return t.withColumns({m: F.col(f"_{m}") for m in MISSING}).select(*table.columns, "_found.*")


def sorted_table(ranks: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """(symbol, place) of (symbol, period, rank): by name, by a period's rank (the best first if ascending), or by ``action``, the rank of 1w.

    Symbols without the period come last both ways; ties go by symbol. One row for each symbol.
    """
    period = "1w" if column == "action" else column
    value = F.max(F.when(F.col("period") == period, 11 - F.col("rank")))
    by_symbol = ranks.groupBy("symbol").agg(value.alias("strength"))
    if column == "symbol":
        order = [F.col("symbol").asc() if ascending else F.col("symbol").desc()]
    else:
        order = [F.col("strength").desc_nulls_last() if ascending else F.col("strength").asc_nulls_last(), F.col("symbol")]
    return by_symbol.select("symbol", F.row_number().over(Window.orderBy(*order)).alias("place"))  # a row for each symbol
