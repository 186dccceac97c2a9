"""Fundamentals: medians of the universe, the summary of a symbol with its flags, and which symbols to fetch again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = ("trailing_pe", "price_to_book", "roe")
WEEK = 7 * 24 * 3600


def medians(table: DataFrame, *by: str) -> DataFrame:
    """One row (by): the median of each measure over its values between 0 and 10,000."""
    inside = lambda m: F.when((F.col(m) > 0) & (F.col(m) < 1e4), F.col(m))
    return table.groupBy(*by).agg(*[F.percentile(inside(m), F.lit(0.5)).alias(f"median_{m}") for m in MEASURES])


def summary(table: DataFrame, middle: DataFrame, today: DataFrame) -> DataFrame:
    """(symbol, sector, pe, forward_pe, pb, roe, margin, dividend_yield, next_earnings, flags); ``middle`` and ``today`` are one row each."""
    t = table.join(F.broadcast(middle)).join(F.broadcast(today))  # one row each
    days, pe = F.date_diff("next_earnings", "today"), F.col("trailing_pe")
    flags = [
        F.when((days >= 0) & (days <= 7), F.format_string("reports in %d days", days)),
        F.when((pe > 0) & (pe > 2 * F.col("median_trailing_pe")), F.format_string("dear: %.0f times earnings, median %.0f", pe, "median_trailing_pe"))
        .when((pe > 0) & (pe < 0.5 * F.col("median_trailing_pe")), F.format_string("cheap: %.0f times earnings, median %.0f", pe, "median_trailing_pe")),
        F.when(F.col("roe") > 0.30, F.format_string("return on equity %.0f%%", 100 * F.col("roe"))),
    ]
    two = lambda c, by=1: F.round(finite(F.col(c)) * by, 2)
    return t.select(
        "symbol", "sector", two("trailing_pe").alias("pe"), two("forward_pe").alias("forward_pe"), two("price_to_book").alias("pb"), two("roe", 100).alias("roe"), two("margin", 100).alias("margin"),
        two("dividend_yield", 100).alias("dividend_yield"), "next_earnings", F.array_compact(F.array(*flags)).alias("flags"),
    )


def finite(x: Column) -> Column:
    return F.when(F.abs(x) < float("inf"), x)


def to_refresh(ages: DataFrame, most: int = 8) -> DataFrame:
    """(symbol, age) of those to fetch again: never fetched first, then the stalest; none younger than a week."""
    return ages.where(F.col("age").isNull() | (F.col("age") >= WEEK)).orderBy(F.col("age").desc_nulls_first(), "symbol").limit(most)
