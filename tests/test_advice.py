"""Detailed advice against its rules, the sorted table, and windows over gaps."""

import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.functions.rolling import known, observed, tail
from barline.operators import advice


def test_each_rule_and_missing_measures(spark):
    rows = [(9, 8, 75.0, 0.1, 1.0, 10.0), (7, 6, 65.0, 0.1, 1.0, 10.0), (2, 3, 50.0, 0.1, 1.0, 50.0), (4, 5, 50.0, 0.2, 1.0, 50.0), (6, 4, None, None, None, None), (4, 6, 0.0, 0.0, 0.0, 0.0), (5, 5, None, None, None, None), (7, 7, 50.0, 0.5, -1.0, None), (5, 5, 50.0, 0.9, 3.0, float("nan"))]
    got = advice.detailed(spark.createDataFrame(rows, "short_rank int, medium_rank int, rsi double, bbp double, macd double, adx double")).collect()
    assert [r.action for r in got] == ["sell", "reduce", "buy", "accumulate", "watch", "trade", "hold", "reduce", "hold"]
    assert [r.reason for r in got][:4] == ["overbought by RSI", "nearly overbought by RSI", "at the lower band", "MACD rises"]
    assert got[6].reason == "MACD near zero" and got[7].reason == "MACD falls in a moderate trend" and got[8].reason == "RSI is neutral" and got[8].strategy == "look again in 2-4 weeks"
    assert got[6].rsi is None and got[5].rsi == 0.0  # measures stay as they were


def test_orders(spark):
    ranks = spark.createDataFrame([("A", "1w", 3), ("B", "1w", 1), ("C", "1w", 3), ("D", "1m", 1)], "symbol string, period string, rank int")
    order = lambda c, up: [r.symbol for r in advice.sorted_table(ranks, c, up).orderBy("place").collect()]
    assert order("action", True) == ["B", "A", "C", "D"] and order("1w", False) == ["A", "C", "B", "D"]
    assert order("symbol", False) == ["D", "C", "B", "A"] and order("1m", True) == order("1m", False) == ["D", "A", "B", "C"]


@pytest.mark.parametrize("k", [1, 3, 10])
def test_tail_counts_values(spark, k):
    values = [None, 1.0, None, 2.0, 5.0, None, None, 3.0, 8.0, None, 1.0, 1.0, None]
    rows = [("A", datetime.date(2024, 1, 1) + datetime.timedelta(days=d), v) for d, v in enumerate(values)]
    t = spark.createDataFrame(rows, "symbol string, date date, x double").withColumn("n", observed("x"))
    got = t.select("date", known("x").alias("last"), tail(F.sum, "x", "n", k).alias("sum"), tail(F.max, "x", "n", k, 1).alias("top")).orderBy("date").collect()
    seen = pd.Series(values, dtype=float)
    for d, r in enumerate(got):
        last = seen[: d + 1].dropna().tail(k)
        assert r.sum == (last.sum() if len(last) == k else None) and r.top == (last.max() if len(last) else None)
        assert r.last == (last.iloc[-1] if len(last) else None)
