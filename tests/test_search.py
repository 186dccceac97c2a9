"""Survivors of a candidates log on the sealed window."""

import datetime
import json

import numpy as np
import pandas as pd

from barline.functions import factors
from barline.operators import search
from barline.operators.score import HORIZONS
from barline.sources.bars import SCHEMA

DAY = datetime.date(2020, 1, 1)
SWITCH = 560
ENDS = tuple(str(DAY + datetime.timedelta(days=k)) for k in (430, SWITCH))


def planted(spark):
    """Ten names whose volume tells their drift up to the second end; from then on it tells the opposite."""
    rng, parts = np.random.default_rng(5), []
    dates = [DAY + datetime.timedelta(days=k) for k in range(720)]
    for i in range(10):
        drift = np.where(np.arange(720) < SWITCH, i - 4.5, 4.5 - i) * 1e-3
        close = 100 * np.exp(np.cumsum(drift + rng.normal(0, 2e-3, 720)))
        parts.append(pd.DataFrame({"symbol": f"S{i}", "sector": "X", "date": dates, "open": close, "high": close * 1.01, "low": close * 0.99, "close": close, "volume": 100.0 + i}))
    return spark.createDataFrame(pd.concat(parts), SCHEMA)


def log(spark, *rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")


def line(text, verdict="survivor"):
    return {"expression": text, "canonical": factors.canonical(text), "verdict": verdict}


def test_the_sealed_window_tells_what_holds(spark):
    bars = planted(spark)
    mkt = bars.where("symbol = 'S0'")
    written = log(spark, line("volume"), line("volume"), line("volume*1"), line("pct_change(close, 10)"), line("stoch_k", "weak"), '{"expression": "vol', json.dumps({"expression": "close +", "verdict": "survivor"}), "")
    got = {r["expression"]: r for r in search.review(written, bars, mkt, HORIZONS["1m"], 21, ENDS).collect()}
    assert set(got) == {"volume", "volume*1", "pct_change(close, 10)"}
    assert got["volume"]["discovery_t"] > 10 and got["volume"]["clears"] and not got["volume"]["holds"] and got["volume"]["holdout_ic"] < -0.5
    assert got["pct_change(close, 10)"]["holds"] and got["pct_change(close, 10)"]["holdout_dates"] >= 5
    assert abs(got["volume"]["hurdle"] - np.sqrt(2 * np.log(4))) < 1e-12  # repeated, broken and invalid lines don't count as trials


def test_a_log_without_survivors(spark):
    bars = planted(spark)
    for written in (log(spark, line("volume", "weak")), spark.createDataFrame([], "value string")):
        got = search.review(written, bars, bars.where("symbol = 'S0'"), HORIZONS["1m"], 21, ENDS)
        assert got.count() == 0 and "holds" in got.columns
