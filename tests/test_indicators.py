"""Indicators on known paths, causality, and the recursive pass against plain loops."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.functions import factors
from barline.functions.indicators import add
from barline.functions.recursive import PATH, add_recursive, drawdown, ewm, hurst, kama, vol_percentile
from barline.operators.score import HORIZONS, SLEEVES, features, latest, scan, score
from barline.sources.bars import SCHEMA, clean, complete, upsert

START = datetime.date(2020, 1, 1)


def make_bars(spark, paths, seed=0):
    g, rows = np.random.default_rng(seed), []
    for k, (symbol, closes) in enumerate(paths.items()):
        for i, c in enumerate(closes):
            hi, lo = c * (1 + abs(g.normal(0, 0.008))), c * (1 - abs(g.normal(0, 0.008)))
            rows.append((symbol, f"S{k % 2}", START + datetime.timedelta(days=i), float(g.uniform(lo, hi)), float(hi), float(lo), float(c), float(g.integers(1e6, 5e6))))
    return spark.createDataFrame(rows, SCHEMA)


def walk(n, seed, sigma=0.015):
    return 100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, sigma, n)))


def column(df, name, symbol="A"):
    return [r[name] for r in df.where(F.col("symbol") == symbol).orderBy("date").select(name).collect()]


def test_rsi_of_a_rise_is_zero_and_high_is_zero_away(spark):
    bars = add(make_bars(spark, {"A": np.linspace(10, 70, 60)}), "rsi14", "dist_52")
    assert set(column(bars, "rsi14")) == {0.0}
    assert column(bars, "dist_52")[18] is None and column(bars, "dist_52")[-1] == 0


def test_known_drawdown(spark):
    closes = [*range(10, 110), 50.0]
    bars = add(make_bars(spark, {"A": closes}), "max_drawdown126")
    assert column(bars, "max_drawdown126")[-1] == pytest.approx((50 / 109 - 1) * 100)
    assert drawdown(np.array(closes, float), 126)[-1] == pytest.approx((50 / 109 - 1) * 100)


def test_rolling_needs_full_frames(spark):
    bars = add(make_bars(spark, {"A": walk(60, 1)}), "zscore20", "rv21")
    assert [v is None for v in column(bars, "zscore20")] == [True] * 19 + [False] * 41
    assert [v is None for v in column(bars, "rv21")] == [True] * 21 + [False] * 39


def test_recursive_pass_equals_window_columns(spark):
    bars = make_bars(spark, {"A": walk(300, 2)})
    for name in ("vol_pctile", "max_drawdown63", "max_drawdown126"):
        a, b = column(add(bars, name), name), column(add_recursive(bars, name), name)
        assert [x is None for x in a] == [x is None for x in b] and np.allclose([x for x in a if x is not None], [x for x in b if x is not None])
    closes = np.array(column(bars, "close"))
    native = column(add(bars, "hurst252"), "hurst252")
    other = hurst(closes, 252)
    assert all((x is None and np.isnan(y)) or abs(x - y) < 1e-9 for x, y in zip(native, other, strict=True))
    assert np.isnan(vol_percentile(closes)[:41]).all() and set(PATH) >= {"hurst504"}


def test_smoothing():
    assert ewm(np.array([1.0, 3.0]), 0.5).tolist() == [1.0, 2.0]
    flat = kama(np.full(30, 5.0))
    assert (flat == 5).all()


@pytest.mark.parametrize("name", ["1m", "1y"])
def test_no_look_ahead(spark, name):
    h, closes = HORIZONS[name], walk(420, 3)
    whole = score(features(make_bars(spark, {"A": closes}), h), h).where(F.col("date") == START + datetime.timedelta(days=399)).first()
    cut = latest(score(features(make_bars(spark, {"A": closes[:400]}), h), h)).first()
    for c in (*SLEEVES, "score", "evidence"):
        assert whole[c] == pytest.approx(cut[c], abs=1e-9)
    assert whole["trend_state"] == cut["trend_state"] and 0 <= whole["confidence"] <= 100


def test_scan_shape(spark):
    rows = scan(make_bars(spark, {"A": walk(320, 4), "B": walk(320, 5)}), "1d", "6m").collect()
    assert {(r.symbol, r.period) for r in rows} == {(s, p) for s in "AB" for p in ("1d", "6m")}
    assert all(-100 <= r.score <= 100 for r in rows)


def test_bar_contract(spark):
    bars = spark.createDataFrame([("A", "S", START, 1.0, 2.0, 0.5, None, 3.0), ("A", "S", START, 1.0, 2.0, 0.5, 1.5, 3.0)], SCHEMA)
    assert clean(bars).count() == 1
    assert complete(bars.select("symbol", "date", "close")).columns[-1] == "volume"
    new = bars.where("close IS NOT NULL").withColumn("close", F.lit(9.0))
    assert [r.close for r in upsert(clean(bars), new).collect()] == [9.0]


GOOD = ["-zscore(close, 20)", "tanh(ts_mean(cmf20, 5)) + 1", "clip(ret1, -1, 1) / 2", "ts_rank(volume, 10)"]
BAD = ["__import__('os')", "close.__class__", "close[0]", "lambda: 1", "open + 1", "close ** 2", "ts_mean(close)", "ts_mean(close, w=3)", "'a'", "close +", "3 + 4", "ts_mean(close, -1)", "not close", "tanh(tanh(tanh(tanh(tanh(close)))))"]


@pytest.mark.parametrize("text", BAD)
def test_language_is_closed(text):
    with pytest.raises(factors.FactorError):
        factors.check(text)


def test_factors(spark):
    bars = factors.prepared(make_bars(spark, {"A": walk(80, 6)}), *GOOD)
    for i, text in enumerate(GOOD):
        bars = factors.add_factor(bars, text, f"f{i}")
    z = column(add(bars, "zscore20"), "zscore20")
    assert np.allclose([-v for v in column(bars, "f0")[19:]], z[19:])
    assert factors.canonical("close+1") == factors.canonical(" (close + 1) ")
