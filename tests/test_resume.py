"""The resumable pass equals the full one, however bars are appended, and begins again before a late bar."""

import numpy as np
from test_indicators import make_bars, walk

from barline.functions import recursive


def test_parts_equal_the_whole():
    g = np.random.default_rng(1)
    close = 100 * np.exp(np.cumsum(g.normal(0, 0.02, 120)))
    high, low = close * 1.01, close * 0.99
    high[60:70] = low[60:70] = close[60:70] = close[60]  # a flat stretch
    want = recursive.features(high, low, close)
    for cuts in ([120], [1, 2, 9, 10, 11, 12, 14, 60, 120], range(1, 121)):
        state, at, got = None, 0, {}
        for end in cuts:
            found, states = recursive.resumed(state, high[at:end], low[at:end], close[at:end])
            state, at = states[-1], end
            for k, v in found.items():
                got[k] = np.concatenate([got.get(k, []), v])
        for k, v in got.items():
            assert np.allclose(v, want[k], equal_nan=True), k


def test_late_bars_go_on_from_the_state_before(spark):
    bars = make_bars(spark, {"A": walk(90, 1), "B": walk(70, 2), "C": walk(5, 3)}).cache()
    whole = {(r.symbol, r.date): r for r in recursive.add_recursive(bars).collect()}
    days = sorted({r.date for r in bars.select("date").distinct().collect()})
    first, states = recursive.resume(bars.where(bars.date < days[40]), every=10)
    more, again = recursive.resume(bars.where(bars.date >= days[40]), states)
    late, _ = recursive.resume(bars.where(bars.date >= days[25]), states.unionByName(again), bars)  # the bar of day 25 was wrong
    for part, n in ((first, 40), (more, 40), (late, 25)):
        rows = part.collect()
        assert {r.symbol for r in rows} <= {"A", "B", "C"} and rows
        for r in rows:
            for c in ("atr14", "atr10", "ema20", "macd_hist", "kama10"):
                a, b = r[c], whole[r.symbol, r.date][c]
                assert (a is None and b is None) or abs(a - b) < 1e-9
    assert first.count() + more.count() == bars.count()
    assert recursive.resume(bars.limit(0), states)[0].count() == 0
