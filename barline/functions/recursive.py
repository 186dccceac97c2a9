"""Indicators that feed back on themselves: each symbol's history runs through one Arrow group, once for all of them.

A symbol's bars are bounded by its trading days, so a group is small however many symbols there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

COLUMNS = ("atr14", "atr10", "ema20", "macd_hist", "kama10", "psar_score")


def ewm(x: np.ndarray, alpha: float) -> np.ndarray:
    """y = (1 - alpha) y + alpha x, seeded with the first value."""
    out, y = np.empty(len(x)), 0.0
    for i, v in enumerate(x):
        y = v if i == 0 else (1 - alpha) * y + alpha * v
        out[i] = y
    return out


def kama(close: np.ndarray, period: int = 10, fast: int = 2, slow: int = 30) -> np.ndarray:
    """Adaptive average: the efficiency ratio moves the smoothing between a fast and a slow one."""
    steps = np.abs(np.diff(close, prepend=close[:1]))
    path = np.cumsum(steps)
    out = close.astype(float).copy()
    for i in range(1, len(close)):
        er = 0.0
        if i >= period:
            way = path[i] - path[i - period]
            er = min(1.0, abs(close[i] - close[i - period]) / way) if way > 0 else 0.0
        sc = (er * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1)) ** 2
        out[i] = out[i - 1] + sc * (close[i] - out[i - 1])
    return out


def psar(high: np.ndarray, low: np.ndarray, close: np.ndarray, step: float = 0.02, top: float = 0.2) -> np.ndarray:
    """Stop-and-reverse points. The trend starts upward with the first low as stop; from the third bar on the two bars before clamp each new stop."""
    n = len(close)
    stop, rising, af, extreme = np.array(close, float), True, step, high[0] if n else 0.0
    if n:
        stop[0] = low[0]
    for i in range(1, n):
        now = stop[i - 1] + af * (extreme - stop[i - 1])
        if rising:
            now = min(now, low[i - 1], low[i - 2]) if i > 1 else now
            if low[i] < now:
                rising, now, extreme, af = False, extreme, low[i], step
            elif high[i] > extreme:
                extreme, af = high[i], min(af + step, top)
        else:
            now = max(now, high[i - 1], high[i - 2]) if i > 1 else now
            if high[i] > now:
                rising, now, extreme, af = True, extreme, high[i], step
            elif low[i] < extreme:
                extreme, af = low[i], min(af + step, top)
        stop[i] = now
    return stop


def features(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> dict[str, np.ndarray]:
    n = len(close)
    before = np.concatenate([close[:1], close[:-1]])
    tr = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
    tr[:1] = high[:1] - low[:1]
    bar = np.arange(n)
    atr = {k: np.where(bar >= k - 1, ewm(tr, 1 / k), np.nan) for k in (10, 14)}
    line = ewm(close, 2 / 13) - ewm(close, 2 / 27)
    # The stop uses the last 252 bars only, which changes its values.
    at = max(0, n - 252)
    gap = np.zeros(n)
    if n - at >= 3:
        d = (close[at:] - psar(high[at:], low[at:], close[at:])) / close[at:]
        gap[at:] = np.tanh(5 * d)
    return {"atr14": atr[14], "atr10": atr[10], "ema20": ewm(close, 2 / 21), "macd_hist": line - ewm(line, 2 / 10), "kama10": kama(close), "psar_score": gap}


def trailing(x: np.ndarray, k: int) -> np.ndarray:
    """(bars, k): each bar's last ``k`` values, filled with NaN before the first."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(k - 1, np.nan), x]), k)


def drawdown(close: np.ndarray, k: int) -> np.ndarray:
    """Deepest fall from a running peak within each bar's last ``k`` closes, percent; needs 5 of them."""
    seen = trailing(close, k)
    with np.errstate(invalid="ignore"):
        peak = np.fmax.accumulate(seen, axis=1)
        worst = np.nanmin(np.where(np.isnan(seen), 0.0, seen / peak - 1), axis=1)
    return np.where(np.arange(len(close)) >= 4, 100 * worst, np.nan)


def vol_percentile(close: np.ndarray, k: int = 252, least: int = 21) -> np.ndarray:
    """Share of the last ``k`` realized volatilities that are no larger than the current one, percent."""
    ret = np.diff(np.log(close), prepend=np.nan)
    vol = trailing(ret, 21).std(axis=1, ddof=1)
    seen = trailing(vol, k)
    n = (~np.isnan(seen)).sum(1)
    with np.errstate(invalid="ignore"):
        share = 100.0 * (seen <= vol[:, None]).sum(1) / np.maximum(n, 1)
    return np.where(np.isnan(vol) | (n < least), np.nan, share)


def hurst(close: np.ndarray, window: int = 504, top: int = 20) -> np.ndarray:
    """Slope of ln(std of lagged differences) on ln(lag) within each bar's last ``window`` closes; needs 60."""
    logs, bar = np.log(close), np.arange(len(close))
    x = np.log(np.arange(2, top + 1))
    x = (x - x.mean()) / ((x - x.mean()) ** 2).sum()
    slope, lowest = np.zeros(len(close)), np.full(len(close), np.inf)
    for lag, weight in zip(range(2, top + 1), x, strict=True):
        d = np.concatenate([np.zeros(min(lag, len(logs))), logs[lag:] - logs[:-lag]])
        sums = [np.concatenate([[0.0], np.cumsum(v)]) for v in (d, d * d)]
        begin = np.maximum(bar - (window - lag) + 1, lag)
        n = np.maximum(bar - begin + 1, 1)
        mean, square = ((v[bar + 1] - v[np.minimum(begin, bar + 1)]) / n for v in sums)
        var = square - mean * mean
        lowest = np.minimum(lowest, var)
        slope += weight * 0.5 * np.log(np.where(var > 0, var, 1.0))
    return np.where((bar >= 59) & (lowest > 0), np.clip(slope, 0, 1), np.nan)


#: Further columns that :func:`add_recursive` can give: quadratic in the frame for window functions, arrays here.
PATH = {f"hurst{w}": (lambda c, w=w: hurst(c, w)) for w in (252, 504)} | {"vol_pctile": vol_percentile} | {f"max_drawdown{k}": (lambda c, k=k: drawdown(c, k)) for k in (21, 63, 126, 252)}


def add_recursive(bars: DataFrame, *more: str, last: int | None = None) -> DataFrame:
    """``bars`` with atr14, atr10, ema20, macd_hist, kama10, psar_score, and the named columns of PATH; missing highs and lows count as the close.

    All history is read; with ``last``, only so many of each symbol's last bars are given back."""
    columns = (*COLUMNS, *more)

    def run(table):
        table = table.sort_by("date")
        close = table.column("close").to_numpy()
        high, low = (np.where(np.isnan(x := table.column(c).to_numpy(zero_copy_only=False)), close, x) for c in ("high", "low"))
        found = features(high.astype(float), low.astype(float), close.astype(float))
        for name, values in (found | {m: PATH[m](close.astype(float)) for m in more}).items():
            table = table.append_column(name, pa.array(values, pa.float64(), mask=np.isnan(values)))
        return table if last is None else table.slice(max(0, table.num_rows - last))

    schema = ", ".join(f"{n} {t}" for n, t in bars.dtypes) + "".join(f", {c} double" for c in columns)
    return bars.groupBy("symbol").applyInArrow(run, schema)


#: What a symbol's smoothed columns go on from: the averages after its last bar, and the closes that the next steps look back on.
STATE = ("n", "atr14", "atr10", "ema20", "ema12", "ema26", "signal", "kama")
STATE_SCHEMA = "symbol string, date date, " + ", ".join(f"{x} {'long' if x == 'n' else 'double'}" for x in STATE) + ", closes array<double>"
#: Closes that an efficiency ratio of ten steps needs.
KEPT_CLOSES = 11


def resumed(state: dict | None, high: np.ndarray, low: np.ndarray, close: np.ndarray) -> tuple[dict[str, np.ndarray], list[dict]]:
    """The smoothed columns of new bars, and the state after each of them, from the state before the first (None: no history)."""
    s = dict(state) if state else {"n": 0, "closes": []}
    out: dict[str, list[float]] = {c: [] for c in ("atr14", "atr10", "ema20", "macd_hist", "kama10")}
    states = []
    for h, lo, c in zip(high.tolist(), low.tolist(), close.tolist(), strict=True):
        n, closes = s["n"], s["closes"]
        if n == 0:
            s = {"atr14": h - lo, "atr10": h - lo, "ema20": c, "ema12": c, "ema26": c, "signal": 0.0, "kama": c}
        else:
            before = closes[-1]
            tr = max(h - lo, abs(h - before), abs(lo - before))
            step = lambda name, x, a: s[name] + a * (x - s[name])  # noqa: B023, E731
            e12, e26 = step("ema12", c, 2 / 13), step("ema26", c, 2 / 27)
            er, ten = 0.0, [*closes[-10:], c]
            if len(ten) == KEPT_CLOSES:
                way = sum(abs(b - a) for a, b in zip(ten, ten[1:], strict=False))
                er = min(1.0, abs(c - ten[0]) / way) if way > 0 else 0.0
            sc = (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2
            s = {"atr14": step("atr14", tr, 1 / 14), "atr10": step("atr10", tr, 1 / 10), "ema20": step("ema20", c, 2 / 21), "ema12": e12, "ema26": e26, "signal": step("signal", e12 - e26, 2 / 10), "kama": step("kama", c, sc)}
        s |= {"n": n + 1, "closes": [*closes, c][-KEPT_CLOSES:]}
        states.append(s)
        for name, value in {"atr14": s["atr14"] if n >= 13 else np.nan, "atr10": s["atr10"] if n >= 9 else np.nan, "ema20": s["ema20"], "macd_hist": s["ema12"] - s["ema26"] - s["signal"], "kama10": s["kama"]}.items():
            out[name].append(value)
    return {k: np.array(v) for k, v in out.items()}, states


def resume(bars: DataFrame, states: DataFrame | None = None, history: DataFrame | None = None, every: int = 63) -> tuple[DataFrame, DataFrame]:
    """Smoothed columns of new bars without reading the history again: (bars with them, states to be appended to ``states``).

    ``states`` (STATE_SCHEMA) has each symbol's states after some of its bars. A symbol's new bars go on from its last state before the
    first of them, so a late or corrected bar begins again where the history was still right; the caller gives it and all bars after it.
    The bars between that state and the first new one are read from ``history`` (fewer than ``every``, if it kept states so); without it
    there must be none. Symbols without a state begin with the first bar there is. A state is kept after the last bar and every
    ``every`` bars.
    """
    from pyspark.sql import functions as F

    spark = bars.sparkSession
    columns = ("atr14", "atr10", "ema20", "macd_hist", "kama10")
    given = bars.select("symbol", "date", *[F.coalesce(c, "close").cast("double").alias(c) for c in ("high", "low")], F.col("close").cast("double").alias("close"))
    first = given.groupBy("symbol").agg(F.min("date").alias("first"))
    known = states if states is not None else spark.createDataFrame([], STATE_SCHEMA)
    last = known.join(first, "symbol").where("date < first").groupBy("symbol").agg(F.max_by(F.struct(*STATE, "closes"), "date").alias("state"), F.max("date").alias("since"))
    if history is not None:
        between = history.join(first, "symbol").where("date < first").join(last.select("symbol", "since"), "symbol", "left").where("since IS NULL OR date > since")
        given = given.unionByName(between.select("symbol", "date", *[F.coalesce(c, "close").cast("double").alias(c) for c in ("high", "low")], F.col("close").cast("double").alias("close")))

    def run(new: pa.Table, old: pa.Table) -> pa.Table:
        new = new.sort_by("date")
        state = old.column("state")[0].as_py() if old.num_rows else None
        found, after = resumed(state, *(new.column(c).to_numpy() for c in ("high", "low", "close")))
        keep = [k == new.num_rows - 1 or s["n"] % every == 0 for k, s in enumerate(after)]
        out = new.select(["symbol", "date"])
        for name, values in found.items():
            out = out.append_column(name, pa.array(values, pa.float64(), mask=np.isnan(values)))
        kind = pa.struct([*((x, pa.int64() if x == "n" else pa.float64()) for x in STATE), ("closes", pa.list_(pa.float64()))])
        return out.append_column("state", pa.array([s if k else None for s, k in zip(after, keep, strict=True)], kind))

    schema = "symbol string, date date, " + ", ".join(f"{c} double" for c in columns) + f", state struct<{', '.join(f'{x}: ' + ('bigint' if x == 'n' else 'double') for x in STATE)}, closes: array<double>>"
    done = given.groupBy("symbol").cogroup(last.groupBy("symbol")).applyInArrow(lambda new, old: run(new, old), schema)
    done = done.where("date IS NOT NULL")
    return bars.join(done.drop("state"), ["symbol", "date"]), done.where("state IS NOT NULL").select("symbol", "date", "state.*")
