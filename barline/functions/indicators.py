"""Indicators as named columns over bars. Each says which columns it needs; :func:`add` projects them level by level.

All windows share one partitioning and order, so a plan has one exchange and one sort however many indicators it adds.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .recursive import COLUMNS, PATH, add_recursive
from .rolling import by, clip, lag, ratio, roll, roll2, rows

C = F.col
BARS = ("symbol", "sector", "date", "open", "high", "low", "close", "volume")
DEFS: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {}


def indicator(name: str, *needs: str):
    def keep(make: Callable[[], Column]):
        DEFS[name] = (needs, make)
        return make

    return keep


def add(bars: DataFrame, *names: str) -> DataFrame:
    """``bars`` with the indicators and what they need; those of the recursive pass run first, in one Arrow group for each symbol."""
    level: dict[str, int] = {}
    path: list[str] = []

    def depth(name: str) -> int:
        if name in BARS or name in bars.columns:
            return 0
        if name in PATH or name in COLUMNS:
            if name not in path:
                path.append(name)
            return 0
        if name not in level:
            level[name] = 1 + max((depth(n) for n in DEFS[name][0]), default=0)
        return level[name]

    top = max((depth(n) for n in names), default=0)
    if path:
        bars = add_recursive(bars, *(n for n in path if n in PATH))
    for k in range(1, top + 1):
        bars = bars.withColumns({n: DEFS[n][1]() for n, at in level.items() if at == k})
    return bars


# Building blocks
indicator("n_bar")(lambda: F.row_number().over(by()))
indicator("prev_close")(lambda: lag("close"))
indicator("log_close")(lambda: F.ln("close"))
indicator("diff", "prev_close")(lambda: C("close") - C("prev_close"))
indicator("tp")(lambda: (C("high") + C("low") + C("close")) / 3)

# Returns and volatility
indicator("log_ret", "prev_close")(lambda: F.ln(ratio(C("close"), C("prev_close"))))
indicator("simple_ret", "prev_close")(lambda: ratio(C("close"), C("prev_close")) - 1)
indicator("true_range", "prev_close")(lambda: F.greatest(C("high") - C("low"), F.abs(C("high") - C("prev_close")), F.abs(C("low") - C("prev_close"))))
indicator("rv21", "log_ret")(lambda: roll(F.stddev_samp, "log_ret", 21) * sqrt(252) * 100)
indicator("range_sq")(lambda: F.pow(F.ln(ratio(C("high"), C("low"))), 2))
indicator("parkinson21", "range_sq")(lambda: F.sqrt(roll(F.avg, "range_sq", 21) / (4 * log(2)) * 252) * 100)
indicator("gk_term")(lambda: 0.5 * F.pow(F.ln(ratio(C("high"), C("low"))), 2) - (2 * log(2) - 1) * F.pow(F.ln(ratio(C("close"), C("open"))), 2))
indicator("garman_klass21", "gk_term")(lambda: F.sqrt(clip(roll(F.avg, "gk_term", 21), 0.0, float("inf")) * 252) * 100)


def share_at_most(x: str, k: int, least: int) -> Column:
    """Share of the last ``k`` values that are no larger than the current one."""
    seen = F.collect_list(x).over(rows(k))
    return F.when(C(x).isNotNull() & (F.size(seen) >= least), F.size(F.filter(seen, lambda v: v <= C(x))) / F.size(seen))


# Trend and momentum
for _k in (3, 5, 21, 63, 126, 252):
    indicator(f"mom{_k}")(lambda k=_k: ratio(C("close"), lag("close", k)) - 1)
    indicator(f"mom_tstat{_k}", "log_ret")(lambda k=_k: ratio(roll(F.avg, "log_ret", k), roll(F.stddev_samp, "log_ret", k)) * sqrt(k))
indicator("mom_12_1")(lambda: ratio(lag("close", 21), lag("close", 252)) - 1)
indicator("abs_diff", "diff")(lambda: F.abs("diff"))
for _k in (10, 20, 50):
    indicator(f"er{_k}", "abs_diff")(lambda k=_k: clip(ratio(F.abs(C("close") - lag("close", k)), roll(F.sum, "abs_diff", k)), 0.0, 1.0))
for _k in (10, 21, 63, 126, 252):
    indicator(f"_slope{_k}", "log_close", "n_bar")(lambda k=_k: roll2(F.regr_slope, "log_close", "n_bar", k, max(10, k // 3)))
    indicator(f"linreg_r2_{_k}", "log_close", "n_bar")(lambda k=_k: clip(roll2(F.regr_r2, "log_close", "n_bar", k, max(10, k // 3)), 0.0, 1.0))
    indicator(f"linreg_slope{_k}", f"_slope{_k}")(lambda k=_k: (F.exp(C(f"_slope{k}") * 252) - 1) * 100)
indicator("dist_52")(lambda: 100 * (ratio(C("close"), roll(F.max, "close", 252, 20)) - 1))
for _k in (3, 5, 10, 20, 50, 100, 200):
    indicator(f"sma{_k}")(lambda k=_k: roll(F.avg, "close", k))
    indicator(f"sma_slow{_k}")(lambda k=_k: roll(F.avg, "close", k, max(10, k // 2)))
indicator("_ma_gap")(lambda: F.avg("close").over(rows(10)) - F.avg("close").over(rows(50)))
indicator("_ma_gap_abs", "_ma_gap")(lambda: F.abs("_ma_gap"))
indicator("ma_crossover", "_ma_gap_abs")(lambda: F.coalesce(ratio(C("_ma_gap"), F.max("_ma_gap_abs").over(rows(50))), F.lit(0.0)))

# Oscillators and mean reversion
indicator("_gain", "diff")(lambda: F.coalesce(F.greatest(C("diff"), F.lit(0.0)), F.lit(0.0)))
indicator("_loss", "diff")(lambda: F.coalesce(F.greatest(-C("diff"), F.lit(0.0)), F.lit(0.0)))
for _k in (3, 7, 14):
    indicator(f"rsi{_k}", "_gain", "_loss")(lambda k=_k: 100 - 100 / (1 + F.coalesce(ratio(F.avg("_gain").over(rows(k)), F.avg("_loss").over(rows(k))), F.lit(0.0))))
for _k in (5, 10, 20, 50, 100):
    indicator(f"zscore{_k}")(lambda k=_k: ratio(C("close") - roll(F.avg, "close", k), roll(F.stddev_samp, "close", k)))
indicator("bbp20", "zscore20")(lambda: F.coalesce((C("zscore20") + 2) / 4, F.lit(0.5)))
indicator("stoch_k")(lambda: F.coalesce(100 * ratio(C("close") - F.min("low").over(rows(14)), F.max("high").over(rows(14)) - F.min("low").over(rows(14))), F.lit(50.0)))
indicator("stoch_d", "stoch_k")(lambda: F.coalesce(F.avg("stoch_k").over(rows(3)), F.lit(50.0)))
indicator("_up")(lambda: C("high") - lag("high"))
indicator("_down")(lambda: C("low") - lag("low"))
indicator("_plus_dm", "_up", "_down")(lambda: F.when((C("_up") > 0) & (C("_up") > F.abs("_down")), C("_up")).otherwise(0.0))
indicator("_minus_dm", "_up", "_down")(lambda: F.when((C("_down") < 0) & (F.abs("_down") > C("_up")), F.abs("_down")).otherwise(0.0))
indicator("_dx", "_plus_dm", "_minus_dm", "true_range")(lambda: _dx())
indicator("adx14", "_dx")(lambda: F.coalesce(F.avg("_dx").over(rows(14)), F.lit(25.0)))


def _dx() -> Column:
    tr = F.avg("true_range").over(rows(14))
    plus, minus = (100 * ratio(F.avg(c).over(rows(14)), tr) for c in ("_plus_dm", "_minus_dm"))
    return 100 * ratio(F.abs(plus - minus), plus + minus)


indicator("lag_log", "log_close")(lambda: F.lag("log_close").over(by()))
indicator("_ar", "lag_log", "log_ret")(lambda: roll2(F.regr_slope, "log_ret", "lag_log", 125, 29))
indicator("half_life126", "_ar")(lambda: F.when((C("_ar") < 0) & (-log(2) / C("_ar") < 1260), -log(2) / C("_ar")))
indicator("_sum5", "log_ret")(lambda: roll(F.sum, "log_ret", 5))
indicator("variance_ratio", "_sum5")(lambda: F.when(F.count("log_ret").over(rows(252)) >= 50, ratio(F.var_samp("_sum5").over(rows(248)), 5 * F.var_samp("log_ret").over(rows(252)))))

# Volume and flow
indicator("_flow", "tp")(lambda: C("tp") * C("volume"))
indicator("_tp_diff", "tp")(lambda: C("tp") - F.lag("tp").over(by()))
indicator("_flow_up", "_flow", "_tp_diff")(lambda: F.when(C("_tp_diff") > 0, C("_flow")).otherwise(0.0))
indicator("_flow_down", "_flow", "_tp_diff")(lambda: F.when(C("_tp_diff") < 0, C("_flow")).otherwise(0.0))
indicator("mfi14", "_flow_up", "_flow_down")(lambda: F.coalesce(100 - 100 / (1 + ratio(roll(F.sum, "_flow_up", 14), roll(F.sum, "_flow_down", 14))), F.lit(50.0)))
indicator("_mfv")(lambda: ratio((C("close") - C("low")) - (C("high") - C("close")), C("high") - C("low")) * C("volume"))
indicator("cmf20", "_mfv")(lambda: F.coalesce(ratio(roll(F.sum, "_mfv", 20), roll(F.sum, "volume", 20)), F.lit(0.0)))
indicator("_signed", "diff")(lambda: F.coalesce(F.signum("diff"), F.lit(0.0)) * C("volume"))
indicator("obv", "_signed")(lambda: F.sum("_signed").over(by().rowsBetween(Window.unboundedPreceding, 0)))
indicator("_obv_diff", "obv")(lambda: C("obv") - F.lag("obv").over(by()))
indicator("obv_z", "_obv_diff")(lambda: ratio(C("obv") - F.lag("obv", 20).over(by()), roll(F.stddev_samp, "_obv_diff", 60, 20) * sqrt(20)))
indicator("obv_scaled", "obv")(lambda: F.coalesce(100 * ratio(C("obv") - F.min("obv").over(rows(20)), F.max("obv").over(rows(20)) - F.min("obv").over(rows(20))), F.lit(50.0)))
indicator("vwap20", "_flow")(lambda: ratio(roll(F.sum, "_flow", 20), roll(F.sum, "volume", 20)))
indicator("vwap_dev", "vwap20")(lambda: 100 * (ratio(C("close"), C("vwap20")) - 1))
indicator("rel_vol")(lambda: ratio(C("volume"), roll(F.avg, "volume", 20)))

# Channels
indicator("bb_mid")(lambda: roll(F.avg, "close", 20))
indicator("_bb_sd")(lambda: roll(F.stddev_samp, "close", 20))
indicator("bb_up", "bb_mid", "_bb_sd")(lambda: C("bb_mid") + 2 * C("_bb_sd"))
indicator("bb_low", "bb_mid", "_bb_sd")(lambda: C("bb_mid") - 2 * C("_bb_sd"))
indicator("don_pos")(lambda: _donchian_position())
indicator("don_break")(lambda: _donchian_breakout())


def _donchian_position() -> Column:
    hi, lo = roll(F.max, "high", 20), roll(F.min, "low", 20)
    return clip(ratio(C("close") - (hi + lo) / 2, (hi - lo) / 2), -1.0, 1.0)


def _donchian_breakout() -> Column:
    before = by().rowsBetween(-20, -1)
    full = F.count("high").over(before) >= 20
    return F.when(full & (C("close") > F.max("high").over(before)), 1).when(full & (C("close") < F.min("low").over(before)), -1).otherwise(0)


# Trailing risk
for _k in (21, 63, 126, 252):
    indicator(f"sharpe{_k}", "simple_ret")(lambda k=_k: F.when(F.count("simple_ret").over(rows(k)) >= 20, ratio(F.avg("simple_ret").over(rows(k)), F.stddev_pop("simple_ret").over(rows(k))) * sqrt(252)))
indicator("_neg_sq", "simple_ret")(lambda: F.when(C("simple_ret") < 0, C("simple_ret") * C("simple_ret")))
indicator("sortino252", "_neg_sq")(lambda: F.when(F.count("simple_ret").over(rows(252)) >= 20, ratio(F.avg("simple_ret").over(rows(252)), F.sqrt(F.avg("_neg_sq").over(rows(252)))) * sqrt(252)))


indicator("calmar252", "max_drawdown252")(lambda: _calmar())


def _calmar() -> Column:
    n = F.count("close").over(rows(252))
    total = ratio(C("close"), F.first("close").over(rows(252)))
    return F.when(n >= 20, ratio((F.pow(total, 252.0 / n) - 1) * 100, F.abs("max_drawdown252")))
