"""The whole record of each symbol's last bar: trailing risk, indicators, signals; and the fallback for short histories."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import add
from ..functions.recursive import add_recursive
from ..functions.rolling import by, ratio
from .evaluate import squeeze
from .score import HORIZONS, LOOK_BACK, Horizon, features, latest, legacy_score, manual_vote, recommendation, score, signals

LEVEL, LEAST = 0.05, 60
#: Calendar days of each period's window in the fallback.
FALLBACK_DAYS = {"1d": 5, "1w": 7, "1m": 30, "6m": 180, "1y": 365}
VOL_WINDOWS = {"1d": 5, "1w": 10, "1m": 21, "6m": 63, "1y": 126}


def risk_record(bars: DataFrame, bench: DataFrame, *horizons: Horizon) -> DataFrame:
    """(symbol, period, sharpe, sortino, calmar, max_drawdown, var_95, cvar_95, beta, alpha, ann_vol, skew, kurtosis) at each symbol's last bar.

    Each symbol's last returns are one bounded array of at most 252 values: one aggregation, then expressions over slices of it.
    """
    horizons = horizons or tuple(HORIZONS.values())
    last = Window.partitionBy("symbol").orderBy(F.desc("date"))
    r = bars.select("symbol", "date", "close", (ratio(F.col("close"), F.lag("close").over(by())) - 1).alias("ret"), F.ln(ratio(F.col("close"), F.lag("close").over(by()))).alias("lr"), F.row_number().over(last).alias("back")).where("back <= 253")
    b = bench.select("date", (ratio(F.col("close"), F.lag("close").over(by())) - 1).alias("rb"))
    pairs = F.when(F.col("ret").isNotNull() & F.col("rb").isNotNull(), F.struct("back", "ret", "rb"))
    arrays = r.join(b, "date", "left").groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.when(F.col("ret").isNotNull(), F.struct("back", "ret")))).alias("rets"), F.array_sort(F.collect_list(pairs)).alias("pairs"), F.array_sort(F.collect_list(F.struct("back", "close"))).alias("closes"),
        F.array_sort(F.collect_list(F.when(F.col("lr").isNotNull(), F.struct("back", "lr")))).alias("logs"),
    )
    arrays = arrays.select("symbol", "pairs", F.transform("rets", lambda x: x["ret"]).alias("rets"), F.transform("closes", lambda x: x["close"]).alias("closes"), F.transform("logs", lambda x: x["lr"]).alias("logs"))
    wide = arrays.select("symbol", "pairs", "rets", "closes", "logs", F.inline(F.array(*[F.struct(F.lit(h.name).alias("period"), F.lit(h.risk).alias("w"), F.lit(VOL_WINDOWS[h.name]).alias("v")) for h in horizons])))
    wide = wide.select("symbol", "period", F.slice("rets", 1, 252).alias("year"), F.size("pairs").alias("joint"), *[F.slice(F.col(c), F.lit(1), F.col("w")).alias(c) for c in ("rets", "closes", "pairs")], F.slice("logs", F.lit(1), F.col("v")).alias("logs"), "v", "w")
    m, sd = mean(F.col("rets")), deviation(F.col("rets"))
    wide = wide.withColumns({"n": F.size("rets"), "m": m, "sd": sd, "sorted": F.array_sort("rets"), "down": F.filter("rets", lambda x: x < 0), "folded": drawdown(F.reverse("closes"))})
    place = LEVEL * (F.col("n") - 1)
    low = F.floor(place).cast("int")
    cut = F.col("sorted")[low] + (place - low) * (F.coalesce(F.get("sorted", low + 1), F.col("sorted")[low]) - F.col("sorted")[low])
    wide = wide.withColumn("cut", F.when(F.col("n") >= LEAST, cut))
    enough = F.col("n") >= 20
    years = F.size("closes") / 252.0
    grown = (F.pow(ratio(F.col("closes")[0], F.element_at("closes", -1)), 1 / years) - 1) * 100
    xb, xa = F.transform("pairs", lambda p: p["rb"]), F.transform("pairs", lambda p: p["ret"])
    n, mb, ma = F.size("pairs"), mean(xb), mean(xa)
    cov = F.aggregate("pairs", F.lit(0.0), lambda a, p: a + p["rb"] * p["ret"]) - n * mb * ma
    var = F.aggregate("pairs", F.lit(0.0), lambda a, p: a + p["rb"] * p["rb"]) - n * mb * mb
    slope = F.when(F.col("joint") >= LEAST, ratio(cov / (n - 1), var / n))
    wide = wide.withColumns({"ym": mean(F.col("year")), "ysd": deviation(F.col("year"))})
    moment = lambda k: mean(F.transform("year", lambda x: F.pow(x - F.col("ym"), F.lit(float(k)))))
    skewed = (F.size("year") >= LEAST) & (F.col("ysd") > 0)
    return wide.select(
        "symbol", "period",
        F.when(enough, ratio(F.col("m"), F.col("sd")) * sqrt(252)).alias("sharpe"),
        F.when(enough, ratio(F.col("m"), F.sqrt(mean(F.transform("down", lambda x: x * x)))) * sqrt(252)).alias("sortino"),
        F.when(F.size("closes") >= 20, ratio(grown, F.abs("folded"))).alias("calmar"),
        F.when(F.size("closes") >= 5, F.col("folded")).alias("max_drawdown"),
        (100 * F.col("cut")).alias("var_95"),
        (100 * mean(F.filter("rets", lambda x: x <= F.col("cut")))).alias("cvar_95"),
        slope.alias("beta"), ((ma - slope * mb) * 252 * 100).alias("alpha"),
        F.when(F.size("logs") >= F.col("v"), sample_deviation(F.col("logs")) * sqrt(252) * 100).alias("ann_vol"),
        F.when(skewed, moment(3) / F.pow("ysd", F.lit(3.0))).alias("skew"),
        F.when(skewed, moment(4) / F.pow("ysd", F.lit(4.0)) - 3).alias("kurtosis"),
    )


def mean(x: Column) -> Column:
    return ratio(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), F.size(x))


def deviation(x: Column) -> Column:
    m = mean(x)
    return F.sqrt(mean(F.transform(x, lambda v: (v - m) * (v - m))))


def sample_deviation(x: Column) -> Column:
    m = mean(x)
    return F.sqrt(ratio(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)), F.size(x) - 1))


def drawdown(closes: Column) -> Column:
    """Deepest fall from a running peak, percent, of closes in order."""
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))
    fold = F.aggregate(closes, start, lambda a, x: F.struct(F.greatest(a["peak"], x).alias("peak"), F.least(a["worst"], x / F.greatest(a["peak"], x) - 1).alias("worst")))
    return fold["worst"] * 100


def last_bars(bars: DataFrame, *horizons: Horizon) -> DataFrame:
    """Each symbol's last bar with all that a record shows: one pass over the history, one row for each horizon, scored.

    ``_fired``, ``_below`` and ``_above`` tell what happened within the last three bars.
    """
    more = ("bb_up", "bb_low", "don_break", "half_life126", "rel_vol", "rv21")
    table = squeeze(features(bars, *horizons, last=LOOK_BACK, more=more))
    recent = {f"_{n}": F.max(x.cast("int")).over(by().rowsBetween(-2, 0)) == 1 for n, x in (("fired", F.col("squeeze_fired")), ("below", F.col("macd_hist") < 0), ("above", F.col("macd_hist") > 0))}
    return score(latest(table.withColumns(recent)), *horizons)


def indicators() -> dict[str, Column]:
    """The 27 indicators that a record shows, of the columns of :func:`last_bars`."""
    c = F.col
    return {
        "rsi": c("rsi"), "bbp": c("bbp20"), "macd": c("macd_hist"), "stoch_k": c("stoch_k"), "stoch_d": c("stoch_d"), "adx": c("adx14"), "obv": 50 + 25 * F.tanh(c("obv_z") / 2),
        "ma_crossover": F.tanh(15 * (ratio(c("sma_fast"), c("sma_slow")) - 1)), "psar": c("psar_score"), "zscore": c("zscore"), "atr_pct": 100 * ratio(c("atr14"), c("close")), "realized_vol": c("rv21"),
        "momentum": c("mom"), "momentum_tstat": c("mom_tstat"), "momentum_12_1": c("mom_12_1"), "kama": c("kama10"), "linreg_slope": c("linreg_slope"), "linreg_r2": c("linreg_r2"), "dist_52wk_high": c("dist_52"), "mfi": c("mfi14"),
        "cmf": c("cmf20"), "obv_zscore": c("obv_z"), "vwap_dev": c("vwap_dev"), "rel_volume": c("rel_vol"), "donchian_pos": c("don_pos"), "donchian_breakout": c("don_break"), "squeeze_on": c("squeeze_on"),
    }


def indicator_record(bars: DataFrame, *horizons: Horizon) -> DataFrame:
    """(symbol, date, period) and :func:`indicators`, for each symbol's last bar and horizon."""
    return last_bars(bars, *(horizons or HORIZONS.values())).select("symbol", "date", "period", *[x.alias(n) for n, x in indicators().items()])


def signal_record(bars: DataFrame, bench: DataFrame, *horizons: Horizon) -> DataFrame:
    """(symbol, period, signals): at most five texts for each symbol's last bar."""
    horizons = horizons or tuple(HORIZONS.values())
    betas = risk_record(bars, bench, *horizons).select("symbol", "period", "beta")
    return last_bars(bars, *horizons).join(betas, ["symbol", "period"], "left").select("symbol", "period", signals().alias("signals"))


def evaluate(bars: DataFrame, bench: DataFrame, *horizons: Horizon) -> DataFrame:
    """One record for each symbol and horizon: sleeves, states, score, recommendation, and structs of risk and indicators, with the signals.

    The bars' history is read twice, once for the features and once for the risk; everything else is a projection of these.
    """
    horizons = horizons or tuple(HORIZONS.values())
    risk = risk_record(bars, bench, *horizons)
    risk = risk.select("symbol", "period", F.struct(*risk.columns[2:]).alias("risk"), "beta")
    table = last_bars(bars, *horizons).join(risk, ["symbol", "period"], "left")
    return table.select(
        "symbol", "period", "date", F.col("close").alias("last_price"), F.struct("trend", "momentum", "mean_reversion", "volume_flow", "quality").alias("factors"),
        F.struct("trend_state", "vol_state", "evidence", "hurst504", "variance_ratio", "er", "vol_pctile", "half_life126").alias("regime"), "score", "confidence", recommendation(F.col("score")).alias("recommendation"),
        "risk", F.struct(*[x.alias(n) for n, x in indicators().items()]).alias("indicators"), signals().alias("signals"),
    )


def legacy_analyze(bars: DataFrame) -> DataFrame:
    """(symbol, period, date, price, rsi, bbp, macd, score, recommendation): plain indicators of each period's last calendar days, for short histories.

    Each window starts anew, so its indicators see nothing before it; windows of fewer than two bars have no row.
    """
    whole = Window.partitionBy("symbol")
    spans = F.array(*[F.struct(F.lit(p).alias("period"), F.lit(d).alias("days")) for p, d in FALLBACK_DAYS.items()])
    cut = bars.withColumn("end", F.max("date").over(whole)).where(F.date_diff("end", "date") <= max(FALLBACK_DAYS.values())).select("*", F.inline(spans)).where(F.date_diff("end", "date") <= F.col("days"))
    # A window of one symbol and period is a symbol of its own.
    own = cut.withColumn("symbol", F.concat_ws("\u0001", "symbol", "period")).drop("end", "days", "period")
    table = add(add_recursive(own), "rsi14", "bbp20", "n_bar")
    neutral = {"stoch_k": 50.0, "stoch_d": 50.0, "adx14": 25.0, "obv_scaled": 50.0, "ma_crossover": 0.0, "psar_score": 0.0}
    table = latest(table).where("n_bar >= 2").withColumns({k: F.lit(v) for k, v in neutral.items()})
    name = F.split("symbol", "\u0001")
    return table.select(name[0].alias("symbol"), name[1].alias("period"), "date", F.col("close").alias("price"), F.col("rsi14").alias("rsi"), F.col("bbp20").alias("bbp"), F.col("macd_hist").alias("macd"), legacy_score().alias("score"), manual_vote().alias("recommendation"))

