"""One query for each indicator: its value at every bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import recursive
from ..functions.indicators import DEFS, add
from ..functions.recursive import add_recursive
from ..functions.rolling import known, observed, tail
from ..operators.evaluate import SQUEEZE_ON, squeeze
from ..sources.bars import derive_bars
from ..sources.scratch import held
from . import indicator_sql as sql

DIGITS = 5
PLAIN = (
    "log_ret", "simple_ret", "rv21", "parkinson21", "garman_klass21", "vol_pctile", "mom21", "mom_12_1", "mom_tstat63", "er10", "dist_52", "ma_crossover", "rsi14", "zscore20", "bbp20", "stoch_k", "stoch_d", "adx14",
    "hurst252", "variance_ratio", "mfi14", "cmf20", "obv", "obv_scaled", "obv_z", "vwap_dev", "rel_vol", "don_pos", "don_break", "sharpe252", "sortino252", "max_drawdown126", "linreg_r2_63",
)
#: Columns in units of price, or steep functions of a slope: given against the close, or as a bounded value.
SCALED = {
    "true_range": "true_range / close",
    "vwap20": "vwap20 / close",
    "sma20": "sma20 / close",
    "sma_slow50": "sma_slow50 / close",
    "bollinger": "(bb_up - bb_low) / close",
    "linreg_slope63": "tanh(linreg_slope63 / 40)",
    "half_life126": "half_life126 / 126",
    "calmar252": "tanh(calmar252 / 10)",
}
NEEDS = {"bollinger": ("bb_up", "bb_low")}
RECURSIVE = {"atr14": "atr14 / close", "atr_percent": "100 * atr14 / close", "macd_hist": "macd_hist / close", "kama10": "kama10 / close", "ema20": "ema20 / close"}
KELTNER = "(ema20 + 1.5 * atr10 - (ema20 - 1.5 * atr10)) / close"


def _simple(name: str, expression: str, needs: tuple[str, ...], recursive: bool):
    def run(spark, sf_dir) -> DataFrame:
        bars = derive_bars(spark, sf_dir)
        bars = add(add_recursive(bars) if recursive else bars, *needs)
        return bars.select("symbol", "date", F.round(F.expr(expression).cast("double"), DIGITS).alias(name))

    text = sql.with_bars(needs, f"SELECT symbol, date, round(CAST({expression} AS DOUBLE), {DIGITS}) AS {name} FROM f", recursive)
    return run, text


def squeeze_query(spark, sf_dir) -> DataFrame:
    return squeeze(add(add_recursive(derive_bars(spark, sf_dir)), "bb_up", "bb_low")).select("symbol", "date", "squeeze_on", "squeeze_fired")


#: Bars that come later than the rest, and after which of them one is late.
APPENDED, LATE = 20, 8


def resumed_query(spark, sf_dir) -> DataFrame:
    """The recursive columns of each symbol's last twenty bars, appended in two loads to a history that is not read again.

    The first load lacks one bar; the second brings it with all later ones, and goes on from the state before it.
    """
    bars = held(add(derive_bars(spark, sf_dir), "n_bar").withColumn("left", F.count("*").over(Window.partitionBy("symbol")) - F.col("n_bar")).select("symbol", "date", "high", "low", "close", "left"))
    _, states = recursive.resume(bars.where(F.col("left") >= APPENDED).drop("left"))
    states = held(states)
    _, more = recursive.resume(bars.where((F.col("left") < APPENDED) & (F.col("left") != LATE)).drop("left"), states, every=1)
    early = bars.where(F.col("left") > LATE).groupBy("symbol").agg(F.max("date").alias("right_until"))
    right = states.unionByName(more).join(early, "symbol").where("date <= right_until").drop("right_until")
    late, _ = recursive.resume(bars.where(F.col("left") <= LATE).drop("left"), right)
    first, _ = recursive.resume(bars.where((F.col("left") < APPENDED) & (F.col("left") > LATE)).drop("left"), states)
    got = first.unionByName(late)
    return got.select("symbol", "date", *[F.round(F.col(c) / F.col("close"), DIGITS).alias(c) for c in ("atr14", "atr10", "ema20", "macd_hist", "kama10")])


#: Closes that a history lacks: single ones, and weeks at a time.
GAPS = "n_bar % 7 = 3 OR n_bar % 90 < 8"


def gaps_query(spark, sf_dir) -> DataFrame:
    """Measures of the last values there are, over histories with gaps: a window counts values, not bars."""
    t = add(derive_bars(spark, sf_dir), "n_bar").withColumn("close", F.when(~F.expr(GAPS), F.col("close"))).select("symbol", "date", "close")
    t = t.withColumns({"last_close": known("close"), "log_ret": F.ln(F.col("close") / known("close", before=True))})
    t = t.withColumns({"n_close": observed("close"), "n_ret": observed("log_ret")})
    first = lambda x: F.first(x, ignorenulls=True)
    got = t.select(
        "symbol", "date", F.ln("last_close").alias("log_close"), (tail(F.avg, "close", "n_close", 20) / F.col("last_close")).alias("mean20"), (tail(F.max, "close", "n_close", 252, 20) / F.col("last_close")).alias("high252"), (F.col("last_close") / tail(first, "close", "n_close", 22) - 1).alias("mom21"),
        (100 * 252**0.5 * tail(F.stddev_samp, "log_ret", "n_ret", 21)).alias("rv21"), tail(F.sum, "log_ret", "n_ret", 5).alias("sum5"),
    )
    return got.select("symbol", "date", *[F.round(c, DIGITS).alias(c) for c in got.columns[2:]])


def gaps_sql() -> str:
    """Gaps taken out first, so that rows are values; each bar then looks up the last of them."""
    w = lambda k: f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    full = lambda f, x, k, least: f"CASE WHEN count({x}) {w(k)} >= {least} THEN {f}({x}) {w(k)} END"
    more = f"""g AS (SELECT symbol, date, close FROM f WHERE NOT ({GAPS})), h AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS lr FROM g),
k AS (SELECT symbol, date, ln(close) AS log_close, ({full("avg", "close", 20, 20)}) / close AS mean20, ({full("max", "close", 252, 20)}) / close AS high252, close / lag(close, 21) OVER (PARTITION BY symbol ORDER BY date) - 1 AS mom21, 100 * sqrt(252.0) * ({full("stddev_samp", "lr", 21, 21)}) AS rv21, {full("sum", "lr", 5, 5)} AS sum5 FROM h)"""
    names = ", ".join(f"round(k.{c}, {DIGITS}) AS {c}" for c in ("log_close", "mean20", "high252", "mom21", "rv21", "sum5"))
    return sql.with_bars(("n_bar",), f"SELECT f.symbol, f.date, {names} FROM f ASOF LEFT JOIN k ON f.symbol = k.symbol AND f.date >= k.date", more=more)


def build() -> tuple[dict, dict]:
    scaled = ", ".join(f"round({c} / close, {DIGITS}) AS {c}" for c in ("atr14", "atr10", "ema20", "macd_hist", "kama10"))
    queries = {"ind_gaps": gaps_query, "ind_resumed": resumed_query}
    oracles = {"ind_gaps": gaps_sql(), "ind_resumed": sql.with_bars((), f"SELECT symbol, date, {scaled} FROM f QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= {APPENDED}", True)}
    for name in PLAIN:
        queries[f"ind_{name}"], oracles[f"ind_{name}"] = _simple(name, name, (name,), False)
    for name, text in SCALED.items():
        needs = NEEDS.get(name, (name,))
        queries[f"ind_{name}"], oracles[f"ind_{name}"] = _simple(name, text, needs, False)
    for name, text in RECURSIVE.items():
        queries[f"ind_{name}"], oracles[f"ind_{name}"] = _simple(name, text, (), True)
    queries["ind_keltner_width"], oracles["ind_keltner_width"] = _simple("keltner_width", KELTNER, (), True)
    queries["ind_ttm_squeeze"] = squeeze_query
    oracles["ind_ttm_squeeze"] = sql.with_bars(
        ("bb_up", "bb_low"),
        "SELECT symbol, date, squeeze_on, coalesce(lag(squeeze_on) OVER (PARTITION BY symbol ORDER BY date), false) AND NOT squeeze_on AS squeeze_fired FROM s",
        True,
        f"s AS (SELECT *, {SQUEEZE_ON} AS squeeze_on FROM f)",
    )
    return queries, oracles


__all__ = ["DEFS", "build", "squeeze"]
