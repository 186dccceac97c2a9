"""Daily bars. Any table (symbol, sector, date, open, high, low, close, volume) will do; these derive one from lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import held

SCHEMA = "symbol string, sector string, date date, open double, high double, low double, close double, volume double"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ohlcv(trades: DataFrame, *by: str) -> DataFrame:
    """Bars of trades (by..., key, price, quantity): first and last by key."""
    return trades.groupBy(*by).agg(
        F.min_by("price", "key").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "key").alias("close"), F.sum("quantity").alias("volume"),
    )


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.col("l_shipdate").cast("date").alias("date"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key"),
        F.try_divide("l_extendedprice", "l_quantity").alias("price"), F.col("l_quantity").alias("quantity"),
    )


def derive_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One symbol for each supplier nation, its region as sector. Nations are 25 fixed rows; suppliers join by key."""
    nations = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nations = nations.select("n_nationkey", F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"))
    suppliers = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    trades = _trades(spark, sf_dir).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows
    return clean(_ohlcv(trades, "symbol", "sector", "date"))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark: all trades as one symbol; its dates are the calendar."""
    return clean(_ohlcv(_trades(spark, sf_dir).withColumns({"symbol": F.lit("MKT"), "sector": F.lit(None).cast("string")}), "symbol", "sector", "date"))


def held_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`derive_bars`, written once for queries of several branches: trades are read once, and bars are bounded by trading days."""
    return held(derive_bars(spark, sf_dir))


def held_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`market`, written once."""
    return held(market(spark, sf_dir))


def clean(bars: DataFrame) -> DataFrame:
    """The bar contract: no row without a close; NaN is null."""
    prices = {c: F.nanvl(c, F.lit(None).cast("double")) for c in ("open", "high", "low", "close", "volume")}
    return bars.withColumns(prices).where(F.col("close").isNotNull()).select("symbol", "sector", "date", *prices)


def complete(bars: DataFrame) -> DataFrame:
    """Fill absent columns: open, high, low from the close, volume with 1."""
    have = set(bars.columns)
    more = {c: F.col("close") for c in ("open", "high", "low") if c not in have} | ({} if "volume" in have else {"volume": F.lit(1.0)})
    return bars.withColumns(more) if more else bars


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` replace those of equal (symbol, date)."""
    both = old.withColumn("fresh", F.lit(0)).unionByName(clean(new).withColumn("fresh", F.lit(1)))
    value = F.max_by(F.struct(*[c for c in old.columns if c not in ("symbol", "date")]), "fresh").alias("v")
    return both.groupBy("symbol", "date").agg(value).select("symbol", "date", "v.*").select(*old.columns)


def point_history(bars: DataFrame, symbol: str) -> DataFrame:
    return bars.where(F.col("symbol") == symbol).orderBy("date")


def stale_symbols(bars: DataFrame, cutoff: str) -> DataFrame:
    """Symbols whose history begins after the cutoff: those to fetch again."""
    return bars.groupBy("symbol").agg(F.min("date").alias("first_date")).where(F.col("first_date") >= F.to_date(F.lit(cutoff)))


def long_enough(bars: DataFrame, least: int = 300) -> DataFrame:
    """Bars of symbols with at least ``least`` of them."""
    names = bars.groupBy("symbol").count().where(F.col("count") >= least).select("symbol")
    return bars.join(names, "symbol", "left_semi")
