"""As-of (pad) join: each asked (symbol, date) gets that symbol's last bar at or before the date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pad(bars: DataFrame, asked: DataFrame, values: list[str], prefix: str = "") -> DataFrame:
    """``asked`` (symbol, date, ...) with the bar's date as ``<prefix>bar_date`` and its values; rows without a bar go.

    Both sides are one window: one exchange by symbol, no range join. All values come from the same bar.
    """
    extra = [c for c in asked.columns if c not in ("symbol", "date")]
    bar = F.struct(F.col("date").alias("bar_date"), *values)
    left = bars.select("symbol", "date", F.lit(0).alias("g"), bar.alias("bar"), F.lit(None).cast(asked.select(F.struct("date", *extra).alias("a")).schema["a"].dataType).alias("a"))
    right = asked.select("symbol", "date", F.lit(1).alias("g"), F.lit(None).cast(left.schema["bar"].dataType).alias("bar"), F.struct("date", *extra).alias("a"))
    # Spark 4.1 plans no exchange where both sides are exchanged by symbol, and then loses the union's partitioning if one of these exchanges
    # is reused: the window saw no bars. So the exchange is asked for; by ("symbol") alone it would be taken for one that is there already.
    order = Window.partitionBy("symbol").orderBy("date", "g").rowsBetween(Window.unboundedPreceding, 0)
    last = left.unionByName(right).repartition("symbol", "symbol").withColumn("p", F.last("bar", ignorenulls=True).over(order))
    found = last.where((F.col("g") == 1) & F.col("p").isNotNull())
    return found.select("symbol", "date", *[F.col(f"a.{c}").alias(c) for c in extra], F.col("p.bar_date").alias(f"{prefix}bar_date"), *[F.col(f"p.{v}").alias(f"{prefix}{v}") for v in values])
