"""Connected groups of linked names, by rounds of joins: nothing but a count reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import held


def components(pairs: DataFrame) -> DataFrame:
    """(symbol, head) for every name of the pairs (a, b): the first name that links reach.

    Each round gives a name the least head among itself and its neighbours, and then that head's own head, so that the paths to the
    first name shorten from both ends. Rounds end when no head changes.
    """
    both = pairs.select("a", "b").where("a <> b")
    links = held(both.union(both.select("b", "a")).distinct())
    heads = held(links.select(F.col("a").alias("symbol")).distinct().withColumn("head", F.col("symbol")))
    while True:
        near = links.join(heads.withColumnRenamed("symbol", "b"), "b").groupBy(F.col("a").alias("symbol")).agg(F.min("head").alias("near"))
        least = heads.join(near, "symbol").select("symbol", "head", F.least("head", "near").alias("next"))
        jump = heads.select(F.col("symbol").alias("next"), F.col("head").alias("beyond"))
        moved = held(least.join(jump, "next").select("symbol", F.least("next", "beyond").alias("head"), (F.least("next", "beyond") < F.col("head")).alias("moved")))
        heads = moved.select("symbol", "head")
        if moved.where("moved").isEmpty():
            return heads
