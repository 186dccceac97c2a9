"""Connected components of an edge table, by alternating star contractions. Nothing is collected; each round is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, stored


def components(edges: DataFrame, work: str) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) reaches. Needs O(log n) rounds."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{work}/round0")
    step, before = 0, None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.when(F.col("b") > F.col("a"), 1)).alias("n")).where("n > 0"), f"{work}/least{step}")
        # Large star: every larger neighbour is hung on the node's least neighbour. A centre's many edges are dealt evenly.
        large = join_hot(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: every smaller neighbour, and the node itself, likewise. After the large star a node has few smaller ones.
        large = stored(large, f"{work}/large{step}")
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        step += 1
        now = stored(small, f"{work}/round{step}")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
