"""Filter interaction audit: what each filter removes in each order, from the edges of the lattice of applied filters.

A document's failures are one mask. Standing at a subset of applied filters, the next filter removes it, keeps it, or finds it
gone already; so every document says something about each of the 5 x 16 = 80 edges (subset, next filter). Documents of equal
(part, mask, labels) say the same, so they are counted first and the counts go to the edges. An order is a path through the
lattice: its five steps are five edges, joined from a table of 600 rows. A filter's Shapley sum needs no orders: the edge that
leaves a subset of k filters lies on k! (4 - k)! paths.

Only the mask, the labels and a digest of each text are shuffled. Whether a smaller id has the same text is found from the
least id of each digest (combined before the shuffle) and joined by id and digest, which no hot text can fill.

Contract: null text counts as empty, and equals an empty text; null source is the part ''. A null id is smaller than no id and
has no smaller one, so such rows never fail E. Rows that share an id are rows of their own; the copies under the least id all
pass E. Repeated labels of an id count as good (toxic) if any row says so; null labels and ids without labels say neither.
Other columns are ignored. No documents, no rows.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
SUMS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(text: Column) -> dict[str, Column]:
    """The conditions of a text alone; a document fails a filter where its column is true."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, capitals = F.size(words), F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 50, "B": F.size(F.array_distinct(words)) * 100 < n * 65, "C": capitals * 100 > F.length(text) * 5, "D": text.rlike(r"[#$%&*|]")}


def judged(docs: DataFrame) -> DataFrame:
    """(id, part, mask): bit k of the mask is set if the document fails the k-th filter."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = sum((F.when(bad, 1 << FILTERS.index(f)).otherwise(0) for f, bad in failures(text).items()), F.lit(0))
    seen = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), own.alias("own"), F.unhex(F.sha2(text, 256)).alias("digest"))
    first = seen.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    copy = F.col("is_first").isNull() & F.col("id").isNotNull()
    return seen.join(first, ["id", "digest"], "left").select("id", "part", (F.col("own") + F.when(copy, 16).otherwise(0)).alias("mask"))


def profiles(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): all that the lattice needs of the documents, at most 128 rows a part."""
    said = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    marks = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")]
    return judged(docs).join(said, "id", "left").select("part", "mask", *marks).groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))


def edges(profile: DataFrame) -> DataFrame:
    """(part, applied, filter, sums, share): one row for each part and edge; ``share`` is ``removed`` times the paths through the edge."""
    k = range(len(FILTERS))
    every = [(s, f, factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())) for f in k for s in range(1 << len(FILTERS)) if not s >> f & 1]
    edge = F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next"), F.lit(w).cast("long").alias("paths")) for s, f, w in every]))
    at = profile.select("*", edge.alias("e")).select("*", "e.*").withColumn("bit", F.expr("shiftleft(1, next)"))
    gone, fails = F.expr("mask & applied") != 0, F.expr("mask & bit") != 0
    lost = ~gone & fails
    counted = {
        "kept": ~gone & ~fails, "removed": lost, "redundant": gone & fails, "unique_fails": F.col("mask") == F.col("bit"),
        "good_lost": lost & F.col("good"), "toxic_lost": lost & F.col("toxic"),
    }
    sums = [F.sum(F.when(when, F.col("n")).otherwise(0)).alias(c) for c, when in counted.items()]
    return at.groupBy("part", "applied", "next", "paths").agg(*sums).withColumn("share", F.col("removed") * F.col("paths"))


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, filters applied before, filter): 120 paths of five edges."""
    out = []
    for order in permutations(range(len(FILTERS))):
        for k, f in enumerate(order):
            out.append(("".join(FILTERS[x] for x in order), k + 1, sum(1 << x for x in order[:k]), f))
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part."""
    lattice = edges(profiles(docs, labels))
    shapley = lattice.groupBy("part", "next").agg(F.sum("share").alias("shapley"))
    paths = docs.sparkSession.createDataFrame(steps(), "filter_order string, step int, applied int, next int")
    on_paths = lattice.join(shapley, ["part", "next"]).join(F.broadcast(paths), ["applied", "next"])
    return on_paths.select("part", "filter_order", "step", *SUMS, "shapley")
