"""Nearest neighbours by inner product with vantage-point trees, one tree for each shard.

With one more component that fills every vector to one norm, the largest inner product is the smallest Euclidean
distance, so the triangle inequality prunes. Each shard has a tree for each class of norms (a factor of two), scaled and filled
to the class's largest, so that outliers don't swamp the others. Leaves keep candidates by exact scores, ties by id. A node
holds a vantage point, the median distance to it, and two subtrees; a query skips the subtree whose distance bound, divided by
``factor``, exceeds its worst candidate. Factor 1 searches exactly; smaller factors skip more. A block of queries walks a tree
together, so the work is matrix products.

Every row lies in the tree of one shard. Points cross the network once; a shard's tree is built once, when its points have
come, and the queries stream through it in blocks. Only where there are fewer shards than task slots is a shard built in
several tasks, each for a part of the queries. The shards' best are merged. Equal vectors of a shard are one point with its
smallest ids, so a vector that a third of all rows hold costs one place.

Contract: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components take no
part. Scores are inner products of the original vectors in double precision, summed in order; ties go to the smaller
id. A query's own row, and any row of its id, is no candidate. Rows repeated under one id count once, by the first of their
vectors in order. Other columns of the input are ignored, so clashing names don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, scratch, stored

LEAF = 512
SHARD_ROWS = 16_384
BLOCK_ROWS = 1024
PART_ROWS = 128
#: Distances of points and queries are rounded; a subtree this little beyond the worst candidate is still visited.
SLACK = 1e-6
#: Pairs of a query and a point that are scored at once.
PAIRS = 1 << 16


def score(query: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Inner products, summed component by component, so that equal vectors get equal scores."""
    total = np.zeros(len(points))
    for k in range(points.shape[1]):
        total += query[..., k] * points[:, k]
    return total


class Tree:
    """A vantage-point tree over filled vectors."""

    def __init__(self, points: np.ndarray, seed: int = 1):
        self.points, self.nodes = points, []
        self.order = np.arange(len(points))
        self._grow(0, len(points), np.random.default_rng(seed))

    def _grow(self, lo: int, hi: int, g: np.random.Generator) -> int:
        me = len(self.nodes)
        self.nodes.append(None)
        if hi - lo <= LEAF:
            self.nodes[me] = (lo, hi)
            return me
        own = self.order[lo:hi].copy()  # the order changes below
        # Of a few vantage points, the one whose distances spread most.
        tries = g.choice(len(own), 4, replace=False)
        away = [np.sqrt(((self.points[own] - self.points[own[t]]) ** 2).sum(1)) for t in tries]
        best = int(np.argmax([d.std() for d in away]))
        d, half = away[best], (hi - lo) // 2
        by = np.argsort(d, kind="stable")
        self.order[lo:hi] = own[by]
        d = d[by]
        left, right = self._grow(lo, lo + half, g), self._grow(lo + half, hi, g)
        self.nodes[me] = (self.points[own[tries[best]]], d[0], d[half - 1], d[half], d[-1], left, right)
        return me

    def search(self, queries: np.ndarray, k: int, factor: float, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances and places of ``k`` nearest points; ``skip``: the place that each query leaves out, or -1.

        Ties within the slack are all kept up to ``k``; the caller ranks by exact scores.
        """
        n = len(queries)
        best, place = np.full((n, k), np.inf), np.full((n, k), -1)

        def take(own, who):
            p, q = self.points[own], queries[who]
            d = np.maximum((q * q).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * q @ p.T, 0)
            d[own[None] == skip[who][:, None]] = np.inf
            both = np.concatenate([best[who], d], 1)
            at = np.concatenate([place[who], np.broadcast_to(own, d.shape)], 1)
            k = best.shape[1]
            near = np.argpartition(both, k - 1, 1)[:, :k] if both.shape[1] > k else np.broadcast_to(np.arange(k), (len(who), k))
            best[who], place[who] = np.take_along_axis(both, near, 1), np.take_along_axis(at, near, 1)

        self.visit(queries, factor, lambda who: np.sqrt(best[who].max(1)), take)
        return best, place

    def visit(self, queries: np.ndarray, factor: float, worst, take) -> None:
        """Calls ``take(points, queries)`` for every leaf that may hold a point within ``worst(queries)``."""
        self._visit(0, np.arange(len(queries)), np.zeros(len(queries)), queries, factor, worst, take)

    def _visit(self, node, who, bound, queries, factor, worst, take):
        who = who[bound / factor <= worst(who) + SLACK] if factor > 0 else who
        if not len(who):
            return
        it = self.nodes[node]
        if len(it) == 2:
            take(self.order[it[0] : it[1]], who)
            return
        vantage, in_lo, in_hi, out_lo, out_hi, left, right = it
        d = np.sqrt(((queries[who] - vantage) ** 2).sum(1))
        sides = [(left, np.maximum(in_lo - d, d - in_hi)), (right, np.maximum(out_lo - d, d - out_hi))]
        nearer = sides[0][1] <= sides[1][1]
        for first in (True, False):
            for k, (child, gap) in enumerate(sides):
                mine = nearer == (first == (k == 0))
                if mine.any():
                    self._visit(child, who[mine], np.maximum(gap[mine], 0), queries, factor, worst, take)


def norms(v: np.ndarray) -> np.ndarray:
    largest = np.abs(v).max(1)
    return largest * np.sqrt(((v / largest[:, None]) ** 2).sum(1))


def filled(v: np.ndarray) -> np.ndarray:
    """Vectors of norm 1 at most, with the component that fills them to 1."""
    return np.concatenate([v, np.sqrt(np.maximum(1 - (v * v).sum(1), 0))[:, None]], 1)


class Shard:
    """The distinct vectors of one shard, and a tree for each class of their norms."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        ids, vectors = once(ids, vectors)
        self.points, own = np.unique(vectors, axis=0, return_inverse=True)
        by = np.argsort(own.ravel(), kind="stable")  # ids rise within each point
        self.ids = ids[by]
        self.counts = np.bincount(own.ravel(), minlength=len(self.points))
        self.starts = np.cumsum(self.counts) - self.counts
        self.least = self.ids[self.starts]
        length = norms(self.points)
        classes = np.frexp(length)[1]
        self.trees = []
        for c in np.unique(classes)[::-1]:
            mine = np.flatnonzero(classes == c)
            top = length[mine].max()
            scaled = self.points[mine] / top
            self.trees.append((mine, top, scaled, Tree(filled(scaled))))

    def best(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of the ``k`` points of the largest inner product for each query, ties by id; place -1 where there are fewer."""
        n, k = len(queries), min(k, len(self.points))
        best, place = np.full((n, k), -np.inf), np.full((n, k), -1)
        q_norm = norms(queries)
        unit = queries / q_norm[:, None]
        asked = np.concatenate([unit, np.zeros((n, 1))], 1)
        for mine, top, scaled, tree in self.trees:

            def least(who, top=top):
                """The scaled score that a point must reach."""
                return best[who].min(1) / (q_norm[who] * top)

            def worst(who, least=least):
                return np.sqrt(np.maximum(2 - 2 * least(who), 0))

            def take(own, who, mine=mine, scaled=scaled, least=least):
                near = unit[who] @ scaled[own].T
                bar = least(who)
                if len(own) > k:
                    bar = np.maximum(bar, np.partition(near, len(own) - k, 1)[:, len(own) - k])
                i, j = np.nonzero(near >= bar[:, None] - SLACK)  # rounding is far below the slack
                if not len(i):
                    return
                at, q = mine[own[j]], who[i]
                got = np.concatenate([score(queries[q[lo : lo + PAIRS]], self.points[at[lo : lo + PAIRS]]) for lo in range(0, len(q), PAIRS)])
                some = np.unique(q)
                q, got, at = np.concatenate([np.repeat(some, k), q]), np.concatenate([best[some].ravel(), got]), np.concatenate([place[some].ravel(), at])
                by = np.lexsort((np.where(at < 0, 0, self.least[at]), -got, q))
                q, got, at = q[by], got[by], at[by]
                rank = np.arange(len(q)) - np.searchsorted(q, q, "left")
                keep = rank < k
                best[some], place[some] = got[keep].reshape(-1, k), at[keep].reshape(-1, k)

            tree.visit(asked, factor, worst, take)
        return best, place

    def nearest(self, q_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> pa.RecordBatch:
        """(query_id, id, score) of each query's ``k`` nearest rows of other ids."""
        # One point more than asked for, as the query itself may be among them.
        scores, places = self.best(queries, k + 1, factor)
        out = ([], [], [])
        for q, place, s in zip(q_ids.tolist(), places, scores, strict=True):
            near = [(-x, c) for p, x in zip(place.tolist(), s.tolist(), strict=True) if p >= 0 for c in self.ids[self.starts[p] : self.starts[p] + min(self.counts[p], k + 1)].tolist() if c != q]
            near = sorted(near)[:k]
            out[0].extend([q] * len(near))
            out[1].extend(c for _, c in near)
            out[2].extend(-x for x, _ in near)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "id", "score"])


def once(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by rising id; of several under one id, the first vector in order."""
    by = np.argsort(ids, kind="stable")
    ids, vectors = ids[by], vectors[by]
    fresh = np.diff(ids, prepend=ids[:1] - 1) != 0
    if fresh.all():
        return ids, vectors
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], len(ids))
    pick = [lo if hi - lo == 1 else lo + min(range(hi - lo), key=lambda i, lo=lo: vectors[lo + i].tolist()) for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True)]
    return ids[pick], vectors[pick]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the vectors that take part."""
    v = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("v")).where("id is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, is_query, k: int = 20, factor: float = 1.0, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) for every row where ``is_query``, against all other rows."""
    spark = prepare(vectors.sparkSession)
    work = scratch(spark)
    stats = usable(vectors, id_col, vector_col).groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    schema = "query_id bigint, rank int, id bigint, score double"
    if stats is None:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    dim, shards = stats["dim"], max(1, math.ceil(stats["n"] / shard_rows))
    rows = usable(vectors, id_col, vector_col).where(F.size("v") == dim)
    asked = usable(vectors.where(is_query), id_col, vector_col).where(F.size("v") == dim).groupBy("id").agg(F.min("v").alias("v"))
    # Points are copied only as far as task slots are free and each copy has PART_ROWS queries to answer.
    ways = max(1, min(-(-spark.sparkContext.defaultParallelism // shards), asked.count() // PART_ROWS))

    def every(n: int, step: int = 1):
        return F.explode(F.sequence(F.lit(0), F.lit((n - 1) * step), F.lit(step)))

    # A slot is a shard, or a shard for one part of the queries.
    own = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int") * ways
    points = rows.select(own.alias("shard"), every(ways).alias("part"), "id", "v").select((F.col("shard") + F.col("part")).alias("slot"), F.lit(0).alias("kind"), "id", "v")
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(ways)).cast("int")
    asked = asked.select("id", "v", part.alias("part"), every(shards, ways).alias("shard")).select((F.col("shard") + F.col("part")).alias("slot"), F.lit(1).alias("kind"), "id", "v")

    def stack(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate([p.column(2).to_numpy() for p in parts])
        return ids, np.concatenate([p.column(3).flatten().to_numpy() for p in parts]).astype(np.float64).reshape(-1, dim)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by slot, its points before its queries; only one shard and one block of queries are held."""
        at, points, shard, block, n = None, [], None, [], 0

        def answered():
            return shard.nearest(*stack(block), k, factor)

        for b in batches:
            slot, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            code = slot.astype(np.int64) * 2 + kind
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if slot[lo] != at:
                    if block and shard:
                        yield answered()
                    at, points, shard, block, n = slot[lo], [], None, [], 0
                if kind[lo] == 0:
                    points.append(b.slice(lo, hi - lo))
                    continue
                if points:
                    shard, points = Shard(*stack(points)), []
                while lo < hi:
                    part = b.slice(lo, min(hi - lo, BLOCK_ROWS - n))
                    block.append(part)
                    lo, n = lo + part.num_rows, n + part.num_rows
                    if n == BLOCK_ROWS:
                        if shard:
                            yield answered()
                        block, n = [], 0
        if block and shard:
            yield answered()

    dealt = points.unionByName(asked).repartition(shards * ways, "slot").sortWithinPartitions("slot", "kind")
    parts = stored(dealt.mapInArrow(search, "query_id bigint, id bigint, score double"), f"{work}/parts")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
