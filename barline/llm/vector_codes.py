"""Vector code compression: product codes by filtering Lloyd rounds over kd-trees.

Components become integers floor(scale * x), and each vector is cut into equal parts with a codebook each. Tasks put their vectors
into blocks, build one balanced kd-tree a block and part, and store the points in tree order with every node's box and sum. These
trees are built once and read in every round. A round walks each tree level by level with the codebook as candidates: at a node, the
entry nearest to the middle of the box beats every candidate that is farther from all of the box (the difference of two squared
distances is linear in the point, so its least value over a box is exact), and a node with one candidate left goes to it whole, by
its cached sum and count. Only leaves that keep several candidates look at their points.

All distances are exact integers: in doubles while components stay below 2^21, in 64-bit integers below 2^27. Beyond, a squared error
needn't fit the result's 64 bits, and a ValueError says so. The driver gets codebooks, and one sum for each entry and component.

Contract: rows whose vector is null, or holds null or non-finite components, take no part; zero vectors do. Nor do vectors of another
length than the vector of the smallest id, or empty ones; a length that can't be cut into equal parts is a ValueError. Repeated rows
and ids are rows of their own. Starting entries are the rows of the smallest ids (ties: by vector; null ids last), fewer if there are
fewer. Ties in distance go to the lower entry. Null labels are one label. Other columns are ignored. No vectors, no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, join_hot, prepare, scratch, stored

BLOCK, LEAF = 2048, 32
#: Row groups of the stored trees are cut at this size (looked at every 100 blocks), so a reader's batch stays small.
ROW_GROUP_BYTES = 16 << 20
EXACT_IN_DOUBLE, EXACT_IN_LONG = 1 << 21, 1 << 27
#: Pairs of a node and an entry whose bounds are computed together.
PAIRS_AT_ONCE = 1 << 14


class Tree:
    """A balanced kd-tree over integer points: ``order`` puts them in tree order, level l has 2^l nodes over equal runs of it."""

    def __init__(self, order: np.ndarray, points: np.ndarray, lo: np.ndarray, hi: np.ndarray, sums: np.ndarray):
        self.order, self.points, self.lo, self.hi, self.sums = order, points, lo, hi, sums
        self.depth = (len(lo) + 1).bit_length() - 2

    @classmethod
    def built(cls, points: np.ndarray) -> Tree:
        n = len(points)
        depth, order = max(0, (n // LEAF).bit_length() - 1), np.arange(n)
        for level in range(depth):
            starts = bounds(n, level)
            for i in range(1 << level):
                run = order[starts[i] : starts[i + 1]]
                part, half = points[run], ((2 * i + 1) * n >> level + 1) - starts[i]
                widest = int((part.max(0) - part.min(0)).argmax())
                order[starts[i] : starts[i + 1]] = run[np.argpartition(part[:, widest], half)]
        points = points[order]
        starts = bounds(n, depth)[:-1]
        levels = [(np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts), np.add.reduceat(points, starts))]
        for _ in range(depth):  # a node has what its two children have
            lo, hi, sums = levels[0]
            levels.insert(0, (np.minimum(lo[::2], lo[1::2]), np.maximum(hi[::2], hi[1::2]), sums[::2] + sums[1::2]))
        return cls(order, points, *(np.concatenate(x) for x in zip(*levels, strict=True)))

    def packed(self) -> dict:
        whole = {"points": self.points.astype(np.int32), "box_lo": self.lo.astype(np.int32), "box_hi": self.hi.astype(np.int32), "sums": self.sums.astype(np.int64), "ordered": self.order.astype(np.int32)}
        return {k: v.tobytes() for k, v in whole.items()}

    @classmethod
    def read(cls, x: dict, width: int, kind: type) -> Tree:
        wide = lambda name, of=np.int32: np.frombuffer(x[name], of).reshape(-1, width).astype(kind)
        return cls(np.frombuffer(x["ordered"], np.int32), wide("points"), wide("box_lo"), wide("box_hi"), wide("sums", np.int64))

    def dealt(self, book: np.ndarray) -> Iterator[tuple[np.ndarray | int, np.ndarray | slice, np.ndarray | None]]:
        """Runs of points that go to an entry: (entry or entries, places in tree order, the sum if it is cached), all points once."""
        n, at, alive = len(self.points), np.zeros(1, np.int64), np.ones((1, len(book)), bool)
        for level in range(self.depth + 1):
            starts, base = bounds(n, level), (1 << level) - 1
            step = max(1, PAIRS_AT_ONCE // len(book))
            for k in range(0, len(at), step):
                alive[k : k + step] &= closest(book, self.lo[base + at[k : k + step]], self.hi[base + at[k : k + step]], alive[k : k + step])
            single = alive.sum(1) == 1
            for i, entry in zip(at[single], alive[single].argmax(1), strict=True):
                yield int(entry), slice(starts[i], starts[i + 1]), self.sums[base + i]
            at, alive = at[~single], alive[~single]
            if level < self.depth:
                at, alive = np.stack([2 * at, 2 * at + 1], 1).ravel(), np.repeat(alive, 2, 0)
        for i, left in zip(at, alive, strict=True):
            entries, run = np.flatnonzero(left), slice(starts[i], starts[i + 1])
            yield entries[nearest(self.points[run], book[entries])], run, None

    def sums_by_entry(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and count of the points that are nearest to each entry."""
        sums, counts = np.zeros(book.shape, self.points.dtype), np.zeros(len(book), np.int64)
        for entry, run, cached in self.dealt(book):
            if cached is None:
                np.add.at(sums, entry, self.points[run])
                counts += np.bincount(entry, minlength=len(book))
            else:
                sums[entry] += cached
                counts[entry] += run.stop - run.start
        return sums, counts

    def codes(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each point, in the points' first order."""
        code, error = np.empty(len(self.points), np.int64), np.empty(len(self.points), np.int64)
        for entry, run, _ in self.dealt(book):
            code[run] = entry
        back = np.empty_like(code)
        gap = self.points - book[code]
        error[self.order], back[self.order] = (gap * gap).sum(1).astype(np.int64), code
        return back, error


def bounds(n: int, level: int) -> np.ndarray:
    """Where the runs of a level begin; one more for the end. The children of run i are the runs 2i and 2i + 1 of the next level."""
    return np.arange((1 << level) + 1) * n >> level


def closest(book: np.ndarray, lo: np.ndarray, hi: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Which candidates may be the nearest entry of some point in the box; ties go to the lower entry."""
    far = ((2 * book - (lo + hi)[:, None]) ** 2).sum(2)
    best = np.where(alive, far, np.inf if far.dtype == float else np.iinfo(far.dtype).max).argmin(1)
    gap = book - book[best][:, None]
    # |c - p|^2 - |b - p|^2 = (c - b)(c + b - 2p): least where p is at the end of the box toward c.
    least = (gap * (book + book[best][:, None] - 2 * np.where(gap > 0, hi[:, None], lo[:, None]))).sum(2)
    return (least < 0) | ((least == 0) & (np.arange(len(book)) <= best[:, None]))


def nearest(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Place of each point's nearest entry, the first of equals."""
    return ((entries**2).sum(1) - 2 * (points @ entries.T)).argmin(1)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def blocks(rows: DataFrame, parts: int, kinds: tuple[str, str]) -> DataFrame:
    """One row for each block of up to BLOCK vectors: ids, labels, and a packed tree for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BLOCK:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        whole = t.column("whole").combine_chunks()
        points = whole.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(whole), -1)
        trees = [Tree.built(x).packed() for x in np.split(points, parts, 1)]
        return pa.RecordBatch.from_pylist([{"ids": t.column("id").to_pylist(), "labels": t.column("label").to_pylist(), "trees": trees}], schema)

    schema = pa.schema([("ids", pa.list_(rows_type(rows, "id"))), ("labels", pa.list_(rows_type(rows, "label"))), ("trees", pa.list_(pa.struct([(k, pa.binary()) for k in PACKED])))])
    return rows.mapInArrow(run, f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, trees array<struct<{', '.join(f'{k}: binary' for k in PACKED)}>>")


PACKED = ("points", "box_lo", "box_hi", "sums", "ordered")


def rows_type(rows: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema[name].dataType)


def lloyd_sums(trees: DataFrame, books: list[np.ndarray], kind: type) -> DataFrame:
    """(part, entry, n, sums): what each task's points add up to, by the entry that they are nearest to."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for b in batches:
            for row in b.column("trees").to_pylist():
                for k, x in enumerate(row):
                    s, n = Tree.read(x, width, kind).sums_by_entry(books[k].astype(kind))
                    sums[k] += s.astype(np.int64)
                    counts[k] += n
        used = [(k, e) for k in range(len(books)) for e in np.flatnonzero(counts[k])]
        if used:
            yield pa.RecordBatch.from_pydict({"part": [k for k, _ in used], "entry": [int(e) for _, e in used], "n": [int(counts[k][e]) for k, e in used], "sums": [sums[k][e].tolist() for k, e in used]}, SUMS)

    added = [F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(width)]
    return trees.mapInArrow(run, "part int, entry int, n long, sums array<long>").groupBy("part", "entry").agg(F.sum("n").alias("n"), *added)


SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def assigned(trees: DataFrame, books: list[np.ndarray], kind: type, kinds: tuple[str, str]) -> DataFrame:
    """(id, label, code, error) of every vector: entries in hexadecimal, as many digits a part as the largest needs."""
    width, digits = books[0].shape[1], max(2, len(f"{len(books[0]) - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids, labels = b.column("ids")[k].values, b.column("labels")[k].values
                found = [Tree.read(x, width, kind).codes(book.astype(kind)) for x, book in zip(b.column("trees")[k].as_py(), books, strict=True)]
                code = ["".join(f"{c:0{digits}x}" for c in row) for row in zip(*(c.tolist() for c, _ in found), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code), pa.array(sum(e for _, e in found))], ["id", "label", "code", "error"])

    return trees.mapInArrow(run, f"id {kinds[0]}, label {kinds[1]}, code string, error long")


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every vector that takes part."""
    spark, work = prepare(vectors.sparkSession), scratch(vectors.sparkSession)
    kinds = (dict(vectors.dtypes)[id_col], dict(vectors.dtypes)[label_col])
    out_id, code, error, label_error, digest = (id_col, *fresh(vectors.select(id_col), "code", "error", "label_error", "codebooks_sha256"))
    kept = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).where(usable(F.col("vector")))
    first = kept.select("id", "vector").orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    if not first:
        return spark.createDataFrame([], f"`{out_id}` {kinds[0]}, {code} string, {error} long, {label_error} long, {digest} string")
    length = len(first[0].vector)
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    ours = kept.where(F.size("vector") == length).select("id", "label", F.transform("vector", lambda x: F.floor(x.cast("double") * scale)).alias("whole"))
    most = ours.agg(F.max(F.greatest(F.array_max("whole"), -(F.array_min("whole") + 1)))).first()[0]
    if most >= EXACT_IN_LONG:
        raise ValueError(f"a component of {most} is too large for exact squared distances in 64 bits")
    kind = np.float64 if most < EXACT_IN_DOUBLE else np.int64
    start = np.array([[int(np.floor(float(x) * scale)) for x in r.vector] for r in first if len(r.vector) == length], np.int64)
    books = np.split(start, parts, 1)
    trees = stored(blocks(ours, parts, kinds), f"{work}/trees", **{"parquet.block.size": str(ROW_GROUP_BYTES)})
    for _ in range(rounds):
        for r in lloyd_sums(trees, books, kind).collect():  # one row for each entry
            books[r.part][r.entry] = [r[f"s{d}"] // r.n for d in range(length // parts)]
    text = ",".join(str(x) for b in books for x in b.ravel().tolist())
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))
    done = stored(assigned(trees, books, kind, kinds).withColumn("key", key).drop("label"), f"{work}/codes")
    by_label = stored(done.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), f"{work}/labels")
    named = join_hot(done, by_label, "key").select(F.col("id").alias(out_id), F.col("code").alias(code), F.col("error").alias(error), F.col("label_error").alias(label_error))
    return named.withColumn(digest, F.lit(hashlib.sha256(text.encode()).hexdigest()))
