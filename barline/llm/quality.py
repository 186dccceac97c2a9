"""Quality classifier: supervised subword embeddings.

A text is a bag of hashed features: words, pairs of neighbouring words (all pairs of a word with itself count as one
feature, so repetition is learned in general) and character n-grams within words. Each feature has a learned vector; a document is the mean
of its features' vectors, and a softmax over that gives the label's probability. Training is stochastic gradient descent
in numpy over a bounded sample of labelled rows, whose features are hashed on the executors.

Contract: null text counts as empty; a text without features gets the learned bias alone. Rows stay one for one, repeated and
null ids included. If no labelled row can be learned from, every score is 0.5. Labels, language, source and ids are never inputs
of a score. A text of any length is read whole, in pieces. Other columns are ignored, so clashing names don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, mix, pieces, prepare, raw, slices, words

BUCKETS = 1 << 15
DIMS = 8
GRAMS = (3, 5)
#: Bytes of text whose features are held at once.
PIECE = 1 << 18
REPEAT = BUCKETS - 1


@dataclass
class Model:
    vectors: np.ndarray  # (BUCKETS, DIMS)
    out: np.ndarray  # (DIMS, 2)
    bias: np.ndarray  # (2,)


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h ^ np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(REPEAT)).astype(np.int32)


def features(buf: np.ndarray, off: np.ndarray):
    """Bucket and row of every feature occurrence of the rows, in parts of a bounded size: long texts come in pieces."""
    before, before_row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for lo, hi in pieces(buf, PIECE):
        part, at = buf[lo:hi], np.clip(off - lo, 0, hi - lo)
        h, row, start, end = words(part, at)
        if not len(h):
            continue
        yield _bucket(h, 1), row
        both, both_row = np.concatenate([before, h]), np.concatenate([before_row, row])
        same = both_row[:-1] == both_row[1:]
        pair = _bucket(both[:-1] * np.uint64(3) + both[1:], 2)
        pair[both[:-1] == both[1:]] = REPEAT
        yield pair[same], both_row[1:][same]
        before, before_row = h[-1:], row[-1:]
        yield from grams(part, row, start, end)


def grams(buf: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Bucket and row of the character n-grams within words."""
    size = end - start
    at = np.cumsum(size) - size
    solid = buf[np.repeat(start - at, size) + np.arange(size.sum())]
    lead = np.flatnonzero((solid & 0xC0) != 0x80)
    word = np.repeat(np.arange(len(start)), size)[lead]
    stop = np.append(lead[1:], len(solid))
    power, back = _powers(1 << int(len(solid)).bit_length())
    sums = np.concatenate([[np.uint64(0)], np.cumsum((solid + np.uint64(1)) * power[: len(solid)])])
    for n in GRAMS:
        m = len(lead) - n + 1
        if m > 0:
            inside = np.flatnonzero(word[:m] == word[n - 1 : n - 1 + m])
            first = lead[inside]
            code = (sums[stop[inside + n - 1]] - sums[first]) * back[first]
            yield _bucket(code, n + 2), row[word[inside]]


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse: the hash of any range of bytes is then a difference of running sums."""
    base = 0xD6E8FEB86659FD93
    return tuple(np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(b))])) for b in (base, pow(base, -1, 1 << 64)))


def means(model: Model, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, DIMS): the mean vector of each row's features."""
    n = len(off) - 1
    total, count = np.zeros((n, DIMS)), np.zeros(n)
    for ids, rows in features(buf, off):
        if not len(ids):
            continue
        # The rows come in order, so each one's vectors are one range.
        v = np.take(model.vectors, ids, 0)
        first = np.concatenate([[0], np.flatnonzero(rows[1:] != rows[:-1]) + 1])
        total[rows[first]] += np.add.reduceat(v, first)
        count += np.bincount(rows, minlength=n)
    return total / np.maximum(count, 1)[:, None]


def probability(model: Model, mean: np.ndarray) -> np.ndarray:
    z = mean @ model.out + model.bias
    return 1 / (1 + np.exp(z[:, 0] - z[:, 1]))


def train(bags: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.5, seed: int = 5) -> Model:
    """``bags``: distinct buckets and their shares, for each document. AdaGrad steps over mini-batches."""
    g = np.random.default_rng(seed)
    model = Model(g.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32), np.zeros((DIMS, 2)), np.zeros(2))
    model.out[:, 1] = g.normal(0, 0.1, DIMS)
    seen = [np.full_like(p, 1e-4) for p in (model.vectors, model.out, model.bias)]
    for _ in range(epochs):
        order = g.permutation(len(bags))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            ids = np.concatenate([bags[i][0] for i in pick])
            share = np.concatenate([bags[i][1] for i in pick])
            row = np.repeat(np.arange(len(pick)), [len(bags[i][0]) for i in pick])
            v = model.vectors[ids] * share[:, None]
            mean = np.stack([np.bincount(row, v[:, d], len(pick)) for d in range(DIMS)], 1)
            p = probability(model, mean)
            d = np.stack([(1 - p) - (1 - target[pick]), p - target[pick]], 1) / len(pick)
            d_mean = d @ model.out.T
            touched, inverse = np.unique(ids, return_inverse=True)
            part = d_mean[row] * share[:, None]
            grad = np.stack([np.bincount(inverse, part[:, k], len(touched)) for k in range(DIMS)], 1)
            seen[0][touched] += grad * grad
            model.vectors[touched] -= rate * grad / np.sqrt(seen[0][touched])
            for param, acc, gr in ((model.out, seen[1], mean.T @ d), (model.bias, seen[2], d.sum(0))):
                acc += gr * gr
                param -= rate * gr / np.sqrt(acc)
    return model


def fit(docs: DataFrame, labels: DataFrame, learn, label_col: str = "quality", sample: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Train on at most about ``sample`` labelled rows where ``learn`` holds, drawn by a hash of the id.

    The bound holds for the driver: it gets the hashed features of the sample, at most BUCKETS for a row.
    """
    prepare(docs.sparkSession)
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    ids = docs.where(learn).select(docs[id_col].alias("id"))
    n = ids.join(marks, "id").count()
    if not n:
        return None
    draw = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / n))
    # About ``sample`` ids and labels, so they may be broadcast; no text of another row is hashed.
    chosen = F.broadcast(ids.where(draw).join(marks, "id").select("id", "label").distinct())
    drawn = docs.where(learn).select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(chosen, "id").select("id", "label", "text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        buf, off = raw(b.column(2))
        ids, shares = [], []
        for lo in range(b.num_rows):
            count = np.zeros(BUCKETS, np.int64)
            for own, _ in features(buf[off[lo] : off[lo + 1]], np.array([0, off[lo + 1] - off[lo]])):
                count += np.bincount(own, minlength=BUCKETS)
            got = np.flatnonzero(count)
            ids.append(got.astype(np.int32))
            shares.append((count[got] / max(1, count.sum())).astype(np.float32))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32())), b.column(1)], ["id", "ids", "shares", "label"])

    got = map_arrow(drawn, run, f"id {dict(docs.dtypes)[id_col]}, ids array<int>, shares array<float>, label {dict(marks.dtypes)['label']}")
    # A large sample comes as Arrow, so that the JVM driver holds no row objects.
    rows = got.orderBy("id").limit(2 * sample).select("ids", "shares", "label").toArrow()
    unpacked = [rows.column(k).combine_chunks() for k in range(2)]
    at = unpacked[0].offsets.to_numpy()
    flat = [u.values.to_numpy() for u in unpacked]
    bags = [(flat[0][a:b], flat[1][a:b]) for a, b in zip(at, at[1:], strict=False)]
    return train(bags, rows.column(2).to_numpy().astype(np.float64)) if bags else None


def score(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The columns ``keep`` with score and predicted (1 if the score reaches ``threshold``)."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rest, texts = [b.column(i) for i in range(b.num_columns - 1)], b.column(b.num_columns - 1)
        if shared.value is None:
            got = np.full(b.num_rows, 0.5)
        else:
            buf, off = raw(texts)
            got = np.concatenate([probability(shared.value, means(shared.value, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])) for lo, hi in slices(off, PIECE)])
        return pa.RecordBatch.from_arrays([*rest, pa.array(got, pa.float64())], [*b.schema.names[:-1], "score"])

    picked = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs[text_col].alias("text"))
    schema = "".join(f"k{i} {dict(docs.dtypes)[c]}, " for i, c in enumerate(keep)) + "score double"
    got = map_arrow(picked, run, schema)
    return got.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
