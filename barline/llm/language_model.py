"""A hashed maximum-entropy language model with a class-factored softmax.

The words of the dictionary are dealt by frequency: the commonest to CLASSES - 1 classes of SLOTS words, all others to a tail class
that is cut twice more, into groups of groups of SLOTS words. The probability of a token is that of its class given hashed features of
the two tokens before it (the previous one, the one before it, both), times that of its place in each softmax of SLOTS outcomes on the
way to it, given features of its own: one for a common word, three for another word of the dictionary. Every word of the dictionary is
so predicted from context. Words outside it are the last outcome of the tail, and share it by their smoothed counts. So the model is a
distribution over all words, unseen ones included.

Corpus counts cover every training token. The weights start at the unigram model and are trained in rounds, each over
another part of the training texts (dealt by a hash of the text), so every token makes one gradient step: each task makes steps
on all of the round's tokens that it has, from the shared weights, and the changes are averaged by weight row, by the number
of steps that touched it. Texts are scored in batches of numpy gathers. Counts of
the DICTIONARY most frequent words go to every task; those of rarer ones are joined.

Contract: null text counts as empty, which is one end token. Rows stay one for one, repeated ids included; a null id is held
out. Without training rows every token has the same smoothed base probability. Words are compared by 64-bit hashes. Very long
texts are hashed in pieces and scored in blocks. Other columns are ignored, so clashing names don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, mix, prepare, raw, remainder, scratch, slices, stored, words

CLASSES, SLOTS = 32, 64
ROWS = 4096
HEAD = (CLASSES - 1) * SLOTS
#: The words that have a place, and whose counts every task holds: at 24 bytes each, 6 MB. The tail's last outcome is left for all others.
DICTIONARY = HEAD + (SLOTS - 1) * SLOTS * SLOTS
#: Softmaxes of SLOTS outcomes: those of the head's classes, the tail, its groups, and their groups.
TAIL = CLASSES - 1
GROUPS = TAIL + 1
LEAVES = GROUPS + SLOTS - 1
NODES = LEAVES + (SLOTS - 1) * SLOTS
END, BEGIN = np.uint64(0x1234567), np.uint64(0x7654321)
COUNTS_AT_ONCE = 1 << 20
#: Leading bits of a hash that lead to its place in the dictionary: an index of 4 MB in every task.
FIRST_BITS = 20
BATCH = 1024
#: Logits within this range need no shift before they are raised to powers.
SAFE = 60.0
#: Steps of a batch that touch one weight row are added up one by one over all rows to here, the rest of a row's at once.
SINGLY = 8
BLOCK = 64
UNUSED = -30.0


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of the tokens of all rows: the words, then one end each."""
    h, row, _, _ = words(buf, off)
    n = len(off) - 1
    size = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
    out = np.full(len(h) + n, END, np.uint64)
    out[np.arange(len(h)) + row] = h
    return out, np.repeat(np.arange(n), size + 1)


def count_table(texts: DataFrame) -> DataFrame:
    """(h, c): how often each token occurs in the column ``text``."""

    def run(batches):
        held, n = [], 0

        def sums() -> pa.RecordBatch:
            got, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

        for b in batches:
            buf, off = raw(b.column(0))
            for lo, hi in slices(off):
                held.append(tokens(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])[0])
                n += len(held[-1])
                if n >= COUNTS_AT_ONCE:
                    yield sums()
                    held, n = [], 0
        if held:
            yield sums()

    return texts.mapInArrow(run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The dictionary, sorted by hash, with counts and places by frequency (-1: outside); totals of the corpus."""

    h: np.ndarray
    c: np.ndarray
    place: np.ndarray
    total: int
    types: int
    rest: float  # smoothed count of all words outside the dictionary

    def __post_init__(self):
        """Where the hashes of each leading FIRST_BITS bits begin, and how many share these at most: few, as they are hashes."""
        edges = np.searchsorted(self.h, np.arange(1 << FIRST_BITS, dtype=np.uint64) << np.uint64(64 - FIRST_BITS))
        self.begin = edges.astype(np.int32)
        self.longest = int(np.diff(edges, append=len(self.h)).max())

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's entry, and whether the dictionary has it; the dictionary isn't empty."""
        at, last = self.begin[h >> np.uint64(64 - FIRST_BITS)], len(self.h) - 1
        np.minimum(at, last, out=at)
        got = np.take(self.h, at)
        for _ in range(self.longest):
            later = np.flatnonzero(got < h)
            later = later[at[later] < last]
            if not len(later):
                break
            at[later] += 1
            got[later] = self.h[at[later]]
        return at, got == h

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and place of each token; count -1 where the dictionary hasn't it."""
        if not len(self.h):
            return np.full(len(h), -1), np.full(len(h), -1)
        at, known = self.find(h)
        return np.where(known, self.c[at], -1), np.where(known, self.place[at], -1)


def vocabulary(counts: DataFrame, size: int = DICTIONARY) -> tuple[Vocabulary, int]:
    """The dictionary and the count that its words reach at least; ``size`` bounds what the driver gets."""
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    steps = sorted(((r["k"], r["n"]) for r in counts.groupBy(F.least("c", F.lit(1_000_000)).alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("k")).limit(200_000).collect()), reverse=True)
    least, held = 1_000_001, 0
    for k, n in steps:
        if held + n > size:
            break
        least, held = k, held + n
    rows = counts.where(F.col("c") >= least).toArrow()
    h = rows.column("h").to_numpy().view(np.uint64)
    c = rows.column("c").to_numpy()
    by = np.lexsort((h, -c))
    place = np.empty(len(h), np.int64)
    place[by] = np.arange(len(h))
    order = np.argsort(h)
    rest = float(total - c.sum()) + 0.1 * (types - len(h) + 1)
    return Vocabulary(h[order], c[order], place[order], int(total), int(types), rest), least


def path(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class of each token, and of the softmaxes on its way: the token's position, the softmax and the outcome."""
    head, inside = (place >= 0) & (place < HEAD), place >= HEAD
    cls = np.where(head, place // SLOTS, TAIL)
    h, t = np.flatnonzero(head), np.flatnonzero(~head)
    k = np.flatnonzero(inside)
    at = place[k] - HEAD
    top = np.full(len(place), SLOTS - 1)
    top[k] = at // (SLOTS * SLOTS)
    token = np.concatenate([h, t, k, k])
    node = np.concatenate([cls[h], np.full(len(t), TAIL), GROUPS + top[k], LEAVES + at // SLOTS])
    out = np.concatenate([place[h] % SLOTS, top[t], at // SLOTS % SLOTS, at % SLOTS])
    return cls, token, node, out


class Weights:
    """Log-linear weights: class rows for three features, word rows for two, and both biases, at first the logs of the counts' shares."""

    def __init__(self, v: Vocabulary):
        mass = np.zeros((NODES, SLOTS))
        _, token, node, out = path(v.place)
        np.add.at(mass, (node, out), v.c[token].astype(float))
        mass[TAIL, SLOTS - 1] = v.rest
        self.class_bias = self._logs(mass[: TAIL + 1].sum(1))
        self.word_bias = self._logs(mass)
        self.classes = np.zeros((3 * ROWS, CLASSES), np.float32)
        self.words = np.zeros((2 * ROWS, SLOTS), np.float32)


    @staticmethod
    def _logs(mass: np.ndarray) -> np.ndarray:
        share = mass / np.maximum(mass.sum(-1, keepdims=True), 1e-9)
        return np.where(share > 0, np.log(np.maximum(share, 1e-12)), UNUSED).astype(np.float32)


def history(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, two = np.full(len(h), BEGIN, np.uint64), np.full(len(h), BEGIN, np.uint64)
    one[1:] = np.where(row[1:] == row[:-1], h[:-1], BEGIN)
    two[2:] = np.where(row[2:] == row[:-2], h[:-2], BEGIN)
    return one, two


def bucket(h: np.ndarray, salt: int) -> np.ndarray:
    return (mix(h + np.uint64(salt)) & np.uint64(ROWS - 1)).astype(np.int64)


def class_rows(one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
    return [bucket(one, 1), ROWS + bucket(two, 2), 2 * ROWS + bucket(one * np.uint64(3) + two, 3)]


def word_rows(one: np.ndarray, two: np.ndarray, node: np.ndarray) -> list[np.ndarray]:
    c = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [bucket(one ^ c, 4), ROWS + bucket(two ^ c, 5)]


def logits(table: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """Sums of the features' weight rows and the bias, shifted where they are too large to be raised to powers."""
    z = np.take(table, rows[0], 0)
    for r in rows[1:]:
        z += np.take(table, r, 0)
    z += bias
    if max(z.max(), -z.min()) > SAFE:
        z -= z.max(1, keepdims=True)
    return z


def row_sums(z: np.ndarray) -> np.ndarray:
    return np.einsum("ij->i", z)


def softmax_log(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log probability of one outcome ``at`` for each row of :func:`logits`, which are overwritten."""
    chosen = z[np.arange(len(z)), at]
    return chosen - np.log(row_sums(np.exp(z, out=z)))


class Shares:
    """Log probabilities by weights that change no more: a table and its biases are raised to powers once, and a row's powers are multiplied.

    Where the largest weights and biases could leave the range of powers together, logits are added up instead.
    """

    def __init__(self, table: np.ndarray, bias: np.ndarray, features: int):
        self.table, self.bias = table, bias
        self.safe = features * np.abs(table).max() + np.abs(bias).max() < SAFE
        if self.safe:
            self.table, self.bias = np.exp(table), np.exp(bias)

    def log(self, rows: list[np.ndarray], node: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probability of outcome ``at`` of the softmax ``node`` for each row."""
        if not self.safe:
            return softmax_log(logits(self.table, rows, np.take(self.bias, node, 0)), at)
        p = np.take(self.table, rows[0], 0)
        for r in rows[1:]:
            p *= np.take(self.table, r, 0)
        p *= np.take(self.bias, node, 0)
        return np.log(p[np.arange(len(p)), at] / row_sums(p))


def sums(d: np.ndarray, by: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sum of the rows ``d[by[first:first + count]]`` of each run, the longest first; most runs are short, a few very long."""
    total = np.take(d, by[first], 0)
    longer = len(count) - np.cumsum(np.bincount(np.minimum(count, SINGLY + 1), minlength=SINGLY + 2))
    for k in range(1, SINGLY):
        n = longer[k]
        total[:n] += np.take(d, by[first[:n] + k], 0)
    for k in range(longer[SINGLY]):
        total[k] += np.take(d, by[first[k] + SINGLY : first[k] + count[k]], 0).sum(0)
    return total


def train_task(w: Weights, h: np.ndarray, row: np.ndarray, v: Vocabulary, rate: float, seen: list[np.ndarray], hits: list[np.ndarray]) -> None:
    """Gradient steps on every token, in place; AdaGrad over weight rows."""
    one, two = history(h, row)
    _, place = v.look(h)
    for lo in range(0, len(h), BATCH):
        cls, token, node, out = path(place[lo : lo + BATCH])
        k = slice(lo, lo + BATCH)
        step(w.classes, class_rows(one[k], two[k]), w.class_bias[None], cls, rate, seen[0], hits[0])
        token += lo
        step(w.words, word_rows(one[token], two[token], node), np.take(w.word_bias, node, 0), out, rate, seen[1], hits[1])


def step(table: np.ndarray, rows: list[np.ndarray], bias: np.ndarray, target: np.ndarray, rate: float, seen: np.ndarray, hits: np.ndarray) -> None:
    n = len(target)
    d = logits(table, rows, bias)
    np.exp(d, out=d)
    d *= (1 / row_sums(d))[:, None]
    d[np.arange(n), target] -= 1
    size = np.einsum("ij,ij->i", d, d) / d.shape[1]
    # The features' rows lie in different ranges of the table, so one sort adds up all of them.
    r = np.concatenate(rows).astype(np.uint16)
    by = np.argsort(r, kind="stable")
    r, by = r[by], np.tile(np.arange(n), len(rows))[by]
    first = np.concatenate([[0], np.flatnonzero(r[1:] != r[:-1]) + 1])
    own = r[first].astype(np.int64)
    count = np.append(first[1:], len(r)) - first
    seen[own] += np.add.reduceat(size[by], first)
    hits[own] += count
    longest = np.argsort(-count, kind="stable")
    own, first, count = own[longest], first[longest], count[longest]
    change = sums(d, by, first, count)
    change *= (rate / np.sqrt(seen[own] + 0.1))[:, None]
    table[own] = np.subtract(np.take(table, own, 0), change, out=change)


def train_round(docs: DataFrame, w: Weights, v: Vocabulary, rate: float) -> None:
    """One round of distributed updates over the column ``text``; ``w`` is changed."""
    shared = docs.sparkSession.sparkContext.broadcast((w, v))

    def run(batches):
        base, vocab = shared.value
        own = Weights.__new__(Weights)
        own.class_bias, own.word_bias = base.class_bias, base.word_bias
        own.classes, own.words = base.classes.copy(), base.words.copy()
        seen, hits = ([np.zeros(len(t), np.float32) for t in (own.classes, own.words)] for _ in range(2))
        for b in batches:
            buf, off = raw(b.column(0))
            for lo, hi in slices(off):
                train_task(own, *tokens(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), vocab, rate, seen, hits)
        for kind, (mine, old, hit) in enumerate(((own.classes, base.classes, hits[0]), (own.words, base.words, hits[1]))):
            parts = [(kind, lo, ((mine[lo : lo + BLOCK] - old[lo : lo + BLOCK]) * hit[lo : lo + BLOCK, None]).tobytes(), hit[lo : lo + BLOCK].tobytes()) for lo in range(0, len(mine), BLOCK) if hit[lo : lo + BLOCK].any()]
            if parts:
                yield pa.RecordBatch.from_pylist([dict(zip(("kind", "lo", "change", "hits"), p, strict=True)) for p in parts], pa.schema([("kind", pa.int32()), ("lo", pa.int32()), ("change", pa.binary()), ("hits", pa.binary())]))

    def add(key, batches):
        """Sums of one block of rows; the tasks' shares pass by one batch at a time."""
        change = hits = 0
        for b in batches:
            for c, n in zip(b.column("change").to_pylist(), b.column("hits").to_pylist(), strict=True):
                change, hits = change + np.frombuffer(c, np.float32).astype(np.float64), hits + np.frombuffer(n, np.float32).astype(np.float64)
        mean = change.reshape(BLOCK, -1) / np.maximum(hits, 1)[:, None]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], ["kind", "lo", "mean"])

    from collections.abc import Iterator

    add.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    changes = docs.select("text").mapInArrow(run, "kind int, lo int, change binary, hits binary")
    for kind, lo, mean in changes.groupBy("kind", "lo").applyInArrow(add, "kind int, lo int, mean binary").collect():
        table = (w.classes, w.words)[kind]
        table[lo : lo + BLOCK] += np.frombuffer(bytes(mean), np.float32).reshape(BLOCK, -1)


def shares_of(w: Weights) -> tuple[Shares, Shares]:
    return Shares(w.classes, w.class_bias[None], 3), Shares(w.words, w.word_bias, 2)


def score_rows(h: np.ndarray, row: np.ndarray, n: int, w: Weights, v: Vocabulary, shares: tuple[Shares, Shares] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Known tokens, base score and model score of each row without the counts of rare tokens; where these are."""
    c, place = v.look(h)
    rare = c < 0
    smoothed = np.where(rare, 0, np.log10(np.maximum(c, 0) + 0.1))
    base = smoothed - np.log10(v.total + 0.1 * (v.types + 1))
    one, two = history(h, row)
    classes, ways = shares or shares_of(w)
    model = np.where(place < 0, smoothed - np.log10(v.rest), 0.0)
    for lo in range(0, len(h), BATCH):
        s = slice(lo, lo + BATCH)
        cls, token, node, out = path(place[s])
        got = classes.log(class_rows(one[s], two[s]), np.zeros(len(cls), np.int64), cls)
        way = ways.log(word_rows(one[lo + token], two[lo + token], node), node, out)
        model[s] += (got + np.bincount(token, way, len(got))) / np.log(10)
    return np.bincount(row, c > 0, n), np.bincount(row, base, n), np.bincount(row, model, n), rare


def score(docs: DataFrame, held_mod: int = 10, rounds: int = 2, rate: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row; rows with crc32(id) mod ``held_mod`` = 0 teach nothing."""
    spark = prepare(docs.sparkSession)
    work = scratch(spark)
    rows = docs.select(docs[id_col].alias("id"), (remainder(id_col, held_mod) == 0).alias("held_out"), docs[text_col].alias("text"))
    learn = rows.where("not held_out").select("text")
    counts = stored(count_table(learn), f"{work}/counts")
    v, least = vocabulary(counts)
    w = Weights(v)
    for k in range(rounds if v.total else 0):
        train_round(learn.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k), w, v, rate)
    shared = spark.sparkContext.broadcast((w, v))

    def run(batches):
        weights, vocab = shared.value
        shares = shares_of(weights)
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            buf, off = raw(b.column(2))
            out = [[], [], [], [], []]
            for lo, hi in slices(off):
                h, row = tokens(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                n = hi - lo
                known, base, model, rare = score_rows(h, row, n, weights, vocab, shares)
                ends = np.cumsum(np.bincount(row[rare], minlength=n)) if rare.any() else np.zeros(n, np.int64)
                for o, x in zip(out, (np.bincount(row, minlength=n), known.astype(np.int64), base, model, np.split(h[rare].view(np.int64), ends[:-1])), strict=True):
                    o.extend(x)
            uid = pa.array(np.arange(at, at + b.num_rows) + (part << 40), pa.int64())
            at += b.num_rows
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([uid, b.column(0), b.column(1), *(pa.array(o, t) for o, t in zip(out, kinds, strict=True))], ["uid", "id", "held_out", "n_tokens", "known", "base", "model", "rare"])

    schema = f"uid bigint, id {dict(docs.dtypes)[id_col]}, held_out boolean, n_tokens bigint, known bigint, base double, model double, rare array<bigint>"
    parts = stored(rows.mapInArrow(run, schema), f"{work}/parts")
    rare = parts.select("uid", F.explode("rare").alias("h")).join(counts.where(F.col("c") < least), "h", "left")
    rare = rare.groupBy("uid").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("more"), F.count("c").alias("rare_known"))
    out = parts.drop("rare").join(rare, "uid", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("model") + more).alias("score"),
    )


__all__ = ["count_table", "map_arrow", "score", "vocabulary"]
