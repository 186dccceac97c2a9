"""Language identification by a byte convolutional network.

Filters of several widths slide over byte embeddings of fixed-length windows; each filter's maximum over a window feeds a
softmax. The network is trained in numpy on a bounded sample of labelled rows; a text's prediction is the mean of its
windows' log-probabilities, weighted by their bytes, over the whole text.

Contract: null texts and texts without a letter give ``und`` with score 0. Rows stay one for one. With no labelled row to
learn from, every text gives ``und``. Ties between languages go to the first in alphabetical order. Texts are judged
alone: language, source and id columns are never inputs. A text of any length is read whole, some windows at a time. The
network's size is bounded by ``max_labels``: of more languages than that, the commonest are learned. Rows of equal or null id
are judged like any others; other columns may have any names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, prepare, raw

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
WINDOWS_AT_ONCE = 128
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in LETTER.finditer(text))


@dataclass
class Network:
    """Embedding (256, EMBED), one kernel (width, EMBED, FILTERS) and bias per width, output layer."""

    labels: list[str]
    embed: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maxima (windows, filters) over each window's places, and where they were."""
        tops, places = [], []
        for kernel, bias in zip(self.kernels, self.biases, strict=True):
            w = len(kernel)
            tables = self.tables(kernel)
            acts = sum(tables[k][x[:, k : x.shape[1] - w + 1 + k]] for k in range(w))
            at = acts.argmax(1)
            tops.append(np.maximum(np.take_along_axis(acts, at[:, None, :], 1)[:, 0] + bias, 0))
            places.append(at)
        return np.concatenate(tops, 1), places

    def tables(self, kernel: np.ndarray) -> list[np.ndarray]:
        """A byte's share in a filter at each of its places."""
        return [(self.embed @ k).astype(np.float32) for k in kernel]

    def log_probs(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.out + self.bias
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def train(windows: np.ndarray, target: np.ndarray, labels: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam over mini-batches; ``windows``: (rows, WINDOW) bytes."""
    g = np.random.default_rng(seed)
    net = Network(
        labels,
        g.normal(0, 0.5, (256, EMBED)),
        [g.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)) for w in WIDTHS],
        [np.zeros(FILTERS) for _ in WIDTHS],
        g.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))),
        np.zeros(len(labels)),
    )
    params = [net.embed, *net.kernels, *net.biases, net.out, net.bias]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = g.permutation(len(windows))
        for lo in range(0, len(order), batch):
            pick = order[lo : lo + batch]
            x, n = windows[pick], len(pick)
            top, places = net.pooled(x)
            d = np.exp(net.log_probs(top))
            d[np.arange(n), target[pick]] -= 1
            d /= n
            d_top = (d @ net.out.T) * (top > 0)
            g_embed, g_kernels, g_biases = np.zeros_like(net.embed), [], []
            for i, w in enumerate(WIDTHS):
                dt, at = d_top[:, i * FILTERS : (i + 1) * FILTERS], places[i]
                g_kernel = np.zeros_like(net.kernels[i])
                for k in range(w):
                    seen = x[np.arange(n)[:, None], at + k]
                    g_kernel[k] = np.einsum("nfe,nf->ef", net.embed[seen], dt)
                    np.add.at(g_embed, seen, dt[:, :, None] * net.kernels[i][k].T[None])
                g_kernels.append(g_kernel)
                g_biases.append(dt.sum(0))
            t += 1
            for p, m, v, grad in zip(params, first, second, [g_embed, *g_kernels, *g_biases, top.T @ d, d.sum(0)], strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def windows_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte and length of the windows of all rows; every byte lies in one, the last of a row is shorter."""
    size = np.diff(off)
    n = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), n)
    start = off[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    return row, start, np.minimum(WINDOW, off[1:][row] - start)


def filled(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The windows' bytes; short ones are filled with blanks."""
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < size[:, None]
    return np.where(inside, buf[np.minimum(at, len(buf) - 1)], np.uint8(0x20))


class Scorer:
    """The trained network with its byte tables merged: one lookup for each pair of bytes."""

    def __init__(self, net: Network):
        self.net, self.pairs, self.singles = net, [], []
        for kernel, w in zip(net.kernels, WIDTHS, strict=True):
            t = net.tables(kernel)
            self.pairs.append([(t[k][:, None] + t[k + 1][None]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)])
            self.singles.append(t[-1] if w % 2 else None)

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        two = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        tops = []
        for i, w in enumerate(WIDTHS):
            n = x.shape[1] - w + 1
            acts = self.pairs[i][0][two[:, :n]]
            for k, table in enumerate(self.pairs[i][1:], 1):
                acts += table[two[:, 2 * k : 2 * k + n]]
            if self.singles[i] is not None:
                acts += self.singles[i][x[:, w - 1 : w - 1 + n]]
            tops.append(np.maximum(acts.max(1) + self.net.biases[i].astype(np.float32), 0))
        return self.net.log_probs(np.concatenate(tops, 1).astype(np.float64))

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        buf, off = raw(texts)
        row, start, size = windows_of(buf, off)
        k = len(self.net.labels)
        total, weight = np.zeros((len(texts), k)), np.zeros(len(texts))
        for lo in range(0, len(row), WINDOWS_AT_ONCE):
            s = slice(lo, lo + WINDOWS_AT_ONCE)
            np.add.at(total, row[s], self.log_probs(filled(buf, start[s], size[s])) * size[s, None])
            np.add.at(weight, row[s], size[s])
        mean = total / np.maximum(weight, 1)[:, None]
        prob = np.exp(mean - mean.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        best = prob.argmax(1)
        letters = [has_letter(t or "") for t in texts.to_pylist()]
        return [self.net.labels[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], [float(prob[i, b]) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, letters, strict=True))]


def fit(docs: DataFrame, learn, per_label: int = 500, windows_each: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_labels: int = 400) -> Network | None:
    """Train on at most about ``per_label`` rows of each label among those where ``learn`` holds, drawn by a hash of the id.

    The sample is bounded: labels times rows times windows of WINDOW bytes reach the driver. Windows are drawn from
    the whole text.
    """
    prepare(docs.sparkSession)
    rows = docs.where(learn & docs[label_col].isNotNull() & docs[text_col].isNotNull()).select(docs[id_col].cast("string").alias("id"), docs[text_col].alias("text"), docs[label_col].alias("label"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(max_labels).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(v) for kv in counts.items() for v in (kv[0], min(1.0, per_label / kv[1]))])
    drawn = rows.where((F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)) < F.element_at(share, F.col("label")))
    # Places are drawn by a hash too, so that parts of a text other than its beginning are learned from.
    size = F.greatest(F.char_length("text") - WINDOW, F.lit(0))
    places = F.array(*[F.pmod(F.xxhash64("id", F.lit(k)), (size + 1).cast("long")).cast("int") + 1 for k in range(windows_each)])
    cut = drawn.select("label", F.explode(F.array_distinct(places)).alias("at"), "text").select("label", F.expr(f"substring(text, at, {WINDOW})").alias("text"))
    sample = sorted((r["label"], r["text"]) for r in cut.limit(2 * per_label * windows_each * len(counts)).collect() if has_letter(r["text"]))
    if not sample:
        return None
    labels = sorted({label for label, _ in sample})
    cut_bytes = [t.encode()[:WINDOW] for _, t in sample]
    # Half of the windows are shortened, as short texts and short last windows are judged too.
    g = np.random.default_rng(11)
    cut_bytes = [b[: g.integers(12, WINDOW)] if g.random() < 0.5 else b for b in cut_bytes]
    x = np.frombuffer(b"".join(b.ljust(WINDOW) for b in cut_bytes), np.uint8).reshape(-1, WINDOW)
    return train(x, np.array([labels.index(label) for label, _ in sample]), labels)


def predict(docs: DataFrame, net: Network | None, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` with the prediction and its score, under ``names``."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(net)
    cache: dict = {}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, rest = b.column(b.num_columns - 1), [b.column(i) for i in range(b.num_columns - 1)]
        if shared.value is None:
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        else:
            if "scorer" not in cache:
                cache["scorer"] = Scorer(shared.value)
            langs, scores = cache["scorer"].predict(texts)
        return pa.RecordBatch.from_arrays([*rest, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names[:-1], "lang_pred", "score"])

    picked = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs[text_col].alias("text"))
    schema = "".join(f"k{i} {dict(docs.dtypes)[c]}, " for i, c in enumerate(keep)) + "lang_pred string, score double"
    got = map_arrow(picked, run, schema)
    return got.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("lang_pred").alias(names[0]), F.col("score").alias(names[1]))
