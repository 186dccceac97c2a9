"""Benchmark decontamination: windows of documents within a small edit distance of a benchmark item.

Texts and items are sequences of hashed words. The CGK random walk reads a sequence with a pointer that, step by step,
moves on or stays by a shared random bit for (step, symbol); two sequences at a small edit distance give walks at a small
Hamming distance. Bits sampled from repeated walks key an LSH table of the items; item-sized windows are looked up in it,
and what they meet is verified by the exact edit distance. How many steps a key samples, and in how many tables an item
lies, follows from its length and allowed edits: walks of copies at the largest allowed distance are measured (:func:`plan`),
so that such a pair is met with probability ``recall`` or more wherever its edits lie.

Which windows: within the allowed distance, an item and its copy share a run of consecutive words (pigeonhole), so only
windows aligned to such a shared run are embedded. This skips no pair that the verification would accept.

Contract: a document holds an item if a window of it lies within ``floor((1 - similarity) * words)`` word edits of the
item. Null and empty texts or items hold and are held nowhere. Rows of equal id are judged together; null ids are
kept. Items are taken in blocks of a bounded size, one pass over the documents for each, so any number of them works. Equal
items each have their rows. Other columns are ignored and kept, whatever their names.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_arrow, mix, prepare, raw, scratch, slices, stored, words

BLOCK_BYTES = 16 << 20
#: Alignments that are looked at together, so that a run which many items share takes no more memory than others.
ALIGNMENTS = 1 << 18
LOOKED_UP = 1 << 12
STEPS_PER_WORD = 2
SAMPLED = 3
#: How meeting probabilities are measured: kinds of edits, copies of each, walks of each copy, samples of each walk; lengths; part of the allowed misses.
KINDS_OF_EDITS = ("any", "put", "drop", "add", "front", "dropblock", "addblock", "putblock")
COPIES, WALKS, DRAWS = 24, 6, 24
CLASS, LONGEST = 1.2, 512
FEW, MARGIN = 16, 0.5
_FILTER_BITS = 22
_SEEDS = np.random.default_rng(99).integers(1, 2**63, 4096, dtype=np.int64).astype(np.uint64)


def allowed(n: int, similarity: float) -> int:
    """Word edits that an item of ``n`` words may differ by."""
    return math.floor((1 - similarity) * n + 1e-9)


def run_words(n: int, d: int) -> int:
    """Consecutive words that an item of ``n`` words surely shares with a copy at ``d`` edits; three suffice."""
    return max(1, min(3, math.ceil((n - d) / (d + 1))))


def edited(g: np.random.Generator, n: int, d: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A copy of the words 1..n at ``d`` edits within foreign words: the text, and the windows' first words as ``Index.windows`` aligns them."""
    block = int(g.integers(0, n - d + 1))
    at = range(block, block + d) if kind.endswith("block") else range(d) if kind == "front" else g.choice(n, d, replace=False)
    how = dict.fromkeys(map(int, at), kind.removesuffix("block"))
    text, place, run = [0] * (n + d), np.full(n, -n), run_words(n, d)
    for k in range(n):
        e = how.get(k)
        e = ("put", "drop", "add")[g.integers(3)] if e == "any" else "put" if e == "front" else e
        text += [k + 1] if e is None else [0] if e == "put" else [0, k + 1] if e == "add" else []
        if e in (None, "add"):
            place[k] = len(text) - 1
    text = np.array(text + [0] * (n + d), np.uint64)
    fresh = np.flatnonzero(text == 0)
    text[fresh] = np.uint64(1 << 32) + g.integers(0, 1 << 31, len(fresh)).astype(np.uint64)
    shift = place - np.arange(n)
    first = [q for q in range(n - run + 1) if place[q] >= 0 and (shift[q : q + run] == shift[q]).all()]
    return mix(text), np.unique(shift[first])


@lru_cache(1024)
def meeting(n: int, d: int) -> tuple[np.ndarray, ...]:
    """For each kind of edits, the share of tables in which an item and its copies meet: (sampled - 1, copies)."""
    g = np.random.default_rng([n, d])
    item, steps, zero, out = mix(np.arange(1, n + 1, dtype=np.uint64)), max(SAMPLED, STEPS_PER_WORD * n), np.zeros(1, np.int64), []
    own = [cgk(item, zero, zero + n, steps, w) for w in range(WALKS)]
    for kind in KINDS_OF_EDITS:
        made = [edited(g, n, d, kind) for _ in range(COPIES)]
        off = np.cumsum([0] + [len(t) for t, _ in made])
        begin = np.concatenate([o + b for o, (_, b) in zip(off, made, strict=False)])
        copy = np.repeat(np.arange(COPIES), [len(b) for _, b in made])
        text, p = np.concatenate([t for t, _ in made]), np.zeros((SAMPLED, COPIES))
        for w in range(WALKS):
            agree = cgk(text, begin, begin + n, steps, w) == own[w]
            for _ in range(DRAWS):
                drawn = agree[:, g.choice(steps, SAMPLED, replace=False)]
                for m in range(SAMPLED):
                    p[m] += np.bincount(copy, drawn[:, : m + 1].all(1), COPIES) > 0
        out.append(p / (WALKS * DRAWS))
    return tuple(out)


@lru_cache(1024)
def plan(n: int, similarity: float, recall: float) -> tuple[int, int]:
    """Steps to sample and tables for an item of ``n`` words, so that copies at the limit are met with probability ``recall``.

    Most steps, so fewest chance meetings, that need at most FEW tables; one step and as many tables as it takes otherwise.
    Lengths are measured in classes by their longest, up to LONGEST words; the shares of longer ones no longer change.
    """
    if n > 16:
        n = min(LONGEST, math.ceil(16 * CLASS ** math.ceil(math.log(n / 16) / math.log(CLASS) - 1e-9)))
    shares = meeting(n, allowed(n, similarity))
    for sampled in range(SAMPLED, 0, -1):
        tables = 1
        for share in shares:
            p = np.clip(share[sampled - 1], 1e-3, 1)
            while ((1 - p) ** tables).mean() > (1 - recall) * MARGIN:
                tables += 1
        if tables <= FEW:
            break
    return sampled, tables


def cgk(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, steps: int, walk: int, low: np.ndarray | None = None) -> np.ndarray:
    """Walks (sequences, steps) over ``symbols[begin:end]``; past the end a filling symbol is read, before ``low`` a foreign one."""
    at, out = begin.copy(), np.zeros((len(begin), steps), np.uint64)
    for t in range(steps):
        inside = at < end
        s = np.where(inside, symbols[np.clip(at, 0, len(symbols) - 1)], np.uint64(0))
        if low is not None:
            s = np.where(at < low, mix(at.astype(np.uint64) ^ _SEEDS[0]), s)
        out[:, t] = s
        at += inside & ((mix(s ^ _SEEDS[(walk * 613 + t) % 4096] ^ np.uint64(t)) & np.uint64(1)) == 1)
    return out


@lru_cache(65536)
def sampled_steps(steps: int, walk: int, sampled: int) -> tuple[int, ...]:
    """The steps that a key samples, in order; filled with -1."""
    drawn = np.random.default_rng([walk, steps]).choice(steps, min(sampled, steps), replace=False)
    return (*sorted(drawn.tolist()), *[-1] * (SAMPLED - len(drawn)))


def keys(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, steps: np.ndarray, sampled: np.ndarray, walk: np.ndarray, low: np.ndarray | None = None) -> np.ndarray:
    """One LSH key for each sequence in its table ``walk``; ``steps``: how much of the walk it may sample, ``sampled``: how often.

    Sequences of all sizes and tables walk together, step by step; each takes up its sampled symbols as it passes them.
    """
    kinds, of = np.unique(np.stack([steps, walk, sampled], 1), axis=0, return_inverse=True)
    sample = np.array([sampled_steps(*map(int, k)) for k in kinds], np.int64).reshape(-1, SAMPLED)[of.ravel()]
    who, which = np.nonzero(sample >= 0)
    at_step = sample[who, which]
    by = np.argsort(at_step, kind="stable")
    who, last = who[by], int(at_step.max(initial=-1))
    cuts = np.searchsorted(at_step[by], np.arange(last + 2))
    key, at = (walk * 100003 + steps).astype(np.uint64), begin.copy()
    for t in range(last + 1):
        inside = at < end
        s = np.where(inside, symbols[np.clip(at, 0, len(symbols) - 1)], np.uint64(0))
        if low is not None:
            s = np.where(at < low, mix(at.astype(np.uint64) ^ _SEEDS[0]), s)
        now = who[cuts[t] : cuts[t + 1]]
        key[now] = mix(key[now] * np.uint64(31) + s[now])
        at += inside & ((mix(s ^ _SEEDS[(walk * 613 + t) % 4096] ^ np.uint64(t)) & np.uint64(1)) == 1)
    return key


def infix_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to a substring of ``text``, with the substring's range (the earliest shortest)."""
    n = len(text)
    ramp = np.arange(n + 1)
    row, origin = np.zeros(n + 1, np.int64), ramp.copy()
    for s in item:
        up, diag = row + 1, row[:-1] + (text != s)
        take = diag < up[1:]
        new = up.copy()
        new[1:] = np.where(take, diag, up[1:])
        new_origin = origin.copy()
        new_origin[1:] = np.where(take, origin[:-1], origin[1:])
        # Left neighbours: a running minimum of value minus place.
        level = np.minimum.accumulate(new - ramp)
        source = np.maximum.accumulate(np.where(new - ramp == level, ramp, 0))
        row, origin = level + ramp, new_origin[source]
    e = int(row.argmin())
    return int(row[e]), int(origin[e]), e


class Index:
    """The LSH tables and run filter of one block of items."""

    def __init__(self, ids: list, texts: list[str], similarity: float, recall: float):
        buf, off = raw(pa.array(texts, pa.large_string()))
        self.symbols, row, _, _ = words(buf, off)
        self.ids, self.similarity = ids, similarity
        n = np.bincount(row, minlength=len(ids)) if len(row) else np.zeros(len(ids), int)
        self.begin = np.cumsum(n) - n
        self.size = n
        self.edits = np.array([allowed(k, similarity) for k in n], np.int64)
        self.run = np.array([run_words(int(k), int(d)) for k, d in zip(n, self.edits, strict=True)], np.int64)
        self.steps = np.maximum(SAMPLED, STEPS_PER_WORD * n)
        self.sampled, self.walks = np.array([plan(int(k), similarity, recall) if k else (1, 0) for k in n], np.int64).reshape(-1, 2).T
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for g in (1, 2, 3):
            of = [(i, q) for i in np.flatnonzero((self.run == g) & (n > 0)) for q in range(n[i] - g + 1)]
            if of:
                item, q = np.array(of).T
                h = gram_hash(self.symbols, g)[self.begin[item] + q]
                order = np.argsort(h, kind="stable")
                self.grams[g] = h[order], item[order], q[order]
        self.hit = {g: np.zeros(1 << _FILTER_BITS, bool) for g in self.grams}
        for g, (h, _, _) in self.grams.items():
            self.hit[g][(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        # An item's key in each of its tables: a window meets it where the keys are equal.
        self.keys = np.zeros((self.walks.max(initial=0), len(ids)), np.uint64)
        item, walk = every(self.walks)
        if len(item):
            self.keys[walk, item] = keys(self.symbols, self.begin[item], self.begin[item] + n[item], self.steps[item], self.sampled[item], walk)

    def windows(self, h: np.ndarray, row: np.ndarray):
        """First word, item and row of the windows whose alignment shares a run with an item, in parts of a bounded size."""
        for g, (known, item, q) in self.grams.items():
            if len(h) < g:
                continue
            code = gram_hash(h, g)
            m = len(h) - g + 1
            p = np.flatnonzero(self.hit[g][(code[:m] >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] & (row[:m] == row[g - 1 : g - 1 + m]))
            lo, hi = np.searchsorted(known, code[p], "left"), np.searchsorted(known, code[p], "right")
            p, lo, n = p[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            total = np.cumsum(n)
            at = 0
            while at < len(p):
                to = max(at + 1, int(np.searchsorted(total, total[at] - n[at] + ALIGNMENTS, "right")))
                m = n[at:to]
                k = np.repeat(lo[at:to], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                yield np.unique(np.stack([np.repeat(p[at:to], m) - q[k], item[k], np.repeat(row[p[at:to]], m)], 1), axis=0).T
                at = to

    def search(self, h: np.ndarray, row: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first word, end word, distance) of verified items: the closest, then earliest, for a row and item."""
        first_of = np.searchsorted(row, np.arange(row[-1] + 1), "left")
        end_of = np.searchsorted(row, np.arange(row[-1] + 1), "right")
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for anchor, item, at_row in self.windows(h, row):
            self.verify(h, anchor, item, at_row, first_of, end_of, best)
        return [(r, i, s, e, d) for (r, i), (d, s, e) in sorted(best.items())]

    def verify(self, h, anchor, item, at_row, first_of, end_of, best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
        """Looks the windows up in the tables and keeps the closest, then earliest, verified one of each row and item."""
        met = np.zeros(len(anchor), bool)
        low = first_of[at_row]  # a window may begin before its row: foreign words are read there, so that the rest stays aligned
        end = np.minimum(anchor + self.size[item], end_of[at_row])
        for lo in range(0, len(anchor), LOOKED_UP):
            own, walk = every(self.walks[item[lo : lo + LOOKED_UP]])
            own += lo
            of = item[own]
            got = keys(h, anchor[own], end[own], self.steps[of], self.sampled[of], walk, low[own])
            met[own[got == self.keys[walk, of]]] = True
        # Windows of one row and item that overlap are verified as one stretch.
        anchor, item, at_row = anchor[met], item[met], at_row[met]
        by = np.lexsort((anchor, item, at_row))
        stretch: list[int] | None = None
        for a, i, r in zip(anchor[by].tolist(), item[by].tolist(), at_row[by].tolist(), strict=True):
            d = int(self.edits[i])
            lo, hi = max(int(first_of[r]), a - d), min(int(end_of[r]), a + int(self.size[i]) + d)
            if stretch and stretch[:2] == [r, i] and lo <= stretch[3]:
                stretch[3] = max(stretch[3], hi)
                continue
            if stretch:
                self.measure(h, *stretch, best)
            stretch = [r, i, lo, hi]
        if stretch:
            self.measure(h, *stretch, best)

    def measure(self, h, r: int, i: int, lo: int, hi: int, best: dict[tuple[int, int], tuple[int, int, int]]) -> None:
        distance, s, e = infix_distance(self.symbols[self.begin[i] : self.begin[i] + self.size[i]], h[lo:hi])
        if distance <= self.edits[i]:
            got = (distance, lo + s, lo + e)
            best[r, i] = min(best.get((r, i), got), got)


def every(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts n: each place n times, and 0 to n - 1."""
    own = np.repeat(np.arange(len(counts)), counts)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)


def gram_hash(h: np.ndarray, g: int) -> np.ndarray:
    """Hash of the ``g`` words that begin at each place; the last ones are partial."""
    out = h.copy()
    for k in range(1, g):
        out[:-k] = mix(out[:-k] * np.uint64(3) + h[k:])
    return out


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = 0.8, recall: float = 0.99, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, start, end, distance, item_words) of held items; code points, end exclusive. Clean documents have no row."""
    spark = prepare(docs.sparkSession)
    picked_items = items.where(items[item_text_col].isNotNull()).select(items[item_col].alias("item"), items[item_text_col].alias("text"))
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, key bigint, start bigint, end bigint, distance bigint, item_words bigint"
    work = scratch(spark)
    # Items of one text are searched once; their ids come back at the end. So a block holds what its texts hold, however often they are repeated.
    texts = stored(picked_items.groupBy("text").agg(F.count("*").alias("n")).withColumn("key", F.monotonically_increasing_id()), f"{work}/texts")
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    out = None
    for k in range(blocks):  # one pass over the documents for each 16 MB of items
        part = texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).orderBy("key").collect()
        shared = spark.sparkContext.broadcast(Index([r["key"] for r in part], [r["text"] for r in part], similarity, recall))

        def run(b: pa.RecordBatch, shared=shared) -> pa.RecordBatch | None:
            index, (buf, off), rows = shared.value, raw(b.column(1)), []
            for lo, hi in slices(off):
                part_buf, part_off = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                h, row, start, end = words(part_buf, part_off)
                if not len(h):
                    continue
                for r, i, s, e, d in index.search(h, row):
                    chars = [int(np.count_nonzero((part_buf[part_off[r] : p] & 0xC0) != 0x80)) for p in (start[min(s, len(start) - 1)], end[max(s, e - 1)])]
                    rows.append((lo + r, index.ids[i], *chars, d, int(index.size[i])))
            if not rows:
                return None
            cols = list(zip(*rows, strict=True))
            ids = b.column(0).take(pa.array(cols[0], pa.int64()))
            return pa.RecordBatch.from_arrays([ids, pa.array(cols[1]), *(pa.array(c, pa.int64()) for c in cols[2:])], ["id", "key", "start", "end", "distance", "item_words"])

        picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
        got = map_arrow(picked, run, schema)
        if blocks > 1:  # one block's index at a time on the executors
            got = stored(got, f"{work}/block{k}")
            shared.unpersist()
        out = got if out is None else out.unionByName(got)
    members = stored(picked_items.join(texts, "text").select("key", "item"), f"{work}/members")
    found = out.join(members, "key").select("id", "item", "start", "end", "distance", "item_words")
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def without_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that hold no item; those of null id stay unless a document of null id holds one."""
    (held_id,) = fresh(docs, "held_id")
    held = contaminated(docs, items, id_col=id_col, **options).select(F.col(id_col).alias(held_id)).distinct()
    # Written, so that its size is known: Spark broadcasts it only if that is small, and the documents are not shuffled then.
    held = stored(held, f"{scratch(docs.sparkSession)}/held")
    return docs.join(held, F.col(held_id).eqNullSafe(docs[id_col]), "left_anti")
