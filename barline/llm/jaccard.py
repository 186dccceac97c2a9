"""N-gram Jaccard join with a token-group matrix, for all pairs of documents.

1. Each document becomes the set of its hashed word shingles; equal sets become one, known by a digest.
2. Sets meet by keys: each set's least hashes in many hash ranges, taken in runs. There are so many keys that two sets at
   the threshold fail to meet in fewer than one of 10^10 cases, and more similar ones less often still; sets that share
   a passage only seldom meet.
3. Sets that share a key with the key's first set are compared with it: similar sets gather in groups around leaders.
4. The token-group matrix stores the union of each group's tokens (groups have a bounded size). Where a key joins groups
   that are not yet one component, a set's overlap with the other group's union bounds its similarity to every member;
   only groups whose bound reaches the threshold are opened and compared. Connected sets need no comparison.

Contract: the words are as in :mod:`common`; a text with fewer words than the width is one shingle, the whole sequence; a
text without words has an empty set, size 0, and is linked with nothing. Rows stay one for one; rows of equal id share
the smallest id of their component like any others. A null id never names a component of several texts unless all are null.
Shingles and sets are compared by 64-bit hashes. Very long texts are hashed in pieces. Other columns are ignored, and kept by
:func:`representatives`, whatever their names.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _COEF, HOT_ONE_IN, fresh, join_hot, map_arrow, mix, prepare, raw, scratch, slices, stored, words
from .components import components

GROUP_SETS = 64
MISSED = 1e-10
_SEEDS = np.random.default_rng(31).integers(1, 2**63, 512, dtype=np.int64).astype(np.uint64)


def shingle_sets(texts: pa.Array, width: int):
    """(row, sorted distinct shingle hashes) of every row that has words."""
    buf, off = raw(texts)
    for lo, hi in slices(off):
        h, row, _, _ = words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        n = np.bincount(row, minlength=hi - lo) if len(row) else np.zeros(hi - lo, int)
        at = np.cumsum(n) - n
        grams = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for k in range(width):
            grams += h[k : k + len(grams)] * _COEF[k]
        grams = mix(grams)
        for r in np.flatnonzero(n):
            a, m = at[r], n[r]
            if m >= width:
                yield lo + int(r), np.unique(grams[a : a + m - width + 1])
            else:
                yield lo + int(r), mix(np.array([(h[a : a + m] * _COEF[:m]).sum() + np.uint64(m)], np.uint64))


@lru_cache(64)
def bands(similarity: int) -> tuple[int, int]:
    """Least hashes in a key, and keys, so that sets at the threshold share a key but for one case in MISSED."""
    t = similarity / 100
    rows = max(1, int(math.log(0.4) / math.log(t))) if t < 1 else 8
    return rows, math.ceil(math.log(MISSED) / math.log(1 - min(t**rows, 0.999)))


def places(n: int) -> int:
    """Hash ranges that a set of ``n`` elements is cut into: a power of two, with four elements in each or more."""
    return 1 if n < 8 else min(256, 1 << (n // 4).bit_length() - 1)


def part_keys(tokens: np.ndarray, similarity: int) -> np.ndarray:
    """The keys by which a set meets every set it may be linked with: digests of runs of least hashes by range.

    Sets of nearby sizes may be cut differently, so a set near the border has the keys of the larger cut too.
    """
    n = len(tokens)
    rows, count = bands(similarity)
    keys = []
    for p in sorted({places(n), places(n * 100 // similarity)}):
        repeats = -(-rows * count // p)
        h = mix(tokens[None] ^ _SEEDS[:repeats, None])
        part = (h >> np.uint64(65 - p.bit_length())).astype(np.int64) if p > 1 else np.zeros(h.shape, np.int64)
        least = np.full(repeats * p, np.uint64(2**64 - 1))
        np.minimum.at(least, (part + np.arange(repeats)[:, None] * p).ravel(), h.ravel())
        runs = mix(least[: rows * count] + np.arange(rows * count, dtype=np.uint64)).reshape(count, rows)
        keys.append(mix(runs.sum(1) + np.uint64(p)))
    return np.concatenate(keys)


def linked(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    if min(len(a), len(b)) * 100 < similarity * max(len(a), len(b)):
        return False
    both = overlap(a, b)
    return 100 * both >= similarity * (len(a) + len(b) - both)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def unpacked(column: pa.Array):
    return [np.frombuffer(x, "<u8") for x in column.to_pylist()]


def digest_of(tokens: np.ndarray) -> int:
    return int(mix(np.array([mix(tokens).sum() + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


def digest_rows(docs: DataFrame, width: int, similarity: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, set_id, keys) per row; a task gives the keys of a set once."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            n = b.num_rows
            size, digest, keys = np.zeros(n, np.int64), np.zeros(n, np.int64), [np.zeros(0, np.int64)] * n
            for r, tokens in shingle_sets(b.column(1), width):
                size[r] = len(tokens)
                digest[r] = digest_of(tokens)
                if digest[r] not in seen:
                    if len(seen) >= 1_000_000:
                        seen.clear()  # keys may then come twice, which does no harm
                    seen.add(int(digest[r]))
                    keys[r] = part_keys(tokens, similarity).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(digest), pa.array(keys, pa.list_(pa.int64()))], ["id", "n_shingles", "set_id", "keys"])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return picked.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, n_shingles bigint, set_id bigint, keys array<bigint>")


def stars(keyed: DataFrame) -> DataFrame:
    """(key, leader, member) for every key of two or more sets; the leader is the first of them.

    Each key's rows pass by in order; only the key's first set is held, so no group is gathered in memory.
    """

    def run(batches):
        last_key, leader = None, None
        for b in batches:
            key, member = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(key):
                continue
            fresh = np.ones(len(key), bool)
            fresh[1:] = key[1:] != key[:-1]
            if key[0] == last_key:
                fresh[0] = False
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), -1))
            first = np.where(head >= 0, member[np.maximum(head, 0)], leader if leader is not None else 0)
            other = member != first
            other[1:] &= (member[1:] != member[:-1]) | (key[1:] != key[:-1])
            last_key, leader = key[-1], first[-1]
            yield pa.RecordBatch.from_arrays([pa.array(key[other]), pa.array(first[other]), pa.array(member[other])], ["key", "leader", "member"])

    dealt = keyed.repartition("key").sortWithinPartitions("key", "set_id")
    return dealt.mapInArrow(run, "key bigint, leader bigint, member bigint")


def compared(star: DataFrame, sets: DataFrame, similarity: int, work: str) -> DataFrame:
    """Pairs (a, b) of a leader and a member of its star that are linked.

    A leader may hold a third of all members. Leaders with one row in HOT_ONE_IN or more (so at most that many, of which only
    ids and counts are broadcast) are copied, and each copy's task gets a part of the members.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ok = [linked(x, y, similarity) for x, y in zip(unpacked(b.column(2)), unpacked(b.column(3)), strict=True)]
        return b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    counts = stored(star.groupBy(F.col("leader").alias("hot")).agg(F.count("*").alias("n")), f"{work}/leaders")
    share = max((counts.agg(F.sum("n")).first()[0] or 0) / HOT_ONE_IN, 64.0)
    hot = F.broadcast(counts.where(F.col("n") >= share).select("hot", F.ceil(F.col("n") / share).alias("copies")))
    copies = F.coalesce("copies", F.lit(1).cast("long"))
    pairs = star.select(F.col("leader").alias("a"), F.col("member").alias("b")).distinct()
    pairs = pairs.join(hot, F.col("a") == F.col("hot"), "left").select("a", "b", F.pmod(F.xxhash64("b"), copies).alias("copy"))
    left = sets.join(hot, F.col("set_id") == F.col("hot"), "left").select(F.col("set_id").alias("a"), F.col("tokens").alias("ta"), F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"))
    right = sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("tb"))
    return map_arrow(pairs.join(left, ["a", "copy"]).join(right, "b").select("a", "b", "ta", "tb"), run, "a bigint, b bigint")


def grouped(star: DataFrame, known: DataFrame) -> DataFrame:
    """(set_id, component, grp): similar sets side by side. A set's home is the first leader that it met; homes of many sets are cut."""
    near = star.select("member", "leader").unionByName(star.select(F.col("leader").alias("member"), "leader"))
    home = near.groupBy(F.col("member").alias("set_id")).agg(F.min("leader").alias("home"))
    sizes = home.groupBy("home").agg(F.ceil(F.count("*") / GROUP_SETS).alias("cuts"))
    cut = F.xxhash64("home", F.pmod(F.xxhash64("set_id"), F.col("cuts")))
    return home.join(sizes, "home").select("set_id", cut.alias("grp")).join(known, "set_id")


def across_groups(met: DataFrame, groups: DataFrame, sets: DataFrame, similarity: int, work: str) -> DataFrame:
    """Linked pairs (a, b) of sets that share a key but not a component: the token-group matrix.

    ``met``: (key, set_id); ``groups``: (set_id, component, grp). Groups that meet in a key are held against each other: the
    union of one's tokens bounds the overlap of each set of the other, and only within the bound are its members opened.
    """
    held = groups.groupBy("grp").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    at = met.join(groups, "set_id").select("key", "grp").distinct().join(held, "grp")
    several = at.groupBy("key").agg(F.min("lo").alias("a"), F.max("hi").alias("b")).where("a <> b").select("key")
    at = stored(at.join(several, "key"), f"{work}/at")
    other = at.select("key", F.col("grp").alias("grp2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    one = (F.col("lo") == F.col("hi")) & (F.col("lo2") == F.col("hi2")) & (F.col("lo") == F.col("lo2"))
    pairs = at.join(other, "key").where((F.col("grp") <= F.col("grp2")) & ~one).select("grp", "grp2").distinct()
    pairs = stored(pairs, f"{work}/pairs")
    members = groups.join(sets, "set_id").select("grp", "set_id", "component", "tokens")
    left = pairs.join(members, "grp").select("grp", "grp2", "set_id", "component", "tokens")
    right = pairs.select("grp", F.col("grp2").alias("to")).join(members.withColumnRenamed("grp", "to"), "to")
    right = right.select(F.col("grp").alias("from"), "to", F.col("set_id").alias("set2"), F.col("component").alias("component2"), F.col("tokens").alias("tokens2"))

    def search(key, queries, group):
        asked, opened = [unpacked(t.column(c).combine_chunks()) for t, c in ((queries, "tokens"), (group, "tokens2"))]
        q_id, q_comp, g_id, g_comp = (t.column(c).to_pylist() for t, c in ((queries, "set_id"), (queries, "component"), (group, "set2"), (group, "component2")))
        out = ([], [])
        if asked and opened:
            union, least, most = np.unique(np.concatenate(opened)), min(map(len, opened)), max(map(len, opened))
            within = queries.column("grp")[0].as_py() == queries.column("grp2")[0].as_py()
            for q, tokens, comp in zip(q_id, asked, q_comp, strict=True):
                size = max(len(tokens), least)  # a member's union with the query has at least so many tokens
                if min(len(tokens), most) * 100 < similarity * size or overlap(tokens, union) * 100 < similarity * size:
                    continue
                for g, theirs, other_comp in zip(g_id, opened, g_comp, strict=True):
                    if comp != other_comp and (not within or q < g) and linked(tokens, theirs, similarity):
                        out[0].append(q)
                        out[1].append(g)
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return left.groupBy("grp", "grp2").cogroup(right.groupBy("from", "to")).applyInArrow(search, "a bigint, b bigint")


def join(docs: DataFrame, width: int = 3, similarity: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) per row; ``similarity`` in percent."""
    spark = prepare(docs.sparkSession)
    work = scratch(spark)
    rows = stored(digest_rows(docs, width, similarity, id_col, text_col), f"{work}/rows")
    star = stored(stars(rows.select(F.explode("keys").alias("key"), "set_id")), f"{work}/stars")
    met = star.select("key", F.col("leader").alias("set_id")).unionByName(star.select("key", F.col("member").alias("set_id"))).distinct()
    wanted = met.select("set_id").distinct()
    # One text stands for each set that met another; only those texts are read again.
    chosen = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("id").alias("id")).join(wanted, "set_id")

    def tokens(b: pa.RecordBatch) -> pa.RecordBatch:
        got = {r: t.astype("<u8").tobytes() for r, t in shingle_sets(b.column(1), width)}
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(list(got), pa.int64())), pa.array(list(got.values()), pa.binary())], ["set_id", "tokens"])

    def digested(b: pa.RecordBatch) -> pa.RecordBatch:
        got = [t for _, t in shingle_sets(b.column(0), width)]
        own = [digest_of(t) for t in got]
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([t.astype("<u8").tobytes() for t in got], pa.binary())], ["set_id", "tokens"])

    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(chosen, "id")
    # Rows of equal id may hold other texts: a set is taken only under its own digest.
    sets = map_arrow(texts.select("set_id", "text"), tokens, "set_id bigint, tokens binary")
    # Sets whose rows all lack an id are found by their digest.
    nameless = map_arrow(docs.where(docs[id_col].isNull()).select(docs[text_col].alias("text")), digested, "set_id bigint, tokens binary")
    nameless = nameless.join(chosen.where("id is null").select("set_id"), "set_id", "left_semi")
    sets = stored(own_digest(sets).unionByName(nameless).groupBy("set_id").agg(F.first("tokens").alias("tokens")), f"{work}/sets")
    edges = stored(compared(star, sets, similarity, work), f"{work}/edges")
    first = components(edges, f"{work}/first")
    known = wanted.join(first, wanted["set_id"] == first["node"], "left").select("set_id", F.coalesce("component", "set_id").alias("component"))
    known = stored(known, f"{work}/known")
    groups = stored(grouped(star, known), f"{work}/groups")
    more = stored(across_groups(met, groups, sets, similarity, work), f"{work}/more")
    last = components(edges.unionByName(more), f"{work}/last")
    # The smallest id of each set, then of each component.
    named = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    named = named.join(last, F.col("node") == F.col("set_id"), "left").select("set_id", "least", "n", F.coalesce("component", "set_id").alias("component"))
    named = stored(named, f"{work}/named")
    final = stored(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("sets")), f"{work}/final")
    label = stored(join_hot(named, final, "component", "sets").select("set_id", "component_id", "n"), f"{work}/label")
    bare = rows.select("id", "n_shingles", "set_id")
    out = join_hot(bare.where("n_shingles > 0"), label, "set_id").select("id", "n_shingles", "component_id")
    out = out.unionByName(bare.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id")))
    return out.withColumnRenamed("id", id_col)


def own_digest(sets: DataFrame) -> DataFrame:
    """The rows whose tokens have the digest they are filed under."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        mine = [digest_of(t) for t in unpacked(b.column(1))]
        return b.filter(pa.array(np.array(mine, np.int64) == b.column(0).to_numpy()))

    return map_arrow(sets, run, "set_id bigint, tokens binary")


def representatives(docs: DataFrame, width: int = 5, similarity: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each component: that of the smallest id. Rows of equal id are one document
    and stay together; rows without words or id stay."""
    (found_id,) = fresh(docs, "found_id")
    found = join(docs, width, similarity, id_col, text_col).where("n_shingles > 0")
    later = found.where(F.col(id_col) > F.col("component_id")).select(F.col(id_col).alias(found_id)).distinct()
    # Written, so that its size is known: Spark broadcasts it only if that is small.
    later = stored(later, f"{scratch(docs.sparkSession)}/later")
    return docs.join(later, F.col(found_id) == docs[id_col], "left_anti")
