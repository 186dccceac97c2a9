"""Operators over whole corpora, against brute force on small fixtures."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barline.llm import components, decontaminate, jaccard, substring, vptree
from barline.llm.common import raw, scratch, words


def prose(g, n):
    return " ".join("".join(g.choice(["ta", "ri", "mo", "lun", "pes", "ka"]) for _ in range(g.randint(1, 4))) + g.choice(["", "", "", ".", ","]) for _ in range(n))


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(rows, width, similarity):
    sets = [(d, shingles(t, width)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= similarity * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {d: (len(s), find(d)) for d, s in sets}


def near_copies(seed, many=60):
    """Chains and clouds of edited copies around the threshold, with some unrelated texts."""
    g = random.Random(seed)
    rows = []
    for _ in range(6):
        base = prose(g, g.randint(4, 120)).split()
        for _ in range(many // 6):
            w = list(base)
            for _ in range(g.choice([0, 0, 1, 2, 3, 5])):
                w[g.randrange(len(w))] = prose(g, 1)
            rows.append(" ".join(w))
            if g.random() < 0.3:
                base = w
    rows += [prose(g, 30) for _ in range(20)] + ["", None, "one", "One", "two words", "two  WORDS"]
    return list(enumerate(rows))


@pytest.mark.parametrize(("width", "similarity", "group"), [(3, 90, 64), (5, 80, 3), (2, 50, 2)])
def test_jaccard_join_loses_nothing(spark, monkeypatch, width, similarity, group):
    monkeypatch.setattr(jaccard, "GROUP_SETS", group)
    rows = near_copies(width)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), width, similarity).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, width, similarity)


def test_part_keys_meet_every_linked_pair():
    g = np.random.default_rng(4)
    for similarity in (50, 80, 90):
        for n in (1, 2, 5, 9, 10, 19, 40, 150, 700):
            for _ in range(15):
                a = np.unique(g.integers(0, 2**64, n, dtype=np.uint64))
                most = int(len(a) * (100 - similarity) // 100)
                gone, come = g.integers(0, most + 1), g.integers(0, most + 1)
                b = np.unique(np.concatenate([a[gone:], g.integers(0, 2**64, come, dtype=np.uint64)]))
                if len(b) and jaccard.linked(a, b, similarity):
                    assert set(jaccard.part_keys(a, similarity)) & set(jaccard.part_keys(b, similarity))


def test_representatives_and_odd_rows(spark):
    docs = spark.createDataFrame([(3, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (2, None, "z"), (4, "", "z"), (None, "q", "n"), (5, "other words entirely in this one", "w")], "doc_id long, text string, set_id string")
    got = jaccard.representatives(docs)
    assert got.columns == docs.columns and sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 2, 4, 5]
    assert jaccard.join(docs.limit(0)).count() == 0


def test_rows_without_id_keep_their_links(spark):
    w = [f"w{k}" for k in range(100)]
    texts = {i: " ".join(f"e{j}" if j < i else x for j, x in enumerate(w)) for i in (0, 6, 11)}  # 6 links 0 and 11
    docs = spark.createDataFrame([(1, texts[0]), (None, texts[6]), (2, texts[11])], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.join(docs, 3, 85).collect()}
    assert got == {1: 1, None: 1, 2: 1}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges, scratch(spark)).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def brute_nearest(rows, queries, k):
    known = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 6}
    return {q: sorted((-sum(a * b for a, b in zip(known[q], v, strict=True)), i) for i, v in known.items() if i != q)[:k] for q in queries if q in known}


def test_vantage_trees_are_exact_at_factor_one(spark, monkeypatch):
    monkeypatch.setattr(vptree, "LEAF", 8)
    monkeypatch.setattr(vptree, "BLOCK_ROWS", 7)
    g = np.random.default_rng(1)
    rows = [(i, [float(x) for x in g.normal(size=6)], "s") for i in range(300)]
    rows += [(1000 + i, rows[5][1], "s") for i in range(60)]  # many copies of one vector
    rows += [(2000, None, "s"), (2001, [0.0] * 6, "s"), (2002, [float("nan")] * 6, "s"), (2003, [1.0, None, 1.0, 1.0, 1.0, 1.0], "s"), (2020, [1.0, 2.0], "s"), (2040, [float("inf")] * 6, "s")]
    got = vptree.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=9, shard_rows=90).collect()
    want = brute_nearest(rows, [i for i, _, _ in rows if i % 20 == 0], 9)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert {q: [i for _, i in v] for q, v in found.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert all(abs(a - b) < 1e-12 for q in want for (a, _), (b, _) in zip(found[q], want[q], strict=True))


@pytest.mark.parametrize("kind", ["outlier", "classes", "ties"])
def test_vantage_trees_are_exact_on_skewed_norms_and_ties(spark, monkeypatch, kind):
    monkeypatch.setattr(vptree, "LEAF", 8)
    g = np.random.default_rng(5)
    p = g.normal(size=(300, 6))
    p /= np.sqrt((p * p).sum(1))[:, None]
    if kind == "outlier":
        p[7] *= 1e9
    elif kind == "classes":
        p *= 10.0 ** g.integers(-18, 18, 300)[:, None]
    else:
        p = np.unique(g.integers(0, 3, (700, 6)), axis=0)[1:].astype(float)[g.permutation(300)]
    rows = [(i, [float(x) for x in v], "s") for i, v in enumerate(p)]
    got = vptree.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=9, shard_rows=90).collect()
    want = brute_nearest(rows, range(0, 300, 20), 9)
    for q in want:
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [i for _, i in want[q]]


def test_smaller_factors_keep_recall(spark):
    g = np.random.default_rng(2)
    p = g.normal(size=(4000, 8))
    tree, q = vptree.Tree(p), g.normal(size=(50, 8))
    true = [set(np.argsort(((p - x) ** 2).sum(1))[:10]) for x in q]
    recall = {}
    for factor in (1.0, 0.6):
        _, at = tree.search(q, 10, factor, np.full(50, -1))
        recall[factor] = np.mean([len(true[i] & set(at[i])) / 10 for i in range(50)])
    assert recall[1.0] == 1 and recall[0.6] >= 0.9


def test_vectors_with_repeated_ids_and_clashing_names(spark):
    g = np.random.default_rng(6)
    rows = [(i, [float(x) for x in g.normal(size=3)]) for i in range(40)]
    again = [(i, [x + 1.0 for x in v]) for i, v in rows[:10]]  # later in order, so not counted
    docs = spark.createDataFrame([(i, v, "a", 1.0, 2) for i, v in rows + again + rows[5:8]], "id long, v array<double>, kind string, score double, slot int")
    got = vptree.nearest(docs, F.col("id") % 20 == 0, k=50, id_col="id", vector_col="v").collect()
    first = {i: min([v] + [w for j, w in again if j == i]) for i, v in rows}
    for q in (0, 20):
        want = sorted((-sum(a * b for a, b in zip(first[q], v, strict=True)), i) for i, v in first.items() if i != q)
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [i for _, i in want]
    assert len(got) == 2 * 39


def test_no_vectors(spark):
    assert vptree.nearest(vectors(spark, [(1, None, "")]), F.lit(True)).count() == 0


def brute_infix(item, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        before, row = row, [i]
        for j, y in enumerate(text, 1):
            row.append(min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y)))
    return min(row)


def test_infix_distance():
    g = np.random.default_rng(3)
    for _ in range(300):
        a, b = (g.integers(0, 4, g.integers(1, 12)).astype(np.uint64) for _ in range(2))
        d, s, e = decontaminate.infix_distance(a, b)
        assert d == brute_infix(list(a), list(b)) and 0 <= s <= e <= len(b)
        full = np.abs(len(b[s:e]) - len(a))
        assert full <= d + len(a)


def test_decontamination_finds_all_near_copies(spark):
    g = random.Random(6)
    items = [(i, prose(g, g.randint(8, 60))) for i in range(30)]
    docs, want = [], set()
    for d in range(150):
        w = prose(g, g.randint(20, 120)).split()
        if d % 3 == 0:
            i, text = g.choice(items)
            copy = text.upper().split() if d % 2 else text.split()
            for _ in range(g.randint(0, decontaminate.allowed(len(copy), 0.8))):
                at = g.randrange(len(copy))
                copy[at : at + 1] = g.choice([["zzz"], [], [copy[at], "yyy"]])
            k = g.randint(0, len(w))
            w = w[:k] + copy + w[k:]
        docs.append((d, " ".join(w)))
    for d, t in docs:
        for i, text in items:
            item = text.lower().split()
            if brute_infix(item, t.lower().split()) <= decontaminate.allowed(len(item), 0.8):
                want.add((d, i))
    docs += [(500, None), (501, "")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([*items, (77, None), (78, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 40
    assert decontaminate.without_items(docs, items).count() == 152 - len({d for d, _ in got})


@pytest.mark.parametrize("n", [20, 50, 100, 200, 300])
def test_decontamination_recall_at_the_limit(n):
    g = np.random.default_rng(n)
    d, items, texts = decontaminate.allowed(n, 0.8), [], []
    for k in range(120):
        item = [f"i{k}w{j}" for j in range(n)]
        at = set(range(d)) if k % 4 == 3 else set(g.choice(n, d, replace=False).tolist())  # spread, or the copy's beginning
        how = [("put", "drop", "add")[g.integers(3)] if k % 4 == 0 else ("put", "drop", "drop")[k % 4 - 1] for _ in range(n)]
        copy = [x for j, w in enumerate(item) for x in ([w] if j not in at else [f"x{k}y{j}"] if how[j] == "put" else [] if how[j] == "drop" else [f"x{k}y{j}", w])]
        around = [f"d{k}e{j}" for j in range(40)]
        items.append(" ".join(item))
        texts.append(" ".join(copy + around if k % 2 else around + copy + around))
    index = decontaminate.Index(list(range(120)), items, 0.8, 0.99)
    h, row, _, _ = words(*raw(pa.array(texts)))
    found = {(r, i) for r, i, *_ in index.search(h, row)}
    assert found <= {(k, k) for k in range(120)} and len(found) >= 0.99 * 120


def test_repeated_spans(spark):
    g = random.Random(8)
    passage = " ".join(prose(g, 12).rstrip(".,") + "." for _ in range(6))
    clean = [prose(g, 80) for _ in range(6)]
    rows = [(1, clean[0] + ". " + passage + "\n" + clean[1]), (2, clean[2] + ". " + passage + "\n" + clean[3]), (3, clean[4]), (4, None), (5, ""), (6, clean[5] + ".\n" + passage.upper())]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    got = {}
    for r in substring.repeated_spans(docs).collect():
        got.setdefault(r.doc_id, []).append((r.span_start, r.span_end))
    assert set(got) == {2, 6}
    text = dict(rows)
    for d in (2, 6):
        (s, e), = got[d]
        assert len(text[d][s:e].split()) >= 60 and text[d][s:e].lower() in passage.lower()
    left = {r.doc_id: r.text for r in substring.without_repeats(docs).collect()}
    assert left[1] == text[1] and left[3] == text[3] and left[4] is None and len(left[2]) < len(text[2]) - 200
    assert substring.repeated_spans(docs.limit(0)).count() == 0


@pytest.mark.parametrize("stops", [False, True])
def test_passages_of_little_over_fifty_words(spark, stops):
    g, rows = random.Random(11), []
    word = lambda k: f"{g.choice('abcdefgh')}{g.getrandbits(40):x}{k}"
    sentences = lambda n: [word(k) + ("." if stops and g.random() < 0.07 else "") for k in range(n)]
    for k in range(200):
        passage = sentences(51 + k % 10)
        rows += [(2 * k + i, " ".join(sentences(g.randint(30, 60)) + passage + sentences(g.randint(30, 60)))) for i in range(2)]
    found = {r.doc_id for r in substring.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(d % 2 for d in found) and len(found) >= 0.99 * 200


def test_repeated_spans_of_two_short_sentences(spark):
    g = random.Random(12)
    passage = " ".join(prose(g, 7).replace(".", "") + "." for _ in range(2))
    docs = spark.createDataFrame([(i, f"{prose(g, 30)}.\n{passage}\n{prose(g, 30)}") for i in range(2)], "doc_id long, text string")
    assert [(r.doc_id, r.n_words) for r in substring.repeated_spans(docs).collect()] == [(1, 14)]


def test_copies_of_whole_documents(spark):
    g = random.Random(9)
    t = ". ".join(prose(g, 9).replace(".", "") for _ in range(8))
    docs = spark.createDataFrame([(i, t) for i in range(5)], "doc_id long, text string")
    assert {r.doc_id for r in substring.repeated_spans(docs).collect()} == {1, 2, 3, 4}


def test_words_are_cut_alike():
    g = random.Random(10)
    long = " ".join(prose(g, 1).strip(".,") for _ in range(200))
    a = substring.spans(np.frombuffer(long.encode(), np.uint8), np.array([0, len(long)]), 2, 12)
    shifted = "x y " + long
    b = substring.spans(np.frombuffer(shifted.encode(), np.uint8), np.array([0, len(shifted)]), 2, 12)
    assert len(set(a[1]) & set(b[1])) >= len(a[1]) - 4
    assert pa.array(a[1]).null_count == 0
