"""The filter audit and vector codes against plain loops, on odd tables too."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest
from test_corpus_operators import prose

from barline.llm import filter_audit, vector_codes


def plain_audit(rows, labels):
    """All rows of the audit, document by document and order by order."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    docs = []
    for i, text, source in rows:
        x = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", x)) > 5 * len(x), "D": bool(re.search("[#$%&*|]", x)), "E": i is not None and first[x] < i}
        mine = [r for r in labels if i is not None and r[0] == i]
        docs.append((source or "", {f for f in bad if bad[f]}, any(r[1] == 1 for r in mine), any(r[2] == 1 for r in mine)))
    out = {}
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                here = [d for d in docs if d[0] == part]
                there = [d for d in here if not d[1] & set(order[:k])]
                lost = [d for d in there if f in d[1]]
                out[part, "".join(order), k + 1] = [
                    len(there) - len(lost), len(lost), sum(f in d[1] for d in here) - len(lost), sum(d[1] == {f} for d in here), sum(d[2] for d in lost), sum(d[3] for d in lost),
                ]
    shapley = {}
    for (part, order, step), v in out.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + v[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "doc_id long, text string, source string, part string, mask int, good boolean").repartition(3)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", *filter_audit.SUMS, "shapley"]
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()}


def test_audit_against_a_plain_loop(spark):
    g = random.Random(8)
    texts = [prose(g, g.choice([3, 49, 50, 51, 80])) for _ in range(25)]
    texts += [t.upper() for t in texts[:4]] + [t + " 5% off" for t in texts[4:8]] + ["ab " * 60, "Ab " * 60, "AB| " * 70, "", None, " \t\n", "é" * 40, "w1 w2 " * 100_000]
    rows = [(k, t, g.choice(["a", "b", "", None])) for k, t in enumerate(texts)]
    rows += [(100 + k, g.choice(texts), g.choice(["a", "b"])) for k in range(40)] + [(7, texts[7], "a"), (3, texts[9], "b"), (None, texts[2], "a"), (None, None, None), (None, "only without an id", "b")]
    labels = [(k, g.choice([0, 1, None]), g.choice([0, 1, None])) for k in range(0, 130, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]
    want = plain_audit(rows, labels)
    assert audited(spark, rows, labels) == want and len(want) == 600 * 3
    assert audited(spark, [], labels) == {} and audited(spark, rows, []) == plain_audit(rows, [])


def plain_codes(rows, parts, entries, rounds, scale):
    kept = [(i, lab, np.floor(np.array(v, float) * scale).astype(np.int64)) for i, lab, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2].tolist()))
    points = np.split(np.array([v for _, _, v in kept]), parts, 1)
    books = [p[:entries].copy() for p in points]
    for k in range(rounds + 1):
        codes = [((p[:, None] - b) ** 2).sum(2).argmin(1) for p, b in zip(points, books, strict=True)]
        errors = sum(((p - b[c]) ** 2).sum(1) for p, b, c in zip(points, books, codes, strict=True))
        if k < rounds:
            for p, b, c in zip(points, books, codes, strict=True):
                for e in set(c.tolist()):
                    b[e] = p[c == e].sum(0) // (c == e).sum()
    total = {}
    for (_, lab, _), e in zip(kept, errors, strict=True):
        total[lab] = total.get(lab, 0) + int(e)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    return sorted(((i, "".join(f"{c[n]:02x}" for c in codes), int(errors[n]), total[lab], digest) for n, (i, lab, _) in enumerate(kept)), key=str)


@pytest.mark.parametrize(("parts", "entries", "rounds", "spread", "block"), [(4, 16, 4, 0.05, 300), (2, 200, 3, 1.0, 2048), (1, 5, 0, 0.3, 50), (4, 40, 4, 0.002, 64), (2, 9, 4, 3000.0, 2048), (2, 9, 4, 90_000.0, 2048)])
def test_codes_against_plain_rounds(spark, monkeypatch, parts, entries, rounds, spread, block):
    """Clusters of several widths (the narrowest gives many equal integers, so ties), in doubles and in 64-bit integers."""
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    g = np.random.default_rng(parts * entries)
    centres = g.normal(size=(12, 8))
    rows = [(k, None if k % 7 == 0 else k % 3, (centres[k % 12] + spread * g.uniform(-1, 1, 8)).tolist()) for k in range(700)]
    rows += [rows[5], rows[5], (5, 1, [0.0] * 8), (None, 2, rows[9][2]), (900, None, None), (901, 1, [None] * 8), (902, 1, [float("nan")] * 8), (903, 1, [float("inf")] + [0.0] * 7), (904, 1, [])]
    table = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "vec_id long, label int, embedding array<double>, code string, key string, n int").repartition(3)
    got = vector_codes.compress(table, parts, entries, rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_codes(rows, parts, entries, rounds, 1024)


def test_codes_of_few_and_no_vectors(spark):
    schema = "vec_id long, label int, embedding array<float>"
    rows = [(3, 1, [1.0, 2.0]), (3, 1, [1.0, 2.0]), (4, None, [-1.5, 0.25])]
    got = vector_codes.compress(spark.createDataFrame(rows, schema), parts=2)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_codes(rows, 2, 256, 4, 1024)
    assert vector_codes.compress(spark.createDataFrame([(1, 1, None)], schema)).count() == 0
    mixed = spark.createDataFrame([*rows, (5, 1, [1.0, 2.0, 3.0])], schema)
    assert vector_codes.compress(mixed, parts=2).count() == 3
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(mixed, parts=4)
    with pytest.raises(ValueError, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, 1, [1e30, 0.0])], schema), parts=2)


def test_boxes_and_cached_sums_save_distances(monkeypatch):
    """In tight clusters whole subtrees go to one entry: few points are looked at, and none is lost."""
    g = np.random.default_rng(3)
    points = (np.repeat(g.integers(-5000, 5000, (16, 6)), 256, 0) + g.integers(-20, 20, (4096, 6))).astype(np.float64)
    tree, seen = vector_codes.Tree.built(points.astype(np.int64)), []
    near = vector_codes.nearest
    monkeypatch.setattr(vector_codes, "nearest", lambda p, e: (seen.append(len(p)), near(p, e))[1])
    tree = vector_codes.Tree.read(tree.packed(), 6, np.float64)
    sums, counts = tree.sums_by_entry(points[::256])
    assert counts.tolist() == [256] * 16 and (sums == points.reshape(16, 256, 6).sum(1)).all() and sum(seen) < 400
