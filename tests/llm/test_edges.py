"""Every operator on odd tables: nulls, empty and very long texts, repeated rows, no rows, and columns that are called like its own."""

import itertools
import math
import random
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import prose

from barline.llm import bpe, common, decontaminate, jaccard, language_id, language_model, quality, secret_scan, substring, token_counts
from barline.llm.common import raw, remainder, words

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
OWN_NAMES = "lang string, score string, lang_pred string, found_id string, held_id string, cut_id string, cuts string, id string, hash string, n string, label string, uid string, k0 string, component_id string, set_id string, n_chars long, h string, held_out string"
SCHEMA = f"doc_id long, text string, {OWN_NAMES}"


def odd_rows():
    g = random.Random(3)
    plain = [(i, prose(g, 40)) for i in range(24)]
    long = " ".join(f"w{k % 977}x{k % 13}" for k in range(120_000))
    odd = [(30, None), (31, ""), (32, "   \n"), (None, "a text without an id that is long enough to be one"), (None, None), (33, long), (34, "u" * 60_000), (35, plain[3][1]), (3, plain[3][1]), (3, "another text under one id"), (36, "né 漢字 😀 " * 20)]
    names = len(OWN_NAMES.split(","))
    return [(i, t, *(["aa" if (i or 0) % 2 else "bb"] + ["x"] * (names - 1))) for i, t in plain + odd + [plain[7]]]


@pytest.fixture(scope="module")
def docs(spark):
    k = SCHEMA.split(", ").index("n_chars long")
    return spark.createDataFrame([(*r[:k], len(r[1] or ""), *r[k + 1 :]) for r in odd_rows()], SCHEMA).repartition(3).cache()


def per_row(spark, tmp_path, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(24)], "doc_id long, quality int")
    held = remainder("doc_id", 5) == 0
    yield "op2", lambda d: secret_scan.scan(d, RANKS)
    yield "op3", lambda d: language_model.score(d)
    yield "op4", lambda d: bpe.encode(d, RANKS, public_tokenizers.PATTERN)
    yield "op6", lambda d: quality.score(d, quality.fit(d, labels, ~held), ["doc_id", "score", "k0"])
    yield "op7", lambda d: language_id.predict(d, language_id.fit(d, ~held, per_label=20), ["doc_id", "k0"])
    yield "op9", lambda d: jaccard.join(d)
    yield "op10", lambda d: token_counts.count_tokens(d, public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "cache"))


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op6", "op7", "op9", "op10"])
def test_rows_stay_one_for_one(spark, tmp_path, docs, name):
    run = dict(per_row(spark, tmp_path, docs))[name]
    got = run(docs)
    want = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.select("doc_id").collect())
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.select("doc_id").collect()) == want
    assert run(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["redact", "without_repeats", "without_items", "representatives"])
def test_filters_keep_columns(spark, docs, name):
    items = spark.createDataFrame([(1, "no document holds this item of a few words at all", "x"), (2, None, "x"), (3, "", "x")], "item_id long, text string, id string")
    run = {
        "redact": lambda d: secret_scan.redact(d, RANKS), "without_repeats": substring.without_repeats, "without_items": lambda d: decontaminate.without_items(d, items), "representatives": jaccard.representatives,
    }[name]
    got = run(docs)
    assert got.columns == docs.columns
    n = docs.count()
    assert got.count() == {"redact": n, "without_repeats": n, "without_items": n, "representatives": n - 1}[name]
    assert run(docs.limit(0)).count() == 0


def test_items_without_documents_and_documents_without_items(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, none).count() == 0 and decontaminate.without_items(docs, none).count() == docs.count()
    long = docs.where("doc_id = 33").first().text.split()
    items = spark.createDataFrame([(i, " ".join(long[70_000 : 70_030]).upper()) for i in (5, 6)], "item_id long, text string")  # equal items
    got = decontaminate.contaminated(docs, items).where("doc_id = 33").collect()
    assert {r.item_id for r in got} == {5, 6} and all(r.distance == 0 for r in got)


def test_pipeline_on_odd_rows(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an item of a few words that nobody has")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).where("not exact").count() == 0
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_words_of_long_texts_are_the_same_in_pieces(monkeypatch):
    g = random.Random(1)
    texts = ["".join(g.choice("ab \n\té") for _ in range(g.randint(0, 900))) for _ in range(20)] + ["", "x" * 500]
    whole = words(*raw(pa.array(texts)))
    monkeypatch.setattr(common, "SLICE_BYTES", 64)
    monkeypatch.setattr(common.pieces, "__defaults__", (64,))
    assert all((a == b).all() for a, b in zip(whole, words(*raw(pa.array(texts))), strict=True))


def test_features_of_long_texts_are_the_same_in_pieces(monkeypatch):
    g = random.Random(2)
    buf, off = raw(pa.array([prose(g, g.randint(0, 200)) + " né 漢字" for _ in range(12)] + [""]))
    model = quality.Model(np.random.default_rng(0).normal(size=(quality.BUCKETS, quality.DIMS)).astype(np.float32), np.zeros((quality.DIMS, 2)), np.zeros(2))
    whole = quality.means(model, buf, off)
    monkeypatch.setattr(quality, "PIECE", 50)
    assert np.allclose(whole, quality.means(model, buf, off), atol=1e-6)


def test_character_grams_are_within_words():
    text = "né ab漢字c"
    buf, off = raw(pa.array([text]))
    h, row, start, end = words(buf, off)
    n = [len(ids) for ids, _ in quality.grams(buf, row, start, end)]
    assert n == [sum(max(0, len(w) - k + 1) for w in text.split()) for k in quality.GRAMS][: len(n)]


def test_guess_cost_is_the_least_over_all_segmentations():
    ranks = secret_scan.word_ranks(bpe.read_ranks(RANKS))
    g = random.Random(4)

    def part(text):
        plain = secret_scan.brute(text) if len(text) == 1 else math.inf
        known = secret_scan.segment_cost(text, ranks) if len(text) >= 3 else None
        return min(plain, math.inf if known is None else known + secret_scan.NEW_SEGMENT)

    for _ in range(60):
        value = "".join(g.choice(["pass", "word", "qwe", "19", "84", "aa", "x", "!", "cat"]) for _ in range(4))[:11]
        cuts = range(1, len(value))
        best = min(sum(part(value[a:b]) for a, b in zip((0, *c), (*c, len(value)), strict=True)) for k in range(len(value)) for c in itertools.combinations(cuts, k))
        assert secret_scan.guess_cost(value, ranks) == pytest.approx(best)


def test_repeats_and_walks_of_any_length_stay_cheap():
    ranks = secret_scan.word_ranks(bpe.read_ranks(RANKS))
    for value in ("x" * 100, "x" * 5000, "password" * 4, "qwertyuiop" * 10, "asdfghjkl" * 40, "2019-03-12" * 30):
        assert secret_scan.guess_cost(value, ranks) < 10
        assert secret_scan.guess_spans(f"password is {value}", [], ranks, 10.0) == []
    text = "token is " + "kX9#" * 300_000
    assert [e - s for s, _, e in secret_scan.guess_spans(text, [], ranks, 10.0)] == [1_200_000]
    g = random.Random(9)
    text = "token is " + "".join(chr(g.randint(33, 33 + 90)) for _ in range(400_000)).translate({ord(c): "a" for c in "\"'<>|"})
    assert len(secret_scan.guess_spans(text, [], ranks, 10.0)) == 1


def test_guess_cost_of_long_values_is_the_least_over_all_last_segments():
    ranks = secret_scan.word_ranks(bpe.read_ranks(RANKS))
    g = random.Random(10)
    for _ in range(60):
        value = "".join(g.choice(["pass", "word", "qwe", "rty", "19", "84", "aa", "x", "!", "cat", "asdf", "abab", "2019", "0312", "aaaa", "fdsa"]) * g.choice([1, 1, 2, 12]) for _ in range(g.randint(2, 9)))
        best = [0.0]
        for end in range(1, len(value) + 1):
            parts = [(best[s], secret_scan.segment_cost(value[s:end], ranks)) for s in range(end - 2)]
            best.append(min([best[end - 1] + secret_scan.brute(value[end - 1]), *(b + c + secret_scan.NEW_SEGMENT for b, c in parts if c is not None)]))
        assert secret_scan.guess_cost(value, ranks) == pytest.approx(best[-1])
        for enough in (4.0, 10.0):
            got = secret_scan.guess_cost(value, ranks, enough)
            assert got == pytest.approx(best[-1]) if best[-1] < enough else got >= enough


def brute_spans(rows, run, run_words):
    """Covered stretches (id, first character, end) by comparing every span with every other."""
    spans = []
    for d, text in rows:
        found = [(m.start(), m.end()) for m in re.finditer(r"[^ \n]+", text)]
        if not found:
            continue
        ends = [k for k, (s, e) in enumerate(found) if k + 1 == len(found) or text[e - 1] in ".!?" or "\n" in text[e : found[k + 1][0]]]
        units = list(zip([0, *[e + 1 for e in ends[:-1]]], [e + 1 for e in ends], strict=True))
        for i in range(len(units)):
            j = next((j for j in range(i + run, len(units) + 1) if units[j - 1][1] - units[i][0] >= run_words), None)
            if j is not None:
                a, b = units[i][0], units[j - 1][1]
                # Copies are cut alike: a span is its units.
                key = tuple(tuple(text[s:e].lower() for s, e in found[x:y]) for x, y in units[i:j])
                spans.append((key, d, a, b, found[a][0], found[b - 1][1]))
    first = {}
    for s in sorted(spans, key=lambda s: s[1:3]):
        first.setdefault(s[0], s[1:3])
    out = []
    for _, d, a, b, s, e in sorted((x for x in spans if x[1:3] != first[x[0]]), key=lambda x: x[1:]):
        if out and out[-1][0] == d and a <= out[-1][3]:
            out[-1] = (d, out[-1][1], max(e, out[-1][2]), max(b, out[-1][3]))
        else:
            out.append((d, s, e, b))
    return {(d, s, e) for d, s, e, _ in out}


@pytest.mark.parametrize(("run", "run_words"), [(2, 12), (3, 5), (1, 4)])
def test_repeated_spans_against_brute_force(spark, run, run_words):
    g = random.Random(run)
    pool = [" ".join(prose(g, 1).rstrip(".,") for _ in range(g.randint(1, 9))) + g.choice([".", "!", "?", "\n"]) for _ in range(5)]
    rows = [(d, " ".join(g.choice(pool) if g.random() < 0.7 else prose(g, 6) + "." for _ in range(g.randint(0, 18)))) for d in range(40)]
    got = substring.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), run=run, run_words=run_words).collect()
    want = brute_spans(rows, run, run_words)
    assert {(r.doc_id, r.span_start, r.span_end) for r in got} == want and len(want) > 5


def test_texts_under_one_id_or_none_lose_only_their_own_repeats(spark):
    """Texts that share an id, or have none, are cut each at its own stretches; brute force over keys of their own."""
    g = random.Random(11)
    shared, tail = prose(g, 14).replace(".", "") + ".", prose(g, 15).replace(".", "") + "."
    texts = [f"{shared} {tail}", f"{prose(g, 40)}. It stands here once. {prose(g, 20)}", f"{shared} {prose(g, 25)}", f"{prose(g, 33)}. {tail} {shared}", f"{prose(g, 12)}. {tail} {prose(g, 50)}"]
    for ids in ([1, 2, 2, 3, 3], [1, None, None, None, 2], [5, 5, 5, 5, 5], [None] * 5):
        rows = list(zip(ids, texts, strict=True))
        docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, doc_id long, text string").repartition(3)
        got = {r.k: r.text for r in substring.without_repeats(docs, run=1, run_words=12).collect()}
        own = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) AS d").collect()
        order = sorted(range(5), key=lambda k: (ids[k] is not None, ids[k] or 0, own[k].d))
        cuts = brute_spans([(place, texts[k]) for place, k in enumerate(order)], 1, 12)
        for place, k in enumerate(order):
            want, at = "", 0
            for _, s, e in sorted(c for c in cuts if c[0] == place):
                want, at = want + texts[k][at:s], e
            assert got[k] == want + texts[k][at:]
    again = spark.createDataFrame([(None, texts[0]), (None, texts[0])], "doc_id long, text string")
    assert {r.text for r in substring.without_repeats(again).collect()} == {texts[0]}


def test_hot_keys_join_like_any_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ONE_IN", 4)
    rows = [(i, "hot" if i % 3 else f"k{i % 7}") for i in range(2000)] + [(5000, None), (5001, "lone")]
    left = spark.createDataFrame(rows, "i long, key string")
    right = left.groupBy("key").agg(F.max("i").alias("top"), F.count("*").alias("n")).where("n > 1")
    tops = {r.key: r.top for r in right.collect()}
    got = sorted((r.i, r.key, r.top) for r in common.join_hot(left, right, "key").collect())
    assert got == sorted((i, k, tops[k]) for i, k in rows if k in tops)


@pytest.mark.parametrize("many", [False, True])
def test_model_score_against_a_slow_loop(spark, many):
    """With few words, and with so many that most lie in the groups of the tail."""
    g = random.Random(5)
    more = [f"v{k}" for k in range(9000)] if many else []
    texts = [" ".join(g.choice(["a", "b", "c", "d", *more]) + g.choice(["", "", "x"]) for _ in range(300 if many else 30)) for _ in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    v, _ = language_model.vocabulary(language_model.count_table(docs))
    w = language_model.Weights(v)
    language_model.train_round(docs, w, v, 0.1)
    h, row = language_model.tokens(*raw(pa.array([texts[0], "neverseen a"])))
    _, _, model, rare = language_model.score_rows(h, row, 2, w, v)
    one, two = language_model.history(h, row)
    place = {int(x): int(p) for x, p in zip(v.h, v.place, strict=True)}
    slots, head, slow = language_model.SLOTS, language_model.HEAD, np.zeros(2)

    def share(k, node):
        z = w.word_bias[node].astype(float) + sum(w.words[r[0]].astype(float) for r in language_model.word_rows(one[k : k + 1], two[k : k + 1], np.array([node])))
        return np.exp(z) / np.exp(z).sum()

    for k in range(len(h)):
        z = w.class_bias.astype(float) + sum(w.classes[r[0]].astype(float) for r in language_model.class_rows(one[k : k + 1], two[k : k + 1]))
        classes = np.exp(z) / np.exp(z).sum()
        tail = classes[-1] * share(k, language_model.TAIL)
        words = {p: classes[p // slots] * share(k, p // slots)[p % slots] for p in range(head)}
        assert sum(words.values()) + tail.sum() == pytest.approx(1)
        p = place.get(int(h[k]), -1)
        if 0 <= p < head:
            slow[row[k]] += np.log10(words[p])
        elif p >= head:
            a, b, c = (p - head) // slots**2, (p - head) // slots, (p - head) % slots
            slow[row[k]] += np.log10(tail[a] * share(k, language_model.GROUPS + a)[b % slots] * share(k, language_model.LEAVES + b)[c])
        else:
            slow[row[k]] += np.log10(tail[-1] / v.rest)  # an unseen word's count of 0.1 is added where rare words are counted
    assert np.allclose(slow, model, atol=1e-4) and rare.sum() == 1 + many and (v.place.max() >= head) == many
