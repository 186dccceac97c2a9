"""Texts of over 3 MB, which the operators hash in pieces, and leaders whose stars hold most sets."""

import random

import public_tokenizers
import pytest
import tokenizers
from test_corpus_operators import prose

from barline.llm import decontaminate, jaccard, language_model, substring, token_counts
from barline.llm.common import SLICE_BYTES

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows():
    g = random.Random(21)
    long = " ".join(f"q{g.getrandbits(34):x}" for _ in range(320_000))
    passage = prose(g, 60).replace(".", "") + "."
    assert len(long) > max(2 * SLICE_BYTES, 3_000_000)
    return [(1, f"{long}. {passage}"), (2, f"{long} onemore"), (4, f"{prose(g, 30)}. {passage} {prose(g, 30)}"), (7, prose(g, 50))], passage


def test_join_and_counts_of_words(spark, rows):
    texts, _ = rows
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()}
    for d, t in texts:
        w = t.lower().split()
        assert got[d] == (len(set(zip(w, w[1:], w[2:], strict=False))), 1 if d == 2 else d)
    taught = {r.doc_id: (r.n_tokens, r.train_tokens) for r in language_model.score(docs, held_mod=1000).select("doc_id", "n_tokens", "train_tokens").collect()}
    n = {d: len(t.split()) + 1 for d, t in texts}
    assert taught == {d: (n[d], sum(n.values())) for d in n}


def test_tokens(spark, rows, tmp_path):
    texts, _ = rows
    library = tokenizers.Tokenizer.from_file(WORD_BPE)
    got = token_counts.count_tokens(spark.createDataFrame(texts, "doc_id long, text string"), WORD_BPE, str(tmp_path / "cache")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == {d: (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for d, t in texts}


def test_passages_at_the_end(spark, rows):
    """What repeats behind three megabytes is found, by spans and by benchmark items."""
    texts, passage = rows
    docs = spark.createDataFrame(texts[::2] + texts[3:], "doc_id long, text string")
    body = dict(texts)
    spans = [(r.doc_id, body[r.doc_id][r.span_start : r.span_end]) for r in substring.repeated_spans(docs).collect()]
    assert {d for d, _ in spans} == {4} and sum(len(t.split()) for _, t in spans) >= 55
    items = spark.createDataFrame([("i", passage)], "item_id string, text string")
    assert {r.doc_id for r in decontaminate.contaminated(docs, items).select("doc_id").collect()} == {1, 4}


@pytest.mark.parametrize("hot", [True, False])
def test_most_sets_lie_in_one_star(spark, monkeypatch, hot):
    """Three hundred texts of one base meet in its star; copies of a hot leader's tokens find the same links as one copy."""
    g = random.Random(4)
    base = [f"b{k}" for k in range(60)]
    made = [(k, " ".join(base + [f"end{k}"])) for k in range(300)] + [(500 + k, " ".join(f"o{g.random()}" for _ in range(40))) for k in range(20)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    if not hot:
        monkeypatch.setattr(jaccard, "HOT_ONE_IN", 1e-9)  # no leader is hot
    got = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    assert got == {d: 0 if d < 300 else d for d, _ in made}
