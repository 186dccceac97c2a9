"""The streaming transducers against the library, and the lookahead against all short texts of small merge lists."""

import codecs
import hashlib
import itertools
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import prose
from tokenizers import Tokenizer

from barline.llm import stream_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return stream_bpe.model(f.read())


def streamed(model, parts):
    enc = stream_bpe.Encoder(model)
    return np.frombuffer(b"".join([*(enc.push(p) for p in parts), enc.finish()]), "<u4").tolist()


def cut(g, text, most):
    at = 0
    while at < len(text):
        n = g.randint(1, most)
        yield text[at : at + n]
        at += n


def odd_texts(g):
    bits = [" ", "  ", "\n", "\t", "\r\n", " ", " ", "　", "\u0085", "'", "'s", "'re", "'LL", "a", "word", "Zürich", "漢字", "😀", "́", "12", "³", "½", "...", "<|endoftext|>", "<|endof", "<|", "|>", "\x00", "\x1c", "​", "-", "ll", "r", "e"]
    for _ in range(400):
        yield "".join(g.choice(bits) for _ in range(g.randint(0, 40)))
    for one in ["a", "x1", " ", "\n", "\t ", "'", "漢", "!?", "ab" * 9, "9", "́", " \n", "'r"]:
        yield one * 7000
        yield "head " + one * 3000 + " tail" + one * 2
        yield one * 3000 + "'ve <|endoftext|>" + one * 300


def test_encoder_agrees_with_the_library_however_text_is_cut(library, model):
    g = random.Random(1)
    for text in odd_texts(g):
        want = library.encode(text, add_special_tokens=False).ids
        for most in (3, 400, 5000):
            if most > 3 or len(text) < 2000:
                assert streamed(model, cut(g, text, most)) == want, text[:80]


def test_character_classes_agree_with_the_library(library, model):
    """Unassigned characters may differ between Unicode versions and are left out."""
    known = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    for k in range(0, len(known), 2000):
        text = "".join(f"a{c}1{c}" for c in known[k : k + 2000])
        assert streamed(model, [text]) == library.encode(text, add_special_tokens=False).ids


def plain(merges, data):
    parts = list(data)
    for a, b in merges:
        k = 0
        while k + 1 < len(parts):
            if parts[k] == a and parts[k + 1] == b:
                parts[k : k + 2] = [a + b]
            k += 1
    return parts


@pytest.mark.parametrize("seed", range(12))
def test_tokens_before_the_lookahead_never_change(seed):
    """All texts of two letters up to 13: what is stable in a beginning stands in every text that begins so."""
    g = random.Random(seed)
    tokens, merges = ["a", "b"], []
    while len(merges) < 7:
        a, b = g.choice(tokens), g.choice(tokens)
        if a + b not in tokens and len(a + b) <= 5:
            merges.append((a, b))
            tokens.append(a + b)
    number = {t: k for k, t in enumerate(tokens)}
    base = [number["a"] if k == 97 else number["b"] for k in range(256)]
    m = stream_bpe.MergeList(base, [(number[a], number[b], number[a + b]) for a, b in merges], {k: len(t) for k, t in enumerate(tokens)})
    encoded = {}
    for n in range(1, 14):
        for letters in itertools.product("ab", repeat=n):
            text = "".join(letters)
            encoded[text] = ids = [number[t] for t in plain(merges, text)]
            assert m._by_scan([base[ord(c)] for c in text]) == ids and m._by_heap([base[ord(c)] for c in text]) == ids
            before, at = encoded.get(text[:-1], []), 0
            for k, i in enumerate(before):
                at += m.size[i]
                if at > n - 1 - m.lookahead:
                    break
                assert ids[k] == i
    m.window = m.lookahead + 8
    t = stream_bpe.Transducer(m)
    long = "".join(g.choice("ab") for _ in range(3000))
    got = [i for p in cut(g, long, 5) for i in t.push(p.encode()) if len(t.held) <= m.window + 5] + t.finish()
    assert got == [number[t] for t in plain(merges, long)]


def test_long_units_are_held_in_bounded_space(library, model):
    g = random.Random(2)
    text = "".join(chr(g.choice([97, 98, 101, 116, 0xE9, 0x6F22])) for _ in range(200_000))
    enc, most, ids = stream_bpe.Encoder(model), 0, []
    for part in cut(g, text, 900):
        ids += np.frombuffer(enc.push(part), "<u4").tolist()
        most = max(most, len(enc.pending) + len(enc.held) + (len(enc.run[1].held) if enc.run else 0))
    assert most <= 3 * model.merges.window
    assert ids + np.frombuffer(enc.finish(), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_decoder_is_incremental_and_lossy_like_the_library(library, model):
    g = random.Random(3)
    alphabet = [0x41, 0x80, 0x9F, 0xA0, 0xBF, 0xC1, 0xC3, 0xE0, 0xE2, 0xED, 0xEF, 0xF0, 0xF1, 0xF4, 0xF5, 0xFF, 0x82, 0xAC]
    for _ in range(3000):
        data = bytes(g.choice(alphabet) for _ in range(g.randint(0, 12)))
        dec, std = stream_bpe.Decoder(model), codecs.getincrementaldecoder("utf-8")("replace")
        out, want = "", ""
        for k in range(len(data)):
            out += dec.push_bytes(data[k : k + 1])
            want += std.decode(data[k : k + 1])
            assert len(dec.held) < 4
        assert out + dec.finish() == want + std.decode(b"", True) == data.decode("utf-8", "replace")
    for _ in range(200):
        ids = [g.randrange(50257) for _ in range(g.randint(0, 20))]
        dec = stream_bpe.Decoder(model)
        got = "".join(dec.push(stream_bpe.pack([i])) for i in ids) + dec.finish()
        assert got == library.decode(ids, skip_special_tokens=False)


def test_frames_round_trip(spark, library):
    g = random.Random(4)
    texts = [prose(g, 50), None, "", prose(g, 5) + "<|endoftext|>" + prose(g, 5), "né 漢字 😀 \n\n  x", "u" * 150_000, " ".join(f"w{k % 977}" for k in range(700_000)), prose(g, 50)]
    rows = [(k if k != 4 else None, t, "x", 7) for k, t in enumerate(texts)] + [(0, texts[0], "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, n_tokens int").repartition(3)
    got = stream_bpe.encode(docs, PATH, with_ids=True).cache()
    assert got.count() == len(rows) and got.where("not exact").count() == 0
    for r in got.collect():
        text = (texts[r.doc_id] if r.doc_id is not None else texts[4]) or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.text for r in stream_bpe.decode(got.withColumn("text", F.lit(1)), PATH).collect()}
    assert all(back[k] == (texts[k] or "") for k in (0, 1, 2, 3, 5, 6, 7))
    assert stream_bpe.encode(docs.limit(0), PATH).count() == 0


def test_a_list_out_of_order_is_refused():
    with pytest.raises(ValueError, match="no earlier merge"):
        stream_bpe.MergeList([0] * 256, [(1, 0, 2), (0, 0, 1)], {0: 1, 1: 2, 2: 3})
