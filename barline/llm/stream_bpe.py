"""BPE encoding and decoding as bounded-lookahead streaming transducers.

How far a byte can reach back is a property of the merge list. Take two texts that share their first n bytes and apply the merges
rank by rank. The border p up to which both agree starts at n and moves only when a merge (u, v) crosses it in one text alone: u ends
at p, v begins there, and p falls by len(u). The next move needs a later merge (u', v') whose v' begins with what now stands at p, so u
lies on the left spine of v'. The heaviest chain of such merges, found in one pass over the list, is the sufficient ``lookahead``: a
token of the first n bytes that ends at or before n - lookahead stays whatever follows, and can be emitted.

The encoder takes a text in pieces of any size. Its state is bounded: text whose pre-tokens may still change, and, within a pre-token
that is longer than the window, the bytes behind the last stable token. Emitted ids are never taken back. The decoder's state is the
bytes of one unfinished character.

Contract: null text counts as empty and gives no ids; rows stay one for one (repeated rows and ids included); other columns of the
input are ignored; any text is encoded whole. Special tokens inside texts are taken as the tokenizer file says; bytes that are no UTF-8
decode to U+FFFD, one for each longest broken beginning of a character.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import read_ranks
from .common import map_arrow, prepare

CHUNK = 1 << 16
#: Pre-tokens and units that are remembered in each of two generations: the newer one is filled, and takes over what is used of the older.
CACHE_PIECES, CACHE_UNITS = 1 << 18, 1 << 17
#: Fixed value: how the byte-level tokenizers cut text before their merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Runs that a pre-token goes on with, by the kind of its last character.
RUNS = [regex.compile(r"\p{L}+"), regex.compile(r"\p{N}+"), regex.compile(r"\p{White_Space}+"), regex.compile(r"[^\p{White_Space}\p{L}\p{N}]+")]
SPACES = 2
_PIECES = regex.compile(PIECES)
#: A blank inside or at the end of a run of white space: the text can't be cut before it.
_INNER_BLANK = regex.compile(r"\p{White_Space} (?!\P{White_Space})")
_SPACE = regex.compile(r"\p{White_Space}")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the file: itself if it prints, else the next free one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


class MergeList:
    """Merges by pair of ids, and what can be known of them beforehand."""

    def __init__(self, base: list[int], merges: list[tuple[int, int, int]], size: dict[int, int]):
        """``base``: the id of each byte; ``merges``: (left, right, made) by rank; ``size``: bytes of each id."""
        self.base, self.size = base, size
        self.rank = {(a, b): rank for rank, (a, b, _) in enumerate(merges)}
        self.token = [made for _, _, made in merges]
        made_by: dict[int, list[int]] = {i: [] for i in base}
        for a, b, made in merges:
            if a not in made_by or b not in made_by:
                raise ValueError("a merge uses a token that no earlier merge makes")
            made_by.setdefault(made, []).append(a)
        self.lookahead = self._heaviest_chain(merges, made_by)
        self.window = max(8 * self.lookahead, 1024)

    def _heaviest_chain(self, merges: list[tuple[int, int, int]], lefts: dict[int, list[int]]) -> int:
        reach: dict[int, int] = {}  # the heaviest chain so far whose last merge has this left token
        for a, b, _ in merges:
            spine, top, seen = [b], 0, set()
            while spine:
                t = spine.pop()
                if t not in seen:
                    seen.add(t)
                    top = max(top, reach.get(t, 0))
                    spine.extend(lefts.get(t, ()))
            reach[a] = max(reach.get(a, 0), self.size[a] + top)
        return max(reach.values(), default=0)

    def merged(self, data: bytes) -> list[int]:
        """Ids of the bytes as they stand: the lowest rank first, the leftmost of equals."""
        ids = list(map(self.base.__getitem__, data))
        return self._by_scan(ids) if len(ids) <= 64 else self._by_heap(ids)

    def _by_scan(self, ids: list[int]) -> list[int]:
        get, token, none = self.rank.get, self.token, len(self.token)
        ranks = list(map(get, zip(ids, ids[1:], strict=False), repeat(none)))
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            ids[k : k + 2] = [token[best]]
            del ranks[k]
            if k:
                ranks[k - 1] = get((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = get((ids[k], ids[k + 1]), none)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        get, n = self.rank.get, len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(rank, k) for k in range(n - 1) if (rank := get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            right = after[k]
            if ids[k] < 0 or right < 0 or get((ids[k], ids[right])) != rank:
                continue  # one of the two was merged meanwhile
            ids[k], ids[right], after[k] = self.token[rank], -1, after[right]
            if after[k] >= 0:
                before[after[k]] = k
                if (later := get((ids[k], ids[after[k]]))) is not None:
                    heapq.heappush(heap, (later, k))
            if before[k] >= 0 and (later := get((ids[before[k]], ids[k]))) is not None:
                heapq.heappush(heap, (later, before[k]))
        return [i for i in ids if i >= 0]


class Transducer:
    """Bytes of one pre-token in, stable ids out; never holds more than a window."""

    def __init__(self, merges: MergeList):
        self.merges, self.held = merges, b""

    def push(self, data: bytes) -> list[int]:
        """Ids that no later byte can change."""
        out, m = [], self.merges
        for at in range(0, len(data), m.window):
            self.held += data[at : at + m.window]
            if len(self.held) >= m.window:
                done, stable = 0, len(self.held) - m.lookahead
                for i in m.merged(self.held):
                    if done + m.size[i] > stable:
                        break
                    done += m.size[i]
                    out.append(i)
                self.held = self.held[done:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.merges.merged(self.held), b""
        return out


class Model:
    """What a tokenizer file says, with the ids of short pre-tokens remembered."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        cut, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = cut.get("type") == "ByteLevel" and not cut["add_prefix_space"] and cut.get("use_regex", True) and spec["normalizer"] is None
        plain &= model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        added = spec["added_tokens"]
        if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("not a plain byte-level BPE file")
        byte = {c: b for b, c in enumerate(byte_letters())}
        vocab = model["vocab"]
        content_of = {i: bytes(map(byte.__getitem__, t)) if all(c in byte for c in t) else t.encode() for t, i in [*vocab.items(), *((t["content"], t["id"]) for t in added)]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = MergeList([vocab[c] for c in byte], [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], {i: len(t) for i, t in content_of.items()})
        self.special = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, longest_first))) if added else None
        self.starts = {t[:k] for t in self.special for k in range(1, len(t))}
        self.longest_start = max(map(len, self.starts), default=0)
        self.sizes = np.zeros(max(content_of) + 1, np.int64)
        self.sizes[list(content_of)] = [len(t) for t in content_of.values()]
        self.at = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(content_of[i] for i in sorted(content_of)), np.uint8)
        self.decimal = [str(i) for i in range(len(self.sizes))]
        self.known: dict[str, bytes] = {}  # of units after a blank
        self.short: dict[str, bytes] = {}  # of pre-tokens
        self.older_known, self.older_short = self.known, self.short

    def piece(self, text: str) -> bytes:
        got = self.short.get(text)
        if got is None:
            got = self.older_short.get(text)
            if got is None:
                data = text.encode()
                if len(data) < self.merges.window:  # nothing would be emitted before its end
                    got = pack(self.merges.merged(data))
                else:
                    t = Transducer(self.merges)
                    got = pack(t.push(data) + t.finish())
            if len(text) <= 32:
                if len(self.short) >= CACHE_PIECES:
                    self.older_short, self.short = self.short, {}
                self.short[text] = got
        return got

    def pieces(self, text: str) -> bytes:
        return b"".join(map(self.piece, _PIECES.findall(text)))

    def units(self, text: str) -> bytes:
        """Ids of text that begins and ends at pre-token borders. It is cut before its blanks: each ends a pre-token, but inside white space."""
        if _INNER_BLANK.search(text):
            return self.pieces(text)
        head, *rest = text.split(" ")
        got = list(map(self.known.get, rest))
        if None in got:
            for k, ids in enumerate(got):
                if ids is None:
                    w = rest[k]
                    got[k] = ids = self.older_known.get(w) or self.pieces(" " + w)
                    if len(w) <= 64:
                        if len(self.known) >= CACHE_UNITS:
                            self.older_known, self.known = self.known, {}
                        self.known[w] = ids
        return self.pieces(head) + b"".join(got)


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Text in, ids (little-endian unsigned 32-bit) out, as soon as they are stable."""

    def __init__(self, model: Model):
        self.model, self.pending, self.held = model, "", ""
        self.run: tuple[int, Transducer] | None = None

    def push(self, text: str) -> bytes:
        m, buf, at, out = self.model, self.held + text, 0, []
        while found := m.specials.search(buf, at) if m.specials else None:
            if buf[found.start() :] in m.starts:  # a longer special token may follow
                break
            out += [self._segment(buf[at : found.start()], True), pack([m.special[found[0]]])]
            at = found.end()
        n = next((k for k in range(min(m.longest_start, len(buf) - at), 0, -1) if buf[len(buf) - k :] in m.starts), 0)
        self.held = buf[len(buf) - n :]
        out.append(self._segment(buf[at : len(buf) - n], False))
        return b"".join(out)

    def finish(self) -> bytes:
        m, at, out = self.model, 0, []
        for found in m.specials.finditer(self.held) if m.specials else ():
            out += [self._segment(self.held[at : found.start()], True), pack([m.special[found[0]]])]
            at = found.end()
        rest, self.held = self.held[at:], ""
        return b"".join([*out, self._segment(rest, True)])

    def _segment(self, text: str, last: bool) -> bytes:
        """More text between special tokens; ``last``: the next one, or the end, comes after it."""
        m, t, out, self.pending = self.model, self.pending + text, [], ""
        if self.run:
            kind, transducer = self.run
            found = RUNS[kind].match(t)
            end = found.end() if found else 0
            if end == len(t) and not last:
                keep = min(end, int(kind == SPACES))
                self.pending = t[end - keep :]
                return pack(transducer.push(t[: end - keep].encode()))
            if kind == SPACES and end < len(t):  # the last of the run goes with what follows
                end -= 1
            out.append(pack(transducer.push(t[:end].encode()) + transducer.finish()))
            t, self.run = t[end:], None
        if last:
            return b"".join([*out, m.units(t)])
        cut = len(t)
        while (cut := t.rfind(" ", 0, cut)) > 0 and _SPACE.match(t[cut - 1]):
            pass
        if cut > 0:
            out.append(m.units(t[:cut]))
            t = t[cut:]
        if len(t) > m.merges.window:
            t = self._long(t, out)
        self.pending = t
        return b"".join(out)

    def _long(self, t: str, out: list[bytes]) -> str:
        """No blank to cut before: emit all pre-tokens but the last (and a quote before it), and begin a run if that is long."""
        *done, tail = _PIECES.findall(t)
        if len(tail) <= self.model.merges.window:
            quote = done.pop() if done and done[-1] == "'" else ""
            out.extend(map(self.model.piece, done))
            return quote + tail
        out.extend(map(self.model.piece, done))
        kind = next(k for k, r in enumerate(RUNS) if r.match(tail[-1]))
        transducer, keep = Transducer(self.model.merges), len(tail) - int(kind == SPACES)
        out.append(pack(transducer.push(tail[:keep].encode())))
        self.run = kind, transducer
        return tail[keep:]


class Decoder:
    """Ids in, text out as soon as its characters are whole."""

    def __init__(self, model: Model):
        self.model, self.held = model, b""

    def push(self, ids: bytes) -> str:
        m, k = self.model, np.frombuffer(ids, "<u4")
        size = m.sizes[k]
        end = np.cumsum(size)
        data = m.blob[np.arange(end[-1]) + np.repeat(m.at[k] - (end - size), size)].tobytes() if len(k) else b""
        return self.push_bytes(data)

    def push_bytes(self, data: bytes) -> str:
        data = self.held + data
        n = unfinished(data[-3:])
        self.held = data[len(data) - n :]
        return data[: len(data) - n].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


def unfinished(tail: bytes) -> int:
    """How many last bytes (three at most) are the right beginning of a character that isn't whole."""
    for n in range(1, len(tail) + 1):
        lead = tail[-n]
        if 0x80 <= lead < 0xC0:
            continue  # inside a character: look for its first byte
        needs = 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 1
        if n >= needs:
            return 0
        second = {0xE0: (0xA0, 0xC0), 0xED: (0x80, 0xA0), 0xF0: (0x90, 0xC0), 0xF4: (0x80, 0x90)}.get(lead, (0x80, 0xC0))
        return n if n == 1 or second[0] <= tail[1 - n] < second[1] else 0
    return 0


@lru_cache(2)
def model(content: bytes) -> Model:
    """One model per process."""
    return Model(content)


def chunks(text: str):
    return (text[k : k + CHUNK] for k in range(0, len(text), CHUNK))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, exact) per row, and ``ids`` if asked for; ``exact``: the ids decode to the text.

    ``ids_sha256`` is of the decimal ids joined by commas. Without ``ids``, no more of a row's ids is held than those of one chunk.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(read_ranks(path))
    kind = dict(docs.dtypes)[id_col]

    def row(m: Model, text: str) -> tuple[int, str, str, bool, list[bytes]]:
        enc, dec, n, same, kept = Encoder(m), Decoder(m), 0, True, []
        of_ids, of_text, at = hashlib.sha256(), hashlib.sha256(), 0

        def emit(ids: bytes, end: bool) -> None:
            nonlocal n, same, at
            if ids:
                of_ids.update(("," * bool(n) + ",".join(map(m.decimal.__getitem__, np.frombuffer(ids, "<u4").tolist()))).encode())
                n += len(ids) // 4
                if with_ids:
                    kept.append(ids)
            back = dec.push(ids) + (dec.finish() if end else "")
            of_text.update(back.encode())
            same &= text.startswith(back, at)
            at += len(back)

        for part in chunks(text):
            emit(enc.push(part), False)
        emit(enc.finish(), True)
        return n, of_ids.hexdigest(), of_text.hexdigest(), same and at == len(text), kept

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m = model(shared.value)
        got = [row(m, value.as_py() or "") for value in b.column(1)]
        n, ids, back, exact, kept = zip(*got, strict=True)
        out = [b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back), pa.array(exact)]
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"]
        if with_ids:
            out.append(pa.array([np.frombuffer(b"".join(k), "<u4").astype(np.int32) for k in kept], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(out, names)

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    got = map_arrow(picked, run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, exact boolean" + ", ids array<int>" * with_ids)
    return got.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of each row's ids; null ids give an empty text, an id that the file doesn't have is an error."""
    spark = prepare(encoded.sparkSession)
    shared = spark.sparkContext.broadcast(read_ranks(path))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        m, texts = model(shared.value), []
        for value in b.column(1):
            ids = np.asarray(value.values if value.is_valid else [], "<u4")
            dec = Decoder(m)
            texts.append("".join([*(dec.push(ids[k : k + CHUNK].tobytes()) for k in range(0, len(ids), CHUNK)), dec.finish()]))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    picked = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    return map_arrow(picked, run, f"id {dict(encoded.dtypes)[id_col]}, text string").withColumnRenamed("id", id_col)
