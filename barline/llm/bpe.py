"""Byte-level BPE encoding and decoding.

The vocabulary's byte strings, read as Latin-1, form one Aho-Corasick trie. A unit is encoded by taking the longest
token at each place and stepping back to the next shorter prefix whenever two adjacent tokens could not stand beside
each other in a merge sequence. Whether two may is decided by undoing their merges, and remembered. This gives exactly
the ids that repeated lowest-rank merging gives, in time linear in the unit.

Contract: null text counts as empty and gives no ids; rows stay one for one (repeated rows and ids included); other
columns of the input are ignored, so clashing names don't matter; any text is encoded whole. Special tokens are none.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_arrow, prepare

MAX_VOCABULARY_BYTES = 64 << 20
CACHE_UNITS = 1 << 17


class Codec:
    """Encoder and decoder for one rank file and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        # The library's \s is Unicode white space; this engine's own class differs in a few control characters.
        self.pieces = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.runs = regex.compile(r"\p{White_Space}\p{White_Space}")
        self.parts = {i: self._last_merge(t, i) for t, i in ranks.items()}
        self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, i in ranks.items():
            if self.parts[i] is not None:
                self.trie.add_word(t.decode("latin-1"), i)
        self.shorter = lru_cache(CACHE_UNITS)(self._shorter)
        self.adjacent = lru_cache(CACHE_UNITS)(self._adjacent)
        self.trie.make_automaton()
        self.by_text = {t.decode("latin-1"): i for t, i in ranks.items() if self.parts[i] is not None}
        self.size = {i: len(t) for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.sizes = np.zeros(max(self.size) + 1, np.int64)
        self.sizes[list(self.size)] = list(self.size.values())
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(self.tokens[i] for i in sorted(self.tokens)), np.uint8)
        self.known: dict[str, bytes] = {}  # of units after a blank
        self.short: dict[str, bytes] = {}  # of pre-tokens

    def merged(self, unit: bytes, below: int) -> list[bytes]:
        """Plain merging with ranks under ``below``; only for building the tables."""
        parts = [unit[k : k + 1] for k in range(len(unit))]
        while len(parts) > 1:
            best = min(((self.ranks.get(a + b, below), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] >= below:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; itself twice for a byte; None if no merge sequence ends there."""
        if len(token) == 1:
            return rank, rank
        parts = self.merged(token, rank)
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def _shorter(self, token: int) -> int | None:
        text = self.tokens[token]
        return next((i for n in range(len(text) - 1, 0, -1) if (i := self.ranks.get(text[:n])) is not None and self.parts[i] is not None), None)

    def _adjacent(self, left: int, right: int) -> bool:
        """True unless merging would have joined bytes across the border of the two tokens."""
        limit = len(self.ranks) + 1
        while True:
            both = self.ranks.get(self.tokens[left] + self.tokens[right])
            if both is not None and both < limit:
                return False
            # Undo the later of the two merges; what lies across the border must have waited at least that long.
            undo_left = left > right if self._splits(left) and self._splits(right) else self._splits(left)
            if undo_left:
                limit, left = left, self.parts[left][1]
            elif self._splits(right):
                limit, right = right + 1, self.parts[right][0]
            else:
                return True

    def _splits(self, token: int) -> bool:
        return self.parts[token][0] != token

    def _longest(self, text: str, at: int) -> int:
        rest = text[at : at + self.longest]  # a slice of the whole rest would make long units quadratic
        n = self.trie.longest_prefix(rest)
        while (i := self.by_text.get(rest[:n])) is None:  # the trie path may run past the last whole token
            n -= 1
        return i

    def unit(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text = piece.decode("latin-1")
        # The automaton's run of longest matches is the answer up to the first border that doesn't hold.
        ids = [i for _, i in self.trie.iter_long(text)]
        adjacent = self.adjacent
        for k in range(1, len(ids)):
            if not adjacent(ids[k - 1], ids[k]):
                return self._backtrack(text, ids[:k], ids[k])
        return ids

    def _backtrack(self, text: str, ids: list[int], token: int | None) -> list[int]:
        """Go on after ``ids``, where ``token`` is the longest match."""
        size, adjacent, shorter, n = self.size, self.adjacent, self.shorter, len(text)
        at, dead = sum(map(size.__getitem__, ids)), set()
        while at < n:
            while token is not None:
                end = at + size[token]
                if end not in dead and (not ids or adjacent(ids[-1], token)):
                    break
                token = shorter(token)
            if token is None:
                dead.add(at)
                token = ids.pop()
                at -= size[token]
            else:
                ids.append(token)
                at = end
                token = self._longest(text, at) if at < n else None
        return ids

    def _packed(self, unit: str) -> bytes:
        out = []
        for piece in self.pieces.findall(unit):
            ids = self.short.get(piece)
            if ids is None:
                got = self.unit(piece.encode())
                ids = struct.pack(f"<{len(got)}I", *got)
                if len(self.short) >= CACHE_UNITS:
                    self.short.clear()
                if len(piece) <= 32:
                    self.short[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers.

        No pre-token crosses a single blank except by taking it as its first character, so a text without runs of white
        space is cut before its blanks and each distinct unit is encoded once.
        """
        if self.runs.search(text):
            return self._packed(text)
        head, *rest = text.split(" ")
        known = self.known
        got = list(map(known.get, rest))
        if None in got:
            for k, ids in enumerate(got):
                if ids is None:
                    w = rest[k]
                    got[k] = ids = self._packed(" " + w)
                    if len(known) >= CACHE_UNITS:
                        known.clear()
                    if len(w) <= 64:
                        known[w] = ids
        return self._packed(head) + b"".join(got)

    def decode(self, ids: bytes) -> bytes:
        k = np.frombuffer(ids, "<u4")
        size = self.sizes[k]
        end = np.cumsum(size)
        if not len(k):
            return b""
        return self.blob[np.arange(end[-1]) + np.repeat(self.starts[k] - (end - size), size)].tobytes()


def read_ranks(path: str) -> bytes:
    """The rank file's content; its size is checked, as every executor gets it."""
    with open(path, "rb") as f:
        content = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return content


@lru_cache(2)
def codec(content: bytes, pattern: str) -> Codec:
    """One codec per process."""
    return Codec({base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, content.splitlines()))}, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256, exact) per row, and ``ids`` if asked for; ``exact``: the ids decode to the text."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(read_ranks(path))
    kind = dict(docs.dtypes)[id_col]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(shared.value, pattern)
        cols: list[list] = [[], [], [], [], []]
        for value in b.column(1):
            text = value.as_py() or ""
            ids = c.encode(text)
            back = c.decode(ids)
            got = [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest(), back == text.encode()]
            for k, v in enumerate(got):
                cols[k].append(v)
            if with_ids:
                cols[4].append(np.frombuffer(ids, "<u4").astype(np.int32))
        out = [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_())]
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"]
        if with_ids:
            out.append(pa.array(cols[4], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(out, names)

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    got = map_arrow(picked, run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, exact boolean" + ", ids array<int>" * with_ids)
    return got.withColumnRenamed("id", id_col)
