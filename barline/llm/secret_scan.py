"""Secret scans: pattern spans, and values in credential contexts judged by their guess cost.

The guess cost of a value is the least log10 number of guesses over all its segmentations into common words, dates,
repeats, keyboard walks and brute-force characters, found by dynamic programming. A value whose cost reaches
``min_cost`` is no placeholder and becomes a span of kind ``guess``, unless one pattern span covers all of it. Walks may be of any
length, and so may repeats of a block of at most LONGEST_BLOCK characters; a block costs what it costs as a value of its own.

Contract: null text counts as empty and gives a row without spans; rows stay one for one, whatever their ids; offsets are
code points, end exclusive, over the whole text. Spans of equal start come in the order assign, access, hex, guess. Values of any
length are judged whole, in a time that grows with their length. Other columns are ignored by the scan and kept by the redaction,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from bisect import bisect_right
from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import map_arrow, prepare

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CONTEXT = re.compile(r"""(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_\x20-]?key|credentials?)["']?(?:\x20*[:=]\x20*|\x20is\x20)["']?([^\s"'<>|]{8,})""", re.I | re.A)
HINTS = ("pass", "pwd", "secret", "token", "api", "credential")
#: A date of day precision within 120 years; a year alone.
DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d)", re.A)
YEAR = re.compile(r"(?:19|20)\d\d", re.A)
#: The rows of a US keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
#: A repeat is a block of so many characters at most, any number of times; longer blocks count as what they consist of.
LONGEST_BLOCK = 64
#: Longer entries of a vocabulary are no words.
LONGEST_WORD = 32
NEW_SEGMENT = math.log10(2)


def _neighbours() -> dict[tuple[str, str], tuple[int, int]]:
    """Direction from one key to each adjacent one; rows are shifted by half a key."""
    at = {c: (r, 2 * k + r) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
    return {(a, b): (rb - ra, xb - xa) for a, (ra, xa) in at.items() for b, (rb, xb) in at.items() if a != b and abs(ra - rb) <= 1 and abs(xa - xb) <= 2 - (ra != rb)}


_STEP = _neighbours()


def brute(text: str) -> float:
    """log10 of the characters to try at each place."""
    return sum(1.0 if c.isdigit() else math.log10(26) if c.isalpha() and c.isascii() else math.log10(33) if c.isascii() else 3.0 for c in text)


def walk_cost(text: str) -> float | None:
    """Cost of a keyboard walk over the whole text, None if it isn't one."""
    steps = [_STEP.get(p) for p in zip(text.lower(), text.lower()[1:], strict=False)]
    if len(text) < 3 or None in steps:
        return None
    turns = 1 + sum(a != b for a, b in zip(steps, steps[1:], strict=False))
    return math.log10(47 * len(text)) + turns * math.log10(4)


def repeat_cost(text: str, ranks: dict[str, int]) -> float | None:
    """Cost of the shortest block that repeated makes the whole text, None if there is none or it is too long."""
    n = len(text)
    period = (text + text).find(text, 1)
    return guess_cost(text[:period], ranks) + math.log10(n // period) if n >= 3 and period < n and period <= LONGEST_BLOCK else None


def word_cost(text: str, ranks: dict[str, int]) -> float | None:
    rank = ranks.get(text.lower())
    if rank is None:
        return None
    upper = sum(c.isupper() for c in text)
    plain = upper == 0 or upper == len(text) or (upper == 1 and text[0].isupper())
    return math.log10(rank + 2) + (math.log10(2) * (upper > 0) if plain else math.log10(2) * len(text))


def date_cost(text: str) -> float | None:
    if len(text) in (8, 10) and DATE.fullmatch(text):
        return math.log10(365 * 120) + (not text.isdigit()) * math.log10(4)
    return math.log10(120) if len(text) == 4 and YEAR.fullmatch(text) else None


def segment_cost(part: str, ranks: dict[str, int]) -> float | None:
    """Cost of a part as a word, walk, repeat or date, whichever is least; None if it is none of them."""
    costs = [word_cost(part, ranks), walk_cost(part), repeat_cost(part, ranks), date_cost(part)]
    return min((c for c in costs if c is not None), default=None)


def least_of(chain: list[tuple[float, int]], end: int) -> float:
    """Least ``g + log10(end - start)`` over the starts of a chain, earlier ones first.

    A start that an earlier one equals or beats stays beaten, as the difference of the logarithms shrinks with the end: it is dropped.
    """
    least, kept = math.inf, []
    for g, start in chain:
        cost = g + math.log10(end - start)
        if cost < least:
            least = cost
            kept.append((g, start))
    chain[:] = kept
    return least


def guess_cost(value: str, ranks: dict[str, int], enough: float = math.inf) -> float:
    """Least log10 guesses over all segmentations; exact below ``enough``, any figure from there on where it is more.

    Words and dates end within the longest word's reach. Walks and repeats of any length are chains of starts that go on as long as the
    walk or the period does.
    """
    low, best, below = value.lower(), [0.0], 0
    walk: list[tuple[float, int]] = []
    turns, came = [0], None  # changes of direction up to each character of the walk
    periods: dict[int, tuple[int, dict[int, list[tuple[float, int]]]]] = {}  # matches in a row, and chains by the end's place in the period
    seen: dict[str, deque[int]] = {}
    for end in range(1, len(value) + 1):
        at = end - 1
        c = value[at]
        least = best[at] + brute(c)
        for start in range(max(0, end - LONGEST_WORD), end - 2):
            if best[start] < least and low[start:end] in ranks:
                least = min(least, best[start] + word_cost(value[start:end], ranks) + NEW_SEGMENT)
        for start in (end - 4, end - 8, end - 10) if c.isdigit() else ():
            known = date_cost(value[start:end]) if start >= 0 else None
            if known is not None:
                least = min(least, best[start] + known + NEW_SEGMENT)
        step = _STEP.get((low[at - 1], low[at])) if at else None
        if step is None:
            walk, came = [], None
            turns.append(turns[-1])
        else:
            turns.append(turns[-1] + (came is not None and step != came))
            came = step
            start = end - 3
            if start >= 0 and _STEP.get((low[start], low[start + 1])):
                walk.append((best[start] + math.log10(47) + math.log10(4) * (1 - turns[start + 2]), start))
            if walk:
                least = min(least, least_of(walk, end) + math.log10(4) * turns[end] + NEW_SEGMENT)
        recent, going, shorter = seen.setdefault(c, deque()), {}, []
        while recent and at - recent[0] > LONGEST_BLOCK:
            recent.popleft()
        for before in reversed(recent):
            p = at - before
            run, chains = periods.get(p, (0, {}))
            run += 1
            if any(p % q == 0 and of_q >= p - q for q, of_q in shorter):
                continue  # the block repeats a shorter one, and its period ends where that one does
            if run >= max(p, 3 - p):
                chain, start = chains.setdefault(end % p, []), end - max(2 * p, 3)
                chain.append((best[start] + block_cost(value[end - p : end], ranks) - math.log10(p), start))
                least = min(least, least_of(chain, end) + NEW_SEGMENT)
                shorter.append((p, run))
            going[p] = (run, chains)
            if p == 1 and run >= LONGEST_BLOCK:
                break  # every other period is a multiple
        periods = going
        recent.append(at)
        best.append(least)
        if least < enough:
            below = end
        elif end - below > max(LONGEST_WORD, 2 * LONGEST_BLOCK):  # nothing that ends later can begin where the cost was less
            return least
    return best[-1]


def block_cost(block: str, ranks: dict[str, int]) -> float:
    return brute(block) if len(block) == 1 else guess_cost(block, ranks)


@lru_cache(2)
def word_ranks(content: bytes) -> dict[str, int]:
    """Words of a public vocabulary, commonest first: its order of merges follows frequency."""
    out: dict[str, int] = {}
    for line in filter(None, content.splitlines()):
        token = base64.b64decode(line.split()[0]).strip()
        if 3 <= len(token) <= LONGEST_WORD and token.isalpha() and token.isascii():
            out.setdefault(token.decode().lower(), len(out))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern spans, in order."""
    spans = []
    if any(h in text.lower() for h in HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def guess_spans(text: str, base: list[tuple[int, int, int]], ranks: dict[str, int], min_cost: float) -> list[tuple[int, int, int]]:
    """Spans of the method, for values in credential contexts that no pattern span covers whole."""
    if not any(h in text.lower() for h in HINTS):
        return []
    found = []
    wide = []  # furthest end of the pattern spans up to each one

    for _, _, e in base:
        wide.append(max(e, wide[-1]) if wide else e)
    starts = [s for s, _, _ in base]

    def covered(start: int, end: int) -> bool:
        """One pattern span covers the value whole: as spans are few and sorted, those that begin before it are looked at from the last."""
        k = bisect_right(starts, start) - 1
        while k >= 0 and wide[k] >= end:
            if base[k][2] >= end:
                return True
            k -= 1
        return False

    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".,;:!?)]}")
        start = m.start(1)
        end = start + len(value)
        if len(value) >= 8 and not covered(start, end) and guess_cost(value, ranks, min_cost) >= min_cost:
            found.append((start, 3, end))
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, word_path: str, min_cost: float = 10.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_guess) per row."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(read_ranks(word_path))
    kind = dict(docs.dtypes)[id_col]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ranks, rows = word_ranks(shared.value), []
        for value in b.column(1):
            text = value.as_py() or ""
            base = base_spans(text)
            more = guess_spans(text, base, ranks, min_cost)
            n = [sum(k == i for _, k, _ in base) for i in range(3)]
            rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(sorted(base + more)), len(more)))
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    got = map_arrow(picked, run, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_guess bigint")
    return got.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, word_path: str, min_cost: float = 10.0, mask: str = "[SECRET]", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows with every span replaced by ``mask`` (overlapping spans by one); rows without spans stay as they are."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(read_ranks(word_path))
    at = docs.columns.index(text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ranks, texts = word_ranks(shared.value), b.column(at).to_pylist()
        for i, text in enumerate(texts):
            base = base_spans(text or "")
            spans = sorted(base + guess_spans(text or "", base, ranks, min_cost))
            if spans:
                out, done = [], 0
                for s, _, e in spans:
                    if s >= done:
                        out += [text[done:s], mask]
                    done = max(done, e)
                texts[i] = "".join(out) + text[done:]
        return b.set_column(at, b.schema.field(at).name, pa.array(texts, b.schema.field(at).type))

    got = map_arrow(docs, run, docs.schema)
    if length_col and length_col in docs.columns:
        changed = F.char_length(text_col).cast(dict(docs.dtypes)[length_col])
        got = got.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(changed))
    return got
