"""Substring deduplication over sliding sentence spans.

Texts are cut into sentences (at ``.``, ``!``, ``?`` before white space and at line ends; a sentence of more than
``LONG_WORDS`` words is cut further after words chosen by their hash, so that both copies of a passage are cut alike). At
each sentence begins one span: the shortest run of at least ``run`` sentences and ``run_words`` words. Spans are
hashed and joined globally; the first by (id, place) stays, and the sentences that any other one covers are removed.

Contract: null and empty texts have no spans. Comparison ignores A-Z case and the kind of white space. Rows of equal id count as
one document at equal places: they don't displace each other; with ``by_text`` only if their texts are equal too, so each text's
stretches are its own, and cutting always works so. Rows without an id are always told apart by their texts, and come first. Other
columns are ignored and kept, whatever their names. Very long texts are hashed in pieces; a document's own spans are all that one
task holds. A repeated span of fewer than ``run_words`` words stays unless what follows it is repeated too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _COEF, fresh, join_hot, map_arrow, mix, prepare, raw, scratch, slices, stored, words

LONG_WORDS = 24
#: Long sentences are cut after one word in so many: a passage of 51 words set anywhere then holds whole spans but in rare cases.
CUT_ONE_IN = 4
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
SCHEMA = "id {kind}, digest bigint, hash bigint, word int, word_end int, start int, end int"


def spans(buf: np.ndarray, off: np.ndarray, run: int, run_words: int) -> tuple[np.ndarray, ...]:
    """Row, hash, word range within the row and code-point range of every span."""
    h, row, start, end = words(buf, off)
    n = len(h)
    if not n:
        return (np.zeros(0, np.int64),) * 6
    lines = np.concatenate([[0], np.cumsum(buf == 10)])
    turn = np.ones(n, bool)
    turn[:-1] = (row[1:] != row[:-1]) | _STOP[buf[end[:-1] - 1]] | (lines[start[1:]] != lines[end[:-1]])
    first = np.concatenate([[0], np.flatnonzero(turn)[:-1] + 1])
    size = np.diff(np.concatenate([first, [n]]))
    turn |= (np.repeat(size, size) > LONG_WORDS) & (h % np.uint64(CUT_ONE_IN) == 0)
    first = np.concatenate([[0], np.flatnonzero(turn)[:-1] + 1])
    size = np.diff(np.concatenate([first, [n]]))
    place = np.arange(n) - np.repeat(first, size)
    unit = mix(np.add.reduceat(h * _COEF[place & 255], first))
    m = len(unit)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(m, _BASE)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(m, _BACK)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(unit * power[:-1])])
    begin = np.concatenate([first, [n]])
    i = np.arange(m)
    j = np.maximum(np.searchsorted(begin, first + run_words, "left"), i + run)
    fits = j <= m
    i, j = i[fits], j[fits]
    last = begin[j] - 1
    same = row[first[i]] == row[last]
    i, j, last = i[same], j[same], last[same]
    got = mix((sums[j] - sums[i]) * back[i])
    word0 = np.searchsorted(row, np.arange(len(off) - 1), "left")
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    r = row[first[i]]
    base = chars[off[:-1][r]]
    return r, got.view(np.int64), first[i] - word0[r], last + 1 - word0[r], chars[start[first[i]]] - base, chars[end[last]] - base


def text_digest(id_col: str, text_col: str, by_text: bool):
    """Tells rows apart that share an id (or have none); 0 where the id alone does."""
    digest = F.xxhash64(text_col)
    return digest if by_text else F.when(F.col(id_col).isNull(), digest).otherwise(F.lit(0).cast("long"))


def span_table(docs: DataFrame, run: int, run_words: int, id_col: str, text_col: str, by_text: bool) -> DataFrame:
    def make(b: pa.RecordBatch) -> pa.RecordBatch:
        buf, off = raw(b.column(1))
        parts = []
        for lo, hi in slices(off):
            r, *rest = spans(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], run, run_words)
            parts.append((r + lo, *rest))
        r, got, *places = (np.concatenate(p) for p in zip(*parts, strict=True))
        r = pa.array(r)
        return pa.RecordBatch.from_arrays([b.column(0).take(r), b.column(2).take(r), pa.array(got), *(pa.array(p.astype(np.int32)) for p in places)], ["id", "digest", "hash", "word", "word_end", "start", "end"])

    picked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), text_digest(id_col, text_col, by_text).alias("digest"))
    return map_arrow(picked, make, SCHEMA.format(kind=dict(docs.dtypes)[id_col]))


def stretches(docs: DataFrame, run: int, run_words: int, id_col: str, text_col: str, by_text: bool) -> DataFrame:
    """(id, digest, span_start, span_end, n_words): what any span but the first of its hash covers."""
    spark = prepare(docs.sparkSession)
    table, place = span_table(docs, run, run_words, id_col, text_col, by_text), F.struct("id", "digest", "word")
    # Only sums cross the network for a span that a third of all rows hold, and the join deals its rows evenly.
    firsts = table.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = join_hot(table, stored(firsts, f"{scratch(spark)}/firsts"), "hash").where(~(place.eqNullSafe(F.col("first"))))
    # A span of the same place may be read twice where rows share an id.
    later = later.select("id", "digest", "word", "word_end", "start", "end").distinct()
    order = Window.partitionBy("id", "digest").orderBy("word", "word_end")
    reach = F.max("word_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("fresh", F.coalesce(F.col("word") > reach, F.lit(True)).cast("int"))
    islands = islands.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("id", "digest", "island").agg(F.min("start").alias("span_start"), F.max("end").alias("span_end"), (F.max("word_end") - F.min("word")).alias("n_words")).drop("island")


def repeated_spans(docs: DataFrame, run: int = 2, run_words: int = 12, id_col: str = "doc_id", text_col: str = "text", by_text: bool = False) -> DataFrame:
    """(id, span_start, span_end, n_words): the stretches to remove, code points, end exclusive; documents without any have no row."""
    return stretches(docs, run, run_words, id_col, text_col, by_text).drop("digest").withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 2, run_words: int = 12) -> DataFrame:
    """The documents with their own repeated stretches cut out; untouched ones stay as they are."""
    cut_id, cut_of, cut_at = fresh(docs, "cut_id", "cut_of", "cuts")
    cuts = stretches(docs, run, run_words, id_col, text_col, True)
    cuts = cuts.groupBy(F.col("id").alias(cut_id), F.col("digest").alias(cut_of)).agg(F.array_sort(F.collect_list(F.struct("span_start", "span_end"))).alias(cut_at))
    joined = docs.join(cuts, F.col(cut_id).eqNullSafe(docs[id_col]) & (F.col(cut_of) == F.xxhash64(docs[text_col])), "left")
    text = docs[text_col]
    ends = F.concat(F.transform(cut_at, lambda c: c["span_start"]), F.array(F.char_length(text)))
    begins = F.concat(F.array(F.lit(0)), F.transform(cut_at, lambda c: c["span_end"]))
    kept = F.array_join(F.zip_with(begins, ends, lambda b, e: F.substring(text, b + 1, e - b)), "")
    return joined.select(*[F.when(F.col(cut_at).isNull(), text).otherwise(kept).alias(c) if c == text_col else docs[c] for c in docs.columns])
