"""Shared helpers: scratch folders, Arrow mapping, and vectorised word hashing over Arrow text buffers.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``; only A-Z is lower-cased. Null text counts as empty.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
ROWS_PER_BATCH = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session: texts can be long, so few rows and few bytes go at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return spark


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared folder of ``spark.checkpoint.dir``; where that is unset, a local master (tests) gets a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='barline-')}"
    return f"{base.rstrip('/')}/barline-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Write ``df`` (with the writer's ``options``) and read it back: cuts the lineage, survives lost executors."""
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that ``df`` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: A key is hot if it holds one row in so many, so there are at most so many hot keys: what is broadcast is bounded.
HOT_ONE_IN = 4096


def join_hot(left: DataFrame, right: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row for each key and a column ``n``: how many rows of ``left`` have it.

    Hot keys are joined by broadcasting their few rows, and their rows of ``left`` are dealt evenly in the exchange that the
    others need, so no task gets a key that a third of all rows hold. ``right`` is read three times: give a stored table.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    values = [c for c in right.columns if c not in (key, n)]
    hot = right.where(F.col(n) * HOT_ONE_IN >= max(total, HOT_ONE_IN * 64))
    hot = F.broadcast(hot.select(F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot")))
    marked = left.join(hot, F.col(key) == F.col("_hot_key"), "left")
    marked = marked.withColumn("_spread", F.when(F.col("_hot_key").isNull(), F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id()))
    rest = right.select(F.col(key).alias("_key"), F.struct(*values).alias("_value"), F.lit(0).cast("long").alias("_none"))
    joined = marked.join(rest, (F.col("_spread") == F.col("_none")) & (F.col(key) == F.col("_key")), "left")
    joined = joined.withColumn("_got", F.coalesce("_hot", "_value")).where(F.col("_got").isNotNull())
    return joined.select(*left.columns, *[F.col(f"_got.{v}").alias(v) for v in values])


def remainder(doc_id: str, mod: int):
    """crc32 of the id as text, modulo ``mod``; a null id gives 0 (held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(mod), F.lit(0).cast("long"))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, and where each row begins (one more entry for the end)."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    off = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes, one row at least."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_COEF = np.random.default_rng(20240117).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pieces(buf: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``limit``, each but the last ending at white space: no word is cut."""
    lo, n = 0, len(buf)
    while lo < n:
        hi = min(lo + limit, n)
        while hi < n and not _SPACE[buf[hi]]:
            found = np.flatnonzero(_SPACE[buf[hi : hi + 65536]])
            hi = hi + int(found[0]) if len(found) else min(hi + 65536, n)
        yield lo, hi
        lo = hi


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash (uint64), row, first byte and end byte of every word, in order. Very long texts are hashed in pieces."""
    if len(buf) <= 2 * SLICE_BYTES:
        return _words(buf, off)
    parts = []
    for lo, hi in pieces(buf):
        first, last = int(np.searchsorted(off, lo, "right")) - 1, int(np.searchsorted(off, hi, "left"))
        h, row, start, end = _words(buf[lo:hi], np.clip(off[first : last + 1] - lo, 0, hi - lo))
        parts.append((h, row + first, start + lo, end + lo))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    gap = _SPACE[buf]
    inside = ~gap
    first, last = inside.copy(), inside.copy()
    first[1:] &= gap[:-1]
    last[:-1] &= gap[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return start.astype(np.uint64), start, start, end
    size = end - start
    at = np.cumsum(size) - size
    solid = _LOWER[buf[inside]]
    pos = np.arange(len(solid), dtype=np.int64) - np.repeat(at, size)
    h = np.add.reduceat((solid.astype(np.uint64) + np.uint64(1)) * _COEF[pos & 255] + (pos >> 8).astype(np.uint64), at)
    return mix(h), np.searchsorted(off, start, "right") - 1, start, end


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; it returns a batch or None."""

    def run(batches):
        for b in batches:
            if b.num_rows and (out := fn(b)) is not None:
                yield out

    return df.mapInArrow(run, schema)
