"""Token counts through a digest cache.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens). Texts are normalised (null to empty, runs of
ASCII white space to one blank, ends trimmed: this tokenizer drops white space), digested and joined to it; only distinct
texts without a stored count are encoded, and their counts are appended. Inside a task the encoder also remembers counts
of white-space-free chunks, as no token crosses white space.

Contract: null and empty texts have 0 tokens and 0 bytes; repeated rows stay, each with its count; special strings inside
a text count as the library counts them; other columns are ignored. A lost append only costs a later re-encoding.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import join_hot, map_arrow, prepare, scratch, stored

CACHE_CHUNKS = 400_000
CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens bigint"


class Counter:
    """Counts tokens with the library; remembers chunks."""

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        chunks = [t.encode().split() for t in texts]
        if len(self.known) > CACHE_CHUNKS:
            self.known.clear()
        known = self.known
        fresh = list({c for row in chunks for c in row if c not in known})
        for lo in range(0, len(fresh), 20_000):
            part = fresh[lo : lo + 20_000]
            got = self.tokenizer.encode_batch_fast([c.decode() for c in part], add_special_tokens=False)
            known.update(zip(part, map(len, got), strict=True))
        return [sum(map(known.__getitem__, row)) for row in chunks]


@lru_cache(2)
def counter(content: bytes) -> Counter:
    """One counter per process."""
    return Counter(content)


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) per row; ``cache``: folder of the count table, made if missing."""
    spark = prepare(docs.sparkSession)
    content = read_ranks(path)
    version = hashlib.sha256(content).hexdigest()
    shared = spark.sparkContext.broadcast(content)
    text = F.coalesce(docs[text_col], F.lit(""))
    plain = F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))
    rows = docs.select(docs[id_col].alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(plain, 256)).alias("content_digest"))
    texts = docs.select(plain.alias("text")).select("text", F.unhex(F.sha2("text", 256)).alias("content_digest"))

    def stored_counts() -> DataFrame:
        try:
            table = spark.read.schema(CACHE_SCHEMA).parquet(cache)
        except AnalysisException:
            table = spark.createDataFrame([], CACHE_SCHEMA)
        # A retried append may leave a count twice.
        return table.where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        """Counts of the texts that the cache lacks; the others come without text and with their count."""
        new = pc.is_null(b.column(3))
        got = b.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
        at = np.flatnonzero(new.to_numpy(zero_copy_only=False))
        got[at] = counter(shared.value).counts(pc.fill_null(b.column(1).take(pa.array(at)), "").to_pylist())
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(got.astype(np.int64)), new], ["content_digest", "n", "n_tokens", "new"])

    # Copies meet map-side first, so a text that a third of all rows hold crosses the network once a task.
    distinct = texts.groupBy("content_digest").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    known = distinct.join(stored_counts(), "content_digest", "left").select("content_digest", F.when(F.col("n_tokens").isNull(), F.col("text")).alias("text"), "n", "n_tokens")
    counted = stored(map_arrow(known, run, "content_digest binary, n bigint, n_tokens bigint, new boolean"), f"{scratch(spark)}/counted")
    counted.where("new").select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)
    out = join_hot(rows, counted.select("content_digest", "n", "n_tokens"), "content_digest")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


__all__ = ["count_tokens", "counter", "stored"]
