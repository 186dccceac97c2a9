"""The corpus pipeline: each stage works on what its predecessor kept, written as Parquet in between.

Stages: language ID (texts that are no language go), near duplicates (five-word shingles, 0.8; one document of each
group stays), benchmark decontamination (documents that hold a benchmark item go), secret scan (secrets are masked), and
byte-level BPE (the ids of what is left, with their exact round trip).

Null texts, and texts without a letter, go in the first stage. Other stages never see them, but handle them as their
operators say. Columns other than the operators' own pass through until the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import bpe, decontaminate, jaccard, language_id, secret_scan
from barline.llm.common import fresh, remainder, scratch, stored, table

RANKS = "byte_bpe_50k.tiktoken"
#: Mean-window probability under which a text is taken for no language that was learned.
LEAST_SCORE = 0.4


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the texts whose language the network can tell; learned from the labelled rows with crc32(doc_id) mod 5 <> 0."""
    net = language_id.fit(docs, remainder("doc_id", 5) != 0)
    lang, score = fresh(docs, "lang_pred", "score")
    judged = language_id.predict(docs, net, docs.columns, names=(lang, score))
    return judged.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.representatives(docs, width=5, similarity=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, public_tokenizers.path(RANKS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("language_id", identify), ("near_duplicates", deduplicate), ("decontamination", decontaminated), ("secret_scan", redacted), ("byte_bpe", encoded)]

#: SQL can't express the trained network or the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs, work = table(spark, sf_dir, "documents"), scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{work}/{k}_{name}")
    return docs
