"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, filter_audit, jaccard, language_id, language_model, quality, secret_scan, stream_bpe, substring, token_counts, vector_codes, vptree
from .common import remainder, scratch, table

RANKS = "byte_bpe_50k.tiktoken"


def op1_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, F.col("vec_id") % 20 == 0, k=20, factor=1.0)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_spans(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    docs = docs.select("doc_id", "text", (remainder("doc_id", 5) == 0).alias("held_out"))
    model = quality.fit(docs, labels, ~F.col("held_out"))
    return quality.score(docs, model, ["doc_id", "held_out"])


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (remainder("doc_id", 5) == 0).alias("held_out"))
    net = language_id.fit(docs, ~F.col("held_out"))
    return language_id.predict(docs, net, ["doc_id", "held_out"])


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), width=3, similarity=90)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), f"{scratch(spark)}/counts")


def op11_stream_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


QUERIES = {
    f.__name__: f
    for f in (op1_vantage_trees, op2_secret_scan, op3_language_model, op4_byte_bpe, op5_substring_dedup, op6_quality, op7_language_id, op8_decontaminate, op9_jaccard_join, op10_token_counts, op11_stream_bpe, op12_filter_audit, op13_vector_codes)
}

#: Words as the operators take them, for a column ``text``.
WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, dims: int = 64) -> str:
    """Every distance, in whole numbers; the rounds one after the other."""
    width = dims // parts
    down = "CAST((s - (((s % n) + n) % n)) // n AS BIGINT)"
    sql = [
        f"""WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (SELECT r, vec_id, label, k AS part, w[k * {width} + 1:(k + 1) * {width}] AS x FROM v, range({parts}) t(k)),
b0 AS (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {entries})"""
    ]
    for k in range(rounds + 1):
        sql.append(f"""d{k} AS (
  SELECT p.r, p.vec_id, p.label, p.part, p.x, min(CAST(list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * {entries} + b.entry) AS best
  FROM p JOIN b{k} b ON p.part = b.part GROUP BY ALL)""")
        if k < rounds:
            sql.append(f"""u{k} AS (SELECT part, best % {entries} AS entry, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM d{k}, range(1, {width + 1}) t(i) GROUP BY ALL)""")
            sql.append(f"""n{k} AS (SELECT part, entry, list({down} ORDER BY i) AS c FROM u{k} GROUP BY ALL)""")
            sql.append(f"""b{k + 1} AS (SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN n{k} n ON b.part = n.part AND b.entry = n.entry)""")
    sql.append(f"""f AS (SELECT r, vec_id, label, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM d{rounds} GROUP BY ALL)""")
    last = f"(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM b{rounds})"
    return ",\n".join(sql) + f"\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, {last} AS codebooks_sha256 FROM f"


ORACLES: dict[str, str] = {
    "op12_filter_audit": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), m AS (
  SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * len(x), regexp_matches(x, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false)] AS bad
  FROM t
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, bad, len(list_filter(bad, lambda x: x)) AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM m LEFT JOIN l USING (doc_id)),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || f FROM o, unnest(['A', 'B', 'C', 'D', 'E']) u(f) WHERE NOT contains(filter_order, f)),
s AS (
  SELECT filter_order, k AS step, ascii(filter_order[k]) - 64 AS f, list_transform(range(1, k), lambda i: ascii(filter_order[i]) - 64) AS before
  FROM o, range(1, 6) r(k) WHERE len(filter_order) = 5
), c AS (
  SELECT part, filter_order, step, f, bad[f] AS here, len(list_filter(before, lambda b: bad[b])) > 0 AS gone, fails, good, toxic FROM d, s
), g AS (
  SELECT part, filter_order, step, f, count(*) FILTER (NOT gone AND NOT here) AS kept, count(*) FILTER (NOT gone AND here) AS removed, count(*) FILTER (gone AND here) AS redundant,
    count(*) FILTER (here AND fails = 1) AS unique_fails, count(*) FILTER (NOT gone AND here AND good) AS good_lost, count(*) FILTER (NOT gone AND here AND toxic) AS toxic_lost
  FROM c GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g
""",
    "op13_vector_codes": codes_sql(),
    "op1_vantage_trees": """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, 65), lambda k: q.e[k] * c.e[k])), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id::BIGINT AS query_id, rank::INT AS rank, vec_id::BIGINT AS vec_id, score FROM r WHERE rank <= 20
""",
    "op9_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' '))) END AS g
  FROM w
), d AS (SELECT doc_id, len(g) AS n, g FROM s),
t AS (SELECT doc_id, n, unnest(g) AS x FROM d),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a)
SELECT d.doc_id, d.n::BIGINT AS n_shingles, min(reach.b) AS component_id FROM d JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, d.n
""",
}
