"""The pipeline on a small corpus, stage by stage."""

import random

import corpus_pipeline
from test_corpus_operators import prose


def test_stages(spark, tmp_path):
    g = random.Random(12)
    item = prose(g, 40)
    rows = [(i, prose(g, 60), "aa", "s", 0) for i in range(60)]
    rows += [(100, rows[3][1], "aa", "s", 0), (101, prose(g, 20) + " " + item, "aa", "s", 0), (102, rows[5][1] + " token=abcdefghijklmnop", "aa", "s", 0), (103, "12345 !!!", "aa", "s", 0), (104, None, "aa", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "secret_scan":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert not docs.where("text like '%abcdefghijklmnop%'").count()
    everything = {r[0] for r in rows}
    assert everything - kept["language_id"] == {103, 104}
    # 102 is 5 with two more words; both lie above 0.8, so the smaller id stays.
    assert kept["language_id"] - kept["near_duplicates"] == {100, 102}
    assert kept["near_duplicates"] - kept["decontamination"] == {101}
    assert kept["byte_bpe"] == kept["secret_scan"] == kept["decontamination"]
    assert docs.where("not exact").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["byte_bpe"])
