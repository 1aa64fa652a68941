"""Empty tables, awkward rows and clashing columns."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from tallymill.llm import matroska, quality


def test_files_of_empty_tables_and_clashing_columns(make_docs):
    assert matroska.store(make_docs([])).count() == 0 and matroska.digests(make_docs([])).count() == 0
    texts = ["", None, "a" * 700_000, "b" * 400_000, "c", "c"]
    docs = make_docs(texts).withColumn("media", F.lit("old")).withColumn("feature", F.lit("old")).withColumn("n_bytes", F.lit(-1))
    stored = {r.doc_id: bytes(r.media) for r in matroska.store(docs).collect()}
    found = {r.doc_id: r for r in matroska.digests(docs).collect()}
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        packets, _ = matroska.read(stored[k])
        back = b"".join(stored[k][p[4] : p[4] + p[5]] for p in packets)
        assert back.rstrip(b"\0") == raw and len(back) % 64 == 0 and len(back) >= 64
        assert found[k].n_bytes == len(raw) and found[k].media_bytes == len(stored[k]) and found[k].feature != "old"
    assert stored[0] == stored[1] and stored[4] == stored[5]


def test_quality_of_an_empty_table(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(make_docs([]), *quality.learn(make_docs([]), none)).count() == 0


def test_pipeline_of_empty_tables(spark, make_docs, tmp_path):
    path = str(tmp_path)
    make_docs([]).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
