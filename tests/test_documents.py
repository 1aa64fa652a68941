from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.sources.documents import explode_results, read_results, write_documents

RUN = ["run_id", "model_name", "quantization", "user_style", "system_style"]


def test_only_long_runs_are_parted(spark, tmp_path):
    """Runs of few rows are one document, a long one is several, and null run columns and repeated rows stay."""
    rows = spark.range(300).select(
        F.when(F.col("id") >= 60, "long").when(F.col("id") >= 30, "short").alias("run_id"),
        F.when(F.col("id") >= 30, "m").alias("model_name"),
        *(F.lit(None).cast("string").alias(c) for c in ("quantization", "user_style", "system_style", "task_params", "raw_response", "match_type")),
        (F.col("id") - F.col("id") % 2).cast("string").alias("test_id"),
        F.when(F.col("id") % 3 > 0, "success").otherwise("error").alias("status"),
        F.lit(0.5).alias("duration"), F.lit(1).alias("input_tokens"), F.lit(2).alias("output_tokens"), (F.col("id") % 2 == 0).alias("correct"),
    )
    write_documents(rows, str(tmp_path / "d"), RUN, per_document=50)
    docs = read_results(spark, str(tmp_path / "d"), "*.json.gz", one_per_file=False)
    sizes = {r.run: r.n for r in docs.groupBy(F.col("metadata.result_id").alias("run")).agg(F.count("*").alias("n")).collect()}
    assert sizes[None] == sizes["short"] == 1 and 1 < sizes["long"] <= 5
    back, was = explode_results(docs).select("run_id", "test_id", "status", "correct"), rows.select("run_id", "test_id", "status", "correct")
    assert back.count() == 300 and back.exceptAll(was).count() == 0
