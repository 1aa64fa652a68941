"""Listings of result and test-set files without their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.functions.identity import task_type_from_id


def run_catalog(documents: DataFrame, *file_columns: str) -> DataFrame:
    """One row per document: model, counts, tokens and task types, newest first.

    Works on the arrays inside each document, so nothing is exploded or shuffled
    but the final order.  ``file_columns`` are carried along (path, size, time).
    """
    done = F.filter("results", lambda r: r["status"] == "success")
    tasks = F.array_sort(F.array_distinct(F.transform(done, lambda r: task_type_from_id(r["test_id"]))))
    s = "summary_statistics"
    return documents.select(
        *file_columns,
        F.col("metadata.result_id").alias("run_id"),
        F.coalesce("model_info.model_name", F.lit("unknown")).alias("model_name"),
        F.coalesce("model_info.provider", F.lit("unknown")).alias("provider"),
        F.coalesce(f"{s}.accuracy", F.lit(0.0)).alias("accuracy"),
        F.coalesce(f"{s}.correct_responses", F.lit(0)).alias("correct"),
        F.coalesce(F.size("results"), F.lit(0)).alias("total_tests"),
        (F.coalesce(f"{s}.total_input_tokens", F.lit(0)) + F.coalesce(f"{s}.total_output_tokens", F.lit(0))).alias("total_tokens"),
        F.coalesce("testset_metadata.name", "testset_metadata.testset_name", F.lit("")).alias("testset_name"),
        tasks.alias("task_types"),
    )


def newest_first(catalog: DataFrame, modified: str, *ties: str) -> DataFrame:
    """Sorted listing.  Its rows are shuffled before, as sorting reads its input twice, and documents should be read once."""
    return catalog.repartition(modified, *ties).orderBy(F.desc(modified), *ties)


def testset_catalog(cases: DataFrame, testset: str, order: str, sample: int = 5) -> DataFrame:
    """Per test set: cases, distinct task types, and the ids of its first cases.

    The sample is a top-k per set, taken before and after the shuffle, so a
    large set never reaches one task whole.
    """
    from pyspark.sql import Window

    totals = cases.groupBy(testset, "task_type").agg(F.count(F.lit(1)).alias("n")).groupBy(testset).agg(
        F.sum("n").alias("test_count"), F.array_join(F.array_sort(F.collect_set("task_type")), ",").alias("task_types")
    )
    place = F.row_number().over(Window.partitionBy(testset).orderBy(order))
    first = cases.select(testset, order).withColumn("_n", place).filter(F.col("_n") <= sample)
    sampled = first.groupBy(testset).agg(
        F.array_join(F.array_sort(F.collect_list(F.col(order))).cast("array<string>"), ",").alias("sample_cases")
    )
    return totals.join(sampled, testset)


testset_catalog.__test__ = False  # not a pytest case
