"""Results out: aggregates as Parquet, JSON or CSV, failures as JSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.functions.identity import test_family
from tallymill.session import scratch_path


def write_aggregates(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A small table in the wanted format; CSV gets a header."""
    writer = df.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "json":
        writer.json(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def wrong_rows(rows: DataFrame) -> DataFrame:
    """Wrong answers with a usable response, under their test family."""
    response = F.lower(F.trim(F.coalesce("raw_response", F.lit(""))))
    return rows.filter(~F.coalesce("correct", F.lit(False)) & (response != "") & (response != "timed out")).withColumn(
        "family", test_family(F.col("test_id"))
    )


def write_failures_jsonl(rows: DataFrame, path: str) -> None:
    """Wrong answers as JSON lines, in one folder per test family.

    Rows stay in the partitions they are in: a family with a third of all rows
    is written by all tasks.
    """
    wrong_rows(rows).write.mode("overwrite").partitionBy("family").json(path)


def write_bronze(rows: DataFrame, path: str, created: str = "created_at") -> None:
    """Flat response rows as Parquet by run date and model: the table all later queries should read.

    Partitions that the rows belong to are replaced and others stay, so a job that is run again for the
    same runs doubles nothing.  Rows of one date must therefore come together.
    """
    dated = rows.withColumn("run_date", F.try_to_date(F.substring(F.col(created), 1, 10)))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date", "model_name").parquet(path)


def buckets_for(rows: DataFrame, per_bucket: int = 1_000_000, least: int = 8) -> int:
    """Buckets that hold some ``per_bucket`` rows each, a power of two so that tables of other sizes can be joined in halves."""
    wanted = max(least, -(-rows.count() // per_bucket))
    return 1 << (wanted - 1).bit_length()


def write_bucketed(rows: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """``rows`` stored as the table ``name``, bucketed and sorted by ``keys``; returns the stored table.

    Two tables with the same keys and number of buckets join on these keys without a shuffle on either side, so
    results and test sets that are joined time and again pay for it once, when they are written.  Rows are
    brought together by bucket first, which makes one file per bucket.  Keys should be nearly unique, as
    (config_hash, test_id) is: all rows of one key are in one bucket.  Size ``buckets`` by the larger table,
    some 128 MB to 1 GB a bucket.  Without ``path`` the files are in the shared scratch folder.
    """
    spark = rows.sparkSession
    place = path or scratch_path(spark, name)
    dealt = rows.repartition(buckets, *keys)
    dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", place).format("parquet").saveAsTable(name)
    return spark.table(name)
