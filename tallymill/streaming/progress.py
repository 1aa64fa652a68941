"""Progress of running jobs from their events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def progress_rollup(events: DataFrame, time: str, job: str, correct: Column, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events, right answers and running accuracy per job and time window.

    On a stream, state older than ``late`` behind the newest event is dropped,
    and so are events that come later than that.
    """
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    timed = timed.withWatermark(time, late) if events.isStreaming else timed
    return (
        timed.groupBy(F.window(time, width).alias("w"), F.col(job).alias("job"))
        .agg(
            F.count(F.lit(1)).alias("done"),
            F.count_if(correct).alias("correct"),
            F.max(time).alias("latest"),
        )
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            "job",
            "done",
            "correct",
            F.round(F.col("correct") / F.col("done"), 6).alias("accuracy"),
            F.col("latest").cast("timestamp_ntz").alias("latest"),
        )
    )


def keep_updates(rollup: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write changed windows of each batch under the batch number, then stop when nothing is left."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        rollup.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )


def latest_updates(updates: DataFrame) -> DataFrame:
    """The newest state of every window: the batch written last wins."""
    values = [c for c in updates.columns if c not in ("window_start", "job", "batch")]
    newest = updates.groupBy("window_start", "job").agg(
        F.max_by(F.struct(*values), F.struct("batch", "done")).alias("s")
    )
    return newest.select("window_start", "job", *[F.col(f"s.{v}").alias(v) for v in values])
