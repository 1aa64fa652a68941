"""State of running jobs: how much of the total is done, and whether a job runs, is finished or has stalled."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallymill.session import remove

STATE = "done long, correct long, total long, latest long"
OUTPUT = "job string, done long, correct long, total long, state string, latest timestamp"


def job_states(events: DataFrame, time: str, job: str, correct: Column, total: Column, identity: Sequence[str], late: str = "2 hours", patience_hours: float = 12.0) -> DataFrame:
    """Rows (job, done, correct, total, state, latest) of a stream of events, one whenever a job's state changes.

    A job is finished once it has ``total`` events, stalled once the watermark is ``patience_hours`` beyond its
    newest event, else running; an event after that sets a stalled job running again.  Events that repeat by
    ``identity`` within ``late`` count once, later ones are dropped.  The state of a job is four numbers.
    """
    patience = int(patience_hours * 3_600_000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, right, planned, latest = state.get if state.exists else (0, 0, 0, 0)
        stalled = state.hasTimedOut
        if not stalled:
            for batch in batches:
                done += len(batch)
                right += int(batch["_correct"].sum())
                planned = max(planned, int(batch["_total"].max()))
                latest = max(latest, int(batch["_micros"].max()))
            state.update((done, right, planned, latest))
        finished = done >= planned
        if not finished and not stalled:
            state.setTimeoutTimestamp(max(latest // 1000 + patience, state.getCurrentWatermarkMs() + 1))
        word = "finished" if finished else "stalled" if stalled else "running"
        yield pd.DataFrame({"job": [key[0]], "done": [done], "correct": [right], "total": [planned], "state": [word], "latest": [pd.Timestamp(latest, unit="us", tz="UTC")]})

    known = events.select(
        F.col(job).cast("string").alias("job"),
        F.col(time).cast("timestamp").alias("_time"),
        F.coalesce(correct, F.lit(False)).cast("int").alias("_correct"),
        F.coalesce(total, F.lit(0)).cast("long").alias("_total"),
        F.unix_micros(F.col(time).cast("timestamp")).alias("_micros"),
        *identity,
    )
    once = known.withWatermark("_time", late).dropDuplicatesWithinWatermark(["job", *identity])
    return once.groupBy("job").applyInPandasWithState(update, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def merge_updates(batch: DataFrame, number: int, path: str, keys: Sequence[str], newest: Sequence[str]) -> None:
    """Fold a batch of updates into a table of one row per key; of a key's rows the one with the greatest ``newest`` stays.

    Each batch writes the whole table under its number, from the table of the batch before it, and removes the
    one before that: the table is as large as its keys, and a batch that runs again writes the same rows.
    """
    spark = batch.sparkSession
    versions = sorted(n for n in table_versions(batch, path) if n < number)
    rows = batch
    if versions:
        rows = rows.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/{versions[-1]:010d}"))
    values = [c for c in batch.columns if c not in keys]
    last = F.max_by(F.struct(*values), F.struct(*newest)).alias("_s")
    rows.groupBy(*keys).agg(last).select(*keys, *(F.col(f"_s.{c}").alias(c) for c in values)).write.mode("overwrite").parquet(f"{path}/{number:010d}")
    for old in versions[:-1]:
        remove(spark, f"{path}/{old:010d}")


def table_versions(df: DataFrame, path: str) -> list[int]:
    """Numbers of the tables that are complete, in the folder of ``merge_updates``."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    return [int(f.getPath().getName()) for f in files.listStatus(place) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]


def follow_jobs(states: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the current state of every job in a table, until nothing new is left to read."""
    fresh = ["done", F.col("state") == "stalled"]

    def save(batch: DataFrame, number: int) -> None:
        merge_updates(batch, number, path, ["job"], fresh)

    return states.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()


def current_jobs(like: DataFrame, path: str) -> DataFrame:
    """The table that the last complete batch wrote."""
    return like.sparkSession.read.schema(OUTPUT).parquet(f"{path}/{max(table_versions(like, path)):010d}")
