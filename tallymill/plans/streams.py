"""Streaming queries, run until nothing is left and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.fixtures import EVAL_ROWS_SQL
from tallymill.plans.files import _PER_RUN, per_run, result_documents
from tallymill.plans.registry import query
from tallymill.session import scratch_path
from tallymill.streaming import ingest, jobs, progress


@query("stream_ingest", f"WITH {EVAL_ROWS_SQL} {_PER_RUN}")
def _(spark, sf):
    incoming = result_documents(spark, sf)
    rows = ingest.stream_results(spark, incoming, "*.json.gz", one_per_file=False, files_per_batch=4)
    out = scratch_path(spark, "stream-bronze")
    ingest.append_new(rows, out, scratch_path(spark, "stream-state")).awaitTermination()
    return per_run(spark.read.parquet(out))


@query(
    "progress_rollup",
    """SELECT date_trunc('hour', ts) AS window_start, event_type AS job, count(*) AS done, count(*) FILTER (WHERE value > 5) AS correct,
      round(count(*) FILTER (WHERE value > 5) / count(*), 6) AS accuracy, max(ts) AS latest FROM events GROUP BY 1, 2""",
)
def _(spark, sf):
    source = f"{sf}/events.parquet"
    schema = spark.read.parquet(source).schema
    folder, _, name = source.rpartition("/")
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    # the table holds a month of events in any order, so no event counts as late here
    rollup = progress.progress_rollup(events, "ts", "event_type", F.col("value") > 5, "1 hour", "60 days")
    out = scratch_path(spark, "progress")
    progress.keep_updates(rollup, out, scratch_path(spark, "progress-state")).awaitTermination()
    return progress.latest_updates(spark.read.parquet(out))


@query(
    "job_progress",
    """WITH plan AS (SELECT count(*) // count(DISTINCT user_id) AS total, max(ts) AS newest FROM events),
      seen AS (SELECT user_id AS job, count(*) AS done, count(*) FILTER (WHERE value > 5) AS correct, max(ts) AS latest FROM events WHERE user_id IS NOT NULL GROUP BY 1)
      SELECT CAST(job AS VARCHAR) AS job, done, correct, total, CASE WHEN done >= total THEN 'finished'
        WHEN latest + INTERVAL 12 HOUR < newest - INTERVAL 2 HOUR THEN 'stalled' ELSE 'running' END AS state, latest FROM seen, plan""",
)
def _(spark, sf):
    """Events arrive in three parts under one checkpoint: the older half, the newer half, and the older half once more, which is too late."""
    events = spark.read.parquet(f"{sf}/events.parquet").where("user_id is not null")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    plan = events.agg(F.floor(F.count("*") / F.count_distinct("user_id")).alias("total"), F.floor((F.min(micros) + F.max(micros)) / 2).alias("half")).first()
    rows = events.withColumns({"total": F.lit(plan.total), "_at": micros - F.lit(plan.half)})
    folder, out, state = (scratch_path(spark, f"jobs-{x}") for x in ("events", "table", "state"))
    schema = rows.schema
    for part in ("_at < 0", "_at >= 0", "_at < 0"):
        rows.where(part).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        states = jobs.job_states(stream, "ts", "user_id", F.col("value") > 5, F.col("total"), ["event_id"])
        jobs.follow_jobs(states, out, state).awaitTermination()
    return jobs.current_jobs(rows, out).withColumn("latest", F.col("latest").cast("timestamp_ntz"))
