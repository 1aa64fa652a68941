"""Job states and their bounded table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.streaming import jobs

UPDATES = "job string, done long, correct long, total long, state string, latest timestamp"


def rows(df):
    return sorted((r.job, r.done, r.state) for r in df.collect())


def test_merge_of_update_batches(spark, tmp_path):
    """Later rows win, running a batch again changes nothing, and two tables at most are kept."""
    path = str(tmp_path / "table")
    fresh = ["done", F.col("state") == "stalled"]
    say = lambda *said: spark.createDataFrame([(j, d, 0, 9, s, None) for j, d, s in said], UPDATES)
    batches = [say(("a", 1, "running"), ("b", 2, "running")), say(("a", 3, "running")), say(("a", 3, "stalled"), ("c", 9, "finished")), say()]
    for number, batch in enumerate(batches):
        for _ in range(2):
            jobs.merge_updates(batch, number, path, ["job"], fresh)
        assert len(jobs.table_versions(batch, path)) <= 2
    assert rows(jobs.current_jobs(batches[0], path)) == [("a", 3, "stalled"), ("b", 2, "running"), ("c", 9, "finished")]
    jobs.merge_updates(batches[2], 2, path, ["job"], fresh)
    assert rows(jobs.current_jobs(batches[0], path)) == [("a", 3, "stalled"), ("b", 2, "running"), ("c", 9, "finished")]


def test_duplicates_and_late_events(spark, tmp_path):
    """Two runs from one checkpoint: repeats within the watermark count once, events behind it not at all."""
    folder, table, state = (str(tmp_path / x) for x in ("in", "table", "state"))
    schema = "id long, job string, ts timestamp, ok boolean"
    parts = [
        [(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 01:00:00"), (3, "b", "2024-01-01 01:00:00")],
        [(2, "a", "2024-01-01 01:00:00"), (4, "a", "2024-01-01 02:00:00"), (9, "c", "2024-01-03 00:00:00")],
        [(5, "b", "2024-01-01 03:00:00"), (10, "c", "2024-01-03 00:30:00")],
    ]
    for part in parts:
        made = spark.createDataFrame([(i, j, t, True) for i, j, t in part], "id long, job string, t string, ok boolean")
        made.select("id", "job", F.col("t").cast("timestamp").alias("ts"), "ok").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        states = jobs.job_states(stream, "ts", "job", F.col("ok"), F.lit(3), ["id"])
        jobs.follow_jobs(states, table, state).awaitTermination()
    assert rows(jobs.current_jobs(states, table)) == [("a", 3, "finished"), ("b", 1, "stalled"), ("c", 2, "running")]
