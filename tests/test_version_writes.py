"""Two versions of one log are written in one pass."""

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tallymill.plans import comparison


def test_log_is_read_once(spark, sf, monkeypatch):
    writes, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (writes.append(path), write(self, path, *a, **k))[1])
    first, second = comparison.versions(spark, sf)
    assert len(writes) == 1
    rows = comparison.eval_rows(spark, sf)
    assert first.count() == rows.where("status = 'success'").count()
    assert second.count() == rows.where("task_type <> 'linda_fallacy'").count()


def test_version_without_rows(spark, sf, monkeypatch):
    rows = comparison.eval_rows(spark, sf).limit(20).withColumn("status", F.lit("error"))
    monkeypatch.setattr(comparison, "eval_rows", lambda *_: rows)
    first, second = comparison.versions(spark, sf)
    assert first.count() == 0 and first.columns == second.columns
    monkeypatch.setattr(comparison, "eval_rows", lambda *_: rows.limit(0))
    assert [v.count() for v in comparison.versions(spark, sf)] == [0, 0]
