from __future__ import annotations

from tallymill.sources.catalog import newest_first


def test_listing_is_read_once(spark):
    """The rows are shuffled before they are sorted, since sorting reads what it sorts twice."""
    listed = spark.range(50).selectExpr("id % 7 as modified", "id as run_id", "if(id % 5 = 0, null, id) as size")
    done = newest_first(listed, "modified", "run_id")
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan and "rangepartitioning" in plan
    rows = [(r.modified, r.run_id) for r in done.collect()]
    assert rows == sorted(rows, key=lambda r: (-r[0], r[1])) and len(rows) == 50
