from __future__ import annotations

from tallymill.sources.sinks import buckets_for


def test_buckets_grow_with_the_rows(spark):
    assert [buckets_for(spark.range(n), per_bucket=10) for n in (0, 80, 81, 1000)] == [8, 8, 16, 128]
