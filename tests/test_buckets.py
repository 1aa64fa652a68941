from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.operators.compare import join_testset
from tallymill.sources.sinks import write_bucketed

KEYS = ["config_hash", "test_id"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_tables_join_without_a_shuffle(spark):
    cases = spark.range(300).selectExpr("concat('h', id % 7) as config_hash", "concat('t', id) as test_id", "id as prompt")
    results = spark.range(1000).selectExpr("concat('h', id % 7) as config_hash", "concat('t', id % 400) as test_id", "id as row").unionByName(
        spark.createDataFrame([(None, "t1", -1)], "config_hash string, test_id string, row long")
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = [write_bucketed(t, name, KEYS, 5) for t, name in ((results, "bucketed_log"), (cases, "bucketed_cases"))]
        joined = join_testset(*stored, KEYS)
        assert "Exchange" in plan(join_testset(results, cases, KEYS))
        assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined)
        want = join_testset(results, cases, KEYS)
        assert joined.count() == 1001 and joined.exceptAll(want).count() == 0 and want.exceptAll(joined).count() == 0
        assert stored[0].select(F.input_file_name()).distinct().count() <= 5
        again = write_bucketed(cases.limit(0), "bucketed_cases", KEYS, 5)
        assert again.count() == 0 and again.columns == cases.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("bucketed_log", "bucketed_cases"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
