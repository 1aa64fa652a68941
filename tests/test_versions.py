"""Version comparison and distributed ranks against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallymill.functions.rules import drive_or_walk
from tallymill.operators.assemble import number_rows, ranked
from tallymill.operators.compare import version_diff


def test_full_join_of_two_versions(spark):
    schema = "config_hash string, test_id string, model_name string, at int, value string, correct boolean"
    old = spark.createDataFrame([("c", "t1", "m", 1, "a", True), ("c", "t1", "m", 2, "b", False), (None, "t2", "m", 1, "a", True), ("c", "t3", None, 1, None, None), ("c", "gone", "m", 1, "a", True)], schema)
    new = spark.createDataFrame([("c", "t1", "m", 1, "b", True), (None, "t2", "m", 1, "z", False), ("c", "t3", None, 1, None, False), ("c", "fresh", "m", 1, "a", None)], schema)
    got = {r.test_id: (r.config_hash, r.model_name, r.old_value, r.new_value, r.old_correct, r.new_correct, r.parse_changed, r.change) for r in version_diff(old, new, ["at"]).collect()}
    assert got == {
        "t1": ("c", "m", "b", "b", False, True, False, "improved"),
        "t2": (None, "m", "a", "z", True, False, True, "regressed"),
        "t3": ("c", None, None, None, False, False, False, "unchanged"),
        "gone": ("c", "m", "a", None, True, None, False, "removed"),
        "fresh": ("c", "m", None, "a", None, False, False, "added"),
    }
    empty = old.where("false")
    assert {r.change for r in version_diff(old, empty, ["at"]).collect()} == {"removed"}
    assert version_diff(empty, empty, ["at"]).collect() == []


@pytest.mark.parametrize("descending", [True, False])
def test_ranks_with_ties(spark, descending):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice([None, *range(12)])) for k in range(300)] + [(k, "hot", 7) for k in range(300, 500)]
    df = spark.createDataFrame(rows, "id int, g string, x int").repartition(5)
    better = lambda y, x: (x is None and y is not None) or (x is not None and y is not None and (y > x if descending else y < x))
    for within in ((), ("g",)):
        peers = lambda g: [y for _, h, y in rows if not within or h == g]  # noqa: B023, E731
        want = {k: 1 + sum(better(y, x) for y in peers(g)) for k, g, x in rows}
        out = ranked(df, "x", within=within, descending=descending)
        assert {r.id: r["rank"] for r in out.collect()} == want
        assert len(out.collect()) == len(rows)
    assert ranked(df.where("false"), "x").collect() == []


def test_no_window_over_one_partition(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    for made in (ranked(df, "x"), number_rows(df, ["x", "id"])):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert all("_part" in line for line in plan.splitlines() if "Window [" in line)


def test_conditional_walks(spark):
    texts = ["drive. in the    unlikely case you walk", "Drive. however, if " + 41 * "y " + "z walk", "Drive it there. Only walk if you must.", "Walk. Or drive.", "don't drive, go on foot"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r.r for r in df.select("k", drive_or_walk(F.col("t")).alias("r")).orderBy("k").collect()] == ["drive", "walk", "drive", "drive", "walk"]
