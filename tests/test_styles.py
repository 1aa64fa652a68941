"""Styles of test sets: what is shuffled and kept on disk on the way, and rows with missing or repeated keys."""

from __future__ import annotations

import os
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallymill.operators.compare import with_styles
from tallymill.plans import QUERIES, files
from tallymill.session import shuffles_dropped
from tallymill.sources.documents import explode_results, read_results, read_testsets, write_documents


def shuffle_files(spark) -> set[str]:
    places = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {x for place in places for _, _, names in os.walk(place) for x in names if x.startswith("shuffle_")}


def left(spark, before: set[str]) -> set[str]:
    until = time.time() + 20
    while (new := shuffle_files(spark) - before) and time.time() < until:  # files are deleted in the background
        time.sleep(0.2)
    return new


def row_shuffles(df, capsys) -> int:
    capsys.readouterr()
    df.explain()
    return len(re.findall(r"Exchange hashpartitioning", capsys.readouterr().out))


def tables(spark, path) -> list[tuple]:
    """Line items, some twice, some without supplier, order, part or place, some of parts that come twice."""
    rows = [(k % 40 if k % 7 else None, k % 30 if k % 11 else None, k % 12 if k % 13 else None, k % 5 if k % 17 else None, float(k % 20), 100.0 + k, (k % 12) / 100, (k % 10) / 100) for k in range(400)]
    rows = [(*x, "ANR"[(x[2] or 0) % 3]) for x in rows]
    rows += rows[:50]
    schema = "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame([(*x, "F", None) for x in rows], schema).write.parquet(f"{path}/lineitem.parquet")
    parts = [(k, ["STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO"][k % 6], "b", 1) for k in range(12)]
    spark.createDataFrame(parts + parts[:3], "p_partkey long, p_type string, p_brand string, p_size int").write.parquet(f"{path}/part.parquet")
    return rows


def test_no_shuffle_files_stay(spark, tmp_path):
    before = shuffle_files(spark)
    with shuffles_dropped(spark):
        spark.range(1000).groupBy(F.col("id") % 10).count().write.parquet(str(tmp_path / "x"))
    assert not left(spark, before) and spark.read.parquet(str(tmp_path / "x")).count() == 10
    tables(spark, tmp_path)
    before = shuffle_files(spark)
    QUERIES["styles_from_testset"](spark, str(tmp_path))
    assert not left(spark, before)


def test_styles_of_odd_rows(spark, tmp_path):
    rows = tables(spark, tmp_path)
    want = Counter()
    for _, run, part, _, _, _, _, _, flag in rows:
        if part is not None:
            own = ({"A": "minimal", "N": "casual"}.get(flag, "linguistic"), ("analytical", "casual", "adversarial")[part % 3], "en")
            want[(None, None, None) if run is None else own] += 1 + (part < 3)
    got = QUERIES["styles_from_testset"](spark, str(tmp_path)).collect()
    assert {(r.user_style, r.system_style, r.language): r.total for r in got} == want
    assert all(r.successful <= r.total and r.correct <= r.successful for r in got) and sum(r.correct for r in got) > 0


def test_documents_of_odd_rows(spark, tmp_path):
    """A case is in its set once, and results have their names though they are made late."""
    rows = tables(spark, tmp_path)
    folder = files._styled_documents(spark, str(tmp_path))
    _, cases = read_testsets(spark, f"{folder}/sets", one_per_file=False)
    cases = cases.select("config_hash", "test_id", "task_type", "prompt_metadata").collect()
    assert len({(r.config_hash, r.test_id) for r in cases}) == len(cases)
    results = explode_results(read_results(spark, f"{folder}/results", "*.json.gz", one_per_file=False)).collect()
    assert len(results) == sum(1 + (x[2] < 3) for x in rows if x[2] is not None)
    named = {r.test_id for r in cases}
    tasks = ("time_arithmetic", "game_of_life", "arithmetic", "carwash", "linda_fallacy", "grid_tasks")
    for r in results:
        if r.run_id is None:
            assert (r.model_name, r.config_hash, r.quantization) == ("unknown", None, None)
        else:
            assert (r.model_name, r.config_hash) == (f"model{int(r.run_id) % 6}", f"set-{int(r.run_id) % 7}") and r.test_id in named
        assert r.user_style is None and (r.status == "success") == (r.match_type is not None) and r.correct == (r.match_type == "exact")
    for r in cases:
        said = next((t for t in tasks if f"_{t}_" in r.test_id), "unknown")
        assert r.task_type == said and (r.test_id.startswith("multi_") or said == "unknown") and set(r.prompt_metadata) == {"user_style", "system_style", "language"}


def test_styles_are_joined_with_one_shuffle_a_side(spark, capsys):
    cases = spark.createDataFrame(
        [("a", "1", {"user_style": "x", "language": "en"}), ("a", "1", {"user_style": "x", "language": "en"}), (None, "1", {"user_style": "y"}), ("", "1", {"user_style": "z"}), (None, None, {"user_style": "w"})],
        "config_hash string, test_id string, prompt_metadata map<string,string>",
    )
    results = spark.createDataFrame([("a", "1", None), (None, "1", None), ("", "1", None), (None, None, None), ("a", "1", "own"), ("b", "1", None)], "config_hash string, test_id string, user_style string")
    results = results.withColumn("system_style", F.lit(None).cast("string"))
    styled = with_styles(results, cases)
    got = [(r.config_hash, r.test_id, r.user_style, r.language) for r in styled.collect()]
    want = [("a", "1", "x", "en"), (None, "1", "y", None), ("", "1", "z", None), (None, None, None, None), ("a", "1", "own", "en"), ("b", "1", None, None)]
    assert Counter(got) == Counter(want) and styled.columns == ["config_hash", "test_id", "user_style", "system_style", "language"]
    before = {x: spark.conf.get(x) for x in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert row_shuffles(with_styles(results, cases), capsys) == 2
    finally:
        for x, value in before.items():
            spark.conf.set(x, value)


@pytest.mark.parametrize("shares", [1, 3])
def test_fields_made_late(spark, tmp_path, shares):
    """Fields in ``made`` are read back like columns, also in a run of several documents and from several writes."""
    rows = spark.range(90).select(
        F.when(F.col("id") >= 10, 1).alias("run_id"), "id", F.lit("success").alias("status"), F.lit(0.5).alias("duration"),
        F.lit(1).alias("input_tokens"), F.lit(2).alias("output_tokens"), F.lit("exact").alias("match_type"),
    )
    nothing = F.lit(None).cast("string")
    made = {x: nothing for x in ("quantization", "user_style", "system_style", "task_params", "raw_response")} | {
        "test_id": F.concat(F.lit("t"), F.col("id").cast("string")), "model_name": F.concat(F.lit("m"), F.col("run_id").cast("string")), "config_hash": F.lit("c"), "correct": F.col("id") % 2 == 0,
    }
    write_documents(rows, str(tmp_path / "d"), ["run_id"], per_document=30, made=made, shares=shares)
    docs = read_results(spark, str(tmp_path / "d"), "*.json.gz", one_per_file=False)
    got = explode_results(docs).collect()
    assert Counter((r.run_id, r.test_id, r.correct, r.config_hash) for r in got) == Counter((str(1) if k >= 10 else None, f"t{k}", k % 2 == 0, "c") for k in range(90))
    assert 3 <= docs.filter("metadata.result_id = '1'").count() <= 4 and docs.filter("model_info.model_name = 'm1'").count() >= 2
