"""Invariants of the roll-ups, and results on small hand-made rows."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tallymill.fixtures import eval_rows
from tallymill.operators import aggregate as agg
from tallymill.operators import assemble, compare, report
from tallymill.operators.extension import DEFAULT_SCORERS, ScorerSpec
from tallymill.sources import documents
from tallymill.streaming import ingest


@pytest.fixture(scope="module")
def rows(spark, sf):
    return eval_rows(spark, sf).cache()


def test_breakdown_totals(rows):
    n = rows.count()
    dims = ["task_type", "quantization", "p_size"]
    totals = agg.breakdown_by(rows, dims).groupBy("dimension").agg(F.sum("total").alias("t")).collect()
    assert {r["dimension"]: r["t"] for r in totals} == dict.fromkeys(dims, n)


def test_two_runs_of_one_model(spark):
    def run(run_id, quantization, total, errors):
        return [
            (run_id, "m", quantization, "arithmetic", "error" if i < errors else "success", i % 2 == 0 and i >= errors, "exact", 1.0, 1, 1)
            for i in range(total)
        ]

    schema = "run_id string, model_name string, quantization string, task_type string, status string, correct boolean, match_type string, duration double, input_tokens int, output_tokens int"
    df = spark.createDataFrame(run("a", None, 20, 2) + run("b", None, 10, 2) + run("c", "Q8_0", 5, 0), schema)
    out = {r["model_key"]: r for r in agg.model_rollup(df).collect()}
    assert set(out) == {"m", "m (Q8_0)"}
    assert (out["m"]["total_tests"], out["m"]["successful_tests"], out["m"]["result_count"]) == (30, 26, 2)
    assert [r["model_key"] for r in agg.model_rollup(df, with_quantization=False).collect()] == ["m"]


def test_top_k_is_limited_before_the_shuffle(rows):
    plan = report.head_sample(rows, ["run_id"], ["l_orderkey", "l_linenumber"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_sample_ignores_partitioning(rows):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    picks = [
        sorted(tuple(r) for r in report.stratified_sample(d, ["model_name"], keys).select(*keys).collect())
        for d in (rows, rows.repartition(7))
    ]
    assert picks[0] == picks[1] and len(picks[0]) <= 6 * 13


def test_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("t").alias("task"))
    out = assemble.number_rows(df, ["k"]).collect()
    assert sorted((r["k"], r["number"]) for r in out) == [(i, i + 1) for i in range(1000)]


@pytest.mark.parametrize("count", [0, 3, 7, 10, 23])
def test_fill_to_count(spark, count):
    df = spark.range(7).select(F.col("id"))
    out = assemble.fill_to_count(df, count, ["id"]).groupBy("id").count().collect()
    assert sum(r["count"] for r in out) == count
    assert not out or max(r["count"] for r in out) - (min(r["count"] for r in out) if len(out) == 7 else 0) <= 1


def test_fill_to_count_takes_whole_rounds(spark):
    df = spark.createDataFrame([(i,) for i in range(23)], "id int")
    for wanted in (0, 5, 23, 57):
        rows = [(r["id"], r["round"]) for r in assemble.fill_to_count(df, wanted, ["id"]).collect()]
        assert len(rows) == len(set(rows)) == wanted
        assert all(sum(1 for _, k in rows if k == n) == 23 for n in range(wanted // 23))
    assert assemble.fill_to_count(df.limit(0), 5, ["id"]).count() == 0


def test_mismatch_pairs(spark):
    items = spark.createDataFrame([(k, "abz"[k % 3]) for k in range(60)] + [(99, None)], "i int, g string")
    pool = spark.createDataFrame([(k, "aaabc"[k % 5]) for k in range(20)], "j int, h string")
    rows = compare.mismatch_pairs(items, pool, "g", "h", "i", "j", partners=4).collect()
    again = compare.mismatch_pairs(items.repartition(3), pool.repartition(2), "g", "h", "i", "j", partners=4).collect()
    assert sorted((r.i, r.j) for r in rows) == sorted((r.i, r.j) for r in again)
    assert all(r.g != r.h for r in rows)
    assert len({(r.i, r.j) for r in rows}) == len(rows) == 61 * 4
    few = compare.mismatch_pairs(items.limit(1), pool.where("h = 'b'"), "g", "h", "i", "j", partners=9).collect()
    assert len(few) == (0 if few and few[0].g == "b" else 4)


def test_rescore_net_equals_change(rows):
    df = rows.select(
        "task_type", F.col("correct").alias("old_correct"), (F.col("l_linenumber") > 3).alias("new_correct"),
        F.lit("a").alias("old_value"), F.lit("b").alias("new_value"),
    )
    for r in compare.rescore_diff(df).collect():
        assert r["improved"] + r["regressed"] + r["unchanged"] == r["total"]
        assert r["net"] == pytest.approx((r["new_accuracy"] - r["old_accuracy"]) * r["total"], abs=0.01 * r["total"])


def document(n, model="m"):
    entries = [
        {"test_id": f"multi_{i:04d}_carwash", "status": "success", "duration": 1.5,
         "input": {"user_prompt": "u", "task_params": {"expected_answer": "drive", "steps": [1, 2]}},
         "output": {"raw_response": "Drive.", "parsed_answer": {"a": 1}}, "tokens": {"input_tokens": 3, "output_tokens": 4},
         "evaluation": {"correct": True, "match_type": "correct", "details": {"fallacy_detected": True}}}
        for i in range(n)
    ]
    return {"metadata": {"result_id": f"r{n}"}, "model_info": {"model_name": model}, "testset_metadata": {"name": "t"}, "results": entries}


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    for n, where in ((2, tmp_path), (3, tmp_path / "deep")):
        with gzip.open(where / f"results_m_{n}.json.gz", "wt") as f:
            json.dump(document(n), f, indent=2)
    with gzip.open(tmp_path / "results_bad.json.gz", "wt") as f:
        f.write('{"metadata": {"result_id": ')
    (tmp_path / "results_torn.json.gz").write_bytes(b"not gzip at all")
    with gzip.open(tmp_path / "other.json.gz", "wt") as f:
        json.dump(document(9), f)
    return tmp_path


def test_documents(spark, folder):
    good, bad = documents.split_readable(spark, str(folder))
    assert sorted(r["file_path"].rsplit("/", 1)[-1] for r in bad.collect()) == ["results_bad.json.gz", "results_torn.json.gz"]
    rows = documents.explode_results(good)
    assert rows.count() == 5
    first = rows.first()
    assert json.loads(first["task_params"])["steps"] == [1, 2] and first["fallacy_detected"] and first["input_tokens"] == 3


def test_stream_takes_each_file_once(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("bronze")
    for _ in range(2):
        stream = ingest.stream_results(spark, str(folder / "deep"))
        ingest.append_new(stream, str(out / "rows"), str(out / "state")).awaitTermination()
        assert spark.read.parquet(str(out / "rows")).count() == 3


def test_scorer_book():
    book = DEFAULT_SCORERS.copy()
    assert len(book.tasks()) == 18 and book.get("nothing") is None
    with pytest.raises(ValueError):
        book.register(ScorerSpec("carwash", lambda a, e, p: a))
    book.register(ScorerSpec("carwash", lambda a, e, p: a), replace=True)


def test_quartiles_of_groups_of_any_size(spark):
    values = {"a": [3.0], "b": [1.0, 2.0], "c": [float(k * 7919 % 101) for k in range(101)], None: [5.0, 5.0, 9.0]}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("d", None)]
    got = {r.g: r for r in agg.quartiles(spark.createDataFrame(rows, "g string, v double"), "g", F.col("v")).collect()}
    assert set(got) == set(values)
    assert (got["a"].min, got["a"].median, got["a"].max, got["a"].iqr) == (3.0, 3.0, 3.0, 0.0)
    assert (got["b"].q1, got["b"].median, got["b"].q3) == (1.25, 1.5, 1.75)
    assert (got["c"].q1, got["c"].median, got["c"].q3, got["c"].max) == (25.0, 50.0, 75.0, 100.0)
    assert (got[None].median, got[None].q3) == (5.0, 7.0)
