"""Nothing is lost on reading: every document is readable or reported."""

from __future__ import annotations

import gzip
import json

from tallymill.operators.aggregate import run_summary
from tallymill.session import checkpoint_root
from tallymill.sources.documents import bad_documents, explode_results, read_results, run_headers, split_readable

import pytest


def document(name, results=()):
    return json.dumps({"metadata": {"result_id": name}, "model_info": {"model_name": name}, "results": list(results)})


def test_lines(spark, tmp_path):
    lines = [document("a"), '{"broken": ', document("b")]
    (tmp_path / "x.json.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    good, bad = split_readable(spark, str(tmp_path), "*.gz", one_per_file=False)
    assert sorted(r.model_info.model_name for r in good.collect()) == ["a", "b"]
    assert [(r.cause, r.document) for r in bad.collect()] == [("broken document", '{"broken": ')]


def test_truncated_gzip_is_reported(spark, tmp_path):
    whole = gzip.compress("\n".join(document(f"m{k}") for k in range(20_000)).encode())
    (tmp_path / "cut.json.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "good.json.gz").write_bytes(gzip.compress(document("g").encode()))
    (tmp_path / "none.json.gz").write_bytes(b"this is no gzip file")
    (tmp_path / "empty.json.gz").write_bytes(gzip.compress(b""))
    (tmp_path / "two.json.gz").write_bytes(gzip.compress(document("t").encode() + b"\n") + gzip.compress(document("u").encode()))
    bad = {(r.file_path.rsplit("/", 1)[1], r.cause) for r in bad_documents(spark, str(tmp_path), "*.gz", one_per_file=False).collect() if r.cause != "broken document"}
    assert bad == {("cut.json.gz", "truncated gzip"), ("none.json.gz", "no gzip"), ("empty.json.gz", "no document")}
    names = {r.model_info.model_name for r in read_results(spark, str(tmp_path), "*.gz", one_per_file=False).collect()}
    assert {"g", "t", "u"} <= names


def test_one_document_per_file(spark, tmp_path):
    (tmp_path / "results_1.json.gz").write_bytes(gzip.compress(json.dumps(json.loads(document("a")), indent=1).encode()))
    (tmp_path / "results_2.json.gz").write_bytes(gzip.compress(b'{"model_info": '))
    good, bad = split_readable(spark, str(tmp_path))
    assert [r.model_info.model_name for r in good.collect()] == ["a"]
    assert [r.cause for r in bad.collect()] == ["broken document"]


def test_runs_without_results_stay(spark, tmp_path):
    entry = {"test_id": "t1", "status": "success", "evaluation": {"correct": True}}
    (tmp_path / "x.json.gz").write_bytes(gzip.compress("\n".join([document("full", [entry]), document("empty")]).encode()))
    docs = read_results(spark, str(tmp_path), "*.gz", one_per_file=False)
    assert {r.run_id: r.n_results for r in run_headers(docs).collect()} == {"full": 1, "empty": 0}
    rows = explode_results(docs)
    assert rows.count() == 2
    totals = {r.run_id: (r.total_tests, r.successful_tests) for r in run_summary(rows).collect()}
    assert totals == {"full": (1, 1), "empty": (0, 0)}


def test_a_cluster_must_name_the_shared_folder():
    class Bare:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(Bare)
