"""Time the headline queries on the driver tables and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from tallymill.plans import QUERIES
from tallymill.session import build_session

HEADLINE = (
    "model_rollup",
    "run_summary",
    "task_breakdown",
    "breakdown_by",
    "match_type_counts",
    "pivot_prompt",
    "leaderboard",
    "best_worst",
    "quartiles",
    "framing_consistency",
    "taxonomy_rates",
    "cube_report",
    "stratified_sample",
    "dedup_last",
    "head_sample",
    "join_testset",
    "rescore_diff",
    "extract_and_score",
    "extract_cascade",
    "extraction_report",
    "score_graded_text",
    "score_equal_incomparable",
    "score_cells",
    "evidence_ngram",
    "text_normalise",
    "last_sentences",
    "classify_refusal",
    "extract_ranking",
    "label_units",
    "assign_ids",
    "progress_rollup",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__checkpoint__dir=os.environ.get("BENCH_SHARED_DIR", "/tmp/tallymill-bench"),
        spark__tallymill__spread="true",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["model_rollup"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
