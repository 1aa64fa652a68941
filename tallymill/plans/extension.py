"""User-supplied scorers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tallymill.fixtures import ANSWER_PAIRS_SQL, EVAL_ROWS_SQL, RESPONSES_SQL, answer_pairs, eval_rows, responses
from tallymill.operators.aggregate import rounded
from tallymill.operators.compare import rescore_diff
from tallymill.operators.extension import DEFAULT_SCORERS, ScorerSpec, extract_and_score, pandas_scorer, rescore, score_by_task, task_metrics
from tallymill.operators.extract import answer_struct
from tallymill.operators.score import by_label
from tallymill.plans.registry import query

ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def parity_score(answer, expected, params):
    """A made-up task: is the answer even, as expected?"""
    same = answer["value"].cast("double") % 2 == expected.cast("double") % 2
    return by_label(F.when(answer["value"].isNull(), "parse_error").when(same, "same_parity").otherwise("other_parity"), ("same_parity",))


@query(
    "register_scorer",
    f"""WITH {ANSWER_PAIRS_SQL} SELECT l_returnflag, count(*) AS total, count(*) FILTER (WHERE predicted_num % 2 = expected_num % 2) AS correct,
      round(count(*) FILTER (WHERE predicted_num % 2 <> expected_num % 2) / count(*), 6) AS other_rate FROM answer_pairs GROUP BY l_returnflag""",
)
def _(spark, sf):
    book = DEFAULT_SCORERS.copy()
    other = rounded(F.count_if(F.col("match_type") == "other_parity") / F.count(F.lit(1)))
    spec = book.register(ScorerSpec("parity", parity_score, {"other_rate": other}))
    rows = answer_pairs(spark, sf).select(
        "l_returnflag",
        F.lit("parity").alias("task"),
        answer_struct(value=F.col("predicted_num")).alias("answer"),
        F.col("expected_num").cast("string").alias("expected"),
    )
    return task_metrics(score_by_task(rows, book, "task", "answer", "expected", {}), spec, ["l_returnflag"])


def _length_rule(answer: pd.Series, expected: pd.Series) -> pd.DataFrame:
    gap = (answer.str.len() - expected.str.len()).abs()
    label = gap.map(lambda g: "same_length" if g == 0 else "near" if g <= 3 else "far")
    return pd.DataFrame({"correct": gap == 0, "match_type": label, "accuracy": 1.0 / (1.0 + gap)})


@query(
    "pandas_scorer",
    f"""WITH {ANSWER_PAIRS_SQL}, g AS (SELECT {KEY_SQL}, abs(length(predicted_txt) - length(expected_txt)) AS gap FROM answer_pairs)
    SELECT {KEY_SQL}, gap = 0 AS correct, CASE WHEN gap = 0 THEN 'same_length' WHEN gap <= 3 THEN 'near' ELSE 'far' END AS match_type,
      round(1.0 / (1.0 + gap), 6) AS accuracy FROM g""",
)
def _(spark, sf):
    verdict = pandas_scorer(_length_rule)(F.col("predicted_txt"), F.col("expected_txt"))
    rows = answer_pairs(spark, sf).select(*ROW_KEY, verdict.alias("v"))
    return rows.select(*ROW_KEY, "v.correct", "v.match_type", rounded(F.col("v.accuracy")).alias("accuracy"))


@query(
    "extract_and_score",
    f"""WITH {RESPONSES_SQL}, t AS (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN 'arithmetic' ELSE 'family_relations' END AS task FROM responses)
    SELECT task, count(*) AS total, count(*) FILTER (WHERE l_linenumber % 7 <= 2
      OR (l_linenumber % 7 = 4 AND (task = 'family_relations' OR l_quantity = 12))) AS correct FROM t GROUP BY task""",
)
def _(spark, sf):
    rows = responses(spark, sf).withColumn(
        "task", F.expr("case when l_partkey % 2 = 0 then 'arithmetic' else 'family_relations' end")
    )
    out = extract_and_score(rows, DEFAULT_SCORERS, "task", "raw_response", "expected", {}, ["arithmetic", "family_relations"])
    return out.groupBy("task").agg(F.count(F.lit(1)).alias("total"), F.count_if("verdict.correct").alias("correct"))


# Tasks with metrics of their own, and labels that their rows take in turn.
_LABELS = {
    "linda_fallacy": ["fallacy_detected", "no_fallacy", "parse_error", "conjunction_not_found"],
    "false_premise": ["partial_hedge", "wrong_compliance", "correct_refusal"],
    "symbol_arithmetic": ["wrong_assumed_commutative", "wrong_assumed_associative", "undefined_correct", "undefined_missed", "parse_error"],
    "encoding_cipher": ["paranoid_refusal", "hallucinated_execution", "wrong_decode", "correct"],
    "sally_anne": ["reality_trap", "correct", "parse_error"],
    "time_arithmetic": ["correct_refusal", "wrong_compliance", "wrong_refusal"],
}
_RIGHT = "('no_fallacy', 'correct_refusal', 'undefined_correct', 'correct')"
_LABELLED_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS task, model_name, l_linenumber % 2 = 0 AS is_impossible, list_extract({ls}, CAST((l_orderkey + l_partkey) % {len(ls)} AS INT) + 1) AS match_type FROM eval_rows"
    for t, ls in _LABELS.items()
)
# Metric: rows that count and rows of its base.
_METRICS = {
    "linda_fallacy": {"fallacy_rate": ("match_type = 'fallacy_detected'", "match_type NOT IN ('parse_error', 'conjunction_not_found')")},
    "false_premise": {"hedge_rate": ("match_type = 'partial_hedge'", "NOT correct"), "compliance_rate": ("match_type = 'wrong_compliance'", "NOT correct")},
    "symbol_arithmetic": {
        "commutativity_rate": ("match_type = 'wrong_assumed_commutative'", "NOT correct AND match_type <> 'parse_error'"),
        "associativity_rate": ("match_type = 'wrong_assumed_associative'", "NOT correct AND match_type <> 'parse_error'"),
        "undefined_detection_rate": ("match_type = 'undefined_correct'", "match_type IN ('undefined_correct', 'undefined_missed')"),
    },
    "encoding_cipher": {
        "refusal_rate": ("match_type = 'paranoid_refusal'", "TRUE"),
        "hallucinated_execution_rate": ("match_type = 'hallucinated_execution'", "TRUE"),
        "wrong_decode_rate": ("match_type = 'wrong_decode'", "TRUE"),
    },
    "sally_anne": {"reality_trap_rate": ("match_type = 'reality_trap'", "TRUE")},
    "time_arithmetic": {
        "impossible_detection_rate": ("match_type = 'correct_refusal'", "is_impossible"),
        "hallucination_rate": ("match_type = 'wrong_compliance'", "is_impossible"),
        "false_refusal_rate": ("match_type = 'wrong_refusal'", "NOT is_impossible"),
    },
}
_METRICS_SQL = " UNION ALL ".join(
    f"SELECT task, model_name, '{m}' AS metric, count(*) AS total, count(*) FILTER (WHERE correct) AS correct, "
    f"round(count(*) FILTER (WHERE {n} AND {d}) / nullif(count(*) FILTER (WHERE {d}), 0), 6) AS value FROM r WHERE task = '{t}' GROUP BY task, model_name"
    for t, ms in _METRICS.items()
    for m, (n, d) in ms.items()
)


@query(
    "metrics_by_task",
    f"WITH {EVAL_ROWS_SQL}, l AS ({_LABELLED_SQL}), r AS (SELECT *, match_type IN {_RIGHT} AS correct FROM l) {_METRICS_SQL}",
)
def _(spark, sf):
    cases = F.create_map(*[x for t, ls in _LABELS.items() for x in (F.lit(t), F.array(*map(F.lit, ls)))])
    rows = eval_rows(spark, sf).select(
        "model_name",
        (F.col("l_linenumber") % 2 == 0).alias("is_impossible"),
        F.explode(cases).alias("task", "labels"),
        (F.col("l_orderkey") + F.col("l_partkey")).alias("k"),
    )
    label = F.get("labels", F.pmod("k", F.size("labels")).cast("int"))
    right = F.expr(f"label IN {_RIGHT}")
    verdict = F.struct(right.alias("correct"), F.col("label").alias("match_type"), right.cast("double").alias("accuracy"))
    scored = rows.withColumn("label", label).withColumn("verdict", verdict).withColumn("error", F.lit(None).cast("string"))
    out = None
    for task, metrics in _METRICS.items():
        wide = task_metrics(scored.filter(F.col("task") == task), DEFAULT_SCORERS.get(task), ["task", "model_name"])
        long = wide.unpivot(["task", "model_name", "total", "correct"], list(metrics), "metric", "value")
        out = long if out is None else out.unionByName(long)
    return out


@query(
    "rescore_by_task",
    f"""WITH {RESPONSES_SQL}, t AS (SELECT *, CASE WHEN l_partkey % 2 = 0 THEN 'arithmetic' ELSE 'family_relations' END AS task FROM responses
      WHERE status = 'success' AND raw_response <> ''),
    n AS (SELECT task, correct AS old, l_linenumber % 7 = 5 AND task = 'arithmetic' AS failed,
      l_linenumber % 7 <= 2 OR (l_linenumber % 7 = 4 AND (task = 'family_relations' OR l_quantity = 12)) AS fresh FROM t),
    v AS (SELECT task, old, CASE WHEN failed THEN old ELSE fresh END AS new FROM n)
    SELECT task AS task_type, count(*) AS total, count(*) FILTER (WHERE NOT old AND new) AS improved, count(*) FILTER (WHERE old AND NOT new) AS regressed,
      count(*) FILTER (WHERE old = new) AS unchanged FROM v GROUP BY task
    UNION ALL SELECT 'TOTAL', count(*), count(*) FILTER (WHERE NOT old AND new), count(*) FILTER (WHERE old AND NOT new), count(*) FILTER (WHERE old = new) FROM v""",
)
def _(spark, sf):
    rows = responses(spark, sf).select(
        F.expr("case when l_partkey % 2 = 0 then 'arithmetic' else 'family_relations' end").alias("task_type"),
        F.to_json(F.struct(F.col("expected").alias("expected_answer"))).alias("task_params"),
        "raw_response",
        F.lit(None).cast("string").alias("parsed_answer"),
        "status",
        "correct",
    )
    changed = rescore_diff(rescore(rows, DEFAULT_SCORERS, ["arithmetic", "family_relations"]))
    return changed.select("task_type", "total", "improved", "regressed", "unchanged")
