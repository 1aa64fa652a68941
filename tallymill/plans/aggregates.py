"""Aggregations over the evaluation log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.fixtures import CELL_PAIRS_SQL, EVAL_ROWS_SQL, MODEL_INVENTORY_SQL, cell_pairs, eval_rows, model_inventory
from tallymill.functions import fields, identity
from tallymill.operators import aggregate as agg
from tallymill.operators.aggregate import rounded
from tallymill.operators.score import score_cells
from tallymill.operators.report import inventory_groups
from tallymill.plans.columns import _BUCKET_CASE, _FAMILY_CASE, _QUANT_CASE
from tallymill.plans.registry import query

OK = "count(*) FILTER (WHERE status = 'success')"
GOOD = "count(*) FILTER (WHERE correct)"
PARSE = "count(*) FILTER (WHERE match_type = 'parse_error')"
TYPE = "count(*) FILTER (WHERE match_type = 'type_error')"


def summary_sql(keys: str) -> str:
    """Run-level summary with unrounded rates, as a subquery body."""
    return f"""SELECT {keys}, count(*) AS total_tests, {OK} AS successful_tests, count(*) - {OK} AS failed_tests,
      {GOOD} AS correct_responses, {PARSE} AS parse_errors, {TYPE} AS type_errors, sum(duration) AS duration_seconds,
      CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
      {OK} / count(*) AS success_rate, {GOOD} / nullif({OK}, 0) AS accuracy, {GOOD} / count(*) AS accuracy_total,
      {PARSE} / nullif({OK}, 0) AS parse_error_rate, {PARSE} / count(*) AS parse_error_rate_total,
      {TYPE} / nullif({OK}, 0) AS type_error_rate, sum(duration) / count(*) AS avg_time_per_test,
      sum(input_tokens) / nullif({OK}, 0) AS avg_input_tokens_per_test,
      sum(output_tokens) / nullif({OK}, 0) AS avg_output_tokens_per_test,
      (sum(input_tokens) + sum(output_tokens)) / nullif({OK}, 0) AS avg_tokens_per_test
    FROM eval_rows GROUP BY {keys}"""


RUN_SQL = f"{EVAL_ROWS_SQL}, runs AS ({summary_sql('run_id, model_name, quantization')})"
RUN_KEYS = ["run_id", "model_name", "quantization"]
RATE_COLS = [
    "success_rate",
    "accuracy",
    "accuracy_total",
    "parse_error_rate",
    "type_error_rate",
    "avg_time_per_test",
    "avg_input_tokens_per_test",
    "avg_output_tokens_per_test",
    "avg_tokens_per_test",
]
COUNT_COLS = [
    "total_tests",
    "successful_tests",
    "failed_tests",
    "correct_responses",
    "parse_errors",
    "type_errors",
    "total_input_tokens",
    "total_output_tokens",
]


def runs(spark, sf):
    return agg.run_summary(eval_rows(spark, sf), RUN_KEYS)


@query(
    "run_summary",
    f"WITH {RUN_SQL} SELECT {', '.join(RUN_KEYS + COUNT_COLS)}, round(duration_seconds, 4) AS duration_seconds, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in RATE_COLS)
    + " FROM runs",
)
def _(spark, sf):
    return runs(spark, sf).select(
        *RUN_KEYS,
        *COUNT_COLS,
        rounded(F.col("duration_seconds"), 4).alias("duration_seconds"),
        *[rounded(F.col(c)).alias(c) for c in RATE_COLS],
    )


@query(
    "task_breakdown",
    f"""WITH {EVAL_ROWS_SQL} SELECT run_id, task_type, count(*) AS total, {GOOD} AS correct, {PARSE} AS parse_errors,
      round({GOOD} / count(*), 6) AS accuracy, round({PARSE} / count(*), 6) AS parse_error_rate
    FROM eval_rows GROUP BY run_id, task_type""",
)
def _(spark, sf):
    out = agg.task_breakdown(eval_rows(spark, sf))
    return out.withColumns({c: rounded(F.col(c)) for c in ("accuracy", "parse_error_rate")})


_ROLLUP_RATES = ["success_rate", "accuracy", "parse_error_rate", "avg_time_per_test", "avg_input_tokens_per_test", "avg_output_tokens_per_test"]


@query(
    "model_rollup",
    f"""WITH {EVAL_ROWS_SQL}
    SELECT CASE WHEN quantization IS NULL THEN model_name ELSE model_name || ' (' || quantization || ')' END AS model_key,
      count(DISTINCT run_id) AS result_count, count(*) AS total_tests, {OK} AS successful_tests, {GOOD} AS correct_responses,
      {PARSE} AS parse_errors, round(sum(duration), 4) AS duration_seconds,
      CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
      array_to_string(list_sort(list(DISTINCT task_type)), ',') AS task_types,
      round({OK} / count(*), 6) AS success_rate, round({GOOD} / nullif({OK}, 0), 6) AS accuracy,
      round({PARSE} / nullif({OK}, 0), 6) AS parse_error_rate, round(sum(duration) / nullif({OK}, 0), 6) AS avg_time_per_test,
      round(sum(input_tokens) / nullif({OK}, 0), 6) AS avg_input_tokens_per_test,
      round(sum(output_tokens) / nullif({OK}, 0), 6) AS avg_output_tokens_per_test
    FROM eval_rows GROUP BY 1""",
)
def _(spark, sf):
    return agg.model_rollup(eval_rows(spark, sf)).select(
        "model_key",
        "result_count",
        "total_tests",
        "successful_tests",
        "correct_responses",
        "parse_errors",
        rounded(F.col("duration_seconds"), 4).alias("duration_seconds"),
        "total_input_tokens",
        "total_output_tokens",
        F.array_join("task_types", ",").alias("task_types"),
        *[rounded(F.col(c)).alias(c) for c in _ROLLUP_RATES],
    )


@query(
    "match_type_counts",
    f"""WITH {EVAL_ROWS_SQL}, c AS (SELECT model_name, match_type, count(*) AS n, {OK} AS ok FROM eval_rows GROUP BY ALL)
    SELECT model_name, match_type, n, round(share, 6) AS share FROM (
      SELECT *, n / greatest(sum(ok) OVER (PARTITION BY model_name), 1) AS share FROM c)
    WHERE match_type IS NOT NULL AND match_type NOT IN ('exact', 'perfect')""",
)
def _(spark, sf):
    return agg.match_type_counts(eval_rows(spark, sf), ["model_name"]).withColumn("share", rounded(F.col("share")))


@query(
    "base_aggregate",
    f"""WITH {EVAL_ROWS_SQL} SELECT task_type, round({GOOD} / count(*), 6) AS accuracy, {GOOD} AS correct, count(*) AS total,
      count(*) - {OK} AS error_count FROM eval_rows GROUP BY task_type""",
)
def _(spark, sf):
    return agg.base_aggregate(eval_rows(spark, sf), ["task_type"]).withColumn("accuracy", rounded(F.col("accuracy")))


_DIMS = ["task_type", "user_style", "system_style", "quantization", "p_size", "p_brand"]


@query(
    "breakdown_by",
    f"WITH {EVAL_ROWS_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, coalesce(CAST({d} AS VARCHAR), 'unknown') AS value, count(*) AS total, "
        f"{GOOD} AS correct, round({GOOD} / count(*), 6) AS accuracy FROM eval_rows GROUP BY 2"
        for d in _DIMS
    ),
)
def _(spark, sf):
    return agg.breakdown_by(eval_rows(spark, sf), _DIMS).withColumn("accuracy", rounded(F.col("accuracy")))


@query(
    "cell_accuracy",
    f"""WITH {CELL_PAIRS_SQL}, s AS (SELECT label, len(expected) AS t,
        len(list_filter(list_zip(expected, predicted), lambda z: z[1] = z[2])) AS c FROM cell_pairs)
    SELECT label, CAST(sum(c) AS BIGINT) AS correct_cells, CAST(sum(t) AS BIGINT) AS total_cells,
      round(sum(c) / sum(t), 6) AS micro_accuracy, round(avg(2 * (c / t - 0.5)), 6) AS macro_accuracy FROM s GROUP BY label""",
)
def _(spark, sf):
    scored = cell_pairs(spark, sf).select("label", score_cells(F.col("predicted"), F.col("expected")).alias("s"))
    out = agg.cell_accuracy(scored.select("label", "s.*"), ["label"])
    return out.withColumns({c: rounded(F.col(c)) for c in ("micro_accuracy", "macro_accuracy")})


# The taxonomy labels are spread over the rows by line number and part key.
_TAXONOMY = (
    "fallacy_detected",
    "no_fallacy",
    "conjunction_not_found",
    "partial_hedge",
    "wrong_compliance",
    "correct_refusal",
    "wrong_refusal",
    "wrong_assumed_commutative",
    "wrong_assumed_associative",
    "undefined_correct",
    "undefined_missed",
    "paranoid_refusal",
    "hallucinated_execution",
    "wrong_decode",
    "reality_trap",
    "parse_error",
)
_TAX_SQL = (
    "CASE (l_partkey + l_linenumber) % 16 "
    + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TAXONOMY))
    + " END"
)
_RIGHT = "('no_fallacy', 'correct_refusal', 'undefined_correct', 'hallucinated_execution')"


def _rate_sql(name: str, num: str, den: str) -> str:
    return f"round(count(*) FILTER (WHERE ({num}) AND ({den})) / nullif(count(*) FILTER (WHERE {den}), 0), 6) AS {name}"


def _mt(name: str) -> str:
    return f"mt = '{name}'"


_TAX_RATES = ", ".join(
    [
        _rate_sql("fallacy_rate", _mt("fallacy_detected"), "mt NOT IN ('parse_error', 'conjunction_not_found', 'components_not_found') AND err IS NULL"),
        _rate_sql("hedge_rate", _mt("partial_hedge"), "NOT good"),
        _rate_sql("compliance_rate", _mt("wrong_compliance"), "NOT good"),
        _rate_sql("commutativity_rate", _mt("wrong_assumed_commutative"), "NOT good AND mt <> 'parse_error'"),
        _rate_sql("associativity_rate", _mt("wrong_assumed_associative"), "NOT good AND mt <> 'parse_error'"),
        _rate_sql("undefined_detection_rate", _mt("undefined_correct"), "mt IN ('undefined_correct', 'undefined_wrong', 'undefined_missed')"),
        _rate_sql("impossible_detection_rate", _mt("correct_refusal"), "imp"),
        _rate_sql("hallucination_rate", _mt("wrong_compliance"), "imp"),
        _rate_sql("false_refusal_rate", _mt("wrong_refusal"), "NOT imp"),
        _rate_sql("refusal_rate", _mt("paranoid_refusal"), "TRUE"),
        _rate_sql("hallucinated_execution_rate", _mt("hallucinated_execution"), "TRUE"),
        _rate_sql("wrong_decode_rate", _mt("wrong_decode"), "TRUE"),
        _rate_sql("parse_error_rate", _mt("parse_error"), "TRUE"),
        _rate_sql("reality_trap_rate", _mt("reality_trap"), "TRUE"),
        _rate_sql("decimal_trap_accuracy", "good", "trap"),
    ]
)


@query(
    "taxonomy_rates",
    f"""WITH {EVAL_ROWS_SQL}, t AS (SELECT model_name, mt, mt IN {_RIGHT} AS good, l_quantity % 2 = 0 AS imp,
        l_quantity % 5 = 0 AS trap, CASE WHEN status = 'error' THEN 'failed' END AS err
      FROM (SELECT *, {_TAX_SQL} AS mt FROM eval_rows))
    SELECT model_name, {_TAX_RATES} FROM t GROUP BY model_name""",
)
def _(spark, sf):
    rows = (
        eval_rows(spark, sf)
        .withColumn("match_type", F.expr(_TAX_SQL))
        .withColumns(
            {
                "correct": F.expr(f"match_type in {_RIGHT}"),
                "is_impossible": F.expr("l_quantity % 2 = 0"),
                "is_decimal_trap": F.expr("l_quantity % 5 = 0"),
                "error": F.expr("case when status = 'error' then 'failed' end"),
            }
        )
    )
    return agg.taxonomy_rates(rows, ["model_name"])


_OPTION_COLS = """cast(cast(l_quantity as int) as {S}) as value1, 'kg' as unit1_symbol,
  cast(cast(l_linenumber as int) as {S}) as value2, 'lb' as unit2_symbol,
  case when l_quantity > l_linenumber then 'first' else 'second' end as correct_position,
  case l_partkey % 3 when 0 then concat(cast(cast(l_quantity as int) as {S}), ' KG')
    when 1 then concat(cast(l_linenumber as {S}), 'lb') else 'equal' end as predicted"""


@query(
    "position_bias",
    f"""WITH {EVAL_ROWS_SQL}, o AS (SELECT model_name, {_OPTION_COLS.format(S='VARCHAR')} FROM eval_rows),
    c AS (SELECT *, contains(lower(predicted), value1 || ' kg') OR contains(lower(predicted), value1 || 'kg') AS p1,
      contains(lower(predicted), value2 || ' lb') OR contains(lower(predicted), value2 || 'lb') AS p2 FROM o)
    SELECT model_name, count(*) FILTER (WHERE correct_position = 'first') AS first_correct_total,
      count(*) FILTER (WHERE p1) AS first_predicted_total,
      count(*) FILTER (WHERE correct_position = 'second') AS second_correct_total,
      count(*) FILTER (WHERE NOT p1 AND p2) AS second_predicted_total FROM c GROUP BY model_name""",
)
def _(spark, sf):
    rows = eval_rows(spark, sf).selectExpr("model_name", *_split_exprs(_OPTION_COLS.format(S="string")))
    return agg.position_bias(rows, ["model_name"])


def _split_exprs(text: str) -> list[str]:
    """Split a select list at top-level commas."""
    out, depth, quoted, part = [], 0, False, ""
    for ch in text:
        quoted ^= ch == "'"
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0 and not quoted:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


@query(
    "framing_consistency",
    f"""WITH {EVAL_ROWS_SQL}, g AS (SELECT model_name, l_orderkey, bool_and(correct) AS all_ok,
        count(DISTINCT CAST(l_quantity AS INT)) > 1 AS varied, bool_or(l_linestatus = 'F') AS adv
      FROM eval_rows GROUP BY model_name, l_orderkey)
    SELECT model_name, count(*) AS total_groups, round(count(*) FILTER (WHERE all_ok) / count(*), 6) AS perfect_group_rate,
      count(*) FILTER (WHERE adv) AS adversarial_groups,
      round(count(*) FILTER (WHERE varied AND adv) / nullif(count(*) FILTER (WHERE adv), 0), 6) AS framing_sensitivity_rate,
      round(count(*) FILTER (WHERE all_ok AND adv) / nullif(count(*) FILTER (WHERE adv), 0), 6) AS adversarial_perfect_rate
    FROM g GROUP BY model_name""",
)
def _(spark, sf):
    rows = eval_rows(spark, sf).withColumns(
        {"predicted": F.expr("cast(l_quantity as int)"), "is_adversarial": F.expr("l_linestatus = 'F'")}
    )
    return agg.framing_consistency(rows, "l_orderkey", ["model_name"])


_BATCH = """model_name, 2 * (l_quantity / 50 - 0.5) as accuracy, coalesce(match_type, 'parse_error') = 'parse_error' as parse_error,
  case when status = 'error' then 'request failed' else coalesce(match_type, '') end as error_text"""


@query(
    "batch_metrics",
    f"""WITH {EVAL_ROWS_SQL}, b AS (SELECT {_BATCH} FROM eval_rows)
    SELECT model_name, round(avg(accuracy) FILTER (WHERE NOT parse_error), 6) AS average_accuracy,
      round(stddev_pop(accuracy) FILTER (WHERE NOT parse_error), 6) AS std_accuracy,
      round(sum(accuracy) FILTER (WHERE NOT parse_error) / count(*), 6) AS normalized_accuracy,
      min(accuracy) FILTER (WHERE NOT parse_error) AS min_accuracy, max(accuracy) FILTER (WHERE NOT parse_error) AS max_accuracy,
      count(*) FILTER (WHERE NOT parse_error) AS valid_tests, count(*) FILTER (WHERE parse_error) AS parse_errors,
      count(*) AS total_tests, round(count(*) FILTER (WHERE NOT parse_error) / count(*), 6) AS success_rate,
      count(*) FILTER (WHERE NOT parse_error AND accuracy = 1.0) AS perfect_scores FROM b GROUP BY model_name""",
)
def _(spark, sf):
    return agg.batch_metrics(eval_rows(spark, sf).selectExpr(*_split_exprs(_BATCH)), ["model_name"])


@query(
    "batch_error_patterns",
    f"""WITH {EVAL_ROWS_SQL}, b AS (SELECT {_BATCH} FROM eval_rows)
    SELECT error_text, count(*) AS count FROM b WHERE parse_error GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""",
)
def _(spark, sf):
    rows = eval_rows(spark, sf).selectExpr(*_split_exprs(_BATCH))
    return agg.top_errors(rows.filter("parse_error"), "error_text")


_RANKS = """model_name, duration as response_time, l_quantity % 4 = 0 as fallacy_detected, l_quantity / 50 as confidence,
  l_quantity % 5 <> 0 as parsed, case when l_quantity % 5 = 0 then -1 else l_linenumber end as conjunction_rank,
  case when l_partkey % 4 = 0 then -1 else cast(l_partkey % 7 + 1 as int) end as component_a_rank,
  case when l_partkey % 3 = 0 then -1 else cast(l_partkey % 5 + 1 as int) end as component_b_rank,
  p_brand as culture, case when l_linenumber = 1 then 0 else 1.0 / l_linenumber end as ranking_quality"""


@query(
    "ranking_bias",
    f"""WITH {EVAL_ROWS_SQL}, b AS (SELECT {_RANKS} FROM eval_rows)
    SELECT model_name, count(*) AS total_tests, count(*) FILTER (WHERE fallacy_detected) AS fallacies_detected,
      round(count(*) FILTER (WHERE fallacy_detected) / count(*), 6) AS fallacy_rate,
      round(coalesce(avg(confidence) FILTER (WHERE fallacy_detected), 0), 6) AS avg_fallacy_confidence,
      round(count(*) FILTER (WHERE parsed) / count(*), 6) AS parsing_success_rate, round(avg(response_time), 6) AS avg_response_time,
      round(avg(conjunction_rank) FILTER (WHERE conjunction_rank > 0), 6) AS avg_conjunction_rank,
      round(avg(component_a_rank) FILTER (WHERE component_a_rank > 0), 6) AS avg_component_a_rank,
      round(avg(component_b_rank) FILTER (WHERE component_b_rank > 0), 6) AS avg_component_b_rank
    FROM b GROUP BY model_name""",
)
def _(spark, sf):
    return agg.ranking_bias(eval_rows(spark, sf).selectExpr(*_split_exprs(_RANKS)), ["model_name"])


@query(
    "ranking_bias_ranks",
    f"""WITH {EVAL_ROWS_SQL}, b AS (SELECT {_RANKS} FROM eval_rows), u AS (
      SELECT model_name, 'conjunction' AS item, conjunction_rank AS rank FROM b
      UNION ALL SELECT model_name, 'component_a', component_a_rank FROM b
      UNION ALL SELECT model_name, 'component_b', component_b_rank FROM b)
    SELECT model_name, item, rank, count(*) AS n FROM u WHERE rank > 0 GROUP BY ALL""",
)
def _(spark, sf):
    return agg.rank_histogram(eval_rows(spark, sf).selectExpr(*_split_exprs(_RANKS)), ["model_name"])


@query(
    "task_extra_metrics",
    f"""WITH {EVAL_ROWS_SQL}, b AS (SELECT {_RANKS} FROM eval_rows WHERE task_type = 'linda_fallacy')
    SELECT model_name, round(count(*) FILTER (WHERE fallacy_detected) / count(*), 6) AS fallacy_detection_rate,
      round(avg(confidence) FILTER (WHERE confidence > 0), 6) AS avg_confidence,
      round(avg(ranking_quality) FILTER (WHERE ranking_quality > 0), 6) AS avg_ranking_quality FROM b GROUP BY model_name""",
)
def _(spark, sf):
    rows = eval_rows(spark, sf).filter("task_type = 'linda_fallacy'").selectExpr(*_split_exprs(_RANKS))
    return agg.task_extra_metrics(rows, ["model_name"])


@query(
    "task_extra_cultures",
    f"""WITH {EVAL_ROWS_SQL} SELECT model_name, p_brand AS culture, count(*) AS n FROM eval_rows
    WHERE task_type = 'linda_fallacy' GROUP BY ALL""",
)
def _(spark, sf):
    rows = eval_rows(spark, sf).filter("task_type = 'linda_fallacy'")
    return rows.groupBy("model_name", F.coalesce("p_brand", F.lit("unknown")).alias("culture")).agg(F.count(F.lit(1)).alias("n"))


CONFIG_SQL = f"""{EVAL_ROWS_SQL}, configs AS (SELECT *, user_style || '+' || system_style AS config FROM (
  {summary_sql('model_name, user_style, system_style')}))"""


def configs(spark, sf):
    """One row per model and prompt configuration."""
    out = agg.run_summary(eval_rows(spark, sf), ["model_name", "user_style", "system_style"])
    return out.withColumn("config", F.concat_ws("+", "user_style", "system_style"))


@query(
    "config_stats",
    f"""WITH {CONFIG_SQL} SELECT model_name, round(avg(accuracy * 100), 6) AS avg_accuracy, round(stddev_pop(accuracy * 100), 6) AS std_dev,
      round(max(accuracy * 100) - min(accuracy * 100), 6) AS range, first(config ORDER BY accuracy DESC, config) AS best_config,
      first(config ORDER BY accuracy, config) AS worst_config, CAST(sum(parse_errors) AS BIGINT) AS parse_errors_total,
      round(stddev_pop(accuracy * 100) / avg(accuracy * 100), 6) AS coefficient_of_variation FROM configs GROUP BY model_name""",
)
def _(spark, sf):
    per = configs(spark, sf).withColumn("percent", F.col("accuracy") * 100)
    return agg.config_stats(per, "model_name", "config", "percent", "parse_errors")


@query(
    "mean_off_by",
    f"""WITH {EVAL_ROWS_SQL} SELECT model_name, round(avg(CASE WHEN status = 'success' THEN abs(l_linenumber - 3) END), 6) AS mean_off_by,
      count(CASE WHEN status = 'success' THEN 1 END) AS counted FROM eval_rows GROUP BY model_name""",
)
def _(spark, sf):
    rows = eval_rows(spark, sf).withColumn("off_by", F.expr("case when status = 'success' then abs(l_linenumber - 3) end"))
    return agg.mean_off_by(rows, ["model_name"])


_DETECT = ["model_name", "task_type", "quantization", "user_style", "system_style"]


@query(
    "dimension_detect",
    f"WITH {EVAL_ROWS_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, count(DISTINCT coalesce({d}, 'unknown')) AS n_values, "
        f"count(DISTINCT coalesce({d}, 'unknown')) > 1 AS comparable FROM eval_rows"
        for d in _DETECT
    ),
)
def _(spark, sf):
    return agg.dimension_detect(eval_rows(spark, sf), _DETECT)


@query(
    "token_usage",
    f"""WITH {RUN_SQL} SELECT model_name, round(avg(avg_input_tokens_per_test), 6) AS avg_input,
      round(avg(avg_output_tokens_per_test), 6) AS avg_output,
      round(avg(avg_output_tokens_per_test) / avg(avg_input_tokens_per_test), 6) AS output_ratio
    FROM runs WHERE total_input_tokens > 0 GROUP BY model_name""",
)
def _(spark, sf):
    return agg.token_usage(runs(spark, sf), ["model_name"])


@query(
    "token_correlation",
    f"""WITH {RUN_SQL} SELECT round(corr(avg_input_tokens_per_test, accuracy * 100), 6) AS input_corr,
      round(regr_slope(accuracy * 100, avg_input_tokens_per_test), 6) AS input_slope,
      round(regr_intercept(accuracy * 100, avg_input_tokens_per_test), 6) AS input_intercept,
      round(corr(avg_output_tokens_per_test, accuracy * 100), 6) AS output_corr,
      round(regr_slope(accuracy * 100, avg_output_tokens_per_test), 6) AS output_slope,
      round(regr_intercept(accuracy * 100, avg_output_tokens_per_test), 6) AS output_intercept FROM runs""",
)
def _(spark, sf):
    return agg.token_correlation(runs(spark, sf))


MEANS_SQL = f"""{RUN_SQL}, means AS (SELECT model_name, avg(accuracy) * 100 AS accuracy, avg(parse_error_rate) * 100 AS parse_error,
  avg(type_error_rate) * 100 AS type_error, avg(success_rate) * 100 AS success, stddev_pop(accuracy * 100) AS accuracy_std,
  avg(avg_time_per_test) FILTER (WHERE avg_time_per_test > 0) AS time,
  stddev_pop(avg_time_per_test) FILTER (WHERE avg_time_per_test > 0) AS time_std,
  CAST(sum(total_tests) AS BIGINT) AS total_tests FROM runs GROUP BY model_name)"""


@query(
    "model_dashboard",
    f"""WITH {MEANS_SQL} SELECT model_name, round(accuracy, 6) AS accuracy, round(parse_error, 6) AS parse_error,
      round(1 / time, 6) AS speed, total_tests FROM means""",
)
def _(spark, sf):
    return agg.model_means(runs(spark, sf)).select(
        "model_name",
        rounded(F.col("accuracy")).alias("accuracy"),
        rounded(F.col("parse_error")).alias("parse_error"),
        rounded(F.try_divide(F.lit(1.0), F.col("time"))).alias("speed"),
        "total_tests",
    )


@query(
    "variance_report",
    f"""WITH {MEANS_SQL} SELECT model_name, round(accuracy, 6) AS acc_mean, round(accuracy_std, 6) AS acc_std, round(time, 6) AS time_mean,
      round(time_std, 6) AS time_std, CASE WHEN accuracy_std < 5 THEN 'stable' WHEN accuracy_std < 10 THEN 'variable' ELSE 'unstable' END AS stability
    FROM means""",
)
def _(spark, sf):
    return agg.model_means(runs(spark, sf)).select(
        "model_name",
        rounded(F.col("accuracy")).alias("acc_mean"),
        rounded(F.col("accuracy_std")).alias("acc_std"),
        rounded(F.col("time")).alias("time_mean"),
        rounded(F.col("time_std")).alias("time_std"),
        fields.stability(F.col("accuracy_std")).alias("stability"),
    )


@query(
    "error_mix",
    f"""WITH {MEANS_SQL} SELECT model_name, round(parse_error, 6) AS parse, round(type_error, 6) AS type, round(success, 6) AS success FROM means""",
)
def _(spark, sf):
    return agg.model_means(runs(spark, sf)).select(
        "model_name",
        rounded(F.col("parse_error")).alias("parse"),
        rounded(F.col("type_error")).alias("type"),
        rounded(F.col("success")).alias("success"),
    )


@query(
    "quartiles",
    f"""WITH {RUN_SQL} SELECT quantization, round(min(a), 6) AS min, round(quantile_cont(a, 0.25), 6) AS q1, round(quantile_cont(a, 0.5), 6) AS median,
      round(quantile_cont(a, 0.75), 6) AS q3, round(max(a), 6) AS max, round(quantile_cont(a, 0.75) - quantile_cont(a, 0.25), 6) AS iqr
    FROM (SELECT quantization, accuracy * 100 AS a FROM runs WHERE quantization IS NOT NULL) GROUP BY quantization""",
)
def _(spark, sf):
    return agg.quartiles(runs(spark, sf).filter("quantization is not null"), "quantization", F.col("accuracy") * 100)


@query(
    "difficulty_curve",
    f"""WITH {EVAL_ROWS_SQL} SELECT model_name, l_linenumber AS difficulty, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS accuracy
    FROM eval_rows GROUP BY ALL""",
)
def _(spark, sf):
    rows = eval_rows(spark, sf).groupBy("model_name", F.col("l_linenumber").alias("difficulty"))
    out = rows.agg(rounded(F.avg(F.col("correct").cast("double"))).alias("accuracy"))
    return out.orderBy("model_name", "difficulty")


@query(
    "accuracy_by_model",
    f"WITH {RUN_SQL} SELECT model_name, round(avg(accuracy), 6) AS accuracy FROM runs GROUP BY model_name",
)
def _(spark, sf):
    means = runs(spark, sf).groupBy("model_name").agg(rounded(F.avg("accuracy")).alias("accuracy"))
    return means.orderBy(F.desc("accuracy"), "model_name")


@query(
    "radar_metrics",
    f"""WITH {RUN_SQL}, m AS (SELECT run_id, accuracy * 100 AS a, greatest(0, 100 - avg_time_per_test * 10) AS s, 100 - parse_error_rate * 100 AS r FROM runs)
    SELECT run_id, round(a, 6) AS accuracy, round(s, 6) AS speed, round(r, 6) AS reliability, round((a + s + r) / 3, 6) AS overall FROM m""",
)
def _(spark, sf):
    a, r = F.col("accuracy") * 100, 100 - F.col("parse_error_rate") * 100
    s = F.greatest(F.lit(0.0), 100 - F.col("avg_time_per_test") * 10)
    return runs(spark, sf).select(
        "run_id",
        rounded(a).alias("accuracy"),
        rounded(s).alias("speed"),
        rounded(r).alias("reliability"),
        rounded((a + s + r) / 3).alias("overall"),
    )


@query(
    "failure_census",
    f"""WITH {EVAL_ROWS_SQL} SELECT regexp_replace(regexp_replace(test_id, '^multi_[0-9]+_', ''), '(_[0-9]+)+$', '') AS family, count(*) AS n
    FROM eval_rows WHERE status = 'success' AND NOT correct GROUP BY 1""",
)
def _(spark, sf):
    wrong = eval_rows(spark, sf).filter((F.col("status") == "success") & ~F.col("correct"))
    counts = wrong.groupBy(identity.test_family(F.col("test_id")).alias("family")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "family")


@query(
    "inventory_groups",
    f"""WITH {MODEL_INVENTORY_SQL}, m AS (SELECT name, {_FAMILY_CASE} AS family, coalesce({_QUANT_CASE}, 'Full Precision') AS quantization,
      {_BUCKET_CASE} AS size FROM model_inventory)
    SELECT 'family' AS grouping, family AS value, count(*) AS models, count(DISTINCT name) AS names FROM m GROUP BY ALL
    UNION ALL SELECT 'quantization', quantization, count(*), count(DISTINCT name) FROM m GROUP BY ALL
    UNION ALL SELECT 'size', size, count(*), count(DISTINCT name) FROM m GROUP BY ALL""",
)
def _(spark, sf):
    return inventory_groups(model_inventory(spark, sf))


@query(
    "cube_report",
    f"""WITH {EVAL_ROWS_SQL} SELECT coalesce(model_name, 'all') AS model_name, coalesce(task_type, 'all') AS task_type,
      coalesce(user_style, 'all') AS user_style, CAST(grouping(model_name, task_type, user_style) AS BIGINT) AS level, count(*) AS total,
      {GOOD} AS correct, round({GOOD} / count(*), 6) AS accuracy
    FROM eval_rows GROUP BY CUBE (model_name, task_type, user_style)""",
)
def _(spark, sf):
    return agg.cube_report(eval_rows(spark, sf), ["model_name", "task_type", "user_style"])


@query(
    "totals_row",
    f"""WITH {EVAL_ROWS_SQL} SELECT coalesce(task_type, 'TOTAL') AS task_type, count(*) AS total, {GOOD} AS correct,
      round({GOOD} / count(*), 6) AS accuracy FROM eval_rows GROUP BY ROLLUP (task_type)""",
)
def _(spark, sf):
    good, total = F.count_if("correct"), F.count(F.lit(1))
    cols = [total.alias("total"), good.alias("correct"), rounded(agg.ratio(good, total)).alias("accuracy")]
    return agg.totals_row(eval_rows(spark, sf), "task_type", cols)
