"""Roll-ups of scored responses.

Every function groups raw rows once with map-side combine, so a run or model
that holds a third of all rows still ships one partial row per task.  Windows
appear only over already grouped rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.identity import model_key
from tallymill.operators.assemble import running

SUCCESS = "success"


def rounded(value: Column, digits: int = 6) -> Column:
    return F.round(value, digits)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient as double, null where the base is empty."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def share_where(numerator: Column, denominator: Column) -> Column:
    """Rows meeting ``numerator`` over rows meeting ``denominator``, null over an empty base."""
    return ratio(F.count_if(numerator & denominator), F.count_if(denominator))


def positive_mean(value: Column) -> Column:
    """Mean of the positive values; null where there is none."""
    return F.avg(F.when(value > 0, value))


def response_counts() -> list[Column]:
    """The additive measures from which all rates follow; a run without results counts no row."""
    ok = F.col("status") == SUCCESS
    return [
        F.count("status").alias("total_tests"),
        F.count_if(ok).alias("successful_tests"),
        F.count_if(~ok).alias("failed_tests"),
        F.count_if(F.col("correct")).alias("correct_responses"),
        F.count_if(F.col("match_type") == "parse_error").alias("parse_errors"),
        F.count_if(F.col("match_type") == "type_error").alias("type_errors"),
        F.sum("duration").alias("duration_seconds"),
        F.sum(F.col("input_tokens").cast("bigint")).alias("total_input_tokens"),
        F.sum(F.col("output_tokens").cast("bigint")).alias("total_output_tokens"),
    ]


ADDITIVE = (
    "total_tests",
    "successful_tests",
    "failed_tests",
    "correct_responses",
    "parse_errors",
    "type_errors",
    "duration_seconds",
    "total_input_tokens",
    "total_output_tokens",
)


def with_rates(counts: DataFrame) -> DataFrame:
    """Rates over the additive measures; the two accuracy bases carry different names."""
    c = F.col
    total, ok = c("total_tests"), c("successful_tests")
    tokens = c("total_input_tokens") + c("total_output_tokens")
    return counts.withColumns(
        {
            "success_rate": ratio(ok, total),
            "accuracy": ratio(c("correct_responses"), ok),
            "accuracy_total": ratio(c("correct_responses"), total),
            "parse_error_rate": ratio(c("parse_errors"), ok),
            "parse_error_rate_total": ratio(c("parse_errors"), total),
            "type_error_rate": ratio(c("type_errors"), ok),
            "avg_time_per_test": ratio(c("duration_seconds"), total),
            "total_tokens": tokens,
            "avg_input_tokens_per_test": ratio(c("total_input_tokens"), ok),
            "avg_output_tokens_per_test": ratio(c("total_output_tokens"), ok),
            "avg_tokens_per_test": ratio(tokens, ok),
        }
    )


def run_summary(rows: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Counts and rates per run, or per any finer key (run and task, run and style)."""
    return with_rates(rows.groupBy(*keys).agg(*response_counts()))


def task_breakdown(rows: DataFrame, keys: Sequence[str] = ("run_id", "task_type")) -> DataFrame:
    """Per run and task over all rows, failed ones included."""
    return rows.groupBy(*keys).agg(
        F.count("status").alias("total"),
        F.count_if("correct").alias("correct"),
        F.count_if(F.col("match_type") == "parse_error").alias("parse_errors"),
        ratio(F.count_if("correct"), F.count("status")).alias("accuracy"),
        ratio(F.count_if(F.col("match_type") == "parse_error"), F.count("status")).alias("parse_error_rate"),
    )


def model_rollup(rows: DataFrame, with_quantization: bool = True) -> DataFrame:
    """All runs of a model in one row: summed counts, rates over the sums, runs and tasks seen.

    Rows collapse to (model, run, task) first, then to (model, run), then to the
    model, so no group is ever wider than the number of its runs.
    """
    key = model_key(F.col("model_name"), F.col("quantization")) if with_quantization else F.col("model_name")
    per_task = rows.withColumn("model_key", key).groupBy("model_key", "run_id", "task_type").agg(*response_counts())
    per_run = per_task.groupBy("model_key", "run_id").agg(
        *[F.sum(c).alias(c) for c in ADDITIVE], F.collect_set("task_type").alias("tasks")
    )
    totals = per_run.groupBy("model_key").agg(
        F.count(F.lit(1)).alias("result_count"),
        *[F.sum(c).alias(c) for c in ADDITIVE],
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tasks")))).alias("task_types"),
    )
    return with_rates(totals).withColumn(
        "avg_time_per_test", ratio(F.col("duration_seconds"), F.col("successful_tests"))
    )


def token_fallback(rows: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    """Token totals a run declares, or the sums of its rows where it declares none."""
    sums = rows.groupBy(key).agg(
        F.sum(F.col("input_tokens").cast("bigint")).alias("row_in"),
        F.sum(F.col("output_tokens").cast("bigint")).alias("row_out"),
        F.count_if(F.col("status") == SUCCESS).alias("ok"),
    )
    none = F.coalesce(F.col("total_input_tokens"), F.lit(0)) == 0
    return (
        sums.join(declared, key)
        .withColumns(
            {
                "total_input_tokens": F.when(none, F.col("row_in")).otherwise(F.col("total_input_tokens")),
                "total_output_tokens": F.when(none, F.col("row_out")).otherwise(F.col("total_output_tokens")),
            }
        )
        .select(
            key,
            "total_input_tokens",
            "total_output_tokens",
            rounded(ratio(F.col("total_input_tokens"), F.col("ok"))).alias("avg_input_tokens"),
            rounded(ratio(F.col("total_output_tokens"), F.col("ok"))).alias("avg_output_tokens"),
        )
    )


def match_type_counts(
    rows: DataFrame, by: Sequence[str] = (), exclude: Sequence[str] = ("exact", "perfect")
) -> DataFrame:
    """Histogram of match types, with each count's share of the successful rows of its group."""
    per = rows.groupBy(*by, "match_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == SUCCESS).alias("ok")
    )
    from pyspark.sql import Window

    base = F.sum("ok").over(Window.partitionBy(*by)) if by else F.sum("ok").over(Window.partitionBy(F.lit(0)))
    return (
        per.withColumn("share", ratio(F.col("n"), F.greatest(base, F.lit(1))))
        .filter(F.col("match_type").isNotNull() & ~F.col("match_type").isin(*exclude))
        .select(*by, "match_type", "n", "share")
    )


def base_aggregate(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        ratio(F.count_if("correct"), F.count(F.lit(1))).alias("accuracy"),
        F.count_if("correct").alias("correct"),
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") != SUCCESS).alias("error_count"),
    )


def breakdown_by(rows: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Accuracy by each dimension on its own, in one pass: (dimension, value, total, correct, accuracy)."""
    named = rows.select(
        *[F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias(d) for d in dimensions], "correct"
    )
    sets = named.groupingSets([[F.col(d)] for d in dimensions], *[F.col(d) for d in dimensions]).agg(
        *[F.grouping(d).alias(f"_absent_{d}") for d in dimensions],
        F.count(F.lit(1)).alias("total"),
        F.count_if("correct").alias("correct"),
    )
    name = F.coalesce(*[F.when(F.col(f"_absent_{d}") == 0, F.lit(d)) for d in dimensions])
    value = F.coalesce(*[F.when(F.col(f"_absent_{d}") == 0, F.col(d)) for d in dimensions])
    return sets.select(
        name.alias("dimension"),
        value.alias("value"),
        "total",
        "correct",
        ratio(F.col("correct"), F.col("total")).alias("accuracy"),
    )


def cell_accuracy(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of right cells over all cells, and mean row accuracy over rows without an error."""
    return scored.groupBy(*by).agg(
        F.sum("correct_cells").alias("correct_cells"),
        F.sum("total_cells").alias("total_cells"),
        ratio(F.sum("correct_cells"), F.sum("total_cells")).alias("micro_accuracy"),
        F.avg(F.when(F.col("error").isNull(), F.col("norm_accuracy"))).alias("macro_accuracy"),
    )


def taxonomy() -> dict[str, Column]:
    """Conditional rates of the failure taxonomies by name, each over its own base.

    Each is an aggregate column; it reads ``match_type`` and ``correct`` and, where its name says so,
    ``error``, ``is_impossible`` or ``is_decimal_trap``.
    """
    mt = F.col("match_type")
    everything = F.lit(True)
    failed = ~F.col("correct")
    ranked = ~mt.isin("parse_error", "conjunction_not_found", "components_not_found") & F.col("error").isNull()
    wrong = failed & (mt != "parse_error")
    undefined = mt.isin("undefined_correct", "undefined_wrong", "undefined_missed")
    impossible, trap = F.col("is_impossible"), F.col("is_decimal_trap")
    rates = {
        "fallacy_rate": (mt == "fallacy_detected", ranked),
        "hedge_rate": (mt == "partial_hedge", failed),
        "compliance_rate": (mt == "wrong_compliance", failed),
        "commutativity_rate": (mt == "wrong_assumed_commutative", wrong),
        "associativity_rate": (mt == "wrong_assumed_associative", wrong),
        "undefined_detection_rate": (mt == "undefined_correct", undefined),
        "impossible_detection_rate": (mt == "correct_refusal", impossible),
        "hallucination_rate": (mt == "wrong_compliance", impossible),
        "false_refusal_rate": (mt == "wrong_refusal", ~impossible),
        "refusal_rate": (mt == "paranoid_refusal", everything),
        "hallucinated_execution_rate": (mt == "hallucinated_execution", everything),
        "wrong_decode_rate": (mt == "wrong_decode", everything),
        "parse_error_rate": (mt == "parse_error", everything),
        "reality_trap_rate": (mt == "reality_trap", everything),
        "decimal_trap_accuracy": (F.col("correct"), trap),
    }
    return {name: rounded(share_where(num, den)) for name, (num, den) in rates.items()}


def taxonomy_rates(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """All taxonomy rates per group."""
    return rows.groupBy(*by).agg(*[rate.alias(name) for name, rate in taxonomy().items()])


def position_bias(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """How often each option is the right one against how often it is chosen.

    Reads ``correct_position``, ``predicted`` and the two options as
    ``value1``/``unit1_symbol`` and ``value2``/``unit2_symbol``; the first
    option is tested before the second.
    """

    def chosen(n: int) -> Column:
        value, unit = F.lower(f"value{n}"), F.lower(f"unit{n}_symbol")
        said = F.lower("predicted")
        named = said.contains(F.concat_ws(" ", value, unit)) | said.contains(F.concat(value, unit))
        return (value != "") & (unit != "") & named

    first = F.coalesce(chosen(1), F.lit(False))
    second = ~first & F.coalesce(chosen(2), F.lit(False))
    return rows.groupBy(*by).agg(
        F.count_if(F.col("correct_position") == "first").alias("first_correct_total"),
        F.count_if(first).alias("first_predicted_total"),
        F.count_if(F.col("correct_position") == "second").alias("second_correct_total"),
        F.count_if(second).alias("second_predicted_total"),
    )


def framing_consistency(rows: DataFrame, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Do re-phrasings of one question get one answer?  Two aggregations, groups then rates.

    The first level keeps only min and max of the answer, so a question with a
    third of all rows is a single partial row per task.
    """
    answer = F.trim(F.coalesce(F.col("predicted").cast("string"), F.lit("")))
    groups = (
        rows.filter(F.coalesce(F.col(group).cast("string"), F.lit("")) != "")
        .groupBy(*by, group)
        .agg(
            F.every(F.coalesce(F.col("correct"), F.lit(False))).alias("all_correct"),
            (F.min(answer) != F.max(answer)).alias("varied"),
            F.bool_or(F.coalesce(F.col("is_adversarial"), F.lit(False))).alias("adversarial"),
        )
    )
    adv = F.col("adversarial")
    out = groups.groupBy(*by) if by else groups.groupBy()
    return out.agg(
        F.count(F.lit(1)).alias("total_groups"),
        rounded(share_where(F.col("all_correct"), F.lit(True))).alias("perfect_group_rate"),
        F.count_if(adv).alias("adversarial_groups"),
        rounded(share_where(F.col("varied"), adv)).alias("framing_sensitivity_rate"),
        rounded(share_where(F.col("all_correct"), adv)).alias("adversarial_perfect_rate"),
    )


def batch_metrics(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Spread of accuracies over parsed rows; ``normalized`` divides by all rows."""
    ok = ~F.col("parse_error")
    acc = F.when(ok, F.col("accuracy"))
    total = F.count(F.lit(1))
    return scored.groupBy(*by).agg(
        rounded(F.avg(acc)).alias("average_accuracy"),
        rounded(F.coalesce(F.stddev_pop(acc), F.lit(0.0))).alias("std_accuracy"),
        rounded(ratio(F.sum(acc), total)).alias("normalized_accuracy"),
        F.min(acc).alias("min_accuracy"),
        F.max(acc).alias("max_accuracy"),
        F.count_if(ok).alias("valid_tests"),
        F.count_if(~ok).alias("parse_errors"),
        total.alias("total_tests"),
        rounded(ratio(F.count_if(ok), total)).alias("success_rate"),
        F.count_if(acc == 1.0).alias("perfect_scores"),
    )


def top_errors(scored: DataFrame, error: str, n: int = 3) -> DataFrame:
    """The ``n`` most frequent error texts; ties go to the smaller text."""
    return scored.groupBy(error).count().orderBy(F.desc("count"), error).limit(n)


def ranking_bias(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fallacy and parse rates, mean confidence over fallacies, mean ranks over items found."""
    shown = F.col("fallacy_detected")
    found = {c: F.when(F.col(c) > 0, F.col(c)) for c in ("conjunction_rank", "component_a_rank", "component_b_rank")}
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_tests"),
        F.count_if(shown).alias("fallacies_detected"),
        rounded(share_where(shown, F.lit(True))).alias("fallacy_rate"),
        rounded(F.coalesce(F.avg(F.when(shown, F.col("confidence"))), F.lit(0.0))).alias("avg_fallacy_confidence"),
        rounded(share_where(F.col("parsed"), F.lit(True))).alias("parsing_success_rate"),
        rounded(F.avg("response_time")).alias("avg_response_time"),
        *[rounded(F.avg(col)).alias(f"avg_{name}") for name, col in found.items()],
    )


def rank_histogram(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every found rank with its count, per item: the rank lists in bounded form."""
    long = rows.select(
        *by,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("item"), F.col(f"{c}_rank").cast("int").alias("rank"))
                    for c in ("conjunction", "component_a", "component_b")
                ]
            )
        ).alias("r"),
    ).select(*by, "r.*")
    return long.filter(F.col("rank") > 0).groupBy(*by, "item", "rank").agg(F.count(F.lit(1)).alias("n"))


def task_extra_metrics(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Extras of the ranking task: fallacy rate over all rows, means over positive scores."""
    return rows.groupBy(*by).agg(
        rounded(share_where(F.col("fallacy_detected"), F.lit(True))).alias("fallacy_detection_rate"),
        rounded(F.coalesce(positive_mean(F.col("confidence")), F.lit(0.0))).alias("avg_confidence"),
        rounded(F.coalesce(positive_mean(F.col("ranking_quality")), F.lit(0.0))).alias("avg_ranking_quality"),
    )


def config_stats(configs: DataFrame, by: str, config: str, value: str, errors: str) -> DataFrame:
    """Spread over configurations of one model; ties between configurations go to the smaller name."""
    acc = F.col(value)
    best = F.min_by(config, F.struct(-acc, F.col(config)))
    worst = F.min_by(config, F.struct(acc, F.col(config)))
    return configs.groupBy(by).agg(
        rounded(F.avg(acc)).alias("avg_accuracy"),
        rounded(F.stddev_pop(acc)).alias("std_dev"),
        rounded(F.max(acc) - F.min(acc)).alias("range"),
        best.alias("best_config"),
        worst.alias("worst_config"),
        F.sum(errors).alias("parse_errors_total"),
        rounded(ratio(F.stddev_pop(acc), F.avg(acc))).alias("coefficient_of_variation"),
    )


def mean_off_by(rows: DataFrame, by: Sequence[str], column: str = "off_by") -> DataFrame:
    return rows.groupBy(*by).agg(rounded(F.avg(column)).alias("mean_off_by"), F.count(column).alias("counted"))


def dimension_detect(rows: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """How many values each dimension has, and whether a comparison along it makes sense."""
    values = breakdown_by(rows.withColumn("correct", F.lit(False)), dimensions)
    return values.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("n_values"), (F.count(F.lit(1)) > 1).alias("comparable")
    )


def token_usage(summary: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean tokens per test over runs that report tokens, with the output/input ratio."""
    used = summary.filter(F.col("total_input_tokens") > 0)
    means = used.groupBy(*by).agg(
        F.avg("avg_input_tokens_per_test").alias("i"), F.avg("avg_output_tokens_per_test").alias("o")
    )
    return means.select(
        *by,
        rounded(F.col("i")).alias("avg_input"),
        rounded(F.col("o")).alias("avg_output"),
        rounded(F.coalesce(ratio(F.col("o"), F.nullif(F.col("i"), F.lit(0.0))), F.lit(0.0))).alias("output_ratio"),
    )


def token_correlation(summary: DataFrame) -> DataFrame:
    """Pearson r and least-squares line of accuracy (percent) on tokens per test."""
    y = F.col("accuracy") * 100
    out = []
    for side in ("input", "output"):
        x = F.col(f"avg_{side}_tokens_per_test")
        out += [
            rounded(F.corr(x, y)).alias(f"{side}_corr"),
            rounded(F.regr_slope(y, x)).alias(f"{side}_slope"),
            rounded(F.regr_intercept(y, x)).alias(f"{side}_intercept"),
        ]
    return summary.filter(F.col("total_input_tokens") > 0).agg(*out)


def model_means(summary: DataFrame, by: Sequence[str] = ("model_name",)) -> DataFrame:
    """Unrounded means over runs that dashboards, boards and rankings start from."""
    return summary.groupBy(*by).agg(
        (F.avg("accuracy") * 100).alias("accuracy"),
        (F.avg("parse_error_rate") * 100).alias("parse_error"),
        (F.avg("type_error_rate") * 100).alias("type_error"),
        (F.avg("success_rate") * 100).alias("success"),
        F.stddev_pop(F.col("accuracy") * 100).alias("accuracy_std"),
        positive_mean(F.col("avg_time_per_test")).alias("time"),
        F.stddev_pop(F.when(F.col("avg_time_per_test") > 0, F.col("avg_time_per_test"))).alias("time_std"),
        F.sum("total_tests").alias("total_tests"),
    )


def quartiles(summary: DataFrame, by: str, value: Column) -> DataFrame:
    """Five-number summary per group, by linear interpolation between neighbours.

    Rows are first counted per distinct value; counts are then summed up in the order of values, range-partitioned,
    so a group of any size lies over many tasks and a value that many rows share is one row.  A quartile is the value
    that covers one or two known places of its group.  Null values are left out; a group of nulls only has none.
    """
    points = {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}
    counted = summary.select(F.col(by), value.alias("_v")).filter(F.col("_v").isNotNull()).groupBy(by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    placed = running(counted, ["_v"], "_n", [by])
    sizes = placed.groupBy(F.col(by).alias("_by")).agg(F.sum("_n").alias("_size"))
    inside = placed.join(sizes, F.equal_null(by, "_by"))

    def value_at(p: float, side) -> Column:
        place = side((F.col("_size") - 1) * p)
        return F.max(F.when((F.col("_before") <= place) & (place < F.col("_before") + F.col("_n")), F.col("_v")))

    ends = [value_at(p, side).alias(f"{name}_{end}") for name, p in points.items() for end, side in (("low", F.floor), ("high", F.ceil))]
    found = inside.groupBy(by).agg(F.max("_size").alias("_size"), *ends)

    def between(name: str, p: float) -> Column:
        place = (F.col("_size") - 1) * p
        return F.col(f"{name}_low") + (place - F.floor(place)) * (F.col(f"{name}_high") - F.col(f"{name}_low"))

    values = {name: between(name, p) for name, p in points.items()}
    return found.select(by, *[rounded(v).alias(n) for n, v in values.items()], rounded(values["q3"] - values["q1"]).alias("iqr"))


def totals_row(rows: DataFrame, by: str, aggregates: Sequence[Column], label: str = "TOTAL") -> DataFrame:
    """One row per group plus one for everything, in a single rollup."""
    return (
        rows.withColumn(by, F.coalesce(F.col(by), F.lit("unknown")))
        .rollup(by)
        .agg(*aggregates, F.grouping(by).alias("_total"))
        .withColumn(by, F.when(F.col("_total") == 1, label).otherwise(F.col(by)))
        .drop("_total")
    )


def cube_report(rows: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """Accuracy for every combination of dimensions, ``all`` where one is summed over."""
    named = rows.select(
        *[F.coalesce(F.col(d).cast("string"), F.lit("unknown")).alias(d) for d in dimensions], "correct"
    )
    return (
        named.cube(*dimensions)
        .agg(
            F.grouping_id().cast("bigint").alias("level"),
            F.count(F.lit(1)).alias("total"),
            F.count_if("correct").alias("correct"),
        )
        .select(
            *[F.coalesce(F.col(d), F.lit("all")).alias(d) for d in dimensions],
            "level",
            "total",
            "correct",
            rounded(ratio(F.col("correct"), F.col("total"))).alias("accuracy"),
        )
    )
