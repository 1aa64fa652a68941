"""Pivots, rankings, comparisons and reproducible samples.

Rankings and pivots run over grouped rows (one per model or configuration).
The two operators that rank raw rows, ``head_sample`` and ``stratified_sample``,
keep at most k rows per group, which Spark applies before the shuffle as well
as after it, so a hot group ships k rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.functions import identity, vocab
from tallymill.operators.aggregate import rounded
from tallymill.operators.assemble import number_rows, ranked


def pivot_mean(
    df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str], measure: Column, fill: float | None = None
) -> DataFrame:
    """Mean of ``measure`` by row keys and the listed column values; empty cells stay null."""
    out = df.groupBy(*rows).pivot(column, list(values)).agg(rounded(F.avg(measure)))
    return out if fill is None else out.fillna(fill, subset=list(values))


def group_impact(df: DataFrame, by: str, measure: Column) -> DataFrame:
    """Mean and population spread of a measure per style, other styles averaged over."""
    return (
        df.filter(F.col(by).isNotNull())
        .groupBy(by)
        .agg(rounded(F.avg(measure)).alias("mean"), rounded(F.stddev_pop(measure)).alias("std"))
    )


def leaderboard(means: DataFrame) -> DataFrame:
    """Composite = accuracy - parse error / 2 - 2 x time; models without a time rank last.

    ``means`` has one row per model; places come from range partitions, so their number is no limit.
    """
    composite = F.col("accuracy") - F.col("parse_error") * 0.5 - F.col("time") * 2
    rows = means.withColumn("composite", composite)
    place = F.col("place")
    board = number_rows(rows, [F.desc_nulls_last("composite"), F.col("model_name")], "place").withColumn("n", means.agg(F.count(F.lit(1))).scalar())
    return board.select(
        "model_name",
        rounded(F.col("accuracy")).alias("accuracy"),
        rounded(F.col("parse_error")).alias("parse_error"),
        rounded(F.coalesce(F.try_divide(F.lit(1.0), F.col("time")), F.lit(0.0))).alias("speed"),
        rounded(F.col("composite")).alias("composite"),
        place.alias("place"),
        F.when(place - 1 < F.floor(F.col("n") / 3), "green")
        .when(place - 1 < F.floor(2 * F.col("n") / 3), "orange")
        .otherwise("red")
        .alias("third"),
    )


def best_worst(configs: DataFrame, measure: str, ties: Sequence[str], n: int = 5) -> DataFrame:
    """The n best and the n worst configurations, each a distributed top-k."""
    best = configs.orderBy(F.desc(measure), *ties).limit(n).withColumn("side", F.lit("best"))
    worst = configs.orderBy(F.asc(measure), *ties).limit(n).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def best_worst_within(configs: DataFrame, group: str, measure: str, ties: Sequence[str], n: int = 1) -> DataFrame:
    """The n best and n worst configurations of each group."""
    out = []
    for side, first in (("best", F.desc(measure)), ("worst", F.asc(measure))):
        place = F.row_number().over(Window.partitionBy(group).orderBy(first, *ties))
        out.append(configs.withColumn("place", place).filter(F.col("place") <= n).withColumn("side", F.lit(side)))
    return out[0].unionByName(out[1])


def task_rankings(scores: DataFrame, task: str, measure: str) -> DataFrame:
    """Rank of each model inside each task."""
    return ranked(scores, measure, within=[task])


def efficiency(means: DataFrame) -> DataFrame:
    """Accuracy per second (at least 0.1 s), and the quadrant against the mean of all models."""
    mean = lambda c: means.agg(F.avg(c)).scalar()
    high, fast = F.col("accuracy") >= mean("accuracy"), F.col("time") <= mean("time")
    quadrant = F.concat(
        F.when(high, "high_accuracy").otherwise("low_accuracy"), F.when(fast, "_fast").otherwise("_slow")
    )
    return means.select(
        "model_name",
        rounded(F.col("accuracy") / F.greatest(F.col("time"), F.lit(0.1))).alias("efficiency"),
        quadrant.alias("quadrant"),
    )


def quant_tradeoff(summary: DataFrame) -> DataFrame:
    """Mean accuracy and speed per quantization, with its relative model size."""
    time = F.col("avg_time_per_test")
    return (
        summary.filter(F.col("quantization").isNotNull())
        .groupBy("quantization")
        .agg(
            rounded(F.avg(F.col("accuracy") * 100)).alias("accuracy"),
            rounded(F.avg(F.when(time > 0, 1 / time))).alias("speed"),
        )
        .withColumn("compression", F.try_element_at(identity.literal_map(vocab.COMPRESSION), F.col("quantization")))
    )


def delta_vs_baseline(configs: DataFrame, within: Sequence[str], config: str, baseline: str, measure: str) -> DataFrame:
    """Difference of each configuration to a named baseline of the same model."""
    base = F.max(F.when(F.col(config) == baseline, F.col(measure))).over(Window.partitionBy(*within))
    return configs.withColumn("baseline", base).withColumn("delta", F.col(measure) - F.col("baseline"))


def model_gap(
    configs: DataFrame, by: Sequence[str], model_a: str, model_b: str, measure: str, tolerance: float = 0.0
) -> DataFrame:
    """A minus B per configuration, and which of them wins."""
    sides = configs.filter(F.col("model_name").isin(model_a, model_b)).groupBy(*by).agg(
        F.max(F.when(F.col("model_name") == model_a, F.col(measure))).alias("a"),
        F.max(F.when(F.col("model_name") == model_b, F.col(measure))).alias("b"),
    )
    gap = F.col("a") - F.col("b")
    return sides.withColumn("gap", gap).withColumn(
        "winner",
        F.when(gap.isNull(), F.lit(None).cast("string"))
        .when(F.abs(gap) <= tolerance, "tie")
        .when(gap > 0, model_a)
        .otherwise(model_b),
    )


def range_summary(configs: DataFrame, by: str, measure: str) -> DataFrame:
    """Spread over configurations per model, ranked by mean."""
    v = F.col(measure)
    spread = configs.groupBy(by).agg(
        F.min(v).alias("lo"), F.avg(v).alias("mid"), F.max(v).alias("hi"), F.stddev_pop(v).alias("sd")
    )
    return ranked(spread, "mid").select(
        by,
        rounded(F.col("lo")).alias("min"),
        rounded(F.col("mid")).alias("mean"),
        rounded(F.col("hi")).alias("max"),
        rounded(F.col("sd")).alias("std"),
        rounded(F.col("hi") - F.col("lo")).alias("range"),
        F.col("rank"),
    )


def dedup_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last in the given order."""
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") == 1).drop("_n")


def head_sample(rows: DataFrame, group: Sequence[str], order: Sequence[str], n: int = 3) -> DataFrame:
    """The first n rows of each group in the given order."""
    first = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("position", F.row_number().over(first)).filter(F.col("position") <= n)


def stratum(status: Column, correct: Column) -> Column:
    return F.when(status != "success", "error").when(correct, "correct").otherwise("wrong")


def stratified_sample(
    rows: DataFrame,
    group: Sequence[str],
    identity_columns: Sequence[str],
    correct: int = 5,
    wrong: int = 5,
    errors: int = 3,
    seed: str = "42",
) -> DataFrame:
    """Fixed-size samples of right, wrong and failed rows per group.

    The order is a hash of seed and row identity, so the sample depends neither
    on partitioning nor on input order.
    """
    limits = {"correct": correct, "wrong": wrong, "error": errors}
    draw = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in identity_columns]))
    keyed = rows.withColumn("stratum", stratum(F.col("status"), F.col("correct"))).withColumn("draw", draw)
    order = Window.partitionBy(*group, "stratum").orderBy("draw", *identity_columns)
    ranked = keyed.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= max(limits.values()))
    return ranked.filter(F.col("pick") <= F.try_element_at(identity.literal_map(limits), F.col("stratum")))


def inventory_filter(
    models: DataFrame,
    families: Sequence[str] | None = None,
    quantizations: Sequence[str] | None = None,
    min_size: int | None = None,
    max_size: int | None = None,
) -> DataFrame:
    """Models of the given families, quantizations and sizes."""
    out = models.withColumns(
        {"family": identity.model_family(F.col("name")), "quantization": identity.quantization_of(F.col("name"))}
    )
    if families is not None:
        out = out.filter(F.col("family").isin(list(families)))
    if quantizations is not None:
        out = out.filter(F.col("quantization").isin(list(quantizations)))
    if min_size is not None:
        out = out.filter(F.col("size_bytes") >= min_size)
    if max_size is not None:
        out = out.filter(F.col("size_bytes") <= max_size)
    return out


def inventory_groups(models: DataFrame) -> DataFrame:
    """Models and distinct names by family, quantization and size, in one pass."""
    named = models.select(
        "name",
        identity.model_family(F.col("name")).alias("family"),
        F.coalesce(identity.quantization_of(F.col("name")), F.lit("Full Precision")).alias("quantization"),
        identity.size_bucket(F.col("size_bytes")).alias("size"),
    )
    per_name = named.groupBy("name", "family", "quantization", "size").agg(F.count(F.lit(1)).alias("models"))
    dims = ["family", "quantization", "size"]
    sets = per_name.groupingSets([[F.col("name"), F.col(d)] for d in dims], F.col("name"), *[F.col(d) for d in dims]).agg(
        *[F.grouping(d).alias(f"_absent_{d}") for d in dims], F.sum("models").alias("models")
    )
    name = F.coalesce(*[F.when(F.col(f"_absent_{d}") == 0, F.lit(d)) for d in dims])
    return (
        sets.select(name.alias("grouping"), F.coalesce(*dims).alias("value"), "models")
        .groupBy("grouping", "value")
        .agg(F.sum("models").alias("models"), F.count(F.lit(1)).alias("names"))
    )

