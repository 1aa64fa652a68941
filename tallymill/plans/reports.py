"""Pivots, windows, top-k and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.fixtures import EVAL_ROWS_SQL, eval_rows, table
from tallymill.operators import aggregate as agg
from tallymill.operators import report
from tallymill.operators.aggregate import rounded
from tallymill.plans.aggregates import CONFIG_SQL, MEANS_SQL, RUN_SQL, configs, runs, summary_sql
from tallymill.plans.registry import query

ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
USERS = ["minimal", "casual", "linguistic"]
SYSTEMS = ["analytical", "casual", "adversarial"]
TASKS = ["arithmetic", "game_of_life", "time_arithmetic", "carwash", "linda_fallacy", "grid_tasks"]
QUANTS = ["F16", "Q8_0", "Q4_K_M", "Q2_K"]


def pct():
    return F.col("accuracy") * 100


def cases(column: str, values: list[str]) -> str:
    return ", ".join(f"round(avg(CASE WHEN {column} = '{v}' THEN accuracy * 100 END), 6) AS \"{v}\"" for v in values)


RUN_TASK_SQL = f"{EVAL_ROWS_SQL}, tasks AS ({summary_sql('run_id, model_name, task_type')})"
RUN_STYLE_SQL = f"{EVAL_ROWS_SQL}, styles AS ({summary_sql('run_id, model_name, quantization, user_style, system_style')})"


def run_tasks(spark, sf):
    return agg.run_summary(eval_rows(spark, sf), ["run_id", "model_name", "task_type"])


def run_styles(spark, sf):
    return agg.run_summary(eval_rows(spark, sf), ["run_id", "model_name", "quantization", "user_style", "system_style"])


@query("pivot_prompt", f"WITH {RUN_STYLE_SQL} SELECT user_style, {cases('system_style', SYSTEMS)} FROM styles GROUP BY user_style")
def _(spark, sf):
    return report.pivot_mean(run_styles(spark, sf), ["user_style"], "system_style", SYSTEMS, pct())


@query("pivot_task", f"WITH {RUN_TASK_SQL} SELECT model_name, {cases('task_type', TASKS)} FROM tasks GROUP BY model_name")
def _(spark, sf):
    return report.pivot_mean(run_tasks(spark, sf), ["model_name"], "task_type", TASKS, pct())


@query("pivot_quant", f"WITH {RUN_SQL} SELECT model_name, {cases('quantization', QUANTS)} FROM runs GROUP BY model_name")
def _(spark, sf):
    return report.pivot_mean(runs(spark, sf), ["model_name"], "quantization", QUANTS, pct())


@query(
    "pivot_quant_prompt",
    f"WITH {RUN_STYLE_SQL} SELECT user_style, system_style, {cases('quantization', QUANTS)} FROM styles GROUP BY ALL",
)
def _(spark, sf):
    return report.pivot_mean(run_styles(spark, sf), ["user_style", "system_style"], "quantization", QUANTS, pct())


@query(
    "prompt_impact",
    f"""WITH {RUN_STYLE_SQL}
    SELECT 'user' AS side, user_style AS style, round(avg(accuracy * 100), 6) AS mean, round(stddev_pop(accuracy * 100), 6) AS std FROM styles GROUP BY ALL
    UNION ALL SELECT 'system', system_style, round(avg(accuracy * 100), 6), round(stddev_pop(accuracy * 100), 6) FROM styles GROUP BY ALL""",
)
def _(spark, sf):
    rows = run_styles(spark, sf)
    user = report.group_impact(rows, "user_style", pct()).withColumnRenamed("user_style", "style")
    system = report.group_impact(rows, "system_style", pct()).withColumnRenamed("system_style", "style")
    return user.withColumn("side", F.lit("user")).unionByName(system.withColumn("side", F.lit("system")))


@query(
    "prompt_radar",
    f"""WITH {RUN_STYLE_SQL} SELECT user_style || '_' || system_style AS config, round(avg(accuracy * 100), 6) AS mean,
      round(stddev_pop(accuracy * 100), 6) AS std FROM styles GROUP BY 1""",
)
def _(spark, sf):
    rows = run_styles(spark, sf).withColumn("config", F.concat_ws("_", "user_style", "system_style"))
    return report.group_impact(rows, "config", pct())


@query(
    "leaderboard",
    f"""WITH {MEANS_SQL}, b AS (SELECT *, accuracy - parse_error * 0.5 - time * 2 AS composite FROM means),
    r AS (SELECT *, row_number() OVER (ORDER BY composite DESC NULLS LAST, model_name) AS place, count(*) OVER () AS n FROM b)
    SELECT model_name, round(accuracy, 6) AS accuracy, round(parse_error, 6) AS parse_error, round(coalesce(1 / time, 0), 6) AS speed,
      round(composite, 6) AS composite, CAST(place AS INT) AS place,
      CASE WHEN place - 1 < n // 3 THEN 'green' WHEN place - 1 < 2 * n // 3 THEN 'orange' ELSE 'red' END AS third FROM r""",
)
def _(spark, sf):
    return report.leaderboard(agg.model_means(runs(spark, sf)))


_BW = "model_name, config, round(accuracy * 100, 6) AS percent"


@query(
    "best_worst",
    f"""WITH {CONFIG_SQL} SELECT * FROM (SELECT {_BW}, 'best' AS side FROM configs ORDER BY accuracy DESC, model_name, config LIMIT 5)
    UNION ALL SELECT * FROM (SELECT {_BW}, 'worst' FROM configs ORDER BY accuracy, model_name, config LIMIT 5)""",
)
def _(spark, sf):
    out = report.best_worst(configs(spark, sf), "accuracy", ["model_name", "config"])
    return out.select("model_name", "config", rounded(pct()).alias("percent"), "side")


@query(
    "best_worst_within",
    f"""WITH {CONFIG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY accuracy DESC, config) AS b,
        row_number() OVER (PARTITION BY model_name ORDER BY accuracy, config) AS w FROM configs)
    SELECT {_BW}, 'best' AS side, CAST(b AS INT) AS place FROM r WHERE b <= 2
    UNION ALL SELECT {_BW}, 'worst', CAST(w AS INT) FROM r WHERE w <= 2""",
)
def _(spark, sf):
    out = report.best_worst_within(configs(spark, sf), "model_name", "accuracy", ["config"], 2)
    return out.select("model_name", "config", rounded(pct()).alias("percent"), "side", "place")


@query(
    "task_rankings",
    f"""WITH {RUN_TASK_SQL}, m AS (SELECT task_type, model_name, round(avg(accuracy * 100), 6) AS percent FROM tasks GROUP BY ALL)
    SELECT *, CAST(rank() OVER (PARTITION BY task_type ORDER BY percent DESC NULLS LAST) AS INT) AS rank FROM m""",
)
def _(spark, sf):
    means = run_tasks(spark, sf).groupBy("task_type", "model_name").agg(rounded(F.avg(pct())).alias("percent"))
    return report.task_rankings(means, "task_type", "percent")


@query(
    "efficiency",
    f"""WITH {MEANS_SQL} SELECT model_name, round(accuracy / greatest(time, 0.1), 6) AS efficiency,
      CASE WHEN accuracy >= avg(accuracy) OVER () THEN 'high_accuracy' ELSE 'low_accuracy' END ||
      CASE WHEN time <= avg(time) OVER () THEN '_fast' ELSE '_slow' END AS quadrant FROM means""",
)
def _(spark, sf):
    return report.efficiency(agg.model_means(runs(spark, sf)))


@query(
    "quant_tradeoff",
    f"""WITH {RUN_SQL} SELECT quantization, round(avg(accuracy * 100), 6) AS accuracy,
      round(avg(1 / avg_time_per_test) FILTER (WHERE avg_time_per_test > 0), 6) AS speed,
      CAST(CASE quantization WHEN 'F16' THEN 1.0 WHEN 'Q8_0' THEN 0.5 WHEN 'Q4_K_M' THEN 0.25 WHEN 'Q2_K' THEN 0.125 END AS DOUBLE) AS compression
    FROM runs WHERE quantization IS NOT NULL GROUP BY quantization""",
)
def _(spark, sf):
    return report.quant_tradeoff(runs(spark, sf))


@query(
    "delta_vs_baseline",
    f"""WITH {CONFIG_SQL} SELECT model_name, config, round(accuracy * 100, 6) AS percent,
      round((accuracy - max(CASE WHEN config = 'minimal+casual' THEN accuracy END) OVER (PARTITION BY model_name)) * 100, 6) AS delta
    FROM configs""",
)
def _(spark, sf):
    out = report.delta_vs_baseline(configs(spark, sf), ["model_name"], "config", "minimal+casual", "accuracy")
    return out.select("model_name", "config", rounded(pct()).alias("percent"), rounded(F.col("delta") * 100).alias("delta"))


@query(
    "model_gap",
    f"""WITH {CONFIG_SQL}, s AS (SELECT config, max(CASE WHEN model_name = 'model1' THEN accuracy * 100 END) AS a,
        max(CASE WHEN model_name = 'model2' THEN accuracy * 100 END) AS b FROM configs GROUP BY config)
    SELECT config, round(a, 6) AS a, round(b, 6) AS b, round(a - b, 6) AS gap,
      CASE WHEN abs(a - b) <= 0.5 THEN 'tie' WHEN a > b THEN 'model1' ELSE 'model2' END AS winner FROM s""",
)
def _(spark, sf):
    per = configs(spark, sf).withColumn("percent", pct())
    out = report.model_gap(per, ["config"], "model1", "model2", "percent", 0.5)
    return out.withColumns({c: rounded(F.col(c)) for c in ("a", "b", "gap")})


@query(
    "range_summary",
    f"""WITH {CONFIG_SQL}, s AS (SELECT model_name, min(accuracy * 100) AS lo, avg(accuracy * 100) AS mid, max(accuracy * 100) AS hi,
        stddev_pop(accuracy * 100) AS sd FROM configs GROUP BY model_name)
    SELECT model_name, round(lo, 6) AS min, round(mid, 6) AS mean, round(hi, 6) AS max, round(sd, 6) AS std, round(hi - lo, 6) AS range,
      CAST(rank() OVER (ORDER BY mid DESC) AS INT) AS rank FROM s""",
)
def _(spark, sf):
    return report.range_summary(configs(spark, sf).withColumn("percent", pct()), "model_name", "percent")


_LAST = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]
_LAST_SQL = ", ".join(f"{c} DESC" for c in _LAST)


@query(
    "dedup_last",
    f"""WITH {EVAL_ROWS_SQL} SELECT test_id, l_linenumber, l_partkey, l_suppkey, match_type FROM (
      SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY {_LAST_SQL}) AS rn FROM eval_rows) WHERE rn = 1""",
)
def _(spark, sf):
    kept = report.dedup_last(eval_rows(spark, sf), ["test_id"], _LAST)
    return kept.select("test_id", "l_linenumber", "l_partkey", "l_suppkey", "match_type")


@query(
    "stratified_sample",
    f"""WITH {EVAL_ROWS_SQL}, d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_name, test_id ORDER BY {_LAST_SQL}) AS rn FROM eval_rows) WHERE rn = 1),
    s AS (SELECT *, CASE WHEN status <> 'success' THEN 'error' WHEN correct THEN 'correct' ELSE 'wrong' END AS stratum FROM d),
    r AS (SELECT *, row_number() OVER (PARTITION BY model_name, stratum ORDER BY md5('42|' || test_id), test_id) AS pick FROM s)
    SELECT model_name, stratum, test_id, CAST(pick AS INT) AS pick FROM r WHERE pick <= CASE stratum WHEN 'error' THEN 3 ELSE 5 END""",
)
def _(spark, sf):
    unique = report.dedup_last(eval_rows(spark, sf), ["model_name", "test_id"], _LAST)
    picked = report.stratified_sample(unique, ["model_name"], ["test_id"])
    return picked.select("model_name", "stratum", "test_id", "pick")


@query(
    "head_sample",
    f"""WITH {EVAL_ROWS_SQL} SELECT run_id, test_id, CAST(position AS INT) AS position FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {', '.join(_LAST)}) AS position FROM eval_rows) WHERE position <= 3""",
)
def _(spark, sf):
    return report.head_sample(eval_rows(spark, sf), ["run_id"], _LAST).select("run_id", "test_id", "position")


@query(
    "sorted_views",
    f"""WITH {RUN_SQL}, f AS (SELECT run_id, max(l_shipdate) AS latest FROM eval_rows GROUP BY run_id)
    SELECT runs.run_id, model_name, round(accuracy, 6) AS accuracy, latest FROM runs JOIN f USING (run_id)""",
)
def _(spark, sf):
    rows = eval_rows(spark, sf).groupBy("run_id", "model_name").agg(
        *agg.response_counts(), F.max("l_shipdate").alias("latest")
    )
    out = agg.with_rates(rows).select("run_id", "model_name", rounded(F.col("accuracy")).alias("accuracy"), "latest")
    return out.orderBy(F.desc_nulls_last("accuracy"), F.desc("latest"), "model_name", "run_id")
