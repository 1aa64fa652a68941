"""Joins, set operations and run comparison."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallymill.fixtures import EVAL_ROWS_SQL, RESPONSES_SQL, eval_rows, responses, table
from tallymill.functions.text import words
from tallymill.operators import compare
from tallymill.operators.extract import extract
from tallymill.operators.score import score_numeric
from tallymill.plans.extraction import CASCADE_VALUE_SQL
from tallymill.plans.registry import query
from tallymill.session import scratch_path
from tallymill.sources.sinks import buckets_for, write_bucketed

ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(
    "join_testset",
    f"""WITH {EVAL_ROWS_SQL} SELECT {KEY_SQL}, test_id, o_orderpriority AS priority, o_orderstatus AS origin
    FROM eval_rows LEFT JOIN orders ON l_orderkey = o_orderkey""",
)
def _(spark, sf):
    cases = table(spark, sf, "orders").selectExpr(
        "o_orderkey as l_orderkey", "o_orderpriority as priority", "o_orderstatus as origin"
    )
    out = compare.join_testset(eval_rows(spark, sf), cases, ["l_orderkey"])
    return out.select(*ROW_KEY, "test_id", "priority", "origin")


@query(
    "join_bucketed",
    f"""WITH {EVAL_ROWS_SQL} SELECT {KEY_SQL}, test_id, o_orderpriority AS priority, o_orderstatus AS origin
    FROM eval_rows LEFT JOIN orders ON l_orderkey = o_orderkey""",
)
def _(spark, sf):
    """The same join of a log and a test set that are stored in buckets of its key: no shuffle on either side."""
    cases = table(spark, sf, "orders").selectExpr("o_orderkey as l_orderkey", "o_orderpriority as priority", "o_orderstatus as origin")
    run = uuid.uuid4().hex
    buckets = buckets_for(table(spark, sf, "lineitem"))
    log = write_bucketed(eval_rows(spark, sf).select(*ROW_KEY, "test_id"), f"log_{run}", ["l_orderkey"], buckets)
    stored = write_bucketed(cases, f"cases_{run}", ["l_orderkey"], buckets)
    return compare.join_testset(log, stored, ["l_orderkey"]).select(*ROW_KEY, "test_id", "priority", "origin")


@query(
    "lookup_join",
    "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
)
def _(spark, sf):
    nations = compare.lookup_join(table(spark, sf, "customer"), table(spark, sf, "nation"), "c_nationkey", "n_nationkey")
    out = compare.lookup_join(nations, table(spark, sf, "region"), "n_regionkey", "r_regionkey")
    return out.select("c_custkey", "n_name", "r_name")


def rescored(spark, sf):
    """Old verdict from the log, new verdict from extracting and scoring again."""
    rows = extract(responses(spark, sf).filter("status = 'success' and raw_response <> ''"), "arithmetic", "raw_response")
    again = score_numeric(F.col("answer.value"), F.col("expected"))
    return rows.select(
        *ROW_KEY,
        "task_type",
        F.col("correct").alias("old_correct"),
        F.col("match_type").alias("old_value"),
        F.col("answer.value").alias("new_value"),
        F.when(F.col("answer.value").isNotNull(), again["correct"]).alias("new_correct"),
    )


_RESCORED_SQL = f"""{RESPONSES_SQL}, n AS (SELECT *, {CASCADE_VALUE_SQL} AS new_value FROM responses WHERE status = 'success' AND raw_response <> ''),
  v AS (SELECT *, coalesce(correct, FALSE) AS old, match_type AS old_value,
    CASE WHEN new_value IS NULL THEN coalesce(correct, FALSE) ELSE CAST(new_value AS DOUBLE) = CAST(expected AS DOUBLE) END AS new,
    new_value IS NOT NULL AND coalesce(match_type, '') <> coalesce(new_value, '') AS parse_changed FROM n)"""


@query(
    "rescore_diff",
    f"""WITH {_RESCORED_SQL} SELECT coalesce(task_type, 'TOTAL') AS task_type, count(*) AS total, count(*) FILTER (WHERE parse_changed) AS parse_changed,
      count(*) FILTER (WHERE NOT old AND new) AS improved, count(*) FILTER (WHERE old AND NOT new) AS regressed,
      count(*) FILTER (WHERE old = new) AS unchanged, round(count(*) FILTER (WHERE old) / count(*), 6) AS old_accuracy,
      round(count(*) FILTER (WHERE new) / count(*), 6) AS new_accuracy,
      count(*) FILTER (WHERE NOT old AND new) - count(*) FILTER (WHERE old AND NOT new) AS net
    FROM v GROUP BY ROLLUP (task_type)""",
)
def _(spark, sf):
    return compare.rescore_diff(rescored(spark, sf))


def versions(spark, sf):
    """Two written versions of one log.

    The first ran before failed cases were repeated; the second dropped a retired task, takes answers of the
    wrong type, and no longer takes exact answers that took five seconds or more.
    """
    rows = eval_rows(spark, sf).withColumn("config_hash", F.when(F.col("system_style") != "casual", F.col("l_partkey").cast("string")))
    columns = ["config_hash", "test_id", "model_name", "task_type", "l_linenumber", "l_suppkey", F.col("match_type").alias("value")]
    lenient = (F.col("match_type") == "type_error") | ((F.col("match_type") == "exact") & (F.col("duration") < 5))
    first = F.when(F.col("status") == "success", F.struct(F.lit("first").alias("version"), "correct"))
    second = F.when(F.col("task_type") != "linda_fallacy", F.struct(F.lit("second").alias("version"), lenient.alias("correct")))
    # both versions are written in one pass, each to its own folder, so the log is joined and read once
    path = scratch_path(spark, "versions")
    said = F.explode(F.array_compact(F.array(first, second))).alias("said")
    both = rows.select(*columns, said).select(*columns[:-1], "value", "said.correct", "said.version")
    both.write.partitionBy("version").parquet(path)
    written = spark.read.schema(both.schema).parquet(path)
    return [written.where(F.col("version") == name).drop("version") for name in ("first", "second")]


_VERSIONS_SQL = f"""{EVAL_ROWS_SQL}, e AS (SELECT *, CASE WHEN system_style <> 'casual' THEN CAST(l_partkey AS VARCHAR) END AS config_hash FROM eval_rows),
  v AS (SELECT FALSE AS second, config_hash, test_id, model_name, task_type, l_linenumber, l_suppkey, match_type AS value, coalesce(correct, FALSE) AS correct FROM e WHERE status = 'success'
    UNION ALL SELECT TRUE, config_hash, test_id, model_name, task_type, l_linenumber, l_suppkey, match_type,
      coalesce(match_type = 'type_error' OR (match_type = 'exact' AND duration < 5), FALSE) FROM e WHERE task_type <> 'linda_fallacy'),
  u AS (SELECT *, row_number() OVER (PARTITION BY second, config_hash, test_id, model_name ORDER BY l_linenumber DESC, l_suppkey DESC, correct DESC, value DESC NULLS LAST) AS r FROM v),
  o AS (SELECT * FROM u WHERE r = 1 AND NOT second), n AS (SELECT * FROM u WHERE r = 1 AND second),
  d AS (SELECT coalesce(n.config_hash, o.config_hash) AS config_hash, coalesce(n.test_id, o.test_id) AS test_id, coalesce(n.model_name, o.model_name) AS model_name,
    CASE WHEN n.r IS NULL THEN o.task_type ELSE n.task_type END AS task_type, o.value AS old_value, n.value AS new_value, o.correct AS old_correct, n.correct AS new_correct,
    o.r IS NOT NULL AND n.r IS NOT NULL AND o.value IS DISTINCT FROM n.value AS parse_changed,
    CASE WHEN o.r IS NULL THEN 'added' WHEN n.r IS NULL THEN 'removed' WHEN NOT o.correct AND n.correct THEN 'improved' WHEN o.correct AND NOT n.correct THEN 'regressed' ELSE 'unchanged' END AS change
    FROM o FULL JOIN n ON o.config_hash IS NOT DISTINCT FROM n.config_hash AND o.test_id = n.test_id AND o.model_name = n.model_name)"""


@query("version_diff", f"WITH {_VERSIONS_SQL} SELECT * FROM d")
def _(spark, sf):
    return compare.version_diff(*versions(spark, sf), ["l_linenumber", "l_suppkey"], carry=["task_type"])


@query(
    "version_counts",
    f"""WITH {_VERSIONS_SQL} SELECT coalesce(task_type, 'TOTAL') AS task_type, count(*) AS total, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed,
      count(*) FILTER (change = 'improved') AS improved, count(*) FILTER (change = 'regressed') AS regressed, count(*) FILTER (change = 'unchanged') AS unchanged,
      count(*) FILTER (parse_changed) AS parse_changed, round(count(*) FILTER (old_correct) / nullif(count(old_correct), 0), 6) AS old_accuracy,
      round(count(*) FILTER (new_correct) / nullif(count(new_correct), 0), 6) AS new_accuracy FROM d GROUP BY ROLLUP (task_type)""",
)
def _(spark, sf):
    diff = compare.version_diff(*versions(spark, sf), ["l_linenumber", "l_suppkey"], carry=["task_type"])
    return compare.version_counts(diff, "task_type")


@query(
    "failed_keeps_old",
    f"""WITH {_RESCORED_SQL} SELECT {KEY_SQL}, new AS correct,
      CASE WHEN NOT old AND new THEN 'improved' WHEN old AND NOT new THEN 'regressed' ELSE 'unchanged' END AS change FROM v""",
)
def _(spark, sf):
    return compare.rescore_rows(rescored(spark, sf)).select(*ROW_KEY, F.col("new").alias("correct"), "change")


@query(
    "mismatch_pairs",
    """WITH m AS (SELECT n_nationkey, n_regionkey AS g, row_number() OVER (ORDER BY n_regionkey, md5('42|' || n_nationkey), n_nationkey) - 1 AS n FROM nation),
    r AS (SELECT g, min(n) AS low, count(*) AS size FROM m GROUP BY g),
    d AS (SELECT c_custkey, low, size, (SELECT count(*) FROM nation) - size AS others,
      CAST('0x' || substr(md5('42|' || c_custkey), 1, 13) AS BIGINT) / 4503599627370496.0 AS u, unnest(range(0, 3)) AS t
      FROM customer JOIN nation ON c_nationkey = nation.n_nationkey JOIN r ON r.g = n_regionkey),
    p AS (SELECT c_custkey, low, size, (CAST(floor(u * others) AS BIGINT) + t) % others AS slot FROM d)
    SELECT c_custkey, n_nationkey FROM p JOIN m ON m.n = CASE WHEN slot < low THEN slot ELSE slot + size END""",
)
def _(spark, sf):
    nations = table(spark, sf, "nation")
    items = compare.lookup_join(table(spark, sf, "customer"), nations, "c_nationkey", "n_nationkey")
    items = items.select("c_custkey", F.col("n_regionkey").alias("item_region"))
    pool = nations.select("n_nationkey", F.col("n_regionkey").alias("pool_region"))
    return compare.mismatch_pairs(items, pool, "item_region", "pool_region", "c_custkey", "n_nationkey").select("c_custkey", "n_nationkey")


@query(
    "empty_prompt_check",
    """WITH t AS (SELECT a.conv_id, a.turn, a.role, CASE WHEN a.role = 'system' THEN a.text ELSE '' END AS system_prompt,
      coalesce(b.text, '') AS user_prompt FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)
    SELECT role, count(*) AS cases, count(*) FILTER (WHERE system_prompt = '') AS empty_system,
      count(*) FILTER (WHERE user_prompt = '') AS empty_user FROM t GROUP BY role""",
)
def _(spark, sf):
    turns = compare.with_previous_turn(table(spark, sf, "conversations"))
    cases = turns.withColumns(
        {"system_prompt": F.expr("case when role = 'system' then text end"), "user_prompt": F.col("prompt")}
    )
    return compare.empty_prompt_check(cases, ["role"])


@query(
    "missing_cases",
    f"""WITH {EVAL_ROWS_SQL} SELECT o_orderkey FROM orders WHERE NOT EXISTS (
      SELECT 1 FROM eval_rows WHERE l_orderkey = o_orderkey AND status = 'success')""",
)
def _(spark, sf):
    done = eval_rows(spark, sf).filter("status = 'success'").select(F.col("l_orderkey").alias("o_orderkey"))
    return compare.missing_cases(table(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])


_WORDS_SQL = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-zA-Z_0-9 \\t\\n\\r\\f\\v]', '', 'g'), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''))"


@query(
    "set_overlap",
    f"""WITH p AS (SELECT a.conv_id, a.turn, {_WORDS_SQL.format('a.text')} AS a, {_WORDS_SQL.format('b.text')} AS b
      FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1),
    s AS (SELECT conv_id, turn, len(list_intersect(a, b)) AS common, len(list_distinct(list_concat(a, b))) AS combined, len(a) AS na, len(b) AS nb FROM p)
    SELECT conv_id, turn, CAST(common AS INT) AS common, CAST(combined AS INT) AS combined, common = na AS a_in_b, common = nb AS b_in_a,
      round(common / nullif(combined, 0), 6) AS jaccard FROM s""",
)
def _(spark, sf):
    turns = compare.with_previous_turn(table(spark, sf, "conversations")).filter("prompt is not null")
    overlap = compare.set_overlap(words(F.col("text")), words(F.col("prompt")))
    return turns.select("conv_id", "turn", overlap.alias("o")).select("conv_id", "turn", "o.*")
