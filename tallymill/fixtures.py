"""Views over the driver tables that stand in for an evaluation log.

``eval_rows`` (one scored response per line item), ``responses`` (free text to
extract from), ``answer_pairs`` (answer against expected), ``cell_pairs``
(array scoring), ``model_inventory`` (model names and sizes).  The SQL twins
below define the same views for the check engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.identity import task_type_from_id
from tallymill.session import spread

TASKS = ("arithmetic", "game_of_life", "time_arithmetic", "carwash", "linda_fallacy", "grid_tasks")
USER_STYLES = ("minimal", "casual", "linguistic")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_task() -> Column:
    return (
        F.when(F.col("p_type") == "STANDARD", TASKS[0])
        .when(F.col("p_type") == "SMALL", TASKS[1])
        .when(F.col("p_type") == "MEDIUM", TASKS[2])
        .when(F.col("p_type") == "LARGE", TASKS[3])
        .when(F.col("p_type") == "ECONOMY", TASKS[4])
        .otherwise(TASKS[5])
    )


def case_name() -> Column:
    """``test_id`` from ``l_orderkey`` and ``p_type``."""
    key = F.col("l_orderkey").cast("string")
    return F.concat(F.lit("multi_"), F.lpad(key, F.greatest(F.length(key), F.lit(7)), F.lit("0")), F.lit("_"), raw_task())


def model_name(run: str = "run_id") -> Column:
    return F.concat(F.lit("model"), F.expr(f"cast({run} % 6 as string)"))


def quantization(run: str = "run_id") -> Column:
    return (
        F.when(F.expr(f"{run} % 5 = 0"), "F16")
        .when(F.expr(f"{run} % 5 = 1"), "Q8_0")
        .when(F.expr(f"{run} % 5 = 2"), "Q4_K_M")
        .when(F.expr(f"{run} % 5 = 3"), "Q2_K")
    )


def system_style() -> Column:
    return F.when(F.expr("l_partkey % 3 = 0"), "analytical").when(F.expr("l_partkey % 3 = 1"), "casual").otherwise("adversarial")


def input_tokens() -> Column:
    return F.expr("cast(l_quantity * 4 as int)")


def output_tokens() -> Column:
    return F.expr("cast(l_quantity * l_linenumber as int)")


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored response per line item (lineitem joined with part)."""
    lines = spread(table(spark, sf_dir, "lineitem"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    status = F.when(F.col("l_tax") >= 0.08, "error").otherwise("success")
    match_type = (
        F.when(F.col("l_tax") >= 0.08, F.lit(None).cast("string"))
        .when(F.col("l_discount") >= 0.1, "parse_error")
        .when(F.expr("l_quantity % 3 = 0"), "exact")
        .when(F.expr("l_quantity % 7 = 0"), "type_error")
        .otherwise("mismatch")
    )
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .select(
            F.col("l_suppkey").alias("run_id"),
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            "l_quantity",
            "l_extendedprice",
            "l_shipdate",
            "l_linestatus",
            "p_type",
            "p_brand",
            "p_size",
            case_name().alias("test_id"),
            model_name("l_suppkey").alias("model_name"),
            quantization("l_suppkey").alias("quantization"),
            F.when(F.col("l_returnflag") == "A", USER_STYLES[0])
            .when(F.col("l_returnflag") == "N", USER_STYLES[1])
            .otherwise(USER_STYLES[2])
            .alias("user_style"),
            system_style().alias("system_style"),
            status.alias("status"),
            match_type.alias("match_type"),
            F.coalesce(match_type == "exact", F.lit(False)).alias("correct"),
            (F.col("l_extendedprice") / 10000).alias("duration"),
            input_tokens().alias("input_tokens"),
            output_tokens().alias("output_tokens"),
        )
        .withColumn("task_type", task_type_from_id(F.col("test_id")))
    )


EVAL_ROWS_SQL = """eval_rows AS (
  SELECT l_suppkey AS run_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
         l_extendedprice, l_shipdate, l_linestatus, p_type, p_brand, p_size,
         'multi_' || lpad(CAST(l_orderkey AS VARCHAR), greatest(length(CAST(l_orderkey AS VARCHAR)), 7)::INT, '0')
           || '_' || task_type AS test_id,
         task_type,
         'model' || CAST(l_suppkey % 6 AS VARCHAR) AS model_name,
         CASE l_suppkey % 5 WHEN 0 THEN 'F16' WHEN 1 THEN 'Q8_0' WHEN 2 THEN 'Q4_K_M' WHEN 3 THEN 'Q2_K' END AS quantization,
         CASE l_returnflag WHEN 'A' THEN 'minimal' WHEN 'N' THEN 'casual' ELSE 'linguistic' END AS user_style,
         CASE l_partkey % 3 WHEN 0 THEN 'analytical' WHEN 1 THEN 'casual' ELSE 'adversarial' END AS system_style,
         status, match_type, coalesce(match_type = 'exact', FALSE) AS correct,
         l_extendedprice / 10000 AS duration,
         CAST(l_quantity * 4 AS INT) AS input_tokens,
         CAST(l_quantity * l_linenumber AS INT) AS output_tokens
  FROM (SELECT *,
          CASE p_type WHEN 'STANDARD' THEN 'arithmetic' WHEN 'SMALL' THEN 'game_of_life'
            WHEN 'MEDIUM' THEN 'time_arithmetic' WHEN 'LARGE' THEN 'carwash'
            WHEN 'ECONOMY' THEN 'linda_fallacy' ELSE 'grid_tasks' END AS task_type,
          CASE WHEN l_tax >= 0.08 THEN 'error' ELSE 'success' END AS status,
          CASE WHEN l_tax >= 0.08 THEN NULL WHEN l_discount >= 0.1 THEN 'parse_error'
            WHEN l_quantity % 3 = 0 THEN 'exact' WHEN l_quantity % 7 = 0 THEN 'type_error'
            ELSE 'mismatch' END AS match_type
        FROM lineitem JOIN part ON l_partkey = p_partkey))"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``eval_rows`` with a free-text ``raw_response`` and the expected number."""
    q = F.expr("cast(cast(l_quantity as int) as string)")
    q1 = F.expr("cast(cast(l_quantity as int) + 1 as string)")
    case = F.expr("l_linenumber % 7")
    text = (
        F.when(case == 0, F.concat(F.lit("So \\boxed{"), q, F.lit("}")))
        .when(case == 1, F.concat(F.lit("I tried 7. **"), q, F.lit("**")))
        .when(case == 2, F.concat(F.lit("Answer: "), q))
        .when(case == 3, F.concat(F.lit("First 3, then it is "), q1, F.lit(".\nLet me check: 99")))
        .when(case == 4, F.concat(F.lit("maybe 12, 95% sure "), q))
        .when(case == 5, "no idea")
        .otherwise("")
    )
    return (
        eval_rows(spark, sf_dir)
        .withColumn("raw_response", text)
        .withColumn("expected", F.expr("cast(cast(l_quantity as int) as string)"))
    )


RESPONSES_SQL = (
    EVAL_ROWS_SQL
    + """,
responses AS (
  SELECT *, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS expected,
    CASE l_linenumber % 7
      WHEN 0 THEN 'So ' || chr(92) || 'boxed{' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || '}'
      WHEN 1 THEN 'I tried 7. **' || CAST(CAST(l_quantity AS INT) AS VARCHAR) || '**'
      WHEN 2 THEN 'Answer: ' || CAST(CAST(l_quantity AS INT) AS VARCHAR)
      WHEN 3 THEN 'First 3, then it is ' || CAST(CAST(l_quantity AS INT) + 1 AS VARCHAR) || '.' || chr(10) || 'Let me check: 99'
      WHEN 4 THEN 'maybe 12, 95% sure ' || CAST(CAST(l_quantity AS INT) AS VARCHAR)
      WHEN 5 THEN 'no idea' ELSE '' END AS raw_response
  FROM eval_rows)"""
)


def answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted against expected, as numbers and as text."""
    lines = spread(table(spark, sf_dir, "lineitem"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    case = F.expr("l_linenumber % 4")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_discount",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
        "l_extendedprice",
        "p_type",
        "p_brand",
        "p_size",
        F.col("l_quantity").alias("expected_num"),
        F.expr("l_quantity + (l_linenumber % 3) - 1").alias("predicted_num"),
        F.col("p_type").alias("expected_txt"),
        F.when(case == 0, F.lower("p_type"))
        .when(case == 1, F.concat(F.lit("it is "), F.col("p_type")))
        .when(case == 2, F.substring("p_type", 1, 3))
        .otherwise(F.col("p_brand"))
        .alias("predicted_txt"),
    )


ANSWER_PAIRS_SQL = """answer_pairs AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag,
         l_linestatus, l_extendedprice, p_type, p_brand, p_size,
         l_quantity AS expected_num, l_quantity + (l_linenumber % 3) - 1 AS predicted_num,
         p_type AS expected_txt,
         CASE l_linenumber % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN 'it is ' || p_type
           WHEN 2 THEN substr(p_type, 1, 3) ELSE p_brand END AS predicted_txt
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def cell_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a row of 0/1 cells against the next one."""
    vectors = table(spark, sf_dir, "embeddings")
    cells = F.transform("embedding", lambda x: (x > 0).cast("int"))
    a = vectors.select("vec_id", "label", cells.alias("expected"))
    b = vectors.select((F.col("vec_id") - 1).alias("vec_id"), cells.alias("predicted"))
    return a.join(b, "vec_id")


CELL_PAIRS_SQL = """cell_pairs AS (
  SELECT a.vec_id, a.label, list_transform(a.embedding, lambda x: CAST(x > 0 AS INT)) AS expected,
         list_transform(b.embedding, lambda x: CAST(x > 0 AS INT)) AS predicted
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def model_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model per part, with registry-style names and size texts."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as model_id",
        """case p_partkey % 5
             when 0 then concat('hf.co/org', p_size, '/Qwen2.5-', p_size, 'B-GGUF:Q4_K_M')
             when 1 then concat('gemma3:', p_size, 'b')
             when 2 then concat('llama3.2_', p_size, 'b_uncensored.Q8_0')
             when 3 then concat('mistral:0.', p_size % 9 + 1, 'b-Instruct')
             else concat(replace(p_name, ' ', '_'), '-', p_size, '-chat') end as name""",
        "cast(p_retailprice * 10000000 as bigint) as size_bytes",
        """case p_partkey % 4 when 0 then concat(p_size, '.5 GB') when 1 then concat(p_size, ' mb')
             when 2 then concat(p_size, ' XB') else concat('about ', p_size, ' GB') end as size_text""",
    )


MODEL_INVENTORY_SQL = """model_inventory AS (
  SELECT p_partkey AS model_id,
    CASE p_partkey % 5 WHEN 0 THEN 'hf.co/org' || p_size || '/Qwen2.5-' || p_size || 'B-GGUF:Q4_K_M'
      WHEN 1 THEN 'gemma3:' || p_size || 'b' WHEN 2 THEN 'llama3.2_' || p_size || 'b_uncensored.Q8_0'
      WHEN 3 THEN 'mistral:0.' || (p_size % 9 + 1) || 'b-Instruct'
      ELSE replace(p_name, ' ', '_') || '-' || p_size || '-chat' END AS name,
    CAST(p_retailprice * 10000000 AS BIGINT) AS size_bytes,
    CASE p_partkey % 4 WHEN 0 THEN p_size || '.5 GB' WHEN 1 THEN p_size || ' mb'
      WHEN 2 THEN p_size || ' XB' ELSE 'about ' || p_size || ' GB' END AS size_text
  FROM part)"""
