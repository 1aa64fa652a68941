"""Summaries with stated errors, frequent texts, draws from weight tables, variants and catalogue look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.fixtures import EVAL_ROWS_SQL, eval_rows, table
from tallymill.operators import aggregate, draw, matching, params, sketch
from tallymill.plans.registry import query
from tallymill.session import spread

_DURATIONS = "model_name, count(duration) AS n, round(min(duration), 6) AS min, round(max(duration), 6) AS max"
_K = 800


@query(
    "quartile_sketch",
    f"""WITH {EVAL_ROWS_SQL} SELECT {_DURATIONS}, true AS q1_within, true AS median_within, true AS q3_within
    FROM eval_rows WHERE duration IS NOT NULL GROUP BY model_name""",
)
def _(spark, sf):
    """Sketches per run merged per model, and whether their quartiles keep the stated error against all values."""
    rows = eval_rows(spark, sf).select("model_name", "run_id", "duration").filter("duration is not null")
    runs = sketch.quantile_sketches(rows, ["model_name", "run_id"], F.col("duration"), _K)
    found = sketch.sketched_quantiles(sketch.merge_quantiles(runs, ["model_name"], _K))
    off = sketch.rank_distance(rows, "model_name", F.col("duration"), found)
    ends = found.select(F.col("model_name").alias("_m"), *[aggregate.rounded(F.col(c)).alias(c) for c in ("min", "max")])
    # 99 in 100 answers keep the error itself, all but one in millions twice of it
    within = [(F.col(f"o.{c}") <= 2 * sketch.rank_error(_K)).alias(f"{c}_within") for c in ("q1", "median", "q3")]
    return off.alias("o").join(ends.alias("e"), F.equal_null("model_name", "_m")).select("model_name", "n", "e.min", "e.max", *within)


_DIMENSIONS = ["model_name", "task_type", "quantization", "user_style", "l_partkey", "l_orderkey"]


@query(
    "dimension_sketch",
    f"WITH {EVAL_ROWS_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, count(DISTINCT coalesce(CAST({d} AS VARCHAR), 'unknown')) AS n_values, "
        f"count(DISTINCT coalesce(CAST({d} AS VARCHAR), 'unknown')) > 1 AS comparable, true AS within FROM eval_rows"
        for d in _DIMENSIONS
    ),
)
def _(spark, sf):
    """Distinct counts of small and large dimensions from sketches per run, held against the exact counts."""
    rows = eval_rows(spark, sf)
    found = sketch.sketched_dimensions(sketch.distinct_sketches(rows, ["run_id"], _DIMENSIONS), _DIMENSIONS)
    exact = aggregate.dimension_detect(rows, _DIMENSIONS).select("dimension", "n_values")
    close = F.abs(F.col("estimate") - F.col("n_values")) <= F.col("n_values") * 4 * sketch.distinct_error(12)
    return exact.join(found, "dimension").select("dimension", "n_values", "comparable", close.alias("within"))


@query(
    "frequent_lines",
    """WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT line, count(*) AS count FROM l GROUP BY line ORDER BY 2 DESC, 1 LIMIT 20""",
)
def _(spark, sf):
    """The most frequent lines of all documents, nearly all of which are different."""
    lines = spread(table(spark, sf, "documents")).select(F.explode(F.split("text", "\n")).alias("line"))
    return sketch.frequent_texts(lines, "line", 20)


@query(
    "frequent_errors",
    f"""WITH {EVAL_ROWS_SQL}, e AS (SELECT CASE WHEN status = 'error' THEN 'request failed' ELSE 'no answer in ' || l_orderkey || '/' || l_partkey % 50 END AS error_text
      FROM eval_rows WHERE coalesce(match_type, 'parse_error') = 'parse_error')
    SELECT error_text, count(*) AS count FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""",
)
def _(spark, sf):
    """Error texts that name the row, so that nearly each is a text of its own, beside one that many rows share."""
    rows = eval_rows(spark, sf).filter("coalesce(match_type, 'parse_error') = 'parse_error'")
    text = F.expr("case when status = 'error' then 'request failed' else 'no answer in ' || l_orderkey || '/' || l_partkey % 50 end")
    return sketch.frequent_texts(rows.select(text.alias("error_text")), "error_text")


_WEIGHTS_SQL = """SELECT o_orderpriority AS line, l_partkey AS category, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS w
      FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority <> '5-LOW' GROUP BY ALL"""


@query(
    "weighted_pick_table",
    f"""WITH w AS ({_WEIGHTS_SQL}),
    b AS (SELECT *, CAST(sum(w) OVER (PARTITION BY line ORDER BY category) AS HUGEINT) AS high, CAST(sum(w) OVER (PARTITION BY line) AS HUGEINT) AS total FROM w),
    t AS (SELECT DISTINCT line, total FROM b),
    u AS (SELECT o_orderkey, o_orderpriority, CAST(CAST('0x' || substr(md5('11|' || o_orderkey), 1, 13) AS BIGINT) AS HUGEINT) * total // 4503599627370496 AS place
      FROM orders LEFT JOIN t ON line = o_orderpriority)
    SELECT o_orderkey, o_orderpriority, category AS l_partkey FROM u LEFT JOIN b ON line = o_orderpriority AND place >= high - w AND place < high""",
)
def _(spark, sf):
    """A part for every order, by the quantities sold in its priority; one priority has no weights."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    sold = table(spark, sf, "lineitem").join(orders.filter("o_orderpriority <> '5-LOW'"), F.col("l_orderkey") == F.col("o_orderkey"))
    weights = sold.select("o_orderpriority", "l_partkey", F.col("l_quantity").cast("long").alias("sold"))
    return draw.weighted_draw(orders, weights, "11", ["o_orderkey"], group="o_orderpriority", category="l_partkey", weight="sold", per_bin=500)


# Parameters of mixed and nested kinds, one text per order.
_PARAMS_SQL = """CASE o_orderkey % 6 WHEN 0 THEN '{"size": ' || o_custkey || ', "answer": {"value": ' || o_orderkey || ', "unit": "kg"}}'
    WHEN 1 THEN '{"size": "' || o_custkey || '", "answer": {"value": "n' || o_orderkey || '"}, "tags": ["a", "' || o_orderstatus || '"]}'
    WHEN 2 THEN '{"size": null, "answer": ' || o_orderkey || '.5, "strict": true}'
    WHEN 3 THEN '{"tags": [], "strict": false, "answer": [1, [2, ' || o_custkey || ']]}'
    WHEN 4 THEN '{"size": ' END"""


@query(
    "param_fields",
    f"""WITH p AS (SELECT o_orderpriority, {_PARAMS_SQL} AS params FROM orders), v AS (SELECT o_orderpriority, CAST(params AS JSON) AS j FROM p WHERE json_valid(params)),
    k AS (SELECT o_orderpriority, j, unnest(json_keys(j)) AS field FROM v)
    SELECT o_orderpriority, field, CASE json_type(j, '$.' || field) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'text'
      WHEN 'BOOLEAN' THEN 'flag' WHEN 'NULL' THEN 'none' ELSE 'number' END AS class, count(*) AS n FROM k GROUP BY ALL""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderpriority", f"{_PARAMS_SQL} as task_params")
    return params.param_fields(rows, ["o_orderpriority"])


@query(
    "param_schema",
    f"""WITH p AS (SELECT o_orderpriority, {_PARAMS_SQL} AS params, o_orderkey % 6 AS form FROM orders)
    SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE NOT json_valid(params)) AS broken,
      'OBJECT<answer: VARIANT, size: VARIANT, strict: BOOLEAN, tags: ARRAY<STRING>>' AS schema FROM p GROUP BY o_orderpriority""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderpriority", f"{_PARAMS_SQL} as task_params")
    return params.param_schema(rows, ["o_orderpriority"])


@query(
    "param_read",
    f"""WITH p AS (SELECT o_orderkey, {_PARAMS_SQL} AS params FROM orders), j AS (SELECT o_orderkey, CASE WHEN json_valid(params) THEN CAST(params AS JSON) END AS j FROM p)
    SELECT o_orderkey, TRY_CAST(json_extract_string(j, '$.size') AS BIGINT) AS size, TRY_CAST(json_extract_string(j, '$.answer.value') AS BIGINT) AS answer,
      json_extract_string(j, '$.answer.unit') AS unit, json_extract_string(j, '$.tags[1]') AS second_tag, TRY_CAST(json_extract_string(j, '$.answer[1][1]') AS BIGINT) AS inner_value,
      CASE json_extract_string(j, '$.strict') WHEN 'true' THEN true WHEN 'false' THEN false END AS strict FROM j""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_PARAMS_SQL} as task_params")
    fields = {
        "size": ("$.size", "bigint"), "answer": ("$.answer.value", "bigint"), "unit": ("$.answer.unit", "string"),
        "second_tag": ("$.tags[1]", "string"), "inner_value": ("$.answer[1][1]", "bigint"), "strict": ("$.strict", "boolean"),
    }
    return params.read_params(rows, fields).drop("task_params")


def _word_set(text: str) -> str:
    return rf"list_filter(list_distinct(string_split_regex(regexp_replace(lower({text}), '[^\w\s]', '', 'g'), '\s+')), lambda w: w <> '')"


_SAID_SQL = "p_name || ' of ' || p_type || ', ' || p_brand || ' (size ' || p_size || ')'"
_LISTED_SQL = "upper(p_type) || ': ' || p_brand || ' ' || p_name || ' - size ' || p_size % 7"


@query(
    "fuzzy_lookup",
    f"""WITH r AS (SELECT p_partkey, {_SAID_SQL} AS said FROM part), a AS (SELECT said, {_word_set('said')} AS aw FROM (SELECT DISTINCT said FROM r)),
    b AS (SELECT listed, {_word_set('listed')} AS bw FROM (SELECT DISTINCT {_LISTED_SQL} AS listed FROM part)),
    p AS (SELECT said, listed, len(list_intersect(aw, bw)) AS o, len(aw) + len(bw) AS n FROM a CROSS JOIN b),
    k AS (SELECT said, listed, o / (n - o) AS s FROM p WHERE o / (n - o) >= 0.7 - 1e-12),
    m AS (SELECT said, arg_min(listed, struct_pack(s := -s, l := listed)) AS match, max(s) AS similarity, count(*) AS n_matches FROM k GROUP BY said)
    SELECT p_partkey, said, match, round(similarity, 6) AS similarity, coalesce(n_matches, 0) AS n_matches FROM r LEFT JOIN m USING (said)""",
)
def _(spark, sf):
    """Parts as they are spoken of, looked up in the whole catalogue by words."""
    parts = table(spark, sf, "part")
    rows = parts.selectExpr("p_partkey", f"{_SAID_SQL} as said")
    found = matching.fuzzy_lookup(rows, "said", parts.selectExpr(f"{_LISTED_SQL} as listed"), "listed", 0.7)
    return found.withColumn("similarity", aggregate.rounded(F.col("similarity")))
