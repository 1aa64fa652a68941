"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.fixtures import (
    EVAL_ROWS_SQL,
    MODEL_INVENTORY_SQL,
    RESPONSES_SQL,
    eval_rows,
    model_inventory,
    responses,
    table,
)
from tallymill.functions import fields, identity, text
from tallymill.operators.aggregate import run_summary, token_fallback
from tallymill.operators.report import inventory_filter
from tallymill.plans.registry import query
from tallymill.session import spread

_NAMES = "|".join(sorted([*identity.TASK_FAMILIES, *identity.TASK_ALIASES], key=len, reverse=True))
_ALIAS_CASE = "CASE found " + " ".join(f"WHEN '{a}' THEN '{f}'" for a, f in identity.TASK_ALIASES.items()) + " WHEN '' THEN 'unknown' ELSE found END"
ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(
    "task_type_from_id",
    f"""WITH {EVAL_ROWS_SQL}, found AS (
      SELECT {KEY_SQL}, test_id, regexp_extract(test_id, '(?:^|_)({_NAMES})(?:_|$)', 1) AS found FROM eval_rows)
    SELECT {KEY_SQL}, test_id, {_ALIAS_CASE} AS task,
      CASE WHEN contains(test_id, '_arithmetic') THEN 'arithmetic'
           WHEN contains(test_id, '_game_of_life') OR contains(test_id, '_gol') THEN 'game_of_life'
           WHEN contains(test_id, '_linda') THEN 'linda_fallacy'
           WHEN contains(test_id, '_carwash') THEN 'carwash'
           WHEN contains(test_id, '_grid_tasks') THEN 'grid_tasks' ELSE 'unknown' END AS legacy_task
    FROM found""",
)
def _(spark, sf):
    rows = eval_rows(spark, sf)
    return rows.select(
        *ROW_KEY,
        "test_id",
        identity.task_type_from_id(F.col("test_id")).alias("task"),
        identity.task_type_from_id(F.col("test_id"), legacy=True).alias("legacy_task"),
    )


@query(
    "test_family",
    f"""WITH {EVAL_ROWS_SQL}
    SELECT {KEY_SQL}, regexp_replace(regexp_replace(test_id || '_' || run_id || '_' || l_linenumber, '^multi_[0-9]+_', ''), '(_[0-9]+)+$', '') AS family
    FROM eval_rows""",
)
def _(spark, sf):
    full = F.concat_ws("_", "test_id", "run_id", "l_linenumber")
    return eval_rows(spark, sf).select(*ROW_KEY, identity.test_family(full).alias("family"))


@query(
    "model_key",
    f"""WITH {EVAL_ROWS_SQL}
    SELECT DISTINCT run_id, CASE WHEN quantization IS NULL THEN model_name ELSE model_name || ' (' || quantization || ')' END AS model_key
    FROM eval_rows""",
)
def _(spark, sf):
    key = identity.model_key(F.col("model_name"), F.col("quantization"))
    return eval_rows(spark, sf).select("run_id", key.alias("model_key")).distinct()


@query(
    "model_short_name",
    f"""WITH {MODEL_INVENTORY_SQL}
    SELECT model_id, CASE WHEN name LIKE 'hf.co/%' THEN split_part(list_last(string_split(name, '/')), ':', 1)
        WHEN contains(name, ':') THEN split_part(name, ':', 1)
        WHEN contains(lower(name), 'uncensored') AND regexp_matches(name, 'llama[0-9.]+_([0-9]+)b')
          THEN 'llama3.2:' || regexp_extract(name, 'llama[0-9.]+_([0-9]+)b', 1) || 'b-uncensored'
        ELSE name END AS short_name,
      regexp_replace(replace(replace(name, ':', '-'), '/', '-'), '(?i)(-instruct|-chat|-base)$', '') AS file_name
    FROM model_inventory""",
)
def _(spark, sf):
    name = F.col("name")
    return model_inventory(spark, sf).select(
        "model_id",
        identity.model_short_name(name).alias("short_name"),
        identity.model_file_name(name).alias("file_name"),
    )


@query(
    "slug",
    f"""WITH {MODEL_INVENTORY_SQL}
    SELECT model_id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM model_inventory""",
)
def _(spark, sf):
    return model_inventory(spark, sf).select("model_id", identity.slug(F.col("name")).alias("slug"))


_FAMILY_CASE = "CASE " + " ".join(
    f"WHEN contains(lower(name), '{w}') THEN '{f}'" for f, ws in identity.MODEL_FAMILY_WORDS.items() for w in ws
) + " ELSE 'other' END"
_QUANT_CASE = "CASE " + " ".join(f"WHEN contains(upper(name), '{q}') THEN '{q}'" for q in identity.QUANTIZATION_TAGS) + " END"
_BUCKET_CASE = """CASE WHEN size_bytes < 2e9 THEN '< 2B' WHEN size_bytes < 8e9 THEN '2-8B'
  WHEN size_bytes < 15e9 THEN '8-15B' ELSE '> 15B' END"""


@query("model_family", f"WITH {MODEL_INVENTORY_SQL} SELECT model_id, {_FAMILY_CASE} AS family FROM model_inventory")
def _(spark, sf):
    return model_inventory(spark, sf).select("model_id", identity.model_family(F.col("name")).alias("family"))


@query("quantization_of", f"WITH {MODEL_INVENTORY_SQL} SELECT model_id, {_QUANT_CASE} AS quantization FROM model_inventory")
def _(spark, sf):
    return model_inventory(spark, sf).select("model_id", identity.quantization_of(F.col("name")).alias("quantization"))


@query(
    "parse_size",
    f"""WITH {MODEL_INVENTORY_SQL}, p AS (SELECT model_id, string_split(size_text, ' ') AS parts FROM model_inventory)
    SELECT model_id, CASE WHEN len(parts) = 2 AND TRY_CAST(parts[1] AS DOUBLE) IS NOT NULL
      THEN CAST(trunc(TRY_CAST(parts[1] AS DOUBLE) * CASE upper(parts[2]) WHEN 'KB' THEN 1024 WHEN 'MB' THEN 1048576
        WHEN 'GB' THEN 1073741824 WHEN 'TB' THEN 1099511627776 ELSE 1 END) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS bytes
    FROM p""",
)
def _(spark, sf):
    return model_inventory(spark, sf).select("model_id", identity.parse_size(F.col("size_text")).alias("bytes"))


@query(
    "param_size",
    f"""WITH {MODEL_INVENTORY_SQL}, p AS (
      SELECT model_id, size_bytes, TRY_CAST(regexp_extract(name, ':([0-9]+[.]?[0-9]*)[bB]', 1) AS DOUBLE) AS shown FROM model_inventory)
    SELECT model_id, CASE WHEN shown < 1 THEN printf('%.0fM', shown * 1000) WHEN shown IS NOT NULL THEN printf('%.1fB', shown)
      WHEN size_bytes / 6.0 < 1e9 THEN printf('%.1fM', size_bytes::DOUBLE / 6 / 1e6) ELSE printf('%.1fB', size_bytes::DOUBLE / 6 / 1e9) END AS params
    FROM p""",
)
def _(spark, sf):
    params = identity.param_size(F.col("name"), F.col("size_bytes"))
    return model_inventory(spark, sf).select("model_id", params.alias("params"))


@query("size_bucket", f"WITH {MODEL_INVENTORY_SQL} SELECT model_id, {_BUCKET_CASE} AS bucket FROM model_inventory")
def _(spark, sf):
    return model_inventory(spark, sf).select("model_id", identity.size_bucket(F.col("size_bytes")).alias("bucket"))


@query(
    "inventory_filter",
    f"""WITH {MODEL_INVENTORY_SQL}, m AS (SELECT model_id, name, size_bytes, {_FAMILY_CASE} AS family, {_QUANT_CASE} AS quantization FROM model_inventory)
    SELECT model_id, name, family, quantization FROM m
    WHERE family IN ('qwen', 'llama') AND quantization IN ('Q4_K_M', 'Q8_0') AND size_bytes >= 9050000000 AND size_bytes <= 10500000000""",
)
def _(spark, sf):
    kept = inventory_filter(
        model_inventory(spark, sf),
        families=["qwen", "llama"],
        quantizations=["Q4_K_M", "Q8_0"],
        min_size=9_050_000_000,
        max_size=10_500_000_000,
    )
    return kept.select("model_id", "name", "family", "quantization")


@query(
    "token_estimate",
    """WITH turns AS (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prompt FROM conversations)
    SELECT conv_id, turn, CAST((length(coalesce(prompt, '')) + length(role)) // 4 AS BIGINT) AS input_tokens,
      CAST(length(text) // 4 AS BIGINT) AS output_tokens FROM turns WHERE role = 'assistant'""",
)
def _(spark, sf):
    from tallymill.operators.compare import with_previous_turn

    turns = with_previous_turn(table(spark, sf, "conversations")).filter(F.col("role") == "assistant")
    return turns.select(
        "conv_id",
        "turn",
        fields.token_estimate(F.col("prompt"), F.col("role")).alias("input_tokens"),
        fields.token_estimate(F.col("text")).alias("output_tokens"),
    )


@query(
    "token_fallback",
    f"""WITH {EVAL_ROWS_SQL}, r AS (
      SELECT run_id, sum(input_tokens) AS si, sum(output_tokens) AS so, count(*) FILTER (WHERE status = 'success') AS ok
      FROM eval_rows GROUP BY run_id),
    d AS (SELECT s_suppkey AS run_id, CASE WHEN s_nationkey % 2 = 0 THEN CAST(floor(s_acctbal) AS BIGINT) ELSE 0 END AS di,
      CASE WHEN s_nationkey % 2 = 0 THEN CAST(floor(s_acctbal) AS BIGINT) * 2 ELSE 0 END AS dout FROM supplier)
    SELECT run_id, CAST(CASE WHEN di = 0 THEN si ELSE di END AS BIGINT) AS total_input_tokens,
      CAST(CASE WHEN di = 0 THEN so ELSE dout END AS BIGINT) AS total_output_tokens,
      round(CASE WHEN di = 0 THEN si ELSE di END / nullif(ok, 0), 6) AS avg_input_tokens,
      round(CASE WHEN di = 0 THEN so ELSE dout END / nullif(ok, 0), 6) AS avg_output_tokens
    FROM r JOIN d USING (run_id)""",
)
def _(spark, sf):
    declared = table(spark, sf, "supplier").selectExpr(
        "s_suppkey as run_id",
        "case when s_nationkey % 2 = 0 then cast(floor(s_acctbal) as bigint) else 0 end as total_input_tokens",
        "case when s_nationkey % 2 = 0 then cast(floor(s_acctbal) as bigint) * 2 else 0 end as total_output_tokens",
    )
    return token_fallback(eval_rows(spark, sf), declared, "run_id")


@query(
    "expected_display",
    """WITH c AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x > 0 AS INT)) AS cells FROM embeddings)
    SELECT vec_id, CASE label % 4
      WHEN 0 THEN array_to_string(cells, ' ') || ' | ' || array_to_string(list_reverse(cells), ' ')
      WHEN 1 THEN array_to_string(cells, ' ') WHEN 2 THEN '0' ELSE 'N/A' END AS expected FROM c""",
)
def _(spark, sf):
    cells = F.transform("embedding", lambda x: (x > 0).cast("int"))
    label = F.col("label") % 4
    params = (
        F.when(label == 0, F.to_json(F.struct(F.array(cells, F.reverse(cells)).alias("expected_next_state"))))
        .when(label == 1, F.to_json(F.struct(cells.alias("expected_state"))))
        .when(label == 2, F.to_json(F.struct(F.lit(0).alias("expected_answer"), F.lit(7).alias("expected_state"))))
        .otherwise(F.to_json(F.struct(F.lit("x").alias("other"))))
    )
    return table(spark, sf, "embeddings").select("vec_id", fields.expected_display(params).alias("expected"))


@query(
    "thinking_split",
    """SELECT conv_id, turn,
      CASE turn % 3 WHEN 0 THEN role || ' thinks' WHEN 1 THEN role END AS thinking,
      CASE turn % 3 WHEN 2 THEN text ELSE regexp_replace(text, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g') END AS clean
    FROM conversations""",
)
def _(spark, sf):
    turn = F.col("turn") % 3
    tagged = F.concat(F.lit("<think> "), F.col("role"), F.lit("\n</think>\n"), F.col("text"))
    raw = F.when(turn == 2, F.col("text")).otherwise(tagged)
    reasoning = F.when(turn == 0, F.concat("role", F.lit(" thinks")))
    split = fields.thinking_split(raw, reasoning)
    return (
        table(spark, sf, "conversations")
        .select("conv_id", "turn", split.alias("s"))
        .select("conv_id", "turn", "s.thinking", "s.clean")
    )


@query(
    "usable_response_filter",
    f"""WITH {RESPONSES_SQL}
    SELECT {KEY_SQL}, raw_response FROM responses WHERE status = 'success' AND raw_response <> ''""",
)
def _(spark, sf):
    usable = fields.is_usable_response(F.col("status"), F.col("raw_response"))
    return responses(spark, sf).filter(usable).select(*ROW_KEY, "raw_response")


@query(
    "perf_band",
    f"""WITH {EVAL_ROWS_SQL}, s AS (
      SELECT run_id, count(*) FILTER (WHERE correct) / nullif(count(*) FILTER (WHERE status = 'success'), 0) AS a FROM eval_rows GROUP BY run_id)
    SELECT run_id, CASE WHEN a >= 0.8 THEN 'success' WHEN a >= 0.5 THEN 'warning' ELSE 'danger' END AS badge,
      CASE WHEN a > 0.7 THEN 'high' WHEN a < 0.3 THEN 'low' ELSE 'med' END AS css_class,
      CASE WHEN a * 100 >= 70 THEN 'green' WHEN a * 100 >= 50 THEN 'orange' ELSE 'red' END AS colour,
      CASE WHEN a * 20 < 5 THEN 'stable' WHEN a * 20 < 10 THEN 'variable' ELSE 'unstable' END AS stability
    FROM s""",
)
def _(spark, sf):
    acc = F.col("accuracy")
    return run_summary(eval_rows(spark, sf), ["run_id"]).select(
        "run_id",
        fields.accuracy_badge(acc).alias("badge"),
        fields.accuracy_class(acc).alias("css_class"),
        fields.accuracy_colour(acc * 100).alias("colour"),
        fields.stability(acc * 20).alias("stability"),
    )


@query(
    "text_normalise",
    r"""SELECT doc_id, md5(lower(regexp_replace(regexp_replace(
        regexp_replace(regexp_replace(regexp_replace(
          translate(text, '‘’“”′″' || chr(160) || chr(8239) || chr(8201) || chr(8203), '''''""''"    '),
        '\*{1,2}|_{1,2}', '', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'), '^ +| +$', '', 'g'),
        '^[.,;:!?"''`]+|[.,;:!?"''`]+$', '', 'g'), '^ +| +$', '', 'g'))) AS normal_md5
    FROM documents""",
)
def _(spark, sf):
    return spread(table(spark, sf, "documents")).select("doc_id", F.md5(text.text_normalise(F.col("text"))).alias("normal_md5"))


@query("json_param", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", fields.json_param(F.col("props"), "k").cast("int").alias("k"))
