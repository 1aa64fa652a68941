"""Answer extraction from free text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.fixtures import RESPONSES_SQL, responses, table
from tallymill.functions import lists, rules, text
from tallymill.functions.cascade import hit
from tallymill.operators.extract import extract, extraction_report
from tallymill.operators.compare import with_previous_turn
from tallymill.plans.registry import query
from tallymill.session import spread

ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
NUM = "[+-]?(?:[0-9]*[.])?[0-9]+"


def sql_all(pattern: str, group: int = 0, source: str = "raw_response") -> str:
    return f"regexp_extract_all({source}, '{pattern}', {group})"


def sql_last(pattern: str, group: int = 0, source: str = "raw_response") -> str:
    return f"list_last({sql_all(pattern, group, source)})"


_TOKENS = sql_all(f"(?i)(?:(?:confident|certain|sure|probability|chance)[ \\t\\n]*)?{NUM}(?:[ \\t\\n]*%)?")
LAST_PLAIN_SQL = (
    f"list_last(list_filter({_TOKENS}, lambda t: NOT t LIKE '%\\%' ESCAPE '\\' "
    "AND NOT regexp_matches(t, '^(?i)(?:confident|certain|sure|probability|chance)')))"
)
_BOXED_SQL = sql_last("boxed[{][ \\t\\n]*(" + NUM + ")[ \\t\\n]*[}]", 1)
# the keyword rule reads the only line of these texts that carries an answer word
_KEYWORD_SQL = (
    "CASE WHEN regexp_matches(lower(raw_response), 'result|answer|response|therefore|\\\\boxed|equals|=|solution:') "
    f"THEN nullif(regexp_extract(raw_response, '{NUM}', 0), '') END"
)
CASCADE_VALUE_SQL = f"coalesce({_BOXED_SQL}, {_KEYWORD_SQL}, {LAST_PLAIN_SQL})"
_CUT = "regexp_replace(raw_response, '(?is)\\n[ \\t]*let me check.*$', '')"


def cut(sql: str) -> str:
    return sql.replace("raw_response", "cut_text")


_CUT_SQL = f"{RESPONSES_SQL}, cut AS (SELECT *, {_CUT} AS cut_text FROM responses)"


@query("last_match", f"WITH {RESPONSES_SQL} SELECT {KEY_SQL}, {sql_last('[0-9]+')} AS number FROM responses")
def _(spark, sf):
    return responses(spark, sf).select(*ROW_KEY, text.last_match(F.col("raw_response"), "[0-9]+").alias("number"))


@query(
    "last_n_matches",
    f"""WITH {RESPONSES_SQL} SELECT {KEY_SQL}, array_to_string(list_slice({sql_all('[0-9]+')}, greatest(len({sql_all('[0-9]+')}) - 1, 1),
      len({sql_all('[0-9]+')})), ',') AS numbers FROM responses""",
)
def _(spark, sf):
    found = text.last_n_matches(F.col("raw_response"), "[0-9]+", 2)
    return responses(spark, sf).select(*ROW_KEY, F.array_join(found, ",").alias("numbers"))


@query(
    "last_sentences",
    r"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g'),
        '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda p: p <> '') AS parts FROM documents)
    SELECT doc_id, len(parts[-3:]) AS n, md5(array_to_string(parts[-3:], '|')) AS sentences_md5 FROM s""",
)
def _(spark, sf):
    last = text.last_sentences(F.col("text"), 3)
    docs = spread(table(spark, sf, "documents")).select("doc_id", last.alias("s"))
    return docs.select("doc_id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join("s", "|")).alias("sentences_md5"))


@query("strip_verification_tail", f"WITH {_CUT_SQL} SELECT {KEY_SQL}, cut_text FROM cut")
def _(spark, sf):
    kept = text.strip_verification_tail(F.col("raw_response"))
    return responses(spark, sf).select(*ROW_KEY, kept.alias("cut_text"))


@query(
    "last_keyword_position",
    """WITH p AS (SELECT doc_id, length(text) AS n, length(text) + 1 - instr(reverse(lower(text)), 'eht') - 3 AS a,
        length(text) + 1 - instr(reverse(lower(text)), 'dna') - 3 AS b,
        contains(lower(text), 'the') AS ha, contains(lower(text), 'and') AS hb FROM documents)
    SELECT doc_id, CAST(greatest(CASE WHEN ha THEN a ELSE -1 END, CASE WHEN hb THEN b ELSE -1 END) AS INT) AS position FROM p""",
)
def _(spark, sf):
    found = text.last_keyword_position(F.col("text"), ["the", "and"])
    return spread(table(spark, sf, "documents")).select("doc_id", found.alias("position"))


@query(
    "last_signal_wins",
    """WITH p AS (SELECT doc_id, CASE WHEN contains(lower(text), 'the') THEN length(text) - instr(reverse(lower(text)), 'eht') ELSE -1 END AS a,
        CASE WHEN contains(lower(text), 'and') THEN length(text) - instr(reverse(lower(text)), 'dna') ELSE -1 END AS b FROM documents)
    SELECT doc_id, CASE WHEN a > b THEN 'first' WHEN b > a THEN 'second' END AS signal FROM p""",
)
def _(spark, sf):
    signal = rules.last_signal_wins(F.col("text"), ["the"], ["and"], ("first", "second"))
    return spread(table(spark, sf, "documents")).select("doc_id", signal.alias("signal"))


def cascade_rows(spark, sf):
    return extract(responses(spark, sf), "arithmetic", "raw_response", strip_tail=True)


_CASCADE_SQL = f"""{_CUT_SQL}, c AS (SELECT *, {cut(_BOXED_SQL)} AS boxed, {cut(_KEYWORD_SQL)} AS keyword, {cut(LAST_PLAIN_SQL)} AS plain FROM cut),
  answers AS (SELECT *, coalesce(boxed, keyword, plain) AS value,
    CASE WHEN boxed IS NOT NULL THEN 'latex_boxed' WHEN keyword IS NOT NULL THEN 'keyword_search' WHEN plain IS NOT NULL THEN 'last_number'
      WHEN raw_response = '' THEN 'empty' ELSE 'failed' END AS strategy,
    CASE WHEN coalesce(boxed, keyword, plain) IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM c)"""


@query("extract_cascade", f"WITH {_CASCADE_SQL} SELECT {KEY_SQL}, value, strategy, confidence FROM answers")
def _(spark, sf):
    out = cascade_rows(spark, sf)
    return out.select(*ROW_KEY, "answer.value", "answer.strategy", "answer.confidence")


@query(
    "extraction_report",
    f"""WITH {_CASCADE_SQL} SELECT task_type, strategy, count(*) AS n, round(avg(confidence), 6) AS mean_confidence,
      count(*) FILTER (WHERE value IS NULL) AS failed, round(count(*) / sum(count(*)) OVER (PARTITION BY task_type), 6) AS share
    FROM answers GROUP BY task_type, strategy""",
)
def _(spark, sf):
    return extraction_report(cascade_rows(spark, sf), ["task_type"])


# Texts for the single strategies, built from the response number and the row's words.
_WRAPS = {
    "boxed": ("concat('x \\\\boxed{7} so \\\\boxed{ ', expected, '.}')", "'x ' || chr(92) || 'boxed{7} so ' || chr(92) || 'boxed{ ' || expected || '.}'"),
    "bold": ("concat('**', expected, '** and **', p_brand, '** for **', expected, '**')", "'**' || expected || '** and **' || p_brand || '** for **' || expected || '**'"),
    "label": ("concat('answer: 1\\nFinal answer: 3;\\nAnswer: ', expected, '.;')", "'answer: 1' || chr(10) || 'Final answer: 3;' || chr(10) || 'Answer: ' || expected || '.;'"),
    "code_block": ("concat('```1``` then ```sql\\n', expected, '\\n```')", "'```1``` then ```sql' || chr(10) || expected || chr(10) || '```'"),
    "quoted": ("concat('say \"one\" or \"', p_brand, ' ', expected, '\"')", "'say \"one\" or \"' || p_brand || ' ' || expected || '\"'"),
    "equals": ("concat('1 + 1 = 2 and x = ', expected)", "'1 + 1 = 2 and x = ' || expected"),
    "is_n_tail": ("concat('It is 4 now.\\nThe total is ', expected, '!')", "'It is 4 now.' || chr(10) || 'The total is ' || expected || '!'"),
    "json_answer": ("concat('{\"q\": 1} {\"answer\": \"', p_brand, '\", \"n\": ', expected, '}')", "'{\"q\": 1} {\"answer\": \"' || p_brand || '\", \"n\": ' || expected || '}'"),
    "last_line": ("concat('First\\nResult: ', p_brand, ' ', expected, '.\\n\\n')", "'First' || chr(10) || 'Result: ' || p_brand || ' ' || expected || '.' || chr(10) || chr(10)"),
}
_STRATEGY_SQL = {
    "boxed": "regexp_replace(trim(list_last(regexp_extract_all(raw, '[\\\\]boxed[{]([^}]+)[}]', 1))), '[.,;!?]+$', '')",
    "bold": "list_last(list_filter(regexp_extract_all(raw, '[*][*]([^*]+)[*][*]', 1), lambda b: NOT regexp_matches(b, '^[0-9,]+$')))",
    "label": "regexp_replace(list_last(regexp_extract_all(raw, '(?i)(?:^|\\n)Answer:[ ]*([^\\n]+)', 1)), '[.,;!]+$', '')",
    "code_block": "trim(list_last(regexp_extract_all(raw, '```(?:[a-z]+)?[ \\n]*([^`]+)[ \\n]*```', 1)), ' ' || chr(10))",
    "quoted": "list_last(regexp_extract_all(raw, '\"([^\"]+)\"', 1))",
    "equals": f"list_last(regexp_extract_all(raw, '=[ ]*({NUM})(?:[ ]|$)', 1))",
    "is_n_tail": "regexp_replace(list_last(regexp_extract_all(raw, '(?im)(?:is|are|=)[ ]+([^ \\n]+)[ ]*[.!]?[ ]*$', 1)), '[.,;:!?)]+$', '')",
    "json_answer": "json_extract_string(list_last(regexp_extract_all(raw, '[{][^{}]*\"answer\"[^{}]*[}]', 0)), '$.answer')",
    "last_line": "regexp_replace(regexp_replace(list_last(list_filter(string_split(raw, chr(10)), lambda s: s <> '')), '^Result:[ ]*', ''), '[.,;!]+$', '')",
}


def _register_strategy(name: str) -> None:
    spark_text, duck_text = _WRAPS[name]
    find = getattr(rules, f"strategy_{name}")

    @query(
        f"strategy_{name}",
        f"WITH {RESPONSES_SQL}, w AS (SELECT {KEY_SQL}, {duck_text} AS raw FROM responses) SELECT {KEY_SQL}, {_STRATEGY_SQL[name]} AS value FROM w",
    )
    def _(spark, sf):
        wrapped = responses(spark, sf).withColumn("raw", F.expr(spark_text))
        return wrapped.select(*ROW_KEY, find(F.col("raw")).alias("value"))


for _name in _WRAPS:
    _register_strategy(_name)


@query("last_number_excluding", f"WITH {RESPONSES_SQL} SELECT {KEY_SQL}, {LAST_PLAIN_SQL} AS number FROM responses")
def _(spark, sf):
    return responses(spark, sf).select(*ROW_KEY, rules.last_number_excluding(F.col("raw_response")).alias("number"))


_WORD_CASE = "CASE w " + " ".join(f"WHEN '{w}' THEN '{n}'" for w, n in rules.vocab.NUMBER_WORDS.items()) + " END"
_WORD_LIST = list(rules.vocab.NUMBER_WORDS)


@query(
    "number_words",
    f"""WITH {RESPONSES_SQL}, x AS (SELECT {KEY_SQL}, list_extract({_WORD_LIST}, CAST(l_quantity AS INT) % {len(_WORD_LIST) + 1} + 1) AS w FROM responses)
    SELECT {KEY_SQL}, {_WORD_CASE} AS number FROM x""",
)
def _(spark, sf):
    names = F.array(*[F.lit(f" {w.title()}. ") for w in _WORD_LIST])
    word = F.get(names, F.expr(f"cast(l_quantity as int) % {len(_WORD_LIST) + 1}"))
    return responses(spark, sf).select(*ROW_KEY, rules.number_words(word).alias("number"))


# Refusal texts: one sentence per line number, the quantity as the figure in it.
_REFUSAL_TEXTS = [
    ("I cannot recommend that dose. Please see a doctor.", "refusal", "first_sentence_refusal", 0.85),
    ("Mix it with water, {q} ml of each.", "compliance", "compliance_quantity", 0.9),
    ("Such a machine would be a contradiction.", "refusal", "impossibility", 0.9),
    ("Be careful with this. The ratio is {q}:1.", "hedge", "hedge_detection", 0.85),
    ("Usually the recipe has many steps.", "compliance", "keyword_scan", 0.55),
    ("The fumes are toxic and harmful.", "refusal", "keyword_scan", 0.6),
    ("What a nice day.", None, "fallback", 0.1),
]
_REFUSAL_CASE_SPARK = (
    "case l_linenumber % 7 "
    + " ".join(f"when {i} then replace('{t}', '{{q}}', expected)" for i, (t, _, _, _) in enumerate(_REFUSAL_TEXTS))
    + " end"
)


@query(
    "classify_refusal",
    f"WITH {RESPONSES_SQL} SELECT {KEY_SQL}, CASE l_linenumber % 7 "
    + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, (_, v, _, _) in enumerate(_REFUSAL_TEXTS))
    + " END AS value, CASE l_linenumber % 7 "
    + " ".join(f"WHEN {i} THEN '{s}'" for i, (_, _, s, _) in enumerate(_REFUSAL_TEXTS))
    + " END AS strategy, CASE l_linenumber % 7 "
    + " ".join(f"WHEN {i} THEN {c}::DOUBLE" for i, (_, _, _, c) in enumerate(_REFUSAL_TEXTS))
    + " END AS confidence FROM responses",
)
def _(spark, sf):
    rows = responses(spark, sf).withColumn("raw", F.expr(_REFUSAL_CASE_SPARK))
    return extract(rows, "false_premise", "raw").select(*ROW_KEY, "answer.value", "answer.strategy", "answer.confidence")


@query(
    "yes_no_pair",
    f"""WITH {RESPONSES_SQL} SELECT {KEY_SQL}, CASE l_linenumber % 7 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' WHEN 2 THEN 'no' WHEN 3 THEN 'no'
        WHEN 4 THEN 'yes' WHEN 5 THEN 'no' END AS first, CASE l_linenumber % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'yes' WHEN 3 THEN 'yes' END AS second,
      CASE l_linenumber % 7 WHEN 0 THEN 'numbered' WHEN 1 THEN 'labelled' WHEN 2 THEN 'bare_yesno' WHEN 3 THEN 'keyword_inference'
        WHEN 4 THEN 'partial_q1' WHEN 5 THEN 'partial_q1' ELSE 'empty' END AS strategy FROM responses""",
)
def _(spark, sf):
    raw = F.expr(
        """case l_linenumber % 7 when 0 then concat('1. No, ', p_brand, '\n2. **Yes**') when 1 then 'Attribution: Yes. Sentiment: no'
           when 2 then 'Well\n**No**\nYes.' when 3 then concat('It was never said. ', expected, ' times I agree with it')
           when 4 then concat('Yes ', expected) when 5 then raw_response else '' end"""
    )
    out = extract(responses(spark, sf).withColumn("raw", raw), "misquote", "raw")
    return out.select(*ROW_KEY, F.col("answer.value").alias("first"), F.col("answer.second").alias("second"), "answer.strategy")


_ITEMS = [
    "{b} is a bank teller",
    "Linda likes {q} books",
    "{b} is a bank teller",
    "She works in the city",
    "She runs shop number {q}",
    "A teller and a writer",
    "Nobody knows her name",
]


@query(
    "extract_ranking",
    f"""WITH {RESPONSES_SQL}, i AS (SELECT *, [{', '.join("replace(replace('" + t + "', '{b}', p_brand), '{q}', expected)" for t in _ITEMS)}] AS said FROM responses)
    SELECT {KEY_SQL}, CASE WHEN l_linenumber % 2 = 0 THEN array_to_string(list_filter(said, lambda s, i: i <> 3), '|') END AS items,
      CASE WHEN l_linenumber % 2 = 0 THEN 'numbered_list_fallback' ELSE 'failed' END AS strategy FROM i""",
)
def _(spark, sf):
    lines = [
        F.concat(F.lit(f"{i + 1}. **"), F.expr(f"replace(replace('{t}', '{{b}}', p_brand), '{{q}}', expected)"), F.lit("** (likely)\n"))
        for i, t in enumerate(_ITEMS)
    ]
    raw = F.when(F.expr("l_linenumber % 2 = 0"), F.concat(*lines)).otherwise(F.col("raw_response"))
    out = extract(responses(spark, sf).withColumn("raw", raw), "linda_fallacy", "raw")
    return out.select(*ROW_KEY, F.array_join("answer.items", "|").alias("items"), "answer.strategy")


@query(
    "extract_grid",
    """WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x > 0 AS INT)) AS c FROM embeddings)
    SELECT vec_id, array_to_string(list_transform(range(1, len(c) + 1, 8), lambda i: array_to_string(c[i:i + 7], '')), '/') AS grid,
      'line_scan_reverse' AS strategy FROM c""",
)
def _(spark, sf):
    """All cells of a vector as a grid of eight columns, after a smaller grid that is not the answer."""
    cells = F.transform("embedding", lambda x: (x > 0).cast("int"))
    docs = table(spark, sf, "embeddings").select("vec_id", cells.alias("c"))
    docs = docs.withColumn("r", F.transform(F.sequence(F.lit(1), F.size("c"), F.lit(8)), lambda i: F.array_join(F.slice("c", i, 8), " ")))
    raw = F.concat(F.lit("Start:\n"), F.get("r", 0), F.lit("\nStep one gives 3\n"), F.array_join("r", "\n"), F.lit("\nDone."))
    out = extract(docs.withColumn("raw", raw), "game_of_life", "raw", {"rows": F.size("r"), "cols": F.lit(8)})
    joined = F.array_join(F.transform("answer.grid", lambda r: F.array_join(r.cast("array<string>"), "")), "/")
    return out.select("vec_id", joined.alias("grid"), "answer.strategy")


@query(
    "extract_cells",
    """WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x > 0 AS INT)) AS c FROM embeddings)
    SELECT vec_id, array_to_string(c, '') AS cells, 'marker_search' AS strategy FROM c""",
)
def _(spark, sf):
    cells = F.transform("embedding", lambda x: (x > 0).cast("int"))
    docs = table(spark, sf, "embeddings").select("vec_id", cells.alias("c"))
    raw = F.concat(F.lit("From 0 0 1.\nNext state: "), F.array_join("c", " "), F.lit("\n"))
    out = extract(docs.withColumn("raw", raw), "cellular_automata_1d", "raw", {"width": F.size("c")})
    return out.select("vec_id", F.array_join(F.col("answer.cells").cast("array<string>"), "").alias("cells"), "answer.strategy")


@query(
    "value_unit_match",
    f"""WITH {RESPONSES_SQL} SELECT {KEY_SQL}, CASE l_linenumber % 6 WHEN 0 THEN expected || ' kg' WHEN 1 THEN '77 g' WHEN 2 THEN 'equal'
        WHEN 3 THEN 'incomparable' WHEN 4 THEN expected || ' kg' END AS value,
      CASE l_linenumber % 6 WHEN 0 THEN 'bold' WHEN 1 THEN 'value_unit_comparative' WHEN 2 THEN 'keyword_equal' WHEN 3 THEN 'keyword_incomparable'
        WHEN 4 THEN 'value_unit_match' ELSE 'fallback' END AS strategy FROM responses""",
)
def _(spark, sf):
    raw = F.expr(
        """case l_linenumber % 6 when 0 then concat('I pick **', expected, ' kilograms** here') when 1 then '77 g is lighter'
           when 2 then 'They are the same.' when 3 then 'You cannot compare these' when 4 then concat('So ', expected, ' kg beats 77 g')
           else 'no idea' end"""
    )
    params = {"value1": F.col("expected"), "unit1_symbol": F.lit("kg"), "value2": F.lit("77"), "unit2_symbol": F.lit("g")}
    out = extract(responses(spark, sf).withColumn("raw", raw), "measure_comparison", "raw", params)
    return out.select(*ROW_KEY, "answer.value", "answer.strategy")
