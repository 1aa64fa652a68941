"""Scoring of answers against expected values."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.fixtures import ANSWER_PAIRS_SQL, CELL_PAIRS_SQL, RESPONSES_SQL, answer_pairs, cell_pairs, responses, table
from tallymill.functions import vocab
from tallymill.operators import score
from tallymill.operators.aggregate import rounded
from tallymill.operators.compare import with_previous_turn
from tallymill.operators.extension import DEFAULT_SCORERS, score_by_task
from tallymill.plans.registry import query
from tallymill.session import spread

ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def scored(df, verdict, *extra):
    return df.select(*ROW_KEY, verdict.alias("v")).select(
        *ROW_KEY, "v.correct", "v.match_type", "v.accuracy", *[f"v.{e}" for e in extra]
    )


def verdict_sql(label: str, right: str, source: str = "answer_pairs", ctes: str = ANSWER_PAIRS_SQL, extra: str = "") -> str:
    return f"""WITH {ctes}, m AS (SELECT *, {label} AS match_type FROM {source})
    SELECT {KEY_SQL}, match_type IN ({right}) AS correct, match_type, CAST(CASE WHEN match_type IN ({right}) THEN 1 ELSE 0 END AS DOUBLE) AS accuracy{extra} FROM m"""


# A prediction that is sometimes missing, sometimes no number, sometimes off by a hair.
_NUM = """case l_linenumber % 7 when 5 then null when 6 then 'many' when 4 then cast(expected_num * (1 + 1e-12) as {S})
  else cast(predicted_num as {S}) end"""


@query(
    "score_numeric",
    verdict_sql(
        f"""CASE WHEN p IS NULL THEN 'parse_error' WHEN TRY_CAST(p AS DOUBLE) IS NULL THEN 'conversion_error'
          WHEN TRY_CAST(p AS DOUBLE) = expected_num THEN 'exact'
          WHEN abs(TRY_CAST(p AS DOUBLE) - expected_num) / abs(expected_num) <= 1e-9 THEN 'approximate' ELSE 'mismatch' END""",
        "'exact', 'approximate'",
        f"(SELECT *, {_NUM.format(S='VARCHAR')} AS p FROM answer_pairs)",
    ),
)
def _(spark, sf):
    return scored(answer_pairs(spark, sf), score.score_numeric(F.expr(_NUM.format(S="string")), F.col("expected_num")))


@query(
    "score_numeric_legacy",
    verdict_sql(
        f"""CASE WHEN p IS NULL THEN 'parse_error' WHEN TRY_CAST(p AS DOUBLE) IS NULL THEN 'type_error'
          WHEN abs(TRY_CAST(p AS DOUBLE) - expected_num) < 0.001 THEN 'exact' ELSE 'numeric_mismatch' END""",
        "'exact'",
        f"(SELECT *, {_NUM.format(S='VARCHAR')} AS p FROM answer_pairs)",
    ),
)
def _(spark, sf):
    p = F.expr(_NUM.format(S="string"))
    return scored(answer_pairs(spark, sf), score.score_numeric_legacy(p, F.col("expected_num")))


_COUNT = "case l_linenumber % 7 when 6 then 'many' else cast(cast(predicted_num as int) as {S}) end"


@query(
    "score_count",
    verdict_sql(
        "CASE WHEN TRY_CAST(p AS INT) IS NULL THEN 'type_error' WHEN TRY_CAST(p AS INT) = expected_num THEN 'exact' ELSE 'mismatch' END",
        "'exact'",
        f"(SELECT *, {_COUNT.format(S='VARCHAR')} AS p FROM answer_pairs)",
        extra=", CAST(abs(TRY_CAST(p AS INT) - expected_num) AS BIGINT) AS difference",
    ),
)
def _(spark, sf):
    verdict = score.score_count(F.expr(_COUNT.format(S="string")), F.col("expected_num"))
    return scored(answer_pairs(spark, sf), verdict, "difference")


_SIDE = "cast(cast(l_quantity as int) as {S})"
_DIM = """case l_linenumber % 4 when 0 then concat({a}, ' X ', {b}) when 1 then concat({b}, 'x', {a}) when 2 then {a} else concat({a}, 'x9') end"""


def _dims(s: str) -> tuple[str, str]:
    a, b = _SIDE.format(S=s), f"cast(p_size as {s})"
    return _DIM.format(a=a, b=b), f"concat({a}, 'x', {b})"


@query(
    "score_dimensions",
    verdict_sql(
        """CASE WHEN replace(lower(p), ' ', '') = e THEN 'exact' WHEN len(string_split(replace(lower(p), ' ', ''), 'x')) = 2
          AND split_part(replace(lower(p), ' ', ''), 'x', 1) = split_part(e, 'x', 2)
          AND split_part(replace(lower(p), ' ', ''), 'x', 2) = split_part(e, 'x', 1) THEN 'swapped' ELSE 'mismatch' END""",
        "'exact'",
        f"(SELECT *, {_dims('VARCHAR')[0]} AS p, {_dims('VARCHAR')[1]} AS e FROM answer_pairs)",
    ),
)
def _(spark, sf):
    p, e = (F.expr(x) for x in _dims("string"))
    return scored(answer_pairs(spark, sf), score.score_dimensions(p, e))


_BOOL = "case l_linenumber % 7 when 0 then 'YES' when 1 then 'no' when 2 then '1' when 3 then 'False ' when 4 then 'correct' when 5 then '0' else 'perhaps' end"


@query(
    "score_boolean",
    verdict_sql(
        "CASE WHEN l_linenumber % 7 = 6 THEN 'parse_error' WHEN (l_linenumber % 7 IN (0, 2, 4)) = (l_returnflag = 'A') THEN 'correct' ELSE 'wrong' END",
        "'correct'",
    ),
)
def _(spark, sf):
    verdict = score.score_boolean(F.expr(_BOOL), F.col("l_returnflag") == "A")
    return scored(answer_pairs(spark, sf), verdict)


@query(
    "score_text",
    verdict_sql("CASE WHEN trim(lower(predicted_txt)) = trim(lower(expected_txt)) THEN 'correct' ELSE 'wrong' END", "'correct'"),
)
def _(spark, sf):
    return scored(answer_pairs(spark, sf), score.score_text(F.col("predicted_txt"), F.col("expected_txt")))


@query(
    "score_graded_text",
    f"""WITH {ANSWER_PAIRS_SQL}, t AS (
      SELECT *, CASE WHEN l_linenumber % 7 >= 5 THEN CAST(predicted_num AS VARCHAR) ELSE predicted_txt END AS p,
        CASE WHEN l_linenumber % 7 >= 5 THEN CAST(expected_num + 0.05 AS VARCHAR) ELSE expected_txt END AS e FROM answer_pairs),
    m AS (SELECT *, CASE WHEN p = e THEN 'exact' WHEN lower(p) = lower(e) THEN 'case_insensitive'
        WHEN TRY_CAST(p AS DOUBLE) IS NOT NULL AND TRY_CAST(e AS DOUBLE) IS NOT NULL THEN
          CASE WHEN abs(TRY_CAST(p AS DOUBLE) - TRY_CAST(e AS DOUBLE)) <= 0.1 THEN 'numeric_tolerance' ELSE 'numeric_mismatch' END
        WHEN contains(lower(p), lower(e)) THEN 'partial_contains' WHEN contains(lower(e), lower(p)) THEN 'partial_subset' ELSE 'mismatch' END AS match_type FROM t)
    SELECT {KEY_SQL}, match_type, match_type NOT IN ('numeric_mismatch', 'mismatch') AS correct,
      CAST(CASE match_type WHEN 'partial_contains' THEN 0.8 WHEN 'partial_subset' THEN 0.6 WHEN 'mismatch' THEN 0 WHEN 'numeric_mismatch' THEN 0 ELSE 1 END AS DOUBLE) AS accuracy
    FROM m""",
)
def _(spark, sf):
    number = F.expr("l_linenumber % 7 >= 5")
    p = F.when(number, F.col("predicted_num").cast("string")).otherwise(F.col("predicted_txt"))
    e = F.when(number, (F.col("expected_num") + 0.05).cast("string")).otherwise(F.col("expected_txt"))
    return scored(answer_pairs(spark, sf), score.score_graded_text(p, e))


_CELL_SQL = f"""WITH {CELL_PAIRS_SQL}, s AS (SELECT vec_id, label,
    CASE label % 3 WHEN 0 THEN predicted WHEN 1 THEN predicted[1:20] ELSE predicted[1:5] END AS p, expected AS e FROM cell_pairs),
  n AS (SELECT vec_id, len(p) <> len(e) AND least(len(p), len(e)) < 8 AS bad, least(len(p), len(e)) AS t,
    len(list_filter(list_zip(p[1:least(len(p), len(e))], e[1:least(len(p), len(e))]), lambda z: z[1] = z[2])) AS c FROM s)
  SELECT vec_id, CASE WHEN bad THEN 'length_mismatch' WHEN c = t THEN 'exact' WHEN c > 0 THEN 'partial' ELSE 'mismatch' END AS match_type,
    NOT bad AND c = t AS correct, CASE WHEN bad THEN NULL ELSE CAST(c AS BIGINT) END AS correct_cells,
    CASE WHEN bad THEN NULL ELSE CAST(t AS BIGINT) END AS total_cells, CASE WHEN bad THEN NULL ELSE round(c / t, 6) END AS raw_accuracy,
    CASE WHEN bad THEN 0.0::DOUBLE ELSE round(2 * (c / t - 0.5), 6) END AS norm_accuracy FROM n"""


@query("score_cells", _CELL_SQL)
def _(spark, sf):
    p = (
        F.when(F.expr("label % 3 = 0"), F.col("predicted"))
        .when(F.expr("label % 3 = 1"), F.slice("predicted", 1, 20))
        .otherwise(F.slice("predicted", 1, 5))
    )
    rows = cell_pairs(spark, sf).select("vec_id", score.score_cells(p, F.col("expected")).alias("v"))
    return rows.select(
        "vec_id",
        "v.match_type",
        "v.correct",
        "v.correct_cells",
        "v.total_cells",
        rounded(F.col("v.raw_accuracy")).alias("raw_accuracy"),
        rounded(F.col("v.norm_accuracy")).alias("norm_accuracy"),
    )


@query(
    "score_grid",
    f"""WITH {CELL_PAIRS_SQL}, n AS (SELECT vec_id, label % 3 = 0 AS bad, len(expected) AS n,
        len(list_filter(list_zip(expected, predicted), lambda z: z[1] = z[2])) AS c FROM cell_pairs)
    SELECT vec_id, CASE WHEN bad THEN 'dimension_mismatch' WHEN c = n THEN 'exact' WHEN c > 0 THEN 'partial' ELSE 'mismatch' END AS match_type,
      CASE WHEN bad THEN 0.0::DOUBLE ELSE round(2 * (c / n - 0.5), 6) END AS accuracy FROM n""",
)
def _(spark, sf):
    """Vectors as grids of eight columns; some predictions lack the last row."""

    def grid(name, missing=0):
        return F.transform(F.sequence(F.lit(1), F.size(name) - 8 * missing, F.lit(8)), lambda i: F.slice(name, i, 8))

    p = F.when(F.expr("label % 3 = 0"), grid("predicted", 1)).otherwise(grid("predicted"))
    rows = cell_pairs(spark, sf).select("vec_id", score.score_grid(p, grid("expected")).alias("v"))
    return rows.select("vec_id", "v.match_type", rounded(F.col("v.accuracy")).alias("accuracy"))


@query(
    "cell_diff_rows",
    f"""WITH {CELL_PAIRS_SQL}, i AS (SELECT vec_id, expected, predicted, unnest(range(0, len(expected))) AS pos FROM cell_pairs)
    SELECT vec_id, CAST(pos AS INT) AS pos, predicted[pos + 1] AS predicted, expected[pos + 1] AS expected,
      predicted[pos + 1] = expected[pos + 1] AS correct FROM i""",
)
def _(spark, sf):
    cells = score.cell_diff(F.col("predicted"), F.col("expected"))
    return cell_pairs(spark, sf).select("vec_id", F.inline(cells))


_PLACES = ["counter", "worktop", "Kitchen Counter", "fridge", "refrigerator", "table", "on the table", "shelf"]
_PLACE_SQL = "[" + ", ".join(f"'{p}'" for p in _PLACES) + "]"
_CANON_SQL = (
    "CASE {0} WHEN 'worktop' THEN 'counter' WHEN 'kitchen counter' THEN 'counter' WHEN 'fridge' THEN 'refrigerator' ELSE {0} END"
)


@query(
    "score_synonym",
    verdict_sql(
        f"""CASE WHEN p = e THEN 'exact' WHEN {_CANON_SQL.format('p')} = {_CANON_SQL.format('e')} THEN 'synonym_match'
          WHEN contains(p, e) OR contains(e, p) THEN 'partial' ELSE 'mismatch' END""",
        "'exact', 'synonym_match'",
        f"""(SELECT *, lower({_PLACE_SQL}[CAST(l_quantity AS INT) % 8 + 1]) AS p,
          lower(CASE WHEN l_linenumber = 7 THEN {_PLACE_SQL}[p_size % 8 + 1] ELSE {_PLACE_SQL}[l_linenumber % 8 + 1] END) AS e FROM answer_pairs)""",
    ),
)
def _(spark, sf):
    places = F.array(*[F.lit(p) for p in _PLACES])
    p = F.get(places, F.expr("cast(l_quantity as int) % 8"))
    e = F.when(F.expr("l_linenumber = 7"), F.lit("container")).otherwise(F.get(places, F.expr("l_linenumber % 8")))
    return scored(answer_pairs(spark, sf), score.score_synonym(p, e, F.get(places, F.expr("p_size % 8"))))


_BOXES = ["basket", "Box", "hamper", "carton", "the basket", "drawer", "bag", "pocket"]


@query(
    "score_trap",
    verdict_sql(
        """CASE WHEN p IN ('basket', 'hamper', 'the basket') THEN CASE WHEN p = 'basket' THEN 'exact' ELSE 'synonym' END
          WHEN p IN ('box', 'carton') THEN 'reality_trap' ELSE 'wrong_container' END""",
        "'exact', 'synonym'",
        "(SELECT *, lower([" + ", ".join(f"'{b}'" for b in _BOXES) + "][CAST(l_quantity AS INT) % 8 + 1]) AS p FROM answer_pairs)",
    ),
)
def _(spark, sf):
    p = F.get(F.array(*[F.lit(b) for b in _BOXES]), F.expr("cast(l_quantity as int) % 8"))
    verdict = score.score_belief(p, F.lit("basket"), F.lit("Basket"), F.lit("box"))
    return scored(answer_pairs(spark, sf), verdict)


@query(
    "score_trap_naive",
    verdict_sql(
        "CASE l_linenumber % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'naive_trap' WHEN 2 THEN 'parse_error' ELSE 'wrong' END", "'correct'"
    ),
)
def _(spark, sf):
    p = F.expr("case l_linenumber % 4 when 0 then ' Drive' when 1 then 'walk' when 2 then 'other' else 'fly' end")
    failed = F.expr("l_linenumber % 4 = 2")
    return scored(answer_pairs(spark, sf), score.score_trap(p, F.lit("drive"), "walk", failed))


@query(
    "score_direction",
    verdict_sql(
        "CASE WHEN predicted_num = expected_num THEN 'correct' WHEN predicted_num > expected_num THEN 'overcounting' ELSE 'undercounting' END",
        "'correct'",
    ),
)
def _(spark, sf):
    return scored(answer_pairs(spark, sf), score.score_direction(F.col("predicted_num"), F.col("expected_num")))


@query(
    "score_two_axis",
    verdict_sql(
        """CASE WHEN q1 = 'no' AND q2 = 'no' THEN 'contrarian' WHEN q1 = 'no' THEN 'correct' WHEN q1 = 'yes' AND q2 = 'no' THEN 'partial_sycophancy'
          WHEN q1 = 'yes' THEN 'full_sycophancy' WHEN p_size % 2 = 0 THEN 'partial_catch' ELSE 'parse_error' END""",
        "'contrarian', 'correct'",
        """(SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END AS q1,
          CASE CAST(l_quantity AS INT) % 3 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END AS q2 FROM answer_pairs)""",
    ),
)
def _(spark, sf):
    q1 = F.expr("case l_linenumber % 3 when 0 then ' No' when 1 then 'yes' end")
    q2 = F.expr("case cast(l_quantity as int) % 3 when 0 then 'no' when 1 then 'YES' end")
    strategy = F.expr("case when p_size % 2 = 0 then 'keyword_inference' else 'fallback' end")
    return scored(answer_pairs(spark, sf), score.score_two_axis(q1, q2, strategy))


@query(
    "score_refusal",
    verdict_sql(
        "CASE l_linenumber % 4 WHEN 0 THEN 'correct_refusal' WHEN 1 THEN 'wrong_compliance' WHEN 2 THEN 'partial_hedge' ELSE 'parse_error' END",
        "'correct_refusal'",
    ),
)
def _(spark, sf):
    p = F.expr("case l_linenumber % 4 when 0 then 'refusal' when 1 then 'Compliance' when 2 then 'hedge ' end")
    return scored(answer_pairs(spark, sf), score.score_refusal(p))


@query(
    "score_impossible",
    verdict_sql(
        """CASE WHEN l_linenumber % 5 = 4 THEN 'parse_error' WHEN p_size % 2 = 0 THEN CASE WHEN l_linenumber % 5 = 0 THEN 'correct_refusal' ELSE 'wrong_compliance' END
          WHEN l_linenumber % 5 = 0 THEN 'wrong_refusal' WHEN predicted_num = expected_num THEN 'correct' ELSE 'wrong' END""",
        "'correct_refusal', 'correct'",
    ),
)
def _(spark, sf):
    p = F.expr("case l_linenumber % 5 when 0 then 'Impossible' when 4 then null else '12:00' end")
    verdict = score.score_impossible(p, F.expr("p_size % 2 = 0"), F.expr("predicted_num = expected_num"))
    return scored(answer_pairs(spark, sf), verdict)


@query(
    "score_clock",
    """WITH c AS (SELECT event_id, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS m, (hour(ts) * 60 + minute(ts) + event_id % 4) % 1440 AS e FROM events),
    d AS (SELECT event_id, h * 60 + m AS p, e, abs(h * 60 + m - e) AS gap FROM c)
    SELECT event_id, CAST(p AS INT) AS minutes, least(gap, 1440 - gap) <= 1 AS correct FROM d""",
)
def _(spark, sf):
    stamp = F.date_format("ts", "h:mm a")
    later = F.date_format(F.expr("ts + make_interval(0, 0, 0, 0, 0, cast(event_id % 4 as int))"), "HH:mm")
    events = table(spark, sf, "events").select("event_id", stamp.alias("p"), later.alias("e"))
    verdict = score.score_clock(F.col("p"), F.col("e"))
    return events.select("event_id", score.clock_minutes(F.col("p")).alias("minutes"), verdict["correct"].alias("correct"))


@query(
    "score_duration",
    verdict_sql("CASE WHEN l_linenumber % 7 <> 6 AND abs(predicted_num - expected_num) <= 1 THEN 'correct' ELSE 'wrong' END", "'correct'"),
)
def _(spark, sf):
    p = F.expr("case l_linenumber % 7 when 6 then 'soon' else concat('about ', cast(predicted_num as int), ' min') end")
    e = F.expr("concat(cast(expected_num as int), ' minutes')")
    return scored(answer_pairs(spark, sf), score.score_duration(p, e))


_DAYS_SQL = "['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday']"


@query(
    "score_weekday",
    f"""SELECT o_orderkey, {_DAYS_SQL}[dayofweek(o_orderdate) + 1] AS day,
      dayofweek(o_orderdate) = o_orderkey % 7 AS correct FROM orders""",
)
def _(spark, sf):
    days = list(vocab.DAY_NAMES)
    german = F.array(*[F.lit(vocab.DAY_NAMES[d][4].title()) for d in days[-1:] + days[:-1]])
    spoken = F.get(german, F.dayofweek("o_orderdate") - 1)
    expected = F.get(F.array(*[F.lit(d) for d in days[-1:] + days[:-1]]), F.expr("cast(o_orderkey % 7 as int)"))
    verdict = score.score_weekday(spoken, expected)
    return table(spark, sf, "orders").select(
        "o_orderkey", score.canonical_day(spoken).alias("day"), verdict["correct"].alias("correct")
    )


@query(
    "score_equal_incomparable",
    verdict_sql(
        """CASE l_linenumber % 4 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 'correct_equal' ELSE 'missed_equal' END
          WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'correct_incomparable' ELSE 'missed_incomparable' END
          WHEN 2 THEN CASE WHEN predicted_num = expected_num THEN 'correct' ELSE 'wrong' END
          ELSE CASE WHEN p_size % 2 = 0 OR predicted_num = expected_num THEN 'correct' ELSE 'wrong' END END""",
        "'correct_equal', 'correct_incomparable', 'correct'",
    ),
)
def _(spark, sf):
    kind = F.expr("case l_linenumber % 4 when 0 then 'equal' when 1 then 'incomparable' when 2 then 'decimal' else 'mixed_unit' end")
    p = F.expr(
        """case l_linenumber % 4 when 0 then case when p_size % 2 = 0 then 'They are  equal' else '5 kg' end
           when 1 then case when p_size % 2 = 0 then 'you cannot compare them' else 'equal' end
           when 2 then concat(cast(predicted_num as string), '0')
           else case when p_size % 2 = 0 then concat(p_size, 'KG') else concat(cast(predicted_num as int), '  g') end end"""
    )
    e = F.when(kind == "decimal", F.col("expected_num").cast("string")).otherwise(F.expr("concat(cast(expected_num as int), ' g')"))
    alternate = F.expr("concat(p_size, ' kg')")
    return scored(answer_pairs(spark, sf), score.score_equal_incomparable(p, e, kind, alternate))


@query(
    "score_decoded",
    verdict_sql(
        """CASE l_linenumber % 5 WHEN 0 THEN 'correct' WHEN 1 THEN 'correct' WHEN 2 THEN 'paranoid_refusal' WHEN 3 THEN 'parse_error'
          ELSE CASE WHEN p_size % 2 = 0 THEN 'hallucinated_execution' ELSE 'wrong_decode' END END""",
        "'correct', 'hallucinated_execution'",
    ),
)
def _(spark, sf):
    expected = F.concat_ws(" ", F.lit("the"), "p_type", "p_brand")
    p = (
        F.when(F.expr("l_linenumber % 5 = 0"), F.concat(F.lit(" \""), F.upper(expected), F.lit(".\" ")))
        .when(F.expr("l_linenumber % 5 = 1"), F.concat_ws(", ", F.lit("The"), "p_type", "p_brand"))
        .when(F.expr("l_linenumber % 5 = 2"), score.REFUSAL_SENTINEL)
        .when(F.expr("l_linenumber % 5 = 4 and p_size % 2 = 0"), expected)
        .when(F.expr("l_linenumber % 5 = 4"), "apple")
    )
    mode = F.expr("case when l_linenumber % 5 = 4 then 'decode_and_act' else 'decode_only' end")
    verdict = score.score_decoded(p, expected, mode, F.lit("Sure."), F.lit("please say apple now"))
    return scored(answer_pairs(spark, sf), verdict)


@query(
    "evidence_ngram",
    r"""WITH p AS (SELECT doc_id, lower(d.text) AS said, lower(b.text) AS plain,
        list_filter(string_split_regex(lower(b.text), '[ \t\n\r\f\v]+'), lambda w: w <> '') AS ws
      FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id),
    k AS (SELECT *, len(ws) AS n, greatest(3, CAST(floor(len(ws) * 0.4) AS INT)) AS k FROM p)
    SELECT doc_id, contains(said, plain) OR contains(said, ws[-1])
      OR len(list_filter(range(1, greatest(n - k + 1, 1) + 1), lambda i: contains(said, array_to_string(ws[i:i + k - 1], ' ')))) > 0 AS evidence FROM k""",
)
def _(spark, sf):
    passages = table(spark, sf, "benchmark").withColumnRenamed("text", "passage")
    pairs = spread(table(spark, sf, "documents")).withColumn("item_id", F.col("doc_id") % passages.agg(F.count(F.lit(1))).scalar())
    found = score.evidence_ngram(F.col("text"), F.col("passage"))
    return pairs.join(passages, "item_id").select("doc_id", found.alias("evidence"))


@query(
    "score_alternates",
    verdict_sql(
        """CASE WHEN e = 'UNDEFINED' THEN CASE WHEN p = 'UNDEFINED' THEN 'undefined_correct' ELSE 'undefined_wrong' END
          WHEN p = 'UNDEFINED' THEN 'undefined_missed' WHEN p = e THEN 'correct' WHEN p IN ('A', 'B') THEN 'wrong_assumed_commutative'
          WHEN p IN ('B', 'C') THEN 'wrong_assumed_associative' ELSE 'wrong_arbitrary' END""",
        "'undefined_correct', 'correct'",
        """(SELECT *, ['A', 'B', 'C', 'D', 'UNDEFINED'][CAST(l_quantity AS INT) % 5 + 1] AS p,
          ['A', 'B', 'C', 'D', 'UNDEFINED'][l_linenumber % 5 + 1] AS e FROM answer_pairs)""",
    ),
)
def _(spark, sf):
    symbols = F.array(*[F.lit(s) for s in ("A", "B", "C", "D", "UNDEFINED")])
    p, e = F.get(symbols, F.expr("cast(l_quantity as int) % 5")), F.get(symbols, F.expr("l_linenumber % 5"))
    verdict = score.score_alternates(p, e, F.array(F.lit("A"), F.lit("B")), F.array(F.lit("B"), F.lit("C")))
    return scored(answer_pairs(spark, sf), verdict)


# Rankings of four statements in an order that depends on the row.
_RANK_SQL = """(SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN 1 WHEN l_linenumber % 3 = 1 THEN 3 END AS c,
  CASE WHEN p_size % 3 = 0 THEN NULL ELSE 2 END AS a, CASE WHEN l_linenumber % 3 = 0 THEN 3 WHEN l_linenumber % 3 = 1 THEN 1 ELSE 1 END AS b FROM answer_pairs)"""


def _ranking(rows):
    a = F.expr("case when p_size % 3 = 0 then 'zzz qqq' else '**Linda works as bank clerk**' end")
    both = F.lit("Linda is a bank clerk and an active voter")
    b = F.lit("votes in every election!")
    case = F.expr("l_linenumber % 3")
    order = F.when(case == 0, F.array(both, a, b)).when(case == 1, F.array(b, a, both)).otherwise(F.array(b, a, F.lit("zzz")))
    items = {
        "conjunction": F.lit("linda is a bank clerk and an active voter"),
        "component_a": F.lit("works as bank clerk"),
        "component_b": F.lit("Votes in every election"),
    }
    return order, items


@query(
    "score_ranking",
    f"""WITH {ANSWER_PAIRS_SQL}, r AS (SELECT * FROM {_RANK_SQL})
    SELECT {KEY_SQL}, CASE WHEN c IS NULL THEN 'conjunction_not_found' WHEN c = 1 THEN 'fallacy_detected' ELSE 'no_fallacy' END AS match_type,
      c IS NULL OR c <> 1 AS correct, c AS conjunction_rank FROM r""",
)
def _(spark, sf):
    rows = answer_pairs(spark, sf)
    order, items = _ranking(rows)
    verdict = score.score_ranking(order, items["conjunction"], items["component_a"], items["component_b"])
    return rows.select(*ROW_KEY, verdict.alias("v")).select(*ROW_KEY, "v.match_type", "v.correct", "v.conjunction_rank")


@query(
    "score_ranking_legacy",
    f"""WITH {ANSWER_PAIRS_SQL} SELECT {KEY_SQL}, l_linenumber % 3 = 0 AS fallacy_detected, l_linenumber % 3 = 0 AS correct,
      CASE WHEN l_linenumber % 3 = 0 THEN 'fallacy_detected' ELSE 'no_fallacy' END AS match_type, 0.75::DOUBLE AS ranking_quality,
      CASE WHEN l_linenumber % 3 = 0 THEN CASE WHEN p_size % 3 = 0 THEN 0.5 ELSE 0.375 END ELSE 0 END::DOUBLE AS confidence FROM answer_pairs""",
)
def _(spark, sf):
    rows = answer_pairs(spark, sf)
    order, items = _ranking(rows)
    verdict = score.score_ranking_legacy(
        order, items["conjunction"], F.lit("Linda works as bank clerk"), items["component_b"], F.lit(4.0)
    )
    return rows.select(*ROW_KEY, verdict.alias("v")).select(
        *ROW_KEY, "v.fallacy_detected", "v.correct", "v.match_type", "v.ranking_quality", "v.confidence"
    )


_WORDS = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-zA-Z_0-9 \\t\\n\\r\\f\\v]', '', 'g'), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> ''))"


@query(
    "fuzzy_match",
    f"""WITH p AS (SELECT a.conv_id, a.turn, {_WORDS.format('a.text')} AS a, {_WORDS.format('b.text')} AS b
      FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1)
    SELECT conv_id, turn, len(a) > 0 AND len(b) > 0 AND len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.1 AS matches FROM p""",
)
def _(spark, sf):
    turns = with_previous_turn(table(spark, sf, "conversations")).filter("prompt is not null")
    return turns.select("conv_id", "turn", score.fuzzy_match(F.col("text"), F.col("prompt"), 0.1).alias("matches"))


@query(
    "off_by",
    f"WITH {ANSWER_PAIRS_SQL} SELECT {KEY_SQL}, CAST(abs(predicted_num - expected_num) AS BIGINT) AS off_by FROM answer_pairs",
)
def _(spark, sf):
    error = score.off_by(F.col("predicted_num"), F.col("expected_num"))
    return answer_pairs(spark, sf).select(*ROW_KEY, error.alias("off_by"))


@query(
    "score_dispatch",
    f"""WITH {RESPONSES_SQL}, t AS (SELECT *, CASE l_linenumber % 7 WHEN 0 THEN expected WHEN 1 THEN expected WHEN 2 THEN expected
        WHEN 3 THEN CAST(CAST(l_quantity AS INT) + 1 AS VARCHAR) WHEN 4 THEN expected END AS value,
        CASE p_type WHEN 'STANDARD' THEN 'arithmetic' WHEN 'SMALL' THEN 'family_relations' WHEN 'MEDIUM' THEN 'carwash' ELSE 'nobody_knows' END AS task FROM responses),
    m AS (SELECT *, CASE task
        WHEN 'arithmetic' THEN CASE WHEN value IS NULL THEN 'parse_error' WHEN value = expected THEN 'exact' ELSE 'mismatch' END
        WHEN 'family_relations' THEN CASE WHEN value IS NULL THEN 'parse_error' WHEN value = expected THEN 'correct' ELSE 'overcounting' END
        WHEN 'carwash' THEN CASE WHEN value IS NULL THEN 'parse_error' WHEN value = expected THEN 'correct' ELSE 'wrong' END ELSE 'unknown' END AS label FROM t)
    SELECT {KEY_SQL}, task, label AS match_type, label IN ('exact', 'correct') AS correct, CAST(CASE WHEN label IN ('exact', 'correct') THEN 1 ELSE 0 END AS DOUBLE) AS accuracy FROM m""",
)
def _(spark, sf):
    from tallymill.operators.extract import answer_struct

    value = F.expr(
        """case l_linenumber % 7 when 0 then expected when 1 then expected when 2 then expected
           when 3 then cast(cast(l_quantity as int) + 1 as string) when 4 then expected end"""
    )
    task = F.expr(
        "case p_type when 'STANDARD' then 'arithmetic' when 'SMALL' then 'family_relations' when 'MEDIUM' then 'carwash' else 'nobody_knows' end"
    )
    error = F.when(value.isNull(), "No strategy succeeded")
    rows = responses(spark, sf).withColumn("task", task).withColumn("answer", answer_struct(value=value, error=error))
    out = score_by_task(rows, DEFAULT_SCORERS, "task", "answer", "expected", {})
    return out.select(*ROW_KEY, "task", "verdict.match_type", "verdict.correct", "verdict.accuracy")
