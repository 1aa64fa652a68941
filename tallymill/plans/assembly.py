"""Assembly of labelled test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.fixtures import ANSWER_PAIRS_SQL, EVAL_ROWS_SQL, answer_pairs, eval_rows, table
from tallymill.functions import rules, vocab
from tallymill.operators import assemble
from tallymill.operators.aggregate import rounded
from tallymill.plans.registry import query
from tallymill.session import spread

ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_AXES = {"user_style": ["minimal", "casual", "linguistic"], "system_style": ["analytical", "casual", "adversarial"], "language": ["en", "es", "fr", "de", "zh", "ua"]}


def _unnest(values: list[str]) -> str:
    return "unnest([" + ", ".join(f"'{v}'" for v in values) + "])"


@query(
    "config_matrix",
    f"""WITH a AS (SELECT s_suppkey, {_unnest(_AXES['user_style'])} AS user_style FROM supplier),
    b AS (SELECT *, {_unnest(_AXES['system_style'])} AS system_style FROM a)
    SELECT *, {_unnest(_AXES['language'])} AS language FROM b""",
)
def _(spark, sf):
    return assemble.config_matrix(table(spark, sf, "supplier").select("s_suppkey"), _AXES)


@query(
    "fill_to_count",
    """WITH d AS (SELECT c_custkey, md5('42|' || c_custkey) AS draw, (SELECT count(*) FROM customer) AS n FROM customer),
    r AS (SELECT c_custkey, draw, unnest(range(0, 3)) AS round, n FROM d),
    o AS (SELECT *, row_number() OVER (ORDER BY round, draw, c_custkey) AS rn FROM r)
    SELECT c_custkey, CAST(round AS INT) AS round FROM o WHERE rn <= n * 5 // 2""",
)
def _(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey")
    wanted = customers.agg(F.floor(F.count(F.lit(1)) * 5 / 2)).scalar()
    return assemble.fill_to_count(customers, wanted, ["c_custkey"]).select("c_custkey", "round")


# Prompt texts by language and style.
_TEMPLATES = {
    "en": {"minimal": "{name}: {amount}?", "casual": "Hey, what about {name} and {amount}? ", "linguistic": "Consider {name}; state {amount}."},
    "de": {"casual": "Na, {name} mit {amount}?", "minimal": "{name}, {amount}?"},
}
_SYSTEM = {"en": {"analytical": "Think.", "casual": ""}, "de": {"casual": "Hallo."}}


@query(
    "render_prompts",
    """WITH d AS (SELECT doc_id, lang, source, n_chars, CASE doc_id % 4 WHEN 0 THEN 'minimal' WHEN 1 THEN 'casual' WHEN 2 THEN 'linguistic' ELSE 'other' END AS style FROM documents),
    u AS (SELECT doc_id, CASE WHEN lang = 'de' THEN 'Hallo.' ELSE CASE WHEN doc_id % 2 = 0 THEN 'Think.' ELSE '' END END AS system_prompt,
      CASE WHEN lang = 'de' THEN CASE style WHEN 'minimal' THEN source || ', ' || n_chars || '?' ELSE 'Na, ' || source || ' mit ' || n_chars || '?' END
        ELSE CASE style WHEN 'minimal' THEN source || ': ' || n_chars || '?' WHEN 'linguistic' THEN 'Consider ' || source || '; state ' || n_chars || '.'
          ELSE 'Hey, what about ' || source || ' and ' || n_chars || '?' END END AS user_prompt FROM d)
    SELECT *, CASE WHEN system_prompt = '' THEN user_prompt ELSE system_prompt || chr(10) || chr(10) || user_prompt END AS full_prompt FROM u""",
)
def _(spark, sf):
    style = F.expr("case doc_id % 4 when 0 then 'minimal' when 1 then 'casual' when 2 then 'linguistic' else 'other' end")
    tone = F.when(F.col("doc_id") % 2 == 0, "analytical").otherwise("casual")
    user = assemble.render(
        assemble.pick_template(_TEMPLATES, F.col("lang"), style), {"name": F.col("source"), "amount": F.col("n_chars")}
    )
    system = assemble.pick_template(_SYSTEM, F.col("lang"), tone)
    prompts = spread(table(spark, sf, "documents")).select("doc_id", system.alias("system_prompt"), user.alias("user_prompt"))
    return prompts.withColumn("full_prompt", assemble.full_prompt(F.col("system_prompt"), F.col("user_prompt")))


@query(
    "assign_ids",
    """SELECT o_orderkey, printf('multi_%04d_%s', row_number() OVER (ORDER BY o_orderpriority, o_orderkey), lower(o_orderstatus)) AS test_id FROM orders""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.lower("o_orderstatus").alias("task"))
    return assemble.assign_ids(orders, "task", ["o_orderpriority", "o_orderkey"]).select("o_orderkey", "test_id")


@query(
    "config_hash",
    """SELECT p_partkey, substr(sha256('{"brand": "' || p_brand || '", "name": "' || p_name || '", "size": ' || p_size || '}'), 1, 16) AS config_hash FROM part""",
)
def _(spark, sf):
    fields = {"name": F.col("p_name"), "brand": F.col("p_brand"), "raw:size": F.col("p_size")}
    return table(spark, sf, "part").select("p_partkey", assemble.config_hash(fields).alias("config_hash"))


@query(
    "plan_counts",
    f"""WITH {EVAL_ROWS_SQL}, p AS (SELECT p_type, count(DISTINCT p_size) AS levels, count(DISTINCT p_brand) AS targets FROM part GROUP BY p_type),
    m AS (SELECT p_type, count(*) AS produced FROM eval_rows GROUP BY p_type)
    SELECT p_type, levels * targets * 2 AS planned, greatest(levels * targets * 2 // 9, 1) AS per_config, coalesce(produced, 0) AS produced,
      coalesce(produced, 0) - levels * targets * 2 AS surplus FROM p LEFT JOIN m USING (p_type)""",
)
def _(spark, sf):
    plans = table(spark, sf, "part").groupBy("p_type").agg(
        F.count_distinct("p_size").alias("levels"),
        F.count_distinct("p_brand").alias("targets"),
        F.lit(2).alias("per_target"),
        F.lit(9).alias("configs"),
    )
    return assemble.plan_counts(plans, eval_rows(spark, sf), "p_type")


@query(
    "weighted_pick",
    """WITH u AS (SELECT p_partkey, CAST('0x' || substr(md5('7|' || p_partkey), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM part)
    SELECT p_partkey, round(u, 9) AS u, CASE WHEN u < 0.5 THEN 'real' WHEN u < 0.8 THEN 'random' ELSE 'absent_letter' END AS mode FROM u""",
)
def _(spark, sf):
    key = F.col("p_partkey")
    pick = assemble.weighted_pick({"real": 5, "random": 3, "absent_letter": 2}, "7", key)
    return table(spark, sf, "part").select(
        "p_partkey", rounded(assemble.seeded_uniform("7", key), 9).alias("u"), pick.alias("mode")
    )


@query(
    "label_strings",
    """WITH c AS (SELECT *, string_split(lower(p_name), '') AS chars, p_size % length(p_name) + 1 AS n FROM part)
    SELECT p_partkey, CAST(length(p_name) - length(replace(p_name, 'e', '')) AS INT) AS letter_count,
      array_to_string(list_filter(range(0, length(p_name)), lambda i: p_name[i + 1] = 'e'), ',') AS positions, reverse(p_name) AS reversed,
      substr(p_name, n, 1) AS nth, list_sort(chars) = list_sort(string_split(reverse(p_name), '')) AS anagram FROM c""",
)
def _(spark, sf):
    word, e = F.col("p_name"), F.lit("e")
    positions = F.array_join(assemble.letter_positions(word, e).cast("array<string>"), ",")
    return table(spark, sf, "part").select(
        "p_partkey",
        assemble.letter_count(word, e).alias("letter_count"),
        positions.alias("positions"),
        F.reverse(word).alias("reversed"),
        assemble.nth_letter(word, F.expr("cast(p_size % length(p_name) + 1 as int)")).alias("nth"),
        assemble.is_anagram(word, F.reverse(word)).alias("anagram"),
    )


@query(
    "label_pangrams",
    """SELECT doc_id, array_to_string(list_filter(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: NOT contains(lower(text), c)), '') AS missing,
      len(list_filter(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: NOT contains(lower(text), c))) = 0 AS pangram,
      NOT contains(lower(text), 'q') AS lipogram FROM documents""",
)
def _(spark, sf):
    gone = assemble.missing_letters(F.col("text"))
    docs = spread(table(spark, sf, "documents")).select("doc_id", "text", gone.alias("gone"))
    return docs.select(
        "doc_id",
        F.array_join("gone", "").alias("missing"),
        (F.size("gone") == 0).alias("pangram"),
        assemble.is_lipogram(F.col("text"), F.lit("q")).alias("lipogram"),
    )


_MORSE_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in vocab.MORSE.items()) + "}"
_CAESAR_TO = "defghijklmnopqrstuvwxyzabc"


@query(
    "label_encodings",
    f"""WITH t AS (SELECT p_partkey, p_name || ' ' || replace(p_brand, '#', '') AS plain FROM part)
    SELECT p_partkey, base64(encode(plain)) AS base64, plain AS base64_back,
      translate(plain, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', '{_CAESAR_TO}{_CAESAR_TO.upper()}') AS caesar, plain AS caesar_back,
      array_to_string(list_transform(string_split(upper(plain), ' '), lambda w: array_to_string(list_transform(string_split(w, ''),
        lambda c: {_MORSE_SQL}[c]), ' ')), ' / ') AS morse, upper(plain) AS morse_back FROM t""",
)
def _(spark, sf):
    plain = F.concat_ws(" ", "p_name", F.regexp_replace("p_brand", "#", ""))
    rows = table(spark, sf, "part").select("p_partkey", plain.alias("plain"))
    coded = rows.select(
        "p_partkey",
        F.base64(F.encode("plain", "utf-8")).alias("base64"),
        assemble.caesar(F.col("plain"), 3).alias("caesar"),
        assemble.to_morse(F.col("plain")).alias("morse"),
    )
    return coded.withColumns(
        {
            "base64_back": F.decode(F.unbase64("base64"), "utf-8"),
            "caesar_back": assemble.caesar(F.col("caesar"), -3),
            "morse_back": assemble.from_morse(F.col("morse")),
        }
    )


@query(
    "label_table_questions",
    """SELECT p_brand, first(p_name ORDER BY p_partkey) AS first_cell, printf('%.2f', sum(p_retailprice)) AS column_total,
      count(*) FILTER (WHERE p_type = 'SMALL') AS value_count, count(*) FILTER (WHERE p_size > 25) AS filter_count,
      first(p_name ORDER BY p_retailprice DESC, p_partkey) AS arg_max FROM part GROUP BY p_brand""",
)
def _(spark, sf):
    return assemble.table_answers(
        table(spark, sf, "part"),
        ["p_brand"],
        "p_partkey",
        "p_retailprice",
        "p_name",
        F.col("p_type") == "SMALL",
        F.col("p_size") > 25,
    )


_UNITS = ["kg", "g", "lb", "°C", "°F", "K", "km", "mi"]
_FACTORS = {u: vocab.UNITS[u] for u in _UNITS}
_BASE_SQL = (
    "CASE {u} WHEN 'K' THEN {v} WHEN '°C' THEN {v} + 273.15 WHEN '°F' THEN ({v} - 32) * 5.0 / 9.0 + 273.15 "
    + " ".join(f"WHEN '{u}' THEN {{v}} * {f}::DOUBLE" for u, (_, f, _) in _FACTORS.items() if f is not None)
    + " END"
)
_CATEGORY_SQL = "CASE {u} " + " ".join(f"WHEN '{u}' THEN '{c}'" for u, (c, _, _) in _FACTORS.items()) + " END"
_UNIT_LIST_SQL = "[" + ", ".join(f"'{u}'" for u in _UNITS) + "]"


@query(
    "label_units",
    f"""WITH {ANSWER_PAIRS_SQL}, u AS (SELECT {KEY_SQL}, l_quantity AS v1, CAST(p_size AS DOUBLE) AS v2,
        {_UNIT_LIST_SQL}[l_linenumber % 8 + 1] AS u1, {_UNIT_LIST_SQL}[(l_linenumber + p_size % 2) % 8 + 1] AS u2 FROM answer_pairs),
    b AS (SELECT *, {_BASE_SQL.format(u='u1', v='v1')} AS a, {_BASE_SQL.format(u='u2', v='v2')} AS b FROM u)
    SELECT {KEY_SQL}, round(a, 6) AS base1, round(b, 6) AS base2, CASE WHEN {_CATEGORY_SQL.format(u='u1')} <> {_CATEGORY_SQL.format(u='u2')} THEN 'incomparable'
      WHEN abs(a - b) <= 1e-9 * greatest(abs(a), abs(b)) THEN 'equal' WHEN a > b THEN 'first' ELSE 'second' END AS answer FROM b""",
)
def _(spark, sf):
    units = F.array(*[F.lit(u) for u in _UNITS])
    u1, u2 = F.get(units, F.expr("l_linenumber % 8")), F.get(units, F.expr("(l_linenumber + p_size % 2) % 8"))
    v1, v2 = F.col("l_quantity"), F.col("p_size").cast("double")
    return answer_pairs(spark, sf).select(
        *ROW_KEY,
        rounded(assemble.to_base(v1, u1)).alias("base1"),
        rounded(assemble.to_base(v2, u2)).alias("base2"),
        assemble.compare_quantities(v1, u1, v2, u2).alias("answer"),
    )


@query(
    "label_times",
    """WITH c AS (SELECT event_id, user_id, hour(ts) * 60 + minute(ts) AS m, ((hour(ts) * 60 + minute(ts) - user_id * 7) % 1440 + 1440) % 1440 AS r FROM events),
    h AS (SELECT *, user_id // 60 AS dh, user_id % 60 AS dm, r // 60 AS rh FROM c)
    SELECT event_id, printf('%02d:%02d', r // 60, r % 60) AS clock24,
      printf('%d:%02d %s', CASE WHEN rh % 12 = 0 THEN 12 ELSE rh % 12 END, r % 60, CASE WHEN rh < 12 THEN 'AM' ELSE 'PM' END) AS clock12,
      CASE WHEN dh > 0 AND dm > 0 THEN dh || CASE WHEN dh = 1 THEN ' hour' ELSE ' hours' END || ' and ' || dm || CASE WHEN dm = 1 THEN ' minute' ELSE ' minutes' END
        WHEN dh > 0 THEN dh || CASE WHEN dh = 1 THEN ' hour' ELSE ' hours' END ELSE dm || CASE WHEN dm = 1 THEN ' minute' ELSE ' minutes' END END AS duration FROM h""",
)
def _(spark, sf):
    minutes = F.hour("ts") * 60 + F.minute("ts")
    moved = assemble.shift_clock(minutes, -F.col("user_id") * 7)
    return table(spark, sf, "events").select(
        "event_id",
        rules.clock_text(moved, F.lit(False)).alias("clock24"),
        rules.clock_text(moved, F.lit(True)).alias("clock12"),
        assemble.duration_text(F.col("user_id")).alias("duration"),
    )


@query(
    "label_dates",
    """WITH d AS (SELECT o_orderkey, o_orderdate, year(o_orderdate) AS y, o_custkey, year(o_orderdate) || '-' || (o_orderkey % 14) || '-' || (o_custkey % 33) AS written FROM orders)
    SELECT o_orderkey, ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][isodow(o_orderdate + to_days(CAST(o_custkey % 20 AS INT)))] AS weekday,
      (y % 4 = 0 AND y % 100 <> 0) OR y % 400 = 0 AS leap, CASE WHEN TRY_CAST(printf('%04d-%02d-%02d', y, o_orderkey % 14, o_custkey % 33) AS DATE) IS NOT NULL THEN 'valid' ELSE 'impossible' END AS date_label
    FROM d""",
)
def _(spark, sf):
    written = F.expr("concat(year(o_orderdate), '-', o_orderkey % 14, '-', o_custkey % 33)")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        assemble.shift_weekday(F.weekday("o_orderdate"), F.col("o_custkey") % 20).alias("weekday"),
        assemble.is_leap_year(F.year("o_orderdate")).alias("leap"),
        assemble.date_label(written).alias("date_label"),
    )


@query(
    "expand_hazards",
    """WITH p AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Lethal' WHEN 1 THEN 'severe' WHEN 2 THEN 'minor' ELSE '' END AS sev, p_name FROM part)
    SELECT p_partkey, p_name AS product, CASE WHEN sev = '' THEN 'UNKNOWN' ELSE upper(sev) END AS hazard_severity, v = 'described' AS hard_mode, v AS variant
    FROM (SELECT *, unnest(['plain', 'described']) AS v FROM p WHERE sev <> 'minor')""",
)
def _(spark, sf):
    rows = table(spark, sf, "part").select(
        "p_partkey",
        F.expr("case p_size % 4 when 0 then 'Lethal' when 1 then 'severe' when 2 then 'minor' else '' end").alias("sev"),
        F.concat_ws("; ", "p_name", "p_brand", "p_type").alias("product"),
    )
    out = assemble.expand_hazards(rows, "sev", ["LETHAL", "SEVERE"], ["product"])
    return out.select("p_partkey", "product", "hazard_severity", "hard_mode", "variant")


@query(
    "testset_qa",
    """SELECT event_type, count(*) AS cases, count(*) FILTER (WHERE user_id % 2 = 0) AS empty_system, CAST(0 AS BIGINT) AS empty_user,
      (SELECT array_to_string(list_sort(list(DISTINCT k)), ',') FROM (SELECT unnest(json_keys(props)) AS k FROM events i WHERE i.event_type = o.event_type)) AS parameters
    FROM events o GROUP BY event_type""",
)
def _(spark, sf):
    cases = table(spark, sf, "events").selectExpr(
        "event_type",
        "props as task_params",
        "case when user_id % 2 = 0 then '' else 'system' end as system_prompt",
        "cast(event_id as string) as user_prompt",
    )
    return assemble.testset_qa(cases, ["event_type"])
