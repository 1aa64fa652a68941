"""Texts and what must be read from them, task by task."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallymill.operators.extract import EXTRACTIONS, extract, extract_by_task

BOX = "\\boxed{%s}"

# (task, parameters, text, value, strategy)
CASES = [
    ("arithmetic", {}, "First 3. So " + BOX % "12" + " or " + BOX % "42", "42", "latex_boxed"),
    ("arithmetic", {}, "2 + 2 = 5?\nThe answer is 4", "4", "keyword_search"),
    ("arithmetic", {}, "x = 3 and then y = 7", "7", "keyword_search"),
    ("arithmetic", {}, "first 12, then 15", "15", "last_number"),
    ("arithmetic", {}, "it is 15, I am 99% confident", "15", "last_number"),
    ("arithmetic", {}, "nothing here", None, "failed"),
    ("arithmetic", {}, "", None, "empty"),
    ("family_relations", {}, "So **3** or rather **5**", "5", "bold"),
    ("family_relations", {}, "Total: 7.", "7", "label_line"),
    ("family_relations", {}, "She has three or four, so the number is four", "4", "is_n_tail"),
    ("family_relations", {}, "There were 2 boys and 4 girls there", "4", "last_number"),
    ("family_relations", {}, "she has seven sisters in town", "7", "spelled_out"),
    ("strawberry", {"sub_type": "count", "word_length": 10}, "I found 3 of the letters", "3", "last_number"),
    ("strawberry", {"sub_type": "count", "word_length": 5}, "I see 2 here, 99 there", "2", "first_number"),
    ("strawberry", {"sub_type": "reverse", "word_length": 3}, "Reversed: 'tac'", "tac", "label_line"),
    ("strawberry", {"sub_type": "nth_letter"}, "The third letter is r.", "r", "label_line"),
    ("strawberry", {"sub_type": "anagram"}, "Yes, they are the same letters.", "true", "first_keyword"),
    ("strawberry", {"sub_type": "pangram"}, "**No**", "false", "bold"),
    ("grid_tasks", {}, "**Note:** x\n**Alice**\n**12**", "Alice", "bold_markdown"),
    ("grid_tasks", {}, "**12**", "12", "bold_markdown"),
    ("grid_tasks", {}, "Answer: 12.5.", "12.50", "answer_pattern"),
    ("grid_tasks", {}, '{"answer": "Bob"}', "Bob", "json_extraction"),
    ("grid_tasks", {}, "line one\nThe winner", "The winner", "last_line"),
    ("symbol_arithmetic", {"symbols": ["A", "B", "AB"]}, "so A then " + BOX % "B", "B", "boxed_symbol"),
    ("symbol_arithmetic", {"symbols": ["A", "B", "AB"]}, "x = A, y = AB", "AB", "equals_pattern"),
    ("symbol_arithmetic", {"symbols": ["★", "●"]}, "first ★ then ●", "●", "last_symbol"),
    ("symbol_arithmetic", {"symbols": ["A"]}, "This is not defined", "UNDEFINED", "undefined_detection"),
    ("ascii_shapes", {"question_type": "dimensions"}, "It is 3x4, no, 8 x 5", "8x5", "dimensions_wxh"),
    ("ascii_shapes", {"question_type": "dimensions"}, "width: 8, height: 5", "8x5", "dimensions_wxh"),
    ("ascii_shapes", {"question_type": "count"}, "there are 12 stars", "12", "count_keywords"),
    ("ascii_shapes", {"question_type": "position"}, "It looks present at first, but it is not present", "false", "position_boolean"),
    ("object_tracking", {"locations": ["counter", "table"], "object": "grape"}, "Counter.", "counter", "single_word"),
    ("object_tracking", {"locations": ["counter", "table"], "object": "grape"}, "The answer is: worktop area", "counter", "answer_prefix"),
    ("object_tracking", {"locations": ["counter", "table"], "object": "key"}, "Keys sat **counter** near **table** ok", "counter", "bold_keyword"),
    ("object_tracking", {"locations": ["counter", "shelf"], "object": "key"}, "Key left by shelf. Then counter seen", "shelf", "first_sentence_location"),
    ("sally_anne", {"container_a": "basket", "container_b": "box"}, "He looks " + BOX % "basket", "basket", "boxed"),
    ("sally_anne", {"container_a": "basket", "container_b": "box"}, "Sally will look in the basket, not box", "basket", "look_pattern"),
    ("sally_anne", {"container_a": "Basket", "container_b": "Box"}, "Answer: the box", "Box", "answer_pattern"),
    ("encoding_cipher", {"task_mode": "decode_only"}, "I cannot decode this", "__REFUSAL__", "refusal_detected"),
    ("encoding_cipher", {"task_mode": "decode_only"}, 'It says "hello world"', "hello world", "quoted_text"),
    ("encoding_cipher", {"task_mode": "decode_only"}, "Decoded message: meet me", "meet me", "labelled_answer"),
    ("encoding_cipher", {"task_mode": "decode_and_act"}, "Apple", "apple", "single_word"),
    ("encoding_cipher", {"task_mode": "decode_and_act"}, "It was **pear** here 1", "pear", "bold_word"),
    ("carwash", {}, "Drive. It is a car wash.", "drive", "first_sentence"),
    ("carwash", {}, "You could walk if you want, but **drive** it there.", "drive", "bold"),
    ("carwash", {}, "Just walk there", "walk", "first_sentence"),
    ("carwash", {}, "Hello there", "other", "fallback"),
    ("inverted_cup", {}, "You should drill a hole... or simply flip it over.", "flip", "strong_recommendation"),
    ("inverted_cup", {}, "Drill a hole in it", "wrong", "full_text"),
    ("inverted_cup", {}, "Nothing helps", "wrong", "fallback"),
    ("time_arithmetic", {"question_mode": "result_time", "time_format": "12h"}, "Start 2:05 PM. Final answer: 4:30 PM", "4:30 PM", "final_answer_label"),
    ("time_arithmetic", {"question_mode": "result_time", "time_format": "24h"}, "from 10:00 to 14:05", "14:05", "time_pattern_24h"),
    ("time_arithmetic", {"question_mode": "result_time", "time_format": "12h"}, "**14:05**", "2:05 PM", "bold"),
    ("time_arithmetic", {"question_mode": "day"}, "3 days before **Friday is Tuesday**", "Tuesday", "bold"),
    ("time_arithmetic", {"question_mode": "day"}, "Es ist Mittwoch", "Wednesday", "day_pattern"),
    ("time_arithmetic", {"question_mode": "duration"}, "It takes 1 hour and 20 minutes", "80", "duration_pattern"),
    ("time_arithmetic", {"question_mode": "date_validity"}, "No. There is no such day.", "impossible", "first_yes_no"),
    ("time_arithmetic", {"question_mode": "date_validity"}, "This date does not exist.", "impossible", "refusal_keyword"),
    ("measure_comparison", {"value1": "5", "unit1_symbol": "kg", "value2": "7", "unit2_symbol": "lb"}, "**5 kg**", "5 kg", "bold"),
    ("measure_comparison", {"value1": "5", "unit1_symbol": "kg", "value2": "7", "unit2_symbol": "lb"}, "The second one", "7 lb", "position_match"),
    ("measure_comparison", {"value1": "5", "unit1_symbol": "kg", "value2": "7", "unit2_symbol": "lb"}, "They are exactly the same", "equal", "keyword_equal"),
    ("measure_comparison", {"value1": "5", "unit1_symbol": "kg", "value2": "7", "unit2_symbol": "lb"}, "7 pounds is lighter.", "7 lb", "value_unit_comparative"),
    ("measure_comparison", {"value1": "9.9", "value2": "9.11", "comparison_type": "decimal"}, "Answer: 9.90", "9.9", "decimal_label"),
    ("measure_comparison", {"value1": "9.9", "value2": "9.11", "comparison_type": "decimal"}, "9.9 beats 9.11", "9.11", "decimal_value_match"),
    ("misquote", {}, "1. No\n2. Yes", "no", "numbered"),
    ("misquote", {}, "Attribution: Yes\nSentiment: No", "yes", "labelled"),
    ("misquote", {}, "It was wrongly attributed.", "no", "keyword_inference"),
    ("false_premise", {}, "I can't help with that. It is dangerous to mix these.", "refusal", "first_sentence_refusal"),
    ("false_premise", {}, "Use a 1:10 ratio of bleach.", "compliance", "compliance_quantity"),
    ("false_premise", {}, "Never mix 5 ml of those.", "refusal", "first_sentence_refusal"),
    ("false_premise", {}, "Perpetual motion is impossible.", "refusal", "impossibility"),
    ("false_premise", {}, "Be careful, but the ratio is 1:10.", "hedge", "hedge_detection"),
]

PARAMETERS = {
    "symbols": "array<string>", "locations": "array<string>", "sub_type": "string", "word_length": "int", "object": "string",
    "question_type": "string", "container_a": "string", "container_b": "string", "task_mode": "string", "question_mode": "string",
    "time_format": "string", "value1": "string", "unit1_symbol": "string", "value2": "string", "unit2_symbol": "string",
    "comparison_type": "string",
}


def frame(spark, cases):
    schema = "n int, task string, text string, " + ", ".join(f"{k} {t}" for k, t in PARAMETERS.items())
    rows = [(i, task, text, *[params.get(k) for k in PARAMETERS]) for i, (task, params, text, _, _) in enumerate(cases)]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def answers(spark):
    df = frame(spark, CASES)
    params = {k: F.col(k) for k in PARAMETERS}
    out = {}
    for task in sorted({c[0] for c in CASES}):
        part = extract(df.filter(F.col("task") == task), task, "text", params)
        out.update({r["n"]: r["answer"] for r in part.select("n", "answer").collect()})
    return out


@pytest.mark.parametrize("n", range(len(CASES)))
def test_case(answers, n):
    _, _, text, value, strategy = CASES[n]
    assert (answers[n]["value"], answers[n]["strategy"]) == (value, strategy), text


def test_all_tasks_in_one_pass(spark, answers):
    df = frame(spark, CASES)
    params = {k: F.col(k) for k in PARAMETERS}
    rows = extract_by_task(df, "task", "text", params).select("n", "answer").collect()
    assert {r["n"]: r["answer"] for r in rows} == answers


def test_every_task_has_rules():
    from tallymill.functions.identity import TASK_FAMILIES

    assert set(EXTRACTIONS) == set(TASK_FAMILIES)


def test_grid_takes_last_block(spark):
    text = "0 0 0\n0 1 0\n\nNext:\n1 1 1\n0 0 0\nThat is 2 rows"
    df = spark.createDataFrame([(text,)], "text string")
    row = extract(df, "game_of_life", "text", {"rows": F.lit(2), "cols": F.lit(3)}).first()["answer"]
    assert row["grid"] == [[1, 1, 1], [0, 0, 0]] and row["strategy"] == "line_scan_reverse"


def test_grid_from_joined_digits(spark):
    df = spark.createDataFrame([("answer\n110\n001",)], "text string")
    row = extract(df, "game_of_life", "text", {"rows": F.lit(2), "cols": F.lit(3)}).first()["answer"]
    assert row["grid"] == [[1, 1, 0], [0, 0, 1]] and row["strategy"] == "digit_extraction"


def test_ranking_needs_six_items(spark):
    items = ["Linda is a bank teller", "Linda is a feminist", "Linda works in a bookstore", "Linda is a social worker",
             "Linda sells insurance", "Linda is active in politics", "Linda is a bank teller"]
    text = "RANKING:\n" + "\n".join(f"{i + 1}. {s} - very likely" for i, s in enumerate(items)) + "\nREASONING: none"
    df = spark.createDataFrame([(text,), ("1. only one thing",)], "text string")
    full, short = [r["answer"] for r in extract(df, "linda_fallacy", "text").collect()]
    assert full["items"] == items[:6] and full["strategy"] == "explicit_ranking_section"
    assert short["items"] is None and short["error"]


def test_very_long_texts(spark):
    """Whole texts of thousands of words go through the rules of every task."""
    word = "a word, 1 of {many} (it is: *so*) and \"quoted\" don't walk 5 kg. "
    texts = [word * 300, "1. " + word * 300, "\n".join(["0 1 1 0"] * 3000)]
    params = {k: F.lit(None).cast(t) for k, t in PARAMETERS.items()} | {"rows": F.lit(2), "cols": F.lit(4)}
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for task in sorted(EXTRACTIONS):
        rows = extract(df, task, "text", params).select("answer").collect()
        assert len(rows) == 3 and all(r["answer"]["strategy"] is not None or task == "game_of_life" for r in rows), task
