"""Steps that many rules share: texts cut once, words tried only where one can begin, methods short enough to be compiled."""

import re

import pytest
from pyspark.sql import functions as F

from tallymill.functions import rules
from tallymill.functions.cascade import Rule, decode, hit
from tallymill.functions.text import VERIFICATION_HEADER, last_match, looked_ahead, says_any, strip_verification_tail
from tallymill.operators.extract import extract
from tallymill.plans import QUERIES

JIT_LIMIT = 8000


def test_choices_are_tried_where_they_can_begin():
    assert looked_ahead(r"(?i)(?:answer|time)\s*[:=](.+)") == r"(?i)(?=[at])(?:answer|time)\s*[:=](.+)"
    assert looked_ahead(r"(?:a|b)c|d") == r"(?:a|b)c|d" and looked_ahead(r"(\d+)x") == r"(\d+)x"
    assert rules.DAY_WORD.count("|") > 30 and "(?=[" in rules.DAY_WORD


def test_words_found_as_before(spark):
    days = r"(?iuU)\b(" + "|".join(sorted(rules._DAYS, key=len, reverse=True)) + r")\b"
    phrases = rules.IMPOSSIBLE_PHRASES + rules.VALID_PHRASES + ("-x", "^")
    texts = ["Mon, then TUES. thursdays", "THUR thu", "п'ятниця", "СЕРЕДА і Sábado", "星期一 周日", "monday1", "a-x", "^", "it was so", "не існує", "nothing", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        last_match(F.col("t"), rules.DAY_WORD, 1).alias("day"),
        F.try_element_at(F.regexp_extract_all("t", F.lit(days), F.lit(1)), F.lit(-1)).alias("day0"),
        says_any(F.col("t"), phrases).alias("says"),
        F.lower("t").rlike("|".join(f"\\Q{p}\\E" for p in phrases)).alias("says0"),
    )
    for r in rows.collect():
        assert (r.day, r.says) == (r.day0, r.says0)


def test_cut_texts(spark):
    texts = ["so 5 \nLet me check: 7", "Verify: 3", "5  ", "a\n\nCheck\nb\nproof", "no header\nhere", "", None]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(strip_verification_tail(F.col("t")).alias("v")).collect()]
    assert got == ["so 5", "Verify: 3", "5  ", "a", "no header\nhere", "", None]


def test_kept_rules_read_the_cut_text(spark):
    digits = tuple(Rule(f"r{k}", 1.0, rf"{k}(\d)", kept=k > 0) for k in range(4))
    rows = spark.createDataFrame([("05 11\nCheck: 22",), ("11\nCheck: 22",), ("\nCheck: 22",), ("x\nCheck 22",)], "t string")
    found = rows.select(decode(hit(F.col("t"), digits), digits, F.col("t")).alias("d"))
    assert [(r.value, r.strategy) for r in found.select("d.*").collect()] == [("5", "r0"), ("1", "r1"), ("2", "r2"), (None, "failed")]


def cuts(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out.count(VERIFICATION_HEADER[:40])


def test_plan_cuts_the_text_once(spark, capsys):
    rows = spark.createDataFrame([("a",)], "t string")
    once = cuts(rows.select(strip_verification_tail(F.col("t"))), capsys)
    assert once > 0
    for part in rules.time_rules(F.lit(True)).values():
        assert cuts(rows.select(hit(F.col("t"), part)), capsys) == (once if any(r.kept for r in part) else 0)


def test_clock_and_day_answers(spark):
    cases = [
        ("**Friday is Tuesday**", "day", "Tuesday"), ("\\boxed{Mon, Tue}", "day", "Monday"), ("It is dimanche\nCheck: monday", "day", "Sunday"),
        ("at 2:5 or 2:05 p.m.", "result_time", "2:05 PM"), ("at 14.07", "result_time", "2:07 PM"), ("25:61", "result_time", None),
        ("13:10 pm", "result_time", "1:10 PM"), ("1:75 pm", "result_time", None), ("it took 1 hour and 5 min", "duration", "65"), ("about 77", "duration", "77"),
    ]
    rows = spark.createDataFrame([(k, t, q) for k, (t, q, _) in enumerate(cases)], "k int, raw string, q string")
    got = {r.k: r.value for r in extract(rows, "time_arithmetic", "raw", {"question_mode": F.col("q")}).select("k", "answer.value").collect()}
    assert [got[k] for k in range(len(cases))] == [want for _, _, want in cases]


@pytest.mark.parametrize("name", ["extract_all_tasks"])
def test_methods_of_all_tasks_are_compiled(spark, sf, capsys, name):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan shows no code before it runs
    try:
        capsys.readouterr()
        QUERIES[name](spark, sf).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= JIT_LIMIT


def test_all_tasks_with_missing_keys(spark, tmp_path):
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double"
    rows = [(k, k % 7, None if k % 3 == 0 else k, None if k % 4 == 0 else k, None if k % 5 == 0 else 3.0) for k in range(60)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = QUERIES["extract_all_tasks"](spark, str(tmp_path)).collect()
    assert len(got) == 60 and sum(r.task is None for r in got) == 20
