"""The JVM compiles methods of up to 8,000 bytes; longer ones of the generated code stay interpreted, row by row."""

import re

import pytest
from pyspark.sql import functions as F

from tallymill.functions import rules
from tallymill.operators.extract import extract
from tallymill.plans import QUERIES

JIT_LIMIT = 8000


@pytest.mark.parametrize("name", ["yes_no_pair"])
def test_generated_methods_are_compiled(spark, sf, capsys, name):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the plan shows no code before it runs
    try:
        capsys.readouterr()
        QUERIES[name](spark, sf).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= JIT_LIMIT


def test_pairs_of_answers(spark):
    texts = ["1. No\n2. **YES**", "Attribution: yes", "No\nyes.\n**No**", "It was never said. I AGREE with it", "I do not agree with it", "Yes or no: said by him", "yes, no", "", " NO "]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, raw string")
    got = {r.k: (r.value, r.second, r.strategy) for r in extract(rows, "misquote", "raw").select("k", "answer.*").collect()}
    assert got == {
        0: ("no", "yes", "numbered"),
        1: ("yes", None, "labelled"),
        2: ("yes", "no", "bare_yesno"),
        3: ("no", "yes", "keyword_inference"),
        4: (None, None, "fallback"),
        5: ("no", None, "partial_q1"),
        6: (None, None, "fallback"),
        7: (None, None, "empty"),
        8: ("no", None, "partial_q1"),
    }


def test_last_keyword_without_any_is_minus_one(spark):
    row = spark.createDataFrame([("A walk, a Drive", "none", None)], "a string, b string, c string")
    at = row.select(*(rules.last_keyword_position(F.col(c), [r"\bdrive\b", "walk"]).alias(c) for c in "abc")).first()
    assert tuple(at) == (10, -1, -1)
