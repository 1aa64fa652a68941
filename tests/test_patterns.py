from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tallymill.functions import refusal
from tallymill.functions.text import alternatives, any_of, count_hits, openings

GROUPS = ("REFUSALS", "STRONG_REFUSALS", "INSTRUCTIONS", "HEDGES", "IMPOSSIBILITIES", "REFUSAL_WORDS", "COMPLIANCE_WORDS")


def plain(patterns):
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def test_openings():
    assert alternatives(r"a(?:b|c)[|]|\||d") == [r"a(?:b|c)[|]", r"\|", "d"]
    assert (openings("(?:I'?d?\\s+)?advise"), openings(r"\d+|x"), openings("u?ser")) == ("Ia", r"\dx", "us")
    assert (openings(r"\s+a"), openings("a*b"), openings("(?:a|[bc])d"), openings("")) == (None, None, None, None)


@pytest.mark.parametrize("name", GROUPS)
def test_edge_is_tested_once(name):
    """One test of a word's edge for the whole list, before characters that begin one of its patterns."""
    joined = any_of(getattr(refusal, name))
    assert joined.startswith("(?i)(?=[") and "|(?:\\b" not in joined


def test_same_texts_match(spark):
    rng = random.Random(4)
    listed = [p for n in GROUPS for p in getattr(refusal, n)] + [refusal.RATIO, refusal.MEASUREMENT]
    words = sorted({w for p in listed for w in re.findall(r"[A-Za-z]{2,}", p)} | {"I'm", "can't", "don't", "5", "2:1", "7ml", "_", "zero", "the"})
    texts = [rng.choice(["", "x", "\n", "É"]).join(rng.choice([w, w.upper()]) + rng.choice([" ", " ", ". ", ""]) for w in rng.choices(words, k=rng.randint(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", None]], "t string")
    for name in GROUPS:
        group = getattr(refusal, name)
        each = sum((F.col("t").rlike(f"(?i){p}").cast("int") for p in group[1:]), F.col("t").rlike(f"(?i){group[0]}").cast("int"))
        wrong = df.filter(~F.equal_null(F.col("t").rlike(any_of(group)), F.col("t").rlike(plain(group))) | ~F.equal_null(count_hits(F.col("t"), group), each))
        assert wrong.collect() == []
    lone = [refusal.RATIO, refusal.MEASUREMENT]
    assert df.filter(F.col("t").rlike(any_of(lone)) != F.col("t").rlike(plain(lone))).collect() == []


def test_negation_cut_in_a_word(spark):
    """What stands in reach of a negation may begin inside a word."""
    text = "unstop" + " " * 56 + "2:1"
    row = spark.createDataFrame([(text,), ("stop 2:1",), ("mix 2:1",), ("2:1 stop",)], "t string")
    assert [r[0] for r in row.select(refusal.has_ratio(F.col("t"))).collect()] == [False, False, True, True]
