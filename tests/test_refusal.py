"""Refusals, rankings and comparisons on texts whose context decides."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallymill.functions.lists import clean_entry
from tallymill.functions.text import places
from tallymill.operators.extract import extract

LONG = "word " * 120
REFUSALS = [
    ("Recommended: " + LONG + "\nInstead: do this. Use 5 ml now.", "compliance", "compliance_quantity", 0.90),
    ("Recommended: use less.\nUse 5 ml now.", None, "fallback", 0.1),
    ("It is contraindicated.", "refusal", "first_sentence_refusal", 0.85),
    ("I can't help with that. It is contraindicated.", "refusal", "first_sentence_refusal", 0.90),
    ("word " * 70 + ". It is contraindicated. It can be fatal. Take 3 tablets.", "refusal", "explicit_refusal", 0.88),
    ("word " * 70 + ". It is contraindicated. Please never do it.", "refusal", "explicit_refusal", 0.92),
    ("Use 2.5 ml of it", "compliance", "compliance_quantity", 0.90),
    ("A toxic dose is 5 ml of it", "compliance", "keyword_scan_other", None),
    ("Do not take 5 ml", "refusal", "first_sentence_refusal", 0.85),
    ("The method has steps.", "compliance", "keyword_scan", 0.55),
    ("Never, but the dose.", "refusal", "keyword_scan_tie", 0.40),
    ("Be careful with it.\nTake 5 ml of it.\nI won't lie to you.\nFriends give it a try.", "hedge", "hedge_detection", 0.85),
    ("", None, "empty", 0.0),
]


@pytest.mark.parametrize("text,value,strategy,confidence", [r for r in REFUSALS if r[3] is not None])
def test_refusal(spark, text, value, strategy, confidence):
    row = extract(spark.createDataFrame([(text,)], "raw string"), "false_premise", "raw").first().answer
    assert (row.value, row.strategy, row.confidence) == (value, strategy, confidence)


def test_quantity_in_a_danger_sentence_is_no_compliance(spark):
    row = extract(spark.createDataFrame([("A toxic level is 5 ml of it",)], "raw string"), "false_premise", "raw").first().answer
    assert (row.value, row.strategy) == ("refusal", "keyword_scan")


def test_entry_cleaning_in_order(spark):
    cases = {
        "Linda works - part time – in a shop": "Linda works - part time",
        "Linda votes. He said so. This is clear": "Linda votes. He said so",
        "***Linda*** x": "Linda x",
        "Linda: a teller": "Linda",
        "Linda is a teller and a voter: sure": "Linda is a teller and a voter: sure",
        "Linda (most likely) works": "Lindaworks",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.c for r in df.select("t", clean_entry(F.col("t")).alias("c")).collect()}
    assert got == cases


@pytest.mark.parametrize(
    "text,kind,value,strategy,confidence",
    [
        ("This isn't possible, they are incomparable.", "quantity", "incomparable", "keyword_incomparable", 0.86),
        ("They are not incomparable.", "quantity", None, "fallback", 0.1),
        ("no idea", "decimal", None, "decimal_fallback", 0.1),
        ("", "decimal", None, "empty", 0.0),
    ],
)
def test_comparison(spark, text, kind, value, strategy, confidence):
    df = spark.createDataFrame([(text, kind)], "raw string, kind string")
    params = {"comparison_type": F.col("kind"), "value1": F.lit("5"), "unit1_symbol": F.lit("kg"), "value2": F.lit("7"), "unit2_symbol": F.lit("g")}
    row = extract(df, "measure_comparison", "raw", params).first().answer
    assert (row.value, row.strategy, row.confidence) == (value, strategy, confidence)


@pytest.mark.parametrize(
    "task,strategy,confidence", [("carwash", "fallback", 0.1), ("inverted_cup", "fallback", 0.1), ("time_arithmetic", "none", 0.0), ("arithmetic", "failed", 0.0)]
)
def test_failure_labels(spark, task, strategy, confidence):
    row = extract(spark.createDataFrame([("zzz",)], "raw string"), task, "raw").first().answer
    assert (row.strategy, row.confidence) == (strategy, confidence)


def test_blank_label(spark):
    params = {"container_a": F.lit("box"), "container_b": F.lit("basket")}
    assert extract(spark.createDataFrame([(" ",)], "raw string"), "sally_anne", "raw", params).first().answer.strategy == "none"


def test_places(spark):
    df = spark.createDataFrame([("a1bb22c",), ("",), (None,)], "t string")
    assert [r.p for r in df.select(places(F.col("t"), "[0-9]+").alias("p")).collect()] == [[1, 4], [], []]
