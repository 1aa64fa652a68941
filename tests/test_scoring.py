"""Single values and the verdicts they must get."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallymill.functions import fields, identity, text
from tallymill.operators import assemble, score


@pytest.fixture(scope="module")
def one(spark):
    """Value of a column built from literals."""
    return lambda col: spark.range(1).select(col.alias("v")).first()["v"]


def L(value):
    return F.lit(value)


def label(one, verdict):
    row = one(verdict)
    return row["match_type"], row["correct"]


@pytest.mark.parametrize(
    "p, e, want",
    [
        ("5", "5.0", ("exact", True)),
        ("0.0000000001", "0", ("approximate", True)),
        ("6", "5", ("mismatch", False)),
        ("x", "5", ("conversion_error", False)),
        (None, "5", ("parse_error", False)),
        ("5", None, ("error", False)),
    ],
)
def test_numeric(one, p, e, want):
    assert label(one, score.score_numeric(L(p).cast("string"), L(e).cast("string"))) == want


@pytest.mark.parametrize(
    "p, e, want, accuracy",
    [
        ("Bob", "Bob", "exact", 1.0),
        ("bob", "Bob", "case_insensitive", 1.0),
        ("5.05", "5.0", "numeric_tolerance", 1.0),
        ("5.5", "5.0", "numeric_mismatch", 0.0),
        ("it is Bob", "Bob", "partial_contains", 0.8),
        ("Bo", "Bob", "partial_subset", 0.6),
        ("Al", "Bob", "mismatch", 0.0),
    ],
)
def test_graded(one, p, e, want, accuracy):
    row = one(score.score_graded_text(L(p), L(e)))
    assert (row["match_type"], row["accuracy"]) == (want, accuracy)


def test_cells(one):
    a, b = [1, 0, 1, 0, 1, 0, 1, 0], [1, 0, 1, 0, 1, 0, 1, 1]
    row = one(score.score_cells(L(a), L(b)))
    assert (row["match_type"], row["correct_cells"], row["raw_accuracy"], row["accuracy"]) == ("partial", 7, 0.875, 0.75)
    assert label(one, score.score_cells(L([1, 0]), L(a))) == ("length_mismatch", False)
    assert label(one, score.score_cells(L([*a, 1, 1]), L(a))) == ("exact", True)
    assert label(one, score.score_cells(L(None).cast("array<int>"), L(a))) == ("parse_error", False)


def test_ranking_polarity(one):
    rank = F.array(L("Linda is a bank teller and active in the feminist movement"), L("Linda is a bank teller"), L("Linda paints"))
    items = [L("Linda is a bank teller and active in the feminist movement"), L("Linda is a bank teller"), L("Linda is a feminist")]
    assert one(score.score_ranking(rank, *items))["conjunction_rank"] == 1
    legacy = one(score.score_ranking_legacy(rank, *items, L(3.0)))
    assert legacy["match_type"] == "fallacy_detected" and legacy["correct"]


@pytest.mark.parametrize("t, m", [("2:05 PM", 845), ("12:00 am", 0), ("23.59", 1439), ("13:00 pm", None), ("25:00", None), ("soon", None)])
def test_clock(one, t, m):
    assert one(score.clock_minutes(L(t))) == m


def test_clock_wraps_at_midnight(one):
    assert one(score.clocks_match(L("23:59"), L("12:00 AM")))
    assert not one(score.clocks_match(L("23:57"), L("12:00 AM")))


def test_evidence(one):
    plain = L("the quick brown fox jumps over it")
    assert one(score.evidence_ngram(L("I saw the QUICK brown fox"), plain))
    assert not one(score.evidence_ngram(L("a quick fox"), plain))


def test_task_type_traps(one):
    tid = L("multi_0001_time_arithmetic")
    assert one(identity.task_type_from_id(tid)) == "time_arithmetic"
    assert one(identity.task_type_from_id(tid, legacy=True)) == "arithmetic"
    assert one(identity.task_type_from_id(L("symbol_arithmetic_12_3"))) == "symbol_arithmetic"
    assert one(identity.task_type_from_id(L("multi_1_gol"))) == "game_of_life"
    assert one(identity.task_type_from_id(L("something"))) == "unknown"


@pytest.mark.parametrize(
    "params, want",
    [
        ('{"expected_answer": 0}', "0"),
        ('{"expected_answer": false}', "false"),
        ('{"expected_next_state": [[1, 0], [0, 1]]}', "1 0 | 0 1"),
        ('{"expected_state": [1, 0]}', "1 0"),
        ('{"expected_answer": null, "expected_fallacy": "x"}', "x"),
        ("{}", "N/A"),
    ],
)
def test_expected_display(one, params, want):
    assert one(fields.expected_display(L(params))) == want


def test_thinking(one):
    row = one(fields.thinking_split(L("<think>a\nb</think>\n c "), L(None).cast("string")))
    assert (row["thinking"], row["clean"]) == ("a\nb", "c")
    row = one(fields.thinking_split(L(" c "), L(None).cast("string")))
    assert (row["thinking"], row["clean"]) == (None, " c ")


def test_verification_tail(one):
    assert one(text.strip_verification_tail(L("It is 5.\n\n**Verification:** 3+2"))) == "It is 5."
    assert one(text.strip_verification_tail(L("Let's verify: 5"))) == "Let's verify: 5"
    assert one(text.strip_verification_tail(L("It is 5."))) == "It is 5."


def test_last_sentences(one):
    assert one(text.last_sentences(L("A b. C d! E 1.5 f? G"), 2)) == ["E 1.5 f?", "G"]


@pytest.mark.parametrize("s, n", [("4.7 GB", 5046586572), ("3 xb", 3), ("junk", 0), ("1 2 3", 0)])
def test_parse_size(one, s, n):
    assert one(identity.parse_size(L(s))) == n


def test_morse_and_caesar(one):
    assert one(assemble.to_morse(L("Hi, you 2"))) == ".... .. / -.-- --- ..- / ..---"
    assert one(assemble.from_morse(L(".... .. / -.-- --- ..-"))) == "HI YOU"
    assert one(assemble.caesar(assemble.caesar(L("Abc xyz!"), 5), -5)) == "Abc xyz!"


def test_units(one):
    c = assemble.compare_quantities
    assert one(c(L(0.0), L("°C"), L(32.0), L("°F"))) == "equal"
    assert one(c(L(1.0), L("mi"), L(1.0), L("km"))) == "first"
    assert one(c(L(1.0), L("kg"), L(1.0), L("m"))) == "incomparable"


def test_dates(one):
    assert one(assemble.date_label(L("2023-2-29"))) == "impossible"
    assert one(assemble.date_label(L("2024-2-29"))) == "valid"
    assert [one(assemble.is_leap_year(L(y))) for y in (1900, 2000, 2023, 2024)] == [False, True, False, True]


def test_config_hash_is_order_free(one):
    import hashlib
    import json

    fields_ = {"b": L("x"), "raw:a": L(3)}
    want = hashlib.sha256(json.dumps({"a": 3, "b": "x"}, sort_keys=True).encode()).hexdigest()[:16]
    assert one(assemble.config_hash(fields_)) == want
