"""The older ranking score: items that are the same for all rows are made ready once, and word sets only meet where they could be like."""

from pyspark.sql import functions as F

from tallymill.functions.text import word_list
from tallymill.operators.score import fuzzy_match, score_ranking_legacy

ITEMS = ["Linda is a bank clerk and an active voter", "Linda works as bank clerk", "Votes in every election"]


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain("extended")
    return capsys.readouterr().out.split("== Physical Plan ==")[1]


def test_fixed_items_are_made_once(spark, capsys):
    rows = spark.createDataFrame([(["a"],)], "r array<string>")
    plan = plan_of(rows.select(score_ranking_legacy(F.col("r"), *map(F.lit, ITEMS), F.lit(3.0))), capsys)
    assert "[linda,is,a,bank,clerk,and,an,active,voter]" in plan and "array_union" not in plan


def test_ranks_of_rows(spark):
    both, a, b = ITEMS
    cases = [
        ([both, "**Linda works as\tbank clerk**", "votes in every election!"], ("fallacy_detected", 1.0, 0.5)),
        (["votes in every election!", a.upper(), both], ("no_fallacy", 1.0, 0.0)),
        ([both, "zzz", None, b], ("fallacy_detected", 1.0, 1.0)),
        ([both, b, both], ("no_fallacy", 1.0, 0.0)),  # the last place counts
        (["works as bank clerk", b], ("no_fallacy", 2 / 3, 0.0)),
        ([both], ("no_fallacy", 1 / 3, 0.0)),
        ([], ("parse_error", 0.0, 0.0)),
        (None, ("parse_error", 0.0, 0.0)),
    ]
    rows = spark.createDataFrame([(k, r, both, a, b) for k, (r, _) in enumerate(cases)], "k int, r array<string>, c string, a string, b string")
    for items in (("c", "a", "b"), tuple(map(F.lit, ITEMS))):
        columns = [F.col(x) if isinstance(x, str) else x for x in items]
        got = {x.k: x for x in rows.select("k", score_ranking_legacy(F.col("r"), *columns, F.lit(3.0)).alias("v")).select("k", "v.*").collect()}
        for k, (_, (label, quality, confidence)) in enumerate(cases):
            assert (got[k].match_type, got[k].ranking_quality, got[k].confidence) == (label, quality, confidence)


def test_words_and_likeness(spark):
    rows = spark.createDataFrame([(" a\tb\r\n c\x0bc ", "B a, c!"), ("", ""), ("..", "!!"), ("a b c d e f g", "a b c d e x y"), (None, "a")], "a string, b string")
    got = rows.select(word_list(F.col("a")).alias("w"), fuzzy_match(F.col("a"), F.col("b")).alias("m")).collect()
    assert [r.w for r in got] == [["a", "b", "c", "c"], [], [".."], list("abcdefg"), None]
    assert [r.m for r in got] == [True, False, True, False, False]
