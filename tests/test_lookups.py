"""Look-ups in fixed lists, container names and ranking entries: what is not needed is not computed per row."""

import random

from pyspark.sql import functions as F

from tallymill.functions import lists, rules
from tallymill.functions.identity import looked_up, one_of
from tallymill.operators.extract import extract


def test_long_lists_are_hash_sets(spark):
    words = spark.range(3).select(F.when(F.col("id") > 0, F.concat(F.lit("w"), "id")).alias("w"))
    options = [f"w{i}" for i in range(2, 40)]
    df = words.select("w", one_of(F.col("w"), options).alias("m"), looked_up({o: o.upper() for o in options}, F.col("w")).alias("u"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan and "array_contains" not in plan
    assert [tuple(r) for r in df.orderBy("w").collect()] == [(None, None, None), ("w1", False, None), ("w2", True, "W2")]


def test_a_thing_that_is_not_named_makes_no_pattern(spark):
    """``\\E(`` ends the quoting of a name, so its pattern does not compile: only texts with the name may need one."""
    rows = spark.createDataFrame([("It moved.\nFound on the shelf it was", r"\E(")], "t string, o string")
    got = extract(rows, "object_tracking", "t", {"object": F.col("o")}).select("answer.value", "answer.strategy").first()
    assert tuple(got) == ("shelf", "sentence_pattern")


def test_number_words(spark):
    got = spark.createDataFrame([(" Seven. ",), ("nine hundred",), (None,)], "t string").select(rules.number_words(F.col("t"))).collect()
    assert [r[0] for r in got] == ["7", None, None]


def test_containers_by_name(spark):
    cases = [
        ("Answer: the box", "box", r"\E(", "box", "answer_pattern"),
        ("Surely she opens my red box", "red box", r"\E(", "red box", "direct_match"),
        ("box basket", "box", "basket", "box", "direct_match"),
        ("search a basket, **basket** or box. Or so she says it", "box", "basket", "basket", "bold_markdown"),
        ("nothing", "box", "basket", None, "fallback"),
        ("basket", None, "basket", "basket", "direct_match"),
        ("box", "box", None, None, "fallback"),
    ]
    rows = spark.createDataFrame([c[:3] for c in cases], "t string, a string, b string")
    out = extract(rows, "sally_anne", "t", {"container_a": F.col("a"), "container_b": F.col("b")})
    got = [tuple(r) for r in out.select("answer.value", "answer.strategy").collect()]
    assert got == [c[3:] for c in cases]


def near(a, b, threshold):
    x, y = set(a.split()), set(b.split())
    common = len(x & y)
    return a.replace(" ", "") == b.replace(" ", "") or common == min(len(x), len(y)) or common / len(x | y) > threshold


def test_distinct_entries(spark):
    rng = random.Random(1)
    data = []
    for _ in range(80):
        words = rng.sample([f"w{i}" for i in range(rng.choice([5, 18]))], 5 if rng.random() < 0.5 else 4)
        data.append([" ".join(rng.choices(words + ["xx", "y"] + [f"z{i}" for i in range(rng.choice([0, 25]))], k=rng.randint(2, 40))) for _ in range(6)])
    base = [f"v{i}" for i in range(20)]
    data += [[" ".join(base), " ".join(base[:-1] + ["other"]), " ".join(base[:-4] + ["a1", "a2", "a3", "a4"])]]
    for threshold in (0.85, 0.3, 1.0, 0.0):
        items = spark.createDataFrame([(d,) for d in data], "e array<string>")
        df = items.select(lists.distinct_entries(F.col("e"), threshold=threshold).alias("d"))
        # sets too small to overlap without one holding the other are not intersected
        assert "forall" in df._jdf.queryExecution().optimizedPlan().toString()
        for entries, got in zip(data, [r.d for r in df.collect()]):
            kept = []
            for e in entries:
                if len(e) >= 5 and not any(near(e, k, threshold) for k in kept):
                    kept.append(e)
            assert got == kept


def test_clean_entry(spark):
    cases = {"**A b** (likely)": "A b", "_C_ d": "C d", "__E__: Very likely": "E", "F (12)": "F", "G – h": "G", "I-possible j": "Ij", "K": "K", "* l": "* l"}
    rows = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in rows.select(lists.clean_entry(F.col("t"))).collect()] == list(cases.values())
