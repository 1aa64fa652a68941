from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from tallymill.operators import matching
from tallymill.operators.matching import fuzzy_lookup


def bag(text):
    return frozenset(re.sub(r"[^\w\s]", "", (text or "").lower()).split())


@pytest.mark.parametrize("threshold", [0.34, 0.5, 0.7, 0.8, 1.0])
def test_equals_comparing_everything(spark, threshold):
    rng = random.Random(2)
    draw = lambda: " ".join(f"W{int(rng.paretovariate(0.6)) % 25}." for _ in range(rng.randrange(1, 9)))
    said = [draw() for _ in range(120)] + [None, "", "?!", "same words", "Words, SAME", "same words"]
    listed = [draw() for _ in range(150)] + [None, "", "words same"]
    rows = spark.createDataFrame([(k, t, "old") for k, t in enumerate(said)], "id int, text string, match string")
    got = fuzzy_lookup(rows, "text", spark.createDataFrame([(t,) for t in listed], "text string"), "text", threshold).collect()
    assert len(got) == len(said)
    for r in got:
        a, near = bag(r.text), []
        for t in {t for t in listed if bag(t)}:
            s = len(a & bag(t)) / len(a | bag(t))
            if a and s >= threshold - 1e-12:
                near.append((-s, t))
        assert r.n_matches == len(near)
        assert (r.match, r.similarity) == ((min(near)[1], -min(near)[0]) if near else (None, None))


def test_empty_sides(spark):
    some = spark.createDataFrame([(1, "a b")], "id int, text string")
    assert [tuple(r) for r in fuzzy_lookup(some, "text", some.limit(0), "text").collect()] == [(1, "a b", None, None, 0)]
    assert fuzzy_lookup(some.limit(0), "text", some, "text").count() == 0


def test_common_words_make_no_candidates(spark):
    """Sets that differ in one of few words: under single words every text met a large share of all others."""
    said = [(f"kind{k % 7} made of stuff{k % 11} in size {k % 13}",) for k in range(1001)]
    listed = [(f"kind{k % 7} made of stuff{k % 11} with size {k % 13}",) for k in range(1001)]
    chosen = matching._chosen(0.7)
    assert all(len(p) == 6 for a, b, p in chosen if a == b == 7)
    assert max(Counter((a, b) for a, b, _ in chosen).values()) <= matching.COMBINATIONS
    for a in range(1, 10):
        for b in range(1, 10):
            mine, theirs = ([set(p) for x, y, p in chosen if (x, y) == size] for size in ((a, b), (b, a)))
            assert bool(mine) == (min(a, b) / max(a, b) >= 0.7 - 1e-12) == bool(theirs)
    rows, entries = (spark.createDataFrame(x, "text string") for x in (said, listed))
    got = fuzzy_lookup(rows, "text", entries, "text", 0.7).collect()
    assert {(r.similarity, r.n_matches) for r in got} == {(0.75, 1)} and all(r.match == r.text.replace(" in ", " with ") for r in got)


def test_large_sets_meet_small_ones(spark):
    rng = random.Random(5)
    said = [" ".join(f"w{x}" for x in rng.sample(range(26), rng.randrange(10, 25))) for _ in range(150)]
    listed = [" ".join(f"w{x}" for x in rng.sample(range(26), rng.randrange(10, 25))) for _ in range(150)]
    rows, entries = (spark.createDataFrame([(t,) for t in x], "text string") for x in (said, listed))
    for r in fuzzy_lookup(rows, "text", entries, "text", 0.7).collect():
        near = [len(bag(r.text) & bag(t)) / len(bag(r.text) | bag(t)) for t in set(listed)]
        assert r.n_matches == sum(s >= 0.7 - 1e-12 for s in near)
