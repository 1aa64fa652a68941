"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from tallymill.llm import variants


def brute(rows, least=7):
    """All columns by the definitions, with an edit distance of every pair."""
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= least and k >= 2}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        a, b = sorted((a, b), key=len)
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[k:] == b[k + 1 :] or a[k + 1 :] == b[k + 1 :]

    out = {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 10 * n[w] else None
        out[w] = (form, n[w], len(others), n[form] if form else None)

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return {w: (f, root(w), k, near_n, m) for w, (f, k, near_n, m) in out.items()}


def answers(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def spoil(word, rng, letters):
    k = rng.randrange(len(word))
    return rng.choice((word[:k] + word[k + 1 :], word[:k] + rng.choice(letters) + word[k:], word[:k] + rng.choice(letters) + word[k + 1 :]))


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aàéÿz"])
def test_against_brute_force(make_docs, rng, letters):
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 14))) for _ in range(60)]
    pool = base + [spoil(w, rng, letters) for w in base for _ in range(3)]
    pool += [spoil(w, rng, letters) for w in pool[-60:]]
    rows = [(k, " ".join(rng.choice(pool) for _ in range(40))) for k in range(60)]
    rows += [(100 + k, (base[k] + " ") * 250) for k in range(8)]
    got = answers(variants.group(make_docs(rows)))
    assert got == brute(rows)
    assert any(v[0] for v in got.values())


def test_chains_are_followed_to_the_last(make_docs):
    rows = [(1, "xabcdefg " * 2000 + "xabcdefh " * 199 + "xabcdzfh " * 19), (2, "xabqdzfh " * 2)]
    got = answers(variants.group(make_docs(rows)))
    assert got == brute(rows)


def test_odd_rows(spark, make_docs):
    rows = [(None, "Repeated Repeated répétées"), (1, None), (2, ""), (3, "répétées répétées ÀÉÎÕÜß ÀÉÎÕÜß ÀÉÎÕÜßa ÀÉÎÕÜßa"), (3, "short words do not count"), (4, "a" * 3000 + " " + "a" * 3000), (4, "a" * 3000 + " " + "a" * 2999 + "b")]
    docs = make_docs(rows)
    assert answers(variants.group(docs)) == brute(rows)
    clash = docs.selectExpr("*", "1 as word", "2 as n", "3 as key", "4 as form", "5 as _run", "6 as place")
    assert answers(variants.group(clash)) == brute(rows)
    assert variants.group(make_docs([])).collect() == []
    assert variants.group(make_docs([(1, "few short ones")])).collect() == []
    assert isinstance(variants.group(docs).schema["form_n"].dataType, T.LongType)
    with pytest.raises(ValueError):
        variants.group(docs, least_length=3)


def test_pivots_are_disjoint_and_cheapest():
    """The dynamic program against all pairs of disjoint bigrams of a word."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        size = int(rng.integers(3, 9))
        place = np.sort(rng.choice(12, size, replace=False))
        cost = rng.integers(1, 50, size).astype(float)
        chosen = np.flatnonzero(variants.pivots(np.zeros(size, np.int64), place, cost))
        pairs = [cost[i] + cost[j] for i in range(size) for j in range(i) if place[i] - place[j] >= 2]
        assert len(chosen) == 2 and place[chosen[1]] - place[chosen[0]] >= 2
        assert cost[chosen].sum() == min(pairs)
