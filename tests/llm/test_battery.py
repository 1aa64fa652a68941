"""The randomness battery against plain Python."""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallymill.llm import secrets


def upper(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def score(token):
    token = token.replace("=", "").translate(str.maketrans("-_", "+/"))
    alphabet = next(a for p, a in secrets.ALPHABETS if re.search(p, token))
    k, n, x = len(alphabet), len(token), [alphabet.index(c) for c in token]
    chi = max(sum(c * c for c in Counter(x).values()) * k / n - n, 0.0)
    spread = 2 / (9 * (k - 1))
    uniform = upper(((chi / (k - 1)) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))
    above = [2 * v >= k for v in x]
    high, runs = sum(above), 1 + sum(a != b for a, b in zip(above, above[1:]))
    both = 2 * high * (n - high)
    wide = math.sqrt(max(both * (both - n) / (n * n * (n - 1)), 0.0))
    of_runs = 2 * upper(abs(runs - both / n - 1) / wide) if wide else 0.0
    total, variance = sum(x), n * sum(v * v for v in x) - sum(x) ** 2
    serial = 0.0
    if variance > 0:
        r = (n * sum(a * b for a, b in zip(x, x[1:] + x[:1])) - total * total) / variance
        serial = 2 * upper(abs(r + 1 / (n - 1)) * (n - 1) * math.sqrt(n - 2) / n)
    return min(1.0, 3 * min(uniform, of_runs, serial))


@pytest.mark.parametrize("alphabet", [string.digits, "0123456789abcdef", "0123456789ABCDEF", string.ascii_uppercase + "234567", string.ascii_letters + string.digits + "-_", "etaoinshrdlu", "ab"])
def test_battery(spark, alphabet):
    rng = random.Random(8)
    tokens = ["".join(rng.choices(alphabet, k=rng.randint(20, 90))) + rng.choice(["", "="]) for _ in range(120)]
    df = spark.createDataFrame([(t,) for t in tokens], "t string")
    least = 1 / secrets.BINS
    for r in df.select("t", secrets.battery(F.col("t")).alias("p")).collect():
        want = score(r.t)
        assert (r.p < least and want < least + 1e-6) or r.p == pytest.approx(want, abs=1e-5)
