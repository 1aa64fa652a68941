"""Offsets of matches against the standard library's, on texts of any number of matches."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tallymill.functions import text

TEXTS = ["", "a", "walk", "no", "walk walk", " walk" * 63, "walk " * 64, "x walk" * 65, "walk.\nwalk" * 200, "walk" * 300]


@pytest.mark.parametrize("pattern", [r"\bwalk\b", "walk", "wal(?=k)|o"])
def test_places(spark, pattern):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    out = rows.select("i", text.places(F.col("t"), pattern).alias("at"), text.last_start(F.col("t"), [pattern, "zzz"]).alias("last")).collect()
    for i, at, last in out:
        want = [m.start() for m in re.finditer(pattern, TEXTS[i])]
        assert (at, last) == (want, max(want, default=-1)), TEXTS[i][:20]
