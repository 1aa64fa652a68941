from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from a list of texts, or of (id, text)."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        return spark.createDataFrame([(k, t, None, "s", None if t is None else len(t)) for k, t in rows], DOCS)

    return make


@pytest.fixture
def rng():
    return random.Random(11)
