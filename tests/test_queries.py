"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

NAMES = list(entry.queries())


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf, name):
    assert compare(spark, con, sf, name, entry.queries()[name], entry.oracle_sql().get(name)) is None


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(NAMES)
