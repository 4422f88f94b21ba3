"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from merchantry import cases
from tests.oracle import DATA, compare, connect

SF = str(DATA / "sf0.001")
KEYS = set(cases.load())
QUERIES = {key: run for key, run in entry.queries().items() if key in KEYS}
ORACLE = {key: sql for key, sql in entry.oracle_sql().items() if key in KEYS}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, key):
    problem, _ = compare(QUERIES[key](spark, SF), duck, ORACLE[key])
    assert problem is None, problem
