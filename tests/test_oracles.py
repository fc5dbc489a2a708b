"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest
from compare import compare, duck

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def connection(folder):
    return duck(folder)


# A fit of 300 boosted rounds: compare.py runs them, and unit tests hold node tables against the library.
LONG = {"forecast_boosted_residuals", "forecast_recursive_residuals"}
CORPUS = {n for n in oracle_sql() if n.startswith("op")}  # have their own tests


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - LONG - CORPUS))
def test_query_agrees_with_sql(spark, folder, connection, name):
    assert compare(queries()[name](spark, folder), connection, oracle_sql()[name]) == []


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1
