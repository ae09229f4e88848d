"""Every registered query against its oracle on DuckDB, over the smallest provided tables."""

import pytest
from compare import compare, oracle_connection

from __spark_entry__ import entry, oracle_sql, queries
from skyledger.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle_connection(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, sf_dir, name):
    ok, text = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf_dir)
    assert ok, text


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_all_are_offered():
    assert QUERIES.items() <= queries().items() and ORACLES.items() <= oracle_sql().items()


def test_entry_runs(spark):
    assert entry(spark).count() > 0
