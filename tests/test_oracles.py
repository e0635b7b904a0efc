"""Every registered query against its SQL on the small tables."""

import pytest
from compare import compare, duck

import __spark_entry__ as contract

from queries import catalog

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, con, sf_dir, name):
    problem, _, _ = compare(spark, con, sf_dir, name, QUERIES[name], ORACLES.get(name))
    assert not problem, problem


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
