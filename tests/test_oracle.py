"""Every registered query against its SQL statement, and the contract of the entry module."""

import os

import pytest

import __spark_entry__ as contract
from gateflow.queries import QUERIES, SQL
from tests.conftest import SF
from tests.oracle import differences, duck

SF_DIR = os.environ.get("TEST_SF_DIR", SF)


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR).toPandas(), con.execute(SQL[name]).df()) == ""


@pytest.mark.parametrize("name", ["graph_svd", "graph_nmf", "weather_svd"])
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_contract(spark):
    assert contract.entry(spark).count() == 10 * 144
    assert set(contract.oracle_sql()) <= set(contract.queries())
