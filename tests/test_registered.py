"""Every registered query against its SQL twin on the smallest test tables."""

import pytest

import __spark_entry__ as driver
from checks.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(driver.registry.QUERIES))
def test_query(spark, connection, name):
    frame = driver.queries()[name](spark, SF_DIR)
    sql = driver.oracle_sql().get(name)
    if sql is None:
        assert frame.count() > 0
    else:
        assert compare(frame, connection, sql) is None


def test_entry(spark):
    assert driver.entry(spark).count() == 20


def test_every_query_has_a_twin():
    assert set(driver.registry.QUERIES) == set(driver.registry.ORACLES)
