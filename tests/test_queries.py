"""Every registered query beside its SQL, on the smallest data."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
from tidewatch.plans.catalog import QUERIES
from tidewatch.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    problem, *_ = compare(spark, con, sf_dir, name, QUERIES[name], ORACLES.get(name))
    assert problem is None


def test_entry(spark):
    df = entry.entry(spark)
    assert "prediction" in df.columns and df.count() > 0
