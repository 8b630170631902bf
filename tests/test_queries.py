"""Every registered query against its DuckDB text on the smallest tables."""

import pytest

import __spark_entry__ as entry
from cellselect.plans import load
from compare import compare, duck
from conftest import SMALL

QUERIES, ORACLES = load()  # the optional subpackage has its own tests


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SMALL)
    assert not result.startswith(("FAIL", "EMPTY")), result


def test_oracle_keys_are_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"r11_approx_knn"}


def test_entry(spark):
    assert entry.entry(spark).count() == 500
