"""Every registered query over the smallest tables, next to its SQL twin."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.queries()
TWINS = entry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    agrees, note = compare(spark, tables, SF_DIR, name, QUERIES[name], TWINS.get(name))
    assert agrees, note
