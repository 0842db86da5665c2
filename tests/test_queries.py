"""Every registered query against its SQL, on the smallest test tables."""

import os

import pytest

from workload import EXPECTED, QUERIES
from workload.check import connect, differences

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables absent")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_query_agrees_with_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SF_DIR), duck, EXPECTED[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(EXPECTED)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry_is_the_flagship(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
