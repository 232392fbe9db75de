"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_query_of_the_suite_has_a_twin():
    assert set(entry.suite.QUERIES) == set(entry.suite.ORACLES)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    problems, rows, _, _ = oracle.compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert not problems
    assert rows > 0
