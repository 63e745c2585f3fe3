"""Every registered query with oracle SQL equals it on a small scale."""

import os

import pytest

from codelore.plans import registry
from tests.oracle import connect, difference

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.collect(registry.MODULES)


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF), duck, ORACLES[name]) == ""


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()
