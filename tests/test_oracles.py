"""Every query with SQL against that SQL on the driver's tables."""

import os

import pytest

from provender.registry import ORACLES, QUERIES
from tests.oracle import compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    compare(spark, SF, QUERIES[name], ORACLES[name])


def test_each_query_has_rows(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, SF).count() > 0, name
