"""The registered queries against their SQL on the driver's tables."""

import os

import pytest

from provender.llm import queries
from tests.oracle import compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    assert compare(spark, SF, queries.QUERIES[name], queries.ORACLES[name]) > 0
