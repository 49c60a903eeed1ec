"""The registered queries of the subpackage against their SQL."""

import os

import pytest

from sitegauge.llm.queries import ORACLES, QUERIES

from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test data absent")
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF) is None
