"""Registered queries against their SQL at the smallest scale."""

import os

import pytest

from sitegauge.queries import ORACLES, QUERIES

from oracle import compare, connect

SF = "/root/testdata/sf0.001"
# the two keyword queries multiply every text with every keyword on the SQL side; one of them is enough here
NAMES = [n for n in ORACLES if n != "classification"]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test data absent")
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF) is None


def test_every_query_is_registered_once():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 70
