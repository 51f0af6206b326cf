"""Registered queries against their SQL on the smallest data set, and on a larger one where ties and
repeated keys occur only there."""

import pytest
from check_queries import compare, connect

import __spark_entry__ as entry
from fixtures import catalog

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TIES = ("upsert_latest", "upsert_runs", "duplicate_flag", "duplicate_links", "stream_first", "resolve_hot_vendor", "vendor_master_match")
QUERIES, ORACLES = {n: q for n, q in entry.queries().items() if n in catalog.QUERIES}, catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name)) is None


@pytest.mark.parametrize("name", TIES)
def test_query_with_ties(spark, name):
    assert compare(spark, connect(LARGER), LARGER, name, QUERIES[name], ORACLES[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
