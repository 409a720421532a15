"""Registered queries beside their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect
from oracle import ORACLE
from segue.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_registry_is_complete():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    verdict, n, _, _, note = compare(spark, con, SF, name)
    assert verdict in ("equal", "rows only") and n > 0, note


def test_entry(spark):
    assert entry.entry(spark).columns == ["key", "id", "score", "title", "artist", "album_id", "threshold"]
