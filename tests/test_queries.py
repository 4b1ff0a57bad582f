"""Every query against its SQL twin on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry
from fleetlens.queries import QUERIES

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    fn = entry.queries()[name]
    if name not in SQL:
        assert fn(spark, SF).columns
        return
    ok, note = oracle.compare(spark, con, fn, SQL[name], SF)
    assert ok, note


def test_every_query_has_sql():
    assert sorted(set(SQL) & set(QUERIES)) == sorted(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
