"""Every registered query against its SQL, or at least for rows, on the smallest tables."""

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry
from tablewright.catalog import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n != "train_until_ready"))
def test_query(spark, con, name):
    _, difference = compare(spark, con, SF_DIR, name)
    assert not difference


def test_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert entry.queries().keys() >= QUERIES.keys()


def test_entry(spark):
    rounds = entry.entry(spark).collect()
    assert rounds[-1]["readiness"] == "ready"
    assert rounds[-1]["r2"] > 0.3
