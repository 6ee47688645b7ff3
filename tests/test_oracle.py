"""Every query of the array and catalog operators against its SQL, on the smallest tables."""

import pytest

import oracle
from __spark_entry__ import entry
from cellfold import checks

QUERIES, SQL = checks.load()


@pytest.fixture(scope="module")
def db(data):
    return oracle.connection(data)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, db, name):
    assert oracle.compare(spark, db, QUERIES[name], SQL[name], data) is None


def test_entry(spark):
    assert entry(spark).columns == ["series", "bucket", "slot", "pos", "v"]
