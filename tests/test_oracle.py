"""Every registered query with a SQL counterpart gives the same rows on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect
from tests.conftest import make_session

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")

make_session()  # the stop lists in the SQL come from the session
ORACLES = entry.oracle_sql()
OWN = set(entry.QUERIES)  # the llm folder has tests of its own


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(OWN & set(ORACLES)))
def test_same_rows(spark, con, name):
    assert compare(spark, con, SF_DIR, entry.queries()[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(OWN - set(ORACLES)))
def test_runs(spark, name):
    df = entry.queries()[name](spark, SF_DIR)
    assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
