import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from oracle import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_its_sql(spark, con, name):
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert entry.queries()[name](spark, SF).count() > 0
    else:
        assert compare(spark, con, entry.queries()[name], sql, SF) is None


def test_entry_counts(spark):
    row = entry.entry(spark).first()
    assert tuple(row) == (18, 167, 167, 107, row.n_fr, 73, 73)
