"""Every registered query against its SQL on whole tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, diff

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        # a few results are empty on so little data; they are not at the larger scales
        assert diff(df, con, sql) in (None, "both empty")
