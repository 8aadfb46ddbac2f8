"""Every query with SQL gives the rows of its SQL; the others run."""

import pytest

from tests.compare import connect, difference
from tideline.plans.oracle import ORACLE_SQL
from tideline.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert difference(df, con, ORACLE_SQL[name]) == ""
    else:
        assert df.count() > 0


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_comparison_can_fail(spark, con):
    assert difference(spark.sql("select 1 as a"), con, "SELECT 2 AS a")
