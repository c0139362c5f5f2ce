"""Every registered query against its SQL, row for row."""

import pytest

import __spark_entry__ as entry
from cohortlake import plans
from tests.oracle import connect, differences

QUERIES, SQL = plans.QUERIES, plans.ORACLES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    assert name in SQL
    assert differences(df, con, SQL[name]) == []


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["therapeutic_area", "trials", "avg_dropout"]
