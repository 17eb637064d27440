"""Every registered query against its SQL."""

import pytest

from quadrel import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, compare):
    compare(QUERIES[name], SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(plans.queries()) <= set(entry.queries())
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert entry.entry(spark).count() == events.selectExpr("user_id % 20").distinct().count() > 0
