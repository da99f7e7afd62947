"""Every query that has SQL gives the rows of that SQL."""

from __future__ import annotations

import pytest
from conftest import rows_of

from tidegauge.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, small, duck, name):
    got = QUERIES[name](spark, small).toPandas()
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
