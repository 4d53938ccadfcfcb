"""Every registered query with SQL gives the rows of that SQL."""

import pytest

from vaakya import catalog

from .oracle import rows_of, rows_of_sql

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    expected = rows_of_sql(catalog.oracle_sql()[name], SMALL)
    assert rows_of(catalog.queries()[name](spark, SMALL)) == expected
    assert expected[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
