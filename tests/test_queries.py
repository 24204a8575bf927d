import pytest
from oracle import DATA, assert_same

from tensorloom import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, QUERIES[name], SQL[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 500
    assert QUERIES.keys() <= __spark_entry__.queries().keys()
    assert DATA
