import pytest
from comparing import assert_same

from marlstone.edge_oracles import SQL
from marlstone.edge_queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert_same(df, SQL[name], SF)
    else:
        assert df.count() > 0


def test_every_query_has_its_sql():
    assert set(SQL) == set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
