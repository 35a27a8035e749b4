import pytest

from loomspan.plans import catalog
from tests.oracle import connect, rows

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    got = catalog.queries()[name](spark, sf).toPandas()
    want = connect(sf).execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_other_queries_run(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
