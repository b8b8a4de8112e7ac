import pytest
from oracle import compare, connect

from tamizal.plans import catalog


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, data, duck):
    df = catalog.QUERIES[name](spark, data)
    if name in catalog.ORACLES:
        assert compare(df, duck, catalog.ORACLES[name]) is None
    else:
        df.count()


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
