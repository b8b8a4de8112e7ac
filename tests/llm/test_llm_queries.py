import pytest
from oracle import compare, connect

from tamizal.llm import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, duck):
    df = QUERIES[name](spark, data)
    if name in ORACLES:
        assert compare(df, duck, ORACLES[name]) is None
    else:
        df.count()
