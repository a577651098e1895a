import pytest
from fixtures import SF_DIR
from oracle_check import compare, connect

from hushlog.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, QUERIES[name], SQL[name]) is None
