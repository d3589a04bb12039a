import pytest

from docloom.llm import queries
from tests.oracle import connect, same

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, con, name):
    same(spark, con, queries.QUERIES[name], queries.ORACLES[name], SMALL)
