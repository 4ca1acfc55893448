import pytest

from filewright import histories as queries
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, con, name):
    assert differences(spark, queries.QUERIES[name], queries.ORACLES[name], SF, con) == ""


def test_every_query_has_its_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)
