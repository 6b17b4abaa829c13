import pytest

from tests.oracle import compare, connect
from tidefold.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    compare(spark, connect(SF), queries.QUERIES[name], queries.ORACLE_SQL[name], SF)
