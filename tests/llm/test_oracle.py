import pytest

from tests.compare import same
from tests.conftest import DATA
from tickloom.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name, sf):
    same(queries.queries()[name](spark, f"{DATA}/{sf}"), SQL[name], f"{DATA}/{sf}")
