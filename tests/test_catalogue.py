import pytest

from tests.compare import duck_rows, same
from tests.conftest import DATA
from tickloom.plans import catalogue

Q, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name, sf):
    same(Q[name](spark, f"{DATA}/{sf}"), SQL[name], f"{DATA}/{sf}")


def test_every_query_has_sql():
    assert set(Q) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_no_query_is_vacuous(name):
    """Every query has rows at sf0.01, and no column is null in all of them; where there are several rows, flags and counts aren't all the same."""
    names, rows = duck_rows(SQL[name], f"{DATA}/sf0.01")
    assert rows, name
    for k, c in enumerate(names):
        assert any(r[k] is not None for r in rows), (name, c)
        if len(rows) > 20 and all(isinstance(r[k], bool) for r in rows):
            assert len({r[k] for r in rows}) == 2, (name, c)
