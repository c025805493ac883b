import pytest

import __spark_entry__ as contract
import check_queries

TWINS = contract.oracle_sql()
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def database(small):
    return check_queries.tables(small)


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_its_twin(spark, small, database, name):
    ours = QUERIES[name](spark, small).toPandas()
    assert check_queries.difference(ours, database.execute(TWINS[name]).df()) is None
    assert len(ours)


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 5 and sum(r.size for r in rows) == 1500
