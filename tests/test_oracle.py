import pytest

from tallyweave.plans.oracle import ORACLE
from tallyweave.plans.queries import QUERIES

from .compare import database, spark_rows, sql_rows


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sf, con, name):
    assert spark_rows(QUERIES[name](spark, sf)) == sql_rows(con, ORACLE[name])
