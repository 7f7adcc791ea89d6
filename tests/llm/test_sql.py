import pytest

from tallyweave.llm.queries import QUERIES
from tallyweave.llm.sql import ORACLE

from ..compare import database, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf, name):
    assert spark_rows(QUERIES[name](spark, sf)) == sql_rows(database(sf), ORACLE[name])
