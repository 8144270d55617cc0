import pytest

from plumbline.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    compare(spark, connect(sf), sf, QUERIES[name], ORACLE_SQL[name])
