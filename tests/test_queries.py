import pytest

import __spark_entry__
from plumbline.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, compare


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, con, sf, name):
    compare(spark, con, sf, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted({*QUERIES} - {*ORACLE_SQL}))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1
    assert {*QUERIES} <= {*__spark_entry__.queries()} and {*__spark_entry__.oracle_sql()} <= {*__spark_entry__.queries()}
