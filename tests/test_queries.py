import pytest

import __spark_entry__
from tests.oracle import connected, same

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connected(SF)


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_agrees_with_its_sql(spark, db, name):
    assert same(spark, db, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name], SF) > 0


def test_every_sql_has_a_query_and_the_entry_runs(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
