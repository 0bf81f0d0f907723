import pytest

from oracle import differences
from voxmill.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_sql_agree(spark, name):
    assert differences(spark, queries.queries()[name], SQL[name], "/root/testdata/sf0.001") == ""


def test_every_registered_query_is_known():
    import __spark_entry__

    assert set(SQL) <= set(queries.queries()) <= set(__spark_entry__.queries())
