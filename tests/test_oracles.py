import pytest

from oracle import differences
from voxmill import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_and_sql_agree(spark, name):
    assert differences(spark, queries.queries()[name], SQL[name], "/root/testdata/sf0.001") == ""
