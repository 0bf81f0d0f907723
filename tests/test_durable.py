import pytest
from pyspark.sql import functions as F

from voxmill import durable
from voxmill.ordered import handed_on


@pytest.mark.parametrize("how", ["inner", "left"])
def test_both_ways_of_a_measured_join_agree(spark, how):
    rows = spark.range(3000).select((F.col("id") % 7).alias("k"), "id")
    small = spark.createDataFrame([(i, f"v{i}") for i in range(5)] + [(99, None)], "k bigint, v string")
    want = sorted((r.k, r.id, r.v) for r in rows.join(small, "k", how).collect() if r.v or how == "left")
    for limit in (durable.BROADCAST_BYTES, 0):
        joined = durable.sized_join(rows, small, ["k"], how, limit)
        assert sorted((r.k, r.id, r.v) for r in joined.collect()) == want
        assert ("__salt" in joined._jdf.queryExecution().optimizedPlan().toString()) == (limit == 0)
    assert durable.size_of(small) == 6 * 32 + 10 and durable.size_of(small.where("false")) == 0


def test_what_ranges_hand_on():
    merge = lambda a, b: (a[0] + b[0],)
    states = [(0, ("a",), ("b",), (1,)), (2, ("b",), ("b",), (10,)), (3, ("b",), ("b",), (100,)), (4, ("c",), ("c",), (5,)), (7, ("c",), ("d",), (7,))]
    given, goes_on = handed_on(states, merge)
    assert given == {2: (("b",), (1,)), 3: (("b",), (11,)), 7: (("c",), (5,))} and goes_on == {0, 2, 4}
    assert handed_on([], merge) == ({}, set())


def test_checkpoints_are_in_the_folder_of_the_session(spark):
    folder = durable.ensure_checkpoint_dir(spark)
    assert folder and durable.ensure_checkpoint_dir(spark) == folder
    assert durable.durable(spark.range(10)).count() == 10
