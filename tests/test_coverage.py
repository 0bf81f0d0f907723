import random

import pytest
from pyspark.sql import functions as F

from voxmill.operators import coverage

COLS = "source_id string, chunk_idx int, speaker string, s bigint, e bigint"


def spec(rows):
    by = {}
    for *key, s, e in rows:
        by.setdefault(tuple(key), []).append((s, e))
    out = set()
    for key, own in by.items():
        merged = []
        for s, e in sorted(own):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(*key, "period", a, b) for a, b in merged} | {(*key, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("parts, width", [(1, 60_000), (3, 1_000), (17, 7), (40, 100)])
def test_equals_a_plain_spec_over_any_number_of_ranges(spark, parts, width):
    rng = random.Random(parts)
    rows = [("hot", 0, "A", s, s + rng.choice([1, 5, 40, 300, 20_000])) for s in (rng.randint(-50_000, 2_000_000) for _ in range(3000))]
    rows += [(rng.choice(["x", None, ""]), rng.choice([1, None]), rng.choice("AB"), s, s + rng.randint(1, 900)) for s in (rng.randint(0, 30_000) for _ in range(600))]
    rows += rows[:50]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        got = [tuple(r) for r in coverage.periods_and_gaps(spark.createDataFrame(rows, COLS).repartition(5), width=width).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(set(got)) and set(got) == spec(rows)


def test_one_very_long_interval_leaves_the_others_sharded(spark):
    rows = [("hot", 0, "A", i * 2000, i * 2000 + 1500) for i in range(20_000)]
    long = [("other", 0, "B", 0, 10**12), ("hot", 0, "A", 10**9, 10**9 + 10**7)]
    df = spark.createDataFrame(rows + long, COLS)
    assert set(map(tuple, coverage.periods_and_gaps(df).collect())) == spec(rows + long)
    local = coverage.merged_in_shards(df, ["source_id", "chunk_idx", "speaker"])
    # a long interval gives three rows, and the hot speaker's shards are those that it has without them
    assert local.where("source_id = 'other'").count() <= 3
    shards = lambda d: d.where("source_id = 'hot' AND s < 999000000").select(F.expr("s div 60000")).distinct().count()
    assert shards(local) == shards(coverage.merged_in_shards(spark.createDataFrame(rows, COLS), ["source_id", "chunk_idx", "speaker"])) == 667


def test_rows_that_count(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("a", 0, " x ", 0.0, 1.0), ("a", 0, "X", 1.0, 2.0), ("a", 0, None, 0.0, 1.0), ("a", 0, " ", 0.0, 1.0), ("a", 0, "x", nan, 1.0), ("a", 0, "x", None, 1.0), ("a", 0, "x", 5.0, 5.0004), ("a", 0, "x", 7.0, 6.0), ("b", 0, "y", 3.0, inf), ("b", 0, "y", -inf, 1.0)]
    df = spark.createDataFrame(rows, "source_id string, chunk_idx int, speaker string, start double, end double").withColumn("kind", F.lit("clash"))
    got = {(r.source_id, r.speaker, r.kind, r.start_ms, r.end_ms) for r in coverage.speech_periods(df).collect()}
    most = int(coverage.MOST_MS)
    assert got == {("a", "X", "period", 0, 2000), ("b", "Y", "period", -most, 1000), ("b", "Y", "gap", 1000, 3000), ("b", "Y", "period", 3000, most)}
    assert coverage.speech_periods(df.where("false")).count() == 0
