import random

import numpy as np
import pytest

from voxmill.llm import cutoffs, percentiles
from voxmill.llm.queries import queries

COLS = "source string, metric string, value double"
INF = float("inf")


def spec(rows, ps=percentiles.PERCENTILES):
    by = {}
    for s, m, v in rows:
        by.setdefault((s, m), []).append(v)
    out = {}
    for k, v in by.items():
        v = sorted(v)
        for p in ps:
            h = p * (len(v) - 1)
            a, b = v[int(h)], v[int(np.ceil(h))]
            out[(*k, p)] = (len(v), a if a == b or h == int(h) or a == -INF else b if b == INF else a + (b - a) * (h - int(h)))
    return out


@pytest.mark.parametrize("parts", [1, 5, 33])
def test_a_hot_group_over_many_ranges(spark, parts):
    rng = random.Random(parts)
    rows = [("hot", "m", rng.choice([rng.random(), 0.25, -3.0])) for _ in range(4000)] + [(f"s{i % 40}", "n", rng.gauss(0, 9)) for i in range(900)] + [("one", "m", 7.0), ("", "m", -INF), ("", "m", INF), ("", "m", 1.0)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = {(r.source, r.metric, r.p): (r.n, r.value) for r in percentiles.exact_percentiles(spark.createDataFrame(rows, COLS)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = spec(rows)
    assert got.keys() == want.keys()
    for k, (n, v) in want.items():
        assert got[k][0] == n and (got[k][1] == v or abs(got[k][1] - v) < 1e-9), k


def test_runs_and_summaries_of_days_combine(spark):
    rng = random.Random(3)
    rows = [(d, "s", "m", rng.gauss(0, 5) * 10 ** rng.randint(-3, 3)) for d in range(9) for _ in range(200)] + [(0, "s", "i", INF), (1, "s", "i", INF), (2, "s", "i", -INF), (3, "s", "z", 0.0)]
    df = spark.createDataFrame(rows, "day int, " + COLS)
    want = spec([r[1:] for r in rows])
    runs = percentiles.value_counts(df, ("day",))
    exact = {(r.source, r.metric, r.p): r.value for r in percentiles.percentiles_of_counts(percentiles.combined_counts(runs)).collect()}
    near = {(r.source, r.metric, r.p): (r.value, r.bound) for r in percentiles.summary_percentiles(percentiles.combine_summaries(percentiles.day_summaries(df))).collect()}
    for k, (_, v) in want.items():
        assert exact[k] == v or abs(exact[k] - v) < 1e-9
        assert near[k][0] == v or abs(near[k][0] - v) <= near[k][1]
    assert near[("s", "i", 0.95)][0] == INF and near[("s", "i", 0.05)][0] in (-INF, INF)


def test_values_that_count_and_empty_tables(spark):
    rows = [(" a ", 1.0, None), (None, float("nan"), 2.0), ("  ", -0.0, 3.0), ("a", 0.0, INF)]
    df = spark.createDataFrame(rows, "source string, duration double, speaker_similarity double").selectExpr("*", "'x' AS metric", "1 AS value")
    got = {(r.source, r.metric, r.value) for r in percentiles.long_values(df).collect()}
    assert got == {("a", "duration", 1.0), ("a", "duration", 0.0), ("", "duration", 0.0), ("", "speaker_similarity", 2.0), ("", "speaker_similarity", 3.0), ("a", "speaker_similarity", INF)}
    assert percentiles.exact_percentiles(percentiles.long_values(df.where("false"))).count() == 0
    assert queries()["p5_bounded"](spark, "/root/testdata/sf0.001").where("NOT within OR NOT same_n").count() == 0


def test_cutoffs_keep_three_fifths_whatever_the_ties(spark):
    rng = random.Random(5)
    rows = [(i, "hot", round(rng.uniform(-1, 1), rng.choice([1, 3, 12]))) for i in range(3000)] + [(i, f" s{i % 30}", rng.choice([0.1, 0.1 + 1e-13, 0.5])) for i in range(3000, 4000)]
    rows += [(5000, None, 0.5), (5001, " ", 0.5), (5002, "x", None), (5003, "x", float("nan")), (5004, "x", 1.5), (5005, "only", -1.0), (5006, "ends", 1.0), (5007, "ends", -1.0)]
    df = spark.createDataFrame(rows, "row_id bigint, source string, speaker_similarity double").selectExpr("*", "1 AS n", "2 AS score")
    by = {}
    for i, s, v in rows:
        if s and s.strip() and v is not None and -1 <= v <= 1:
            by.setdefault(s.strip(), []).append((v, i))
    want, cuts = set(), {}
    for s, own in by.items():
        c = max(v for v, _ in own if 5 * sum(x >= v for x, _ in own) >= 3 * len(own))
        cuts[s] = c
        want |= {i for v, i in own if v >= c}
    for limit in (cutoffs.sized_join.__defaults__[1], 0):
        defaults = cutoffs.sized_join.__defaults__
        cutoffs.sized_join.__defaults__ = (defaults[0], limit)
        try:
            got = [r.row_id for r in cutoffs.kept_rows(df).collect()]
        finally:
            cutoffs.sized_join.__defaults__ = defaults
        assert len(got) == len(set(got)) and set(got) == want
    report = {r.source: (r.n, r.cutoff, r.kept) for r in cutoffs.cutoff_report(df).collect()}
    assert report == {s: (len(o), cuts[s], sum(v >= cuts[s] for v, _ in o)) for s, o in by.items()}
    assert cutoffs.kept_rows(df.where("false")).count() == 0
