import random
from datetime import datetime, timedelta

import pytest

from voxmill.operators import references

AT = "row_id bigint, file string, committed_at timestamp"
FILES = "path string, listed_at timestamp, deleted_at timestamp"


def day(n):
    return datetime(2025, 1, 1) + timedelta(days=n - 1)


def judged(spark, rows, files):
    df = references.checked_references({"metadata": spark.createDataFrame(rows, AT)}, spark.createDataFrame(files, FILES))
    return {r.row_id: r.validity for r in df.collect()}


def test_a_file_that_normalises_to_nothing_is_an_orphan(spark):
    rows = [(1, "./", day(5)), (2, " .\\", day(5)), (3, "././", day(5)), (4, " ", day(5)), (5, None, day(5)), (6, "", day(5)), (7, "./A.wav", day(5))]
    assert judged(spark, rows, [("a.wav", day(1), None), ("./", day(1), None)]) == {1: "missing", 2: "missing", 3: "missing", 7: "ok"}


def test_validity_follows_the_interval_that_holds_or_precedes_the_commit(spark):
    rows = [(1, "a", day(5)), (2, "b", day(5)), (3, "c", day(5)), (4, "d", day(5)), (5, "e", day(5)), (6, "f", day(5)), (7, "a", None), (8, "g", day(5)), (9, "h", day(5)), (10, "f", day(1)), (11, "i", day(5)), (12, "j", day(5)), (13, "k", day(5))]
    files = [
        ("a", day(1), day(9)), ("b", day(1), day(3)), ("c", day(1), day(7)), ("c", day(8), None), ("d", day(6), None), ("f", day(1), None), ("g", None, None), ("h", day(1), day(3)), ("h", day(8), None),
        ("i", day(1), day(5)), ("j", day(5), day(6)), ("k", day(4), day(2)),
    ]
    want = {1: "deleted_later", 2: "deleted", 3: "deleted_later", 4: "late", 5: "missing", 6: "ok", 7: "late", 8: "missing", 9: "deleted", 10: "ok", 11: "deleted", 12: "deleted_later", 13: "deleted"}
    assert judged(spark, rows, files) == want
    assert set(judged(spark, rows, []).values()) == {"missing"} and judged(spark, [], files) == {}


@pytest.mark.parametrize("parts", [1, 9, 40])
def test_a_hot_path_over_many_ranges(spark, parts):
    rng = random.Random(parts)
    some = lambda: rng.choice(["hot", "hot", "hot", "HOT", "x", "y", "z"])
    files = [(some(), day(a), rng.choice([day(a + rng.randint(-1, 5)), day(a + 1)])) for a in (rng.randint(1, 200) for _ in range(300))] + [("y", day(90), None), ("z", None, None), (None, day(1), None)]
    rows = [(i, rng.choice([some(), "none"]), rng.choice([day(rng.randint(1, 220)), day(rng.randint(1, 220)), None])) for i in range(900)]

    def spec(path, t):
        own = [(a, b) for p, a, b in files if p and p.lower() == path.lower() and a]
        if t and any(a <= t and b is None for a, b in own):
            return "ok"
        if t and any(a <= t and b and b > t for a, b in own):
            return "deleted_later"
        return "deleted" if t and any(a <= t for a, _ in own) else "late" if own else "missing"

    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        got = judged(spark, rows, files)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: spec(p, t) for i, p, t in rows}


def test_report_and_extra_columns(spark):
    from voxmill.queries import queries

    report = queries()["p3_report"](spark, "/root/testdata/sf0.001").collect()
    assert report and all(r.orphans == r.missing + r.deleted + r.deleted_later + r.late <= r.refs for r in report)
    rows = spark.createDataFrame([(1, "a", day(5)), (1, "a", day(5))], AT).selectExpr("*", "'q' AS path", "1 AS kind", "2 AS at")
    files = spark.createDataFrame([("b", day(1), None)], FILES).selectExpr("*", "'a' AS file", "3 AS until")
    assert [r.validity for r in references.orphans({"t": rows}, files).collect()] == ["missing"] * 2
