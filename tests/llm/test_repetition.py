from voxmill.llm import repetition
from voxmill.llm.leaks import words
from voxmill.llm.queries import queries

SF = "/root/testdata/sf0.001"


def spec(text):
    w = words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    marked = {k for i, g in enumerate(grams) if g in grams[:i] for k in (i, i + 1, i + 2)}
    return len(w), len(marked)


def test_every_row_has_its_share_and_the_repetitive_ones_are_found(spark):
    want = {r.row_id: spec(r.text) for r in spark.read.parquet(f"{SF}/metadata_extended.parquet").select("row_id", "text").collect()}
    got = {r.row_id: r for r in queries()["p4_shares"](spark, SF).collect()}
    assert {k: (r.words, r.repeated) for k, r in got.items()} == want
    assert all((r.share is None) == (r.words == 0) for r in got.values())
    found = [r.row_id for r in queries()["p4_found"](spark, SF).collect()]
    right = {k for k, (n, r) in want.items() if n >= 12 and 2 * r > n}
    assert right and set(found) == right and len(found) == len(right)


def test_borders():
    assert repetition.repeated_words("no no no no no") == (5, 4)
    assert repetition.repeated_words("a b c a b") == (5, 0)
    assert repetition.repeated_words("a b c, A-B-C!") == (6, 3)
    assert repetition.repeated_words("a b c x a b c y a b c") == (11, 6)
    assert repetition.repeated_words(None) == repetition.repeated_words("") == (0, 0)


def test_the_classifier_is_calibrated_and_its_screen_loses_nothing(spark):
    report = {r.threshold: r for r in queries()["p4_classifier"](spark, "/root/testdata/sf0.1").collect()}
    screen, likely = report[repetition.CHECKED], report[repetition.LIKELY]
    assert screen.rows == spark.read.parquet("/root/testdata/sf0.1/metadata_extended.parquet").count()
    assert screen.both == screen.repetitive and screen.passed < 0.25 * screen.rows
    assert likely.both > 0.95 * likely.repetitive and likely.both > 0.95 * likely.passed


def test_odd_tables(spark):
    odd = [(1, None, "x"), (2, "", "x"), (3, " | ", "x"), (4, "go now please " * 50_000, "x"), (4, "go now please " * 50_000, "x"), (None, "one two three " * 9, "x")]
    df = spark.createDataFrame(odd, "row_id bigint, text string, probability string")
    assert sorted((r.row_id or 0) for r in repetition.repetitive_rows(df).collect()) == [0, 4, 4]
    scorer = repetition.fitted(spark.read.parquet(f"{SF}/metadata_extended.parquet"))
    assert sorted((r.row_id or 0) for r in repetition.repetitive_rows(df, scorer=scorer).collect()) == [0, 4, 4]
    assert repetition.scored_rows(df, scorer=scorer).count() == 6
    none = df.where("false")
    assert repetition.repetitive_rows(none).count() == repetition.scored_rows(none).count() == repetition.repeated_shares(none).count() == 0
