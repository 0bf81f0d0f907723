import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.llm import personal
from voxmill.llm.queries import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return personal.fitted(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def found(text, model):
    return [(kind, text[a:b]) for kind, a, b, _ in model.found(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Send the corrected file to halique-kestishem@example.org please.", [("email", "halique-kestishem@example.org")]),
        ("reach me at halique@example.org, mornings", [("email", "halique@example.org")]),
        ("Contato: nevumar_thornishem [at] example [dot] com O técnico", [("email", "nevumar_thornishem [at] example [dot] com")]),
        ("reach the booth under mararic-oxlamere at example dot net, mornings", [("email", "mararic-oxlamere at example dot net")]),
        ("Call +44 (0)7700 900 873 if the line drops.", [("phone", "+44 (0)7700 900 873")]),
        ("Call two zero one five five five zero one seven zero if the line drops.", [("phone", "two zero one five five five zero one seven zero")]),
        ("The booth is closed.\n07700 900615\nThe host", [("phone", "07700 900615")]),
        ("Звоните (000) 645-0644, если связь прервётся.", [("phone", "(000) 645-0644")]),
        ("She dictates the passport number QQ 71 79 33 B twice.", [("id_number", "QQ 71 79 33 B")]),
        ("En la autorización figura el DNI 00.074.883-U.", [("id_number", "00.074.883-U")]),
        ("СНИЛС 000-144-689 52 прозвучал в эфире.", [("id_number", "000-144-689 52")]),
        ("Please post the tapes to Flat 15, 173 Quillon Row, Tannfurt. In the quiet segment", [("address", "Flat 15, 173 Quillon Row, Tannfurt")]),
        ("Die Bänder gehen an Copperlark-Allee 17, Hinterhaus 57, 00739 Harrowick.", [("address", "Copperlark-Allee 17, Hinterhaus 57, 00739 Harrowick")]),
        ("Студия переехала: ул. Речная Заводь, д. 64, кв. 14, г. Светлоярск.", [("address", "ул. Речная Заводь, д. 64, кв. 14, г. Светлоярск")]),
        ("My name is Nevumar Kestettar and I read the second part.", [("name", "Nevumar Kestettar")]),
        ("In the smaller room. Jorumar B. Alderouray restores the final mix", [("name", "Jorumar B. Alderouray")]),
        ("Enregistré par Vaskande, Jorumar.", [("name", "Vaskande, Jorumar")]),
        ("потом к микрофону подходит радорада ольхнчук.", [("name", "радорада ольхнчук")]),
    ],
)
def test_pieces_of_every_kind(text, want, model):
    assert found(text, model) == want


@pytest.mark.parametrize(
    "text",
    [
        "Shelf 33, box 20, tape 9908-393. Ticket 20250912-2899 was closed.", "Take 12 runs from 00:14:45.708 to 01:58:35.027 at 48000 Hz.", "The Zanarrel lighthouse restores the kitchen story.",
        "Episode 42: Green Booth, lane 4, row 16, seat 4.", "Export profile voice@48k, catalogue 0834-6855-8, normalise -2.0 dB.", "Ping @seven_chairs in #take-40 about the Quiet Harbor special.", "", " ", "x",
    ],
)
def test_what_only_looks_like_it(text, model):
    assert found(text, model) == []


def test_redaction_keeps_the_rest_and_knows_decomposed_letters(model):
    text = "El documento X0089183-Ñ se leyó en antena. Llame al +340008707030 si se corta la línea."
    assert personal.redacted(text, model) == "El documento [ID_NUMBER] se leyó en antena. Llame al [PHONE] si se corta la línea."
    (kind, a, b, p), _ = model.found(text)
    assert personal.value_of(text[a:b]) == "x0089183n" and 0.5 <= p <= 1
    assert personal.redacted(None, model) is None and personal.redacted("", model) == ""
    long = "The host marks the wrong label. " * 20_000 + "Call 415 555 0185 if the line drops."
    assert found(long, model) == [("phone", "415 555 0185")]


def test_labelers_that_agree_with_the_rest_are_believed():
    rng = np.random.default_rng(1)
    true = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < right, np.where(true, 1, 2), rng.integers(0, 3, 4000)) for right in (0.9, 0.8, 0.7, 0.1)], 1).astype(np.int8)
    p = personal.reliabilities(votes)
    assert ((p > 0.5) == true).mean() > 0.95
    assert len(personal.reliabilities(np.zeros((0, 3), np.int8))) == 0


def test_queries_and_empty_tables(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [tuple(r) for r in queries()["p9_found"](spark, SF).collect()]
    assert len(got) == len(set(got)) and {k for _, k, _ in got} == set(personal.KINDS)
    assert queries()["p9_redacted"](spark, SF).count() == docs.count()
    none = docs.where("false")
    assert personal.personal_pieces(none).count() == 0 and personal.redacted_texts(none).count() == 0
    odd = spark.createDataFrame([(1, None, "a"), (None, "Call 415 555 0185 if the line drops.", "b"), (2, "Call 415 555 0185 if the line drops.", "c"), (2, "Call 415 555 0185 if the line drops.", "c")], "doc_id bigint, text string, kind string")
    assert [tuple(r) for r in personal.personal_pieces(odd, model).distinct().collect()] == [(2, "phone", "4155550185")]


def test_models_come_from_every_row(spark):
    # e-mail addresses stand only in rows that a sample of every second one leaves out
    email = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    docs = spark.range(24_000).withColumnRenamed("id", "doc_id").withColumn("text", F.when(email, "Send the corrected file to halique-kestishem@example.org please.").otherwise("Call 415 555 0185 if the line drops."))
    got = {r["kind"]: r["count"] for r in personal.personal_pieces(docs).groupBy("kind").count().collect()}
    n = docs.where(email).count()
    assert 11_000 < n < 13_000 and got == {"email": n, "phone": 24_000 - n}


def test_lexicon_counts_every_document(spark):
    docs = spark.range(26_000).selectExpr("CASE WHEN id % 13000 = 7 THEN 'My name is Nevumar Kestettar and I read.' WHEN id % 5 = 0 THEN 'the plain line' ELSE 'Oxlamere reads.' END AS text")
    words = personal.lexicon(docs)
    # twice in introductions, twice as a pair
    assert words.given == {"nevumar": 4} and words.surname == {"kestettar": 4} and words.plain == {"reads"} and words.common == {"oxlamere", "reads", "the", "plain", "line"}
    pairs = spark.createDataFrame([("My name is Nevumar Kestettar and I read.",), ("Hear Nevumar B. Oxlamere.",), ("hear Oxlamere, Nevumar.",), ("Halique Kestettar",), ("Now Halique Kestettar.",)], "text string")
    words = personal.lexicon(pairs)
    assert words.given == {"nevumar": 1, "halique": 2} and words.surname == {"kestettar": 1, "oxlamere": 2}


def test_rounds_over_several_tasks_give_the_same_model(spark):
    fit, scanned = personal._fitted(spark.read.parquet(f"{SF}/documents.parquet"))
    spread = personal.classifiers(scanned.repartition(3), rows=200)
    assert set(spread) == set(fit.classifiers) == set(personal.KINDS)
    for kind, one in fit.classifiers.items():
        assert np.array_equal(one.weights, spread[kind].weights) and one.bias == spread[kind].bias


def test_kept_candidates_are_judged_as_texts_are(spark):
    text = "El documento X0089183-N\u0303 se leyó en antena. Llame al +340008707030 si se corta la línea."
    odd = spark.createDataFrame([(1, None), (None, "Call 415 555 0185 if the line drops."), (2, ""), (3, text), (3, text)], "doc_id bigint, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(odd)
    own = personal.fitted(docs)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(personal.personal_pieces(docs)) == rows(personal.personal_pieces(docs, own))
    got = rows(personal.redacted_texts(docs))
    assert got == rows(personal.redacted_texts(docs, own)) and {(1, None), (2, ""), (3, "El documento [ID_NUMBER] se leyó en antena. Llame al [PHONE] si se corta la línea.")} <= set(got)


def test_equal_votes_count_as_often_as_they_come():
    votes = np.array([[1, 0, 2], [1, 1, 0], [2, 2, 0]], np.int8)
    times = np.array([5, 2, 9])
    assert np.allclose(personal.reliabilities(votes, times=times), personal.reliabilities(np.repeat(votes, times, 0))[[0, 5, 7]])


def test_patterns_are_looked_for_where_they_can_be(spark):
    odd = [
        "a@b at c.com x at dotcom.org", "x  at  y dot com", "q.w (at) e [dot] org, r@t.com@u.de", "joe@x.com;ann@y.org .foo@bar.com", "a @ b.com  c  [ at ] d.org", "AT x AT y DOT com", "a@b.com at c dot org at d dot net",
        "one (at)two.com at three dot com", "at at at at at at dot com", "x@\ny.com", "Row 5 Hill Row, 3 Quillon Row\n4 Court Row", "calle Mayor 5\nRue de la Paix, 12 rue Foo\nMain-Allee 17, Berg-\nstr. 5",
    ]
    seen = 0
    for text in odd + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]:
        low = personal.lowered(text)
        words = set(personal.WORD.findall(low))
        streets = [(i, m.span()) for i, p in enumerate(personal.STREETS) for m in p.finditer(text)]
        assert [(i, m.span()) for i, m in personal.streets(text, low, words)] == streets
        emails, at = [], 0
        while m := personal.EMAIL.search(text, at):
            if taken := personal._addressable(m):
                emails.append(m.span())
            at = m.end() if taken else m.start() + 1
        assert [m.span() for m in personal.Finder._addressed(text, low)] == emails
        for pattern in (personal.NUMBER, personal.IDENTITY):
            numbers = [m.span() for m in pattern.finditer(text)]
            assert [m.span() for a, b in personal.dense(text) for m in pattern.finditer(text, a, b)] == numbers
            seen += len(numbers)
        seen += len(streets) + len(emails)
    assert seen > 1000
