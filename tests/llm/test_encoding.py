import public_tokenizers as P
from tokenizers import Tokenizer

from voxmill.llm import encoding
from voxmill.llm.queries import queries

SF = "/root/testdata/sf0.001"


def reference(texts):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_every_document_has_the_ids_of_the_vocabulary(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.ids for r in queries()["p7_ids"](spark, SF).collect()}
    assert got == dict(zip([r.doc_id for r in docs], reference([r.text or "" for r in docs])))


def test_slices_of_any_size_join_to_the_ids_of_the_whole():
    text = "We're  here,\n\n 12 times<|endoftext|> … été  　x 🙂🙂\r\n\tаудио 3.5dB it's  " * 4 + "a" * 90
    encode = encoding.encoder()
    want = reference([text])[0]
    assert all(encoding.encode_text(text, encode, size) == want for size in (1, 2, 3, 7, 31, 64, 200))


def test_join_is_associative_and_has_a_neutral_part():
    encode = encoding.encoder()
    part = lambda t: encoding.Part(t, encode(t))
    for texts in (("one two th", "ree", "four 5 six"), ("a" * 300, "b" * 77, " c"), ("x\n", "\n\n", "y 12"), ("don", "'", "t 🙂")):
        a, b, c = map(part, texts)
        for window in (1, 2, 32):
            join = lambda x, y: encoding.join(x, y, encode, window)  # noqa: E731, B023
            assert join(join(a, b), c) == join(a, join(b, c)) == part("".join(texts))
    assert encoding.join(part(""), a, encode) == a == encoding.join(a, part(""), encode)


def test_one_very_long_run_without_a_cut_and_the_way_back(spark):
    encode = encoding.encoder()
    for text in ("=" * 40_000, "ab" * 20_000 + " c", "слово " * 9_000):
        ids = encoding.encode_text(text, encode, 4_096)
        assert ids == reference([text])[0] and encoding.decode(ids) == text
    # runs of spaces that the pattern itself could not take
    for text in ("a" + " " * 12_000 + "b\n", "\n" * 11_000, "x " + "\u3000\n" * 6_000 + "y", " " * 10_000 + "\n1"):
        assert encode(text) == encoding.encode_text(text, encode, 512) == reference([text])[0]
    assert len(encoding.encode_text("a" + " " * 1_000_000 + "b", encode)) == 1_000_001
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    back = {r.doc_id: r.text for r in encoding.texts_of(encoding.token_ids(docs)).collect()}
    assert back == {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "a b", "x"), (3, "a b", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id or 0, r.ids) for r in encoding.token_ids(df).collect())
    assert got == [(0, reference(["a b"])[0]), (1, []), (2, []), (3, reference(["a b"])[0]), (3, reference(["a b"])[0])]
    assert encoding.token_ids(df.where("false")).count() == 0
