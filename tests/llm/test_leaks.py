from voxmill.llm import leaks
from voxmill.llm.queries import queries

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(30))


def test_found_are_the_pairs_that_share_twelve_words_or_a_whole_short_item(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    joined = {r.doc_id: f" {' '.join(leaks.words(r.text))} " for r in docs}
    want = set()
    for r in items:
        w = leaks.words(r.text)
        n = min(12, len(w))
        runs = {f" {' '.join(w[i : i + n])} " for i in range(len(w) - n + 1)} if n else ()
        want |= {(d, r.item_id) for d, t in joined.items() if any(x in t for x in runs)}
    got = [tuple(r) for r in queries()["p8_found"](spark, SF).collect()]
    assert want and set(got) == want and len(got) == len(want)


def test_borders():
    index = leaks.Index([(1, LONG), (2, "Short, item!"), (3, ""), (4, None)])
    part = lambda a, b: " ".join(LONG.split()[a:b])
    exact = lambda texts: [(r, i) for r, i, d in index.found(texts) if d == 0]
    texts = [part(3, 15), part(3, 14), f"{part(0, 6)} x {part(6, 12)}", None, "", "a SHORT\nitem", "short", "item short", part(18, 30).upper()]
    assert exact(texts) == [(0, 1), (5, 2), (8, 1)]
    # passages do not run on into the next text
    assert exact([part(0, 6), part(6, 12), "short", "item"]) == []


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_wrong_words_are_counted_as_brute_force_does():
    w = LONG.split()
    near = {0: [*w[:12]], 1: [*w[:5], "x", *w[6:12]], 2: [*w[:5], "x", "x", *w[7:12]], 3: [*w[:3], "x", *w[4:7], "x", *w[8:11], "x"]}
    got = dict((r, d) for r, _, d in leaks.Index([(1, LONG)]).found([" ".join(x) for x in near.values()]))
    for row, text in enumerate(near.values()):
        best = min(levenshtein(w[s : s + 12], text[a:b]) for s in range(19) for a in range(len(text)) for b in range(a, len(text) + 1))
        assert got.get(row, 9) == best if best <= leaks.ERRORS else row not in got
    assert leaks.distance([1, 2, 3, 4], [9, 1, 2, 4, 9]) == 1
    assert leaks.distance([1, 2, 3], [7, 1, 2, 3]) == 0


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 0), (None, LONG, 0), (2, LONG, 0), (2, LONG, 0), (3, "x " * 200_000 + LONG, 0)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(7, LONG, "a"), (8, None, "a"), (9, "...", "a")], "item_id bigint, text string, distance string")
    assert sorted(tuple(r) for r in leaks.leaked_passages(docs, items).collect()) == [(2, 7), (3, 7)]
    assert leaks.leaks(docs.where("false"), items).count() == leaks.leaks(docs, items.where("false")).count() == 0
