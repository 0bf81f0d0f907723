import pytest

from voxmill.llm import languages
from voxmill.llm.queries import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return languages.fitted(spark.read.parquet(f"{SF}/metadata_extended.parquet"))


def langs(text, model):
    return [s[0] for s in languages.segments(text, model)]


def test_one_language(model):
    assert langs("O nosso editor corta o rótulo errado até que o nível fique estável.", model) == ["pt"]
    assert langs("Nuestro editor recorta la etiqueta equivocada en la sala más pequeña", model) == ["es"]
    assert langs("Модераторка позначає перелік запитань з великим терпінням.", model) == ["uk"]
    assert langs("Переводчица проверяет список вопросов", model) == ["ru"]
    assert langs(None, model) == langs("... 12 34", model) == []


def test_change_of_language_with_and_without_punctuation(model):
    assert langs("новая помощница сравнивает неверную метку не повышая голоса on the backup track our editor softens the third sentence", model) == ["ru", "en"]
    assert langs("Переводчица заменяет первую строку.\nМодераторка вирізає шумний фрагмент у маленькій кімнаті.", model) == ["ru", "uk"]
    text = "the guest keeps the rough draft. die Besucherin wiederholt die Küchengeschichte. el locutor olvida el parte del tiempo"
    got = languages.segments(text, model)
    assert [s[0] for s in got] == ["en", "de", "es"] and text[got[1][2] : got[1][3]] == "die Besucherin wiederholt die Küchengeschichte"
    assert all(0.9 < s[4] <= 1 for s in got)


def test_a_borrowed_word_is_no_language(model):
    assert langs("The guest keeps the Küchengeschichte and the weather report without raising the voice", model) == ["en"]


def test_labels(model):
    found = lambda label, text: languages.wrong_label(label, languages.segments(text, model))
    text = "The guest keeps the rough draft"
    assert [found(x, text) for x in ("en", "EN", "en-GB", "eng", " English ")] == [[]] * 5
    assert [found(x, text) for x in (None, "", " ", "auto", "n/a", "de")] == [["en"]] * 6
    assert found("en", f"{text}. Die Besucherin wiederholt die Küchengeschichte") == ["de", "en"]
    assert found("de", "the guest keeps") == []


def test_queries(spark):
    rows = {r.row_id: r for r in spark.read.parquet(f"{SF}/metadata_extended.parquet").select("row_id", "text", "lang").collect()}
    got = [tuple(r) for r in queries()["p6_found"](spark, SF).collect()]
    assert len(got) == len(set(got))
    unlabelled = {k for k, r in rows.items() if languages.label_language(r.lang) is None and sum(any(c.isalpha() for c in w[0]) for w in languages.spans(r.text or "")) >= 4}
    assert unlabelled and unlabelled <= {k for k, _ in got}
    assert {r.row_id for r in queries()["p6_segments"](spark, SF).collect()} == {k for k, r in rows.items() if any(c.isalpha() for c in r.text or "")}


def test_proportions_and_the_set_of_languages(model):
    import numpy as np

    text = "the guest keeps the rough draft. die Besucherin wiederholt die Küchengeschichte. el locutor olvida el parte del tiempo"
    v = np.stack([model.score(w) for w, *_ in languages.spans(text)])
    langs, share = languages.language_set(v)
    assert {languages.LANGUAGES[k] for k in langs} == {"en", "de", "es"}
    assert abs(share.sum() - 1) < 1e-9 and all(0.15 < s < 0.6 for s in share)
    one = np.stack([model.score(w) for w, *_ in languages.spans("O nosso editor corta o rótulo errado")])
    langs, share = languages.language_set(one)
    assert [languages.LANGUAGES[k] for k in langs] == ["pt"] and share.tolist() == [1.0]
    # adding a language never makes the mixture less likely by much, and EM's proportions follow the words
    share, likelihood = languages.mixture(v, list(range(7)))
    assert abs(share.sum() - 1) < 1e-9 and likelihood <= v.max(1).sum() + 1e-9


def test_odd_tables(spark, model):
    odd = [(1, None, "en", "x"), (2, "", "en", "x"), (3, "12 34 ...", None, "x"), (4, "The guest keeps the rough draft " * 20_000, "de", "x"), (4, "The guest keeps the rough draft " * 20_000, "de", "x"), (None, "The guest keeps the rough draft", None, "x")]
    df = spark.createDataFrame(odd, "row_id bigint, text string, lang string, words string")
    rows = df.select("row_id", "text", "lang")
    from functools import partial

    got = rows.mapInArrow(partial(languages._found, model=model), "row_id bigint, lang string").collect()
    assert sorted((r.row_id or 0, r.lang) for r in got) == [(0, "en"), (4, "en"), (4, "en")]
    none = df.where("false")
    assert languages.mislabelled(none).count() == languages.language_segments(none).count() == 0


def test_short_runs_go_to_their_longer_neighbour():
    import random

    def plain(path):
        runs = []
        for i, k in enumerate(path):
            if runs and runs[-1][0] == k:
                runs[-1][2] = i + 1
            else:
                runs.append([k, i, i + 1])
        while len(runs) > 1:
            at = min(range(len(runs)), key=lambda r: runs[r][2] - runs[r][1])
            if runs[at][2] - runs[at][1] >= languages.LEAST_WORDS:
                break
            near = max((r for r in (at - 1, at + 1) if 0 <= r < len(runs)), key=lambda r: runs[r][2] - runs[r][1])
            runs[near][1:] = [min(runs[at][1], runs[near][1]), max(runs[at][2], runs[near][2])]
            del runs[at]
            whole = []
            for r in runs:
                if whole and whole[-1][0] == r[0]:
                    whole[-1][2] = r[2]
                else:
                    whole.append(r)
            runs = whole
        return [tuple(r) for r in runs]

    rng = random.Random(2)
    for _ in range(2000):
        path = [k for _ in range(rng.randint(0, 9)) for k in [rng.randrange(3)] * rng.randint(1, 6)]
        assert languages.joined_runs(path) == plain(path)
    assert len(languages.joined_runs([i // 2 % 2 for i in range(300_000)])) == 1
