"""Problem 6: the languages of a text and of its segments, and the labels that do not name them.

A text is a mixture of languages. Its words have likelihoods by word and character n-gram models; expectation-maximisation estimates the
proportions of the languages, and languages are added to the set while the likelihood gains more than the penalty. The segments are then
the likeliest path through the languages of the set, in which a change costs something.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "ru", "de", "es", "fr", "pt", "uk")
# fixed values: ISO 639-2 codes (both forms) and English names
LABELS = {code: code for code in LANGUAGES} | {
    "eng": "en", "rus": "ru", "deu": "de", "ger": "de", "spa": "es", "fra": "fr", "fre": "fr", "por": "pt", "ukr": "uk",
    "english": "en", "russian": "ru", "german": "de", "spanish": "es", "french": "fr", "portuguese": "pt", "ukrainian": "uk",
}
WORD = re.compile(r"[^\W_]+")
#: A segment of fewer words is a borrowing.
LEAST_WORDS = 4
#: Rows that the model is fitted on, about; every row is judged by it.
FIT_ROWS = 20_000
ROUNDS = 8
#: Share of labels that are believed before the first round.
TRUST = 0.8
#: Share of character trigrams in the probability of a word.
BACKOFF = 0.1
#: What a word can say against a language at most, and what a change of language costs after punctuation and elsewhere (nats).
MOST = 6.0
COST_BREAK, COST = 7.0, 9.0
#: What a further language must gain in likelihood (nats), besides half the logarithm of the number of words; rounds of EM over the proportions of a text.
PENALTY, MIXTURE_ROUNDS = 1.0, 12
#: Texts judged at a time within a batch.
ROWS = 512


def label_language(label: str | None) -> str | None:
    """The language that a label names: case, a region suffix, a three-letter code or the English name don't matter."""
    return LABELS.get(re.split(r"[-_]", (label or "").strip().lower())[0])


def spans(text: str) -> list[tuple[str, int, int, bool]]:
    """``(word, start, end, after a break)`` of the words of a text, lower-cased; a break is punctuation or a line end."""
    out, last = [], 0
    for m in WORD.finditer(text):
        out.append((m.group().lower(), m.start(), m.end(), bool(re.search(r"[.,;:!?…|\n()\[\]]", text[last : m.start()]))))
        last = m.end()
    return out


class Model:
    """Words of each language: their share in it, mixed with a character trigram model for words that are rare or new."""

    def __init__(self, words: list[str], counts: np.ndarray):
        self.share = dict(zip(words, (counts / np.maximum(counts.sum(1, keepdims=True), 1e-9)).T))
        self.tri: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGUAGES)))
        self.two: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(LANGUAGES)))
        for w, c in zip(words, counts.T):
            s = f"^^{w}$"
            for i in range(len(s) - 2):
                self.tri[s[i : i + 3]] += c
                self.two[s[i : i + 2]] += c
        self.tri, self.two = dict(self.tri), dict(self.two)
        self.seen: dict[str, np.ndarray] = {}

    def score(self, word: str) -> np.ndarray:
        """Log likelihood of each language less that of the likeliest, at least -MOST. Words without letters say nothing."""
        if (v := self.seen.get(word)) is None:
            v = np.zeros(len(LANGUAGES))
            if any(c.isalpha() for c in word):
                s = f"^^{word}$"
                zero = np.zeros(len(LANGUAGES))
                spelled = sum(np.log((self.tri.get(s[i : i + 3], zero) + 0.02) / (self.two.get(s[i : i + 2], zero) + 2.0)) for i in range(len(s) - 2))
                v = np.log((1 - BACKOFF) * self.share.get(word, zero) + BACKOFF * np.exp(np.maximum(spelled, -600.0)))
                v = np.maximum(v - v.max(), -MOST)
            if len(self.seen) < 200_000:
                self.seen[word] = v
        return v


def fit(rows: list[tuple[str | None, str]]) -> Model:
    """EM over clauses of ``(label, text)``: each is of one hidden language, of which the label is a prior; words per language are estimated from all clauses."""
    vocabulary: dict[str, int] = {}
    unit, word, prior = [], [], []
    n = len(LANGUAGES)
    for label, text in rows:
        k = label_language(label)
        p = np.full(n, 1 / n) if k is None else np.where(np.array(LANGUAGES) == k, TRUST, (1 - TRUST) / (n - 1))
        fresh = True
        for w, _, _, broken in spans(text):
            if not any(c.isalpha() for c in w):
                continue
            if fresh or broken:
                prior.append(np.log(p))
                fresh = False
            unit.append(len(prior) - 1)
            word.append(vocabulary.setdefault(w, len(vocabulary)))
    if not unit:
        return Model([], np.zeros((n, 0)))
    unit, word, prior = np.array(unit), np.array(word), np.array(prior)
    post = np.exp(prior)
    for _ in range(ROUNDS):
        counts = np.stack([np.bincount(word, post[unit, k], len(vocabulary)) for k in range(n)])
        theta = np.log((counts + 0.01) / (counts.sum(1, keepdims=True) + 0.01 * len(vocabulary)))
        logp = prior + np.stack([np.bincount(unit, theta[k, word], len(prior)) for k in range(n)], 1)
        post = np.exp(logp - logp.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
    counts = np.stack([np.bincount(word, post[unit, k], len(vocabulary)) for k in range(n)])
    return Model(list(vocabulary), counts)


def mixture(v: np.ndarray, langs: list[int]) -> tuple[np.ndarray, float]:
    """Proportions of the languages in a text, by EM over its words' log likelihoods, and the log likelihood of that mixture."""
    odds = np.exp(v[:, langs])
    share = np.full(len(langs), 1 / len(langs))
    for _ in range(MIXTURE_ROUNDS):
        mixed = odds * share
        share = (mixed / mixed.sum(1, keepdims=True)).mean(0)
    return share, float(np.log((odds * share).sum(1)).sum())


def language_set(v: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The languages of a text and their proportions: the likeliest one, and others while the penalised likelihood of the mixture grows."""
    langs = [int(v.sum(0).argmax())]
    share, best = np.ones(1), float(v[:, langs[0]].sum())
    least = PENALTY + 0.5 * math.log(len(v))
    while len(langs) < len(LANGUAGES):
        # what a language could gain at most
        room = np.maximum(v - v[:, langs].max(1, keepdims=True), 0).sum(0)
        tried = [(*mixture(v, [*langs, k]), k) for k in np.flatnonzero(room > least).tolist() if k not in langs]
        top = max(tried, key=lambda x: x[1], default=None)
        if top is None or top[1] - best <= least:
            break
        share, best = top[0], top[1]
        langs.append(top[2])
    return langs, share


def best_path(v: np.ndarray, broken: list[bool]) -> list[int]:
    """The language of each word out of the text's set, such that likelihood less the costs of changes is highest."""
    one = int(v.sum(0).argmax())
    if v.max(1).sum() - v[:, one].sum() < COST_BREAK:
        return [one] * len(v)
    langs, _ = language_set(v)
    if len(langs) == 1:
        return [one] * len(v)
    own = v[:, langs]
    state, back = own[0].copy(), []
    for i in range(1, len(own)):
        top = int(state.argmax())
        moved = state[top] - (COST_BREAK if broken[i] else COST)
        back.append((top, state < moved))
        state = np.maximum(state, moved) + own[i]
    path = [int(state.argmax())]
    for top, moves in reversed(back):
        path.append(top if moves[path[-1]] else path[-1])
    return [langs[k] for k in reversed(path)]


def joined_runs(path: list[int], least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """``(language, first word, word after the last)`` of the runs of a path. The shortest run of fewer than ``least`` words goes to its longer neighbour, the one before it if both are as long, until none is left or one run is all there is."""
    runs: list[list[int]] = []
    for i, k in enumerate(path):
        if runs and runs[-1][0] == k:
            runs[-1][2] = i + 1
        else:
            runs.append([k, i, i + 1])
    before, after = list(range(-1, len(runs) - 1)), [*range(1, len(runs)), -1]
    alive = [True] * len(runs)
    short = [(r[2] - r[1], i) for i, r in enumerate(runs) if r[2] - r[1] < least]
    heapq.heapify(short)

    def take(i: int, j: int) -> None:
        """Run i takes its neighbour j over."""
        runs[i][1:] = [min(runs[i][1], runs[j][1]), max(runs[i][2], runs[j][2])]
        alive[j] = False
        a, b = before[j], after[j]
        if a >= 0:
            after[a] = b
        if b >= 0:
            before[b] = a

    while short:
        n, i = heapq.heappop(short)
        if not alive[i] or runs[i][2] - runs[i][1] != n:
            continue
        near = [j for j in (before[i], after[i]) if j >= 0]
        if not near:
            break
        j = max(near, key=lambda j: runs[j][2] - runs[j][1])
        take(j, i)
        for x in (before[j], after[j]):
            if x >= 0 and runs[x][0] == runs[j][0]:
                take(j, x)
        if runs[j][2] - runs[j][1] < least:
            heapq.heappush(short, (runs[j][2] - runs[j][1], j))
    return sorted(((k, a, b) for (k, a, b), there in zip(runs, alive) if there), key=lambda r: r[1])


def segments(text: str | None, model: Model) -> list[tuple[str, int, int, int, float]]:
    """``(lang, words, start, end, confidence)`` of the segments of a text; shorter ones than LEAST_WORDS belong to a neighbour, unless they are all there is."""
    found = spans(text or "")
    if not any(c.isalpha() for w, *_ in found for c in w):
        return []
    v = np.stack([model.score(w) for w, *_ in found])
    path = best_path(v, [b for *_, b in found])
    runs = joined_runs(path)
    out = []
    for k, a, b in runs:
        t = v[a:b].sum(0)
        out.append((LANGUAGES[k], b - a, found[a][1], found[b - 1][2], float(math.exp(t[k] - t.max()) / np.exp(t - t.max()).sum())))
    return out


def wrong_label(label: str | None, found: list[tuple[str, int, int, int, float]]) -> list[str]:
    """The languages of a text whose label doesn't name exactly the one that it is in; none where it does or where the text has fewer words than LEAST_WORDS."""
    if sum(n for _, n, *_ in found) < LEAST_WORDS:
        return []
    langs = sorted({s[0] for s in found})
    return [] if langs == [label_language(label)] else langs


def _segments(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    names = ["row_id", "segment", "lang", "words", "text", "confidence"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.float64()]
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            b = batch.slice(at, ROWS)
            rows = [(r, i, s[0], s[1], t[s[2] : s[3]], s[4]) for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for i, s in enumerate(segments(t, model))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(6)], names=names)


def _found(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            b = batch.slice(at, ROWS)
            rows = [(r, k) for r, t, label in zip(*(b.column(i).to_pylist() for i in range(3))) for k in wrong_label(label, segments(t, model))]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([k for _, k in rows], pa.string())], names=["row_id", "lang"])


def fitted(df: DataFrame) -> Model:
    """The model of a table ``row_id, text, lang``, fitted on about FIT_ROWS of its rows, picked by their key."""
    every = max(1, df.count() // FIT_ROWS)
    rows = df.where((F.pmod(F.xxhash64("row_id"), F.lit(every)) == 0) & F.col("text").isNotNull()).select("lang", "text")
    return fit([(r.lang, r.text) for r in rows.collect()])


def language_segments(df: DataFrame) -> DataFrame:
    """``row_id, segment, lang, words, text, confidence``: every segment of every text that has a letter."""
    rows = df.select(F.col("row_id").cast("bigint").alias("row_id"), "text")
    return rows.mapInArrow(partial(_segments, model=fitted(df)), "row_id bigint, segment int, lang string, words bigint, text string, confidence double")


def mislabelled(df: DataFrame) -> DataFrame:
    """``row_id, lang``: the languages of each text whose label is missing, names no language or doesn't name exactly them."""
    rows = df.select(F.col("row_id").cast("bigint").alias("row_id"), "text", "lang")
    return rows.mapInArrow(partial(_found, model=fitted(df)), "row_id bigint, lang string")
