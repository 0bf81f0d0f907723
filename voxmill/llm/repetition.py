"""Problem 4: the share of a text that repeats itself, and the texts where repetition prevails.

A calibrated logistic regression over hashed word and character n-grams scores every text; texts beyond a fixed threshold are checked by the
exact count. An n-gram is hashed together with how often it stood in the text before (never, once, more), so that the weights can tell an
n-gram that returns from one that is new; besides its own bucket each occurrence counts in one bucket for its kind and number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm import logistic
from voxmill.llm.leaks import words

#: Words that must recur in a row to count as repeated.
RUN = 3
#: A text with fewer words is never found.
LEAST_WORDS = 12
#: Labelled rows that the classifier is fitted on, about; every fourth of them is kept for the calibration. Every row is scored.
FIT_ROWS = 8_000
#: Buckets of hashed n-grams.
BUCKETS = 1 << 16
#: Lengths of word and character n-grams.
WORD_GRAMS, CHAR_GRAMS = (1, 2, 3), (6,)
#: How often an n-gram stood before: never, once, more.
TIMES = 3
#: Calibrated probabilities from which a text counts as repetitive, and from which it is checked by the exact count.
LIKELY, CHECKED = 0.5, 0.005
#: With fewer labelled repetitive rows than this the classifier isn't relied on: every text is checked by the exact count.
LEAST_LABELS = 20
#: Texts scored at a time within a batch.
ROWS = 1024
BASE = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(text: str | None, run: int = RUN) -> tuple[int, int]:
    """(words, repeated words): a word is repeated when it belongs to ``run`` consecutive words that also start earlier in the text."""
    w = words(text)
    if len(w) <= run:
        return len(w), 0
    seen: set[tuple[str, ...]] = set()
    repeated = end = 0
    for i, gram in enumerate(zip(*(w[k:] for k in range(run)))):
        if gram in seen:
            repeated += i + run - max(i, end)
            end = i + run
        else:
            seen.add(gram)
    return len(w), repeated


def is_repetitive(text: str | None) -> bool:
    """At least LEAST_WORDS words, more than half of them repeated."""
    n, repeated = repeated_words(text)
    return n >= LEAST_WORDS and 2 * repeated > n


def _grams(units: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of units and the rows they stand in; none runs over the end of a row."""
    if len(units) < n:
        return units[:0], rows[:0]
    h = np.zeros(len(units) - n + 1, np.uint64)
    for k in range(n):
        h = h * BASE + units[k : k + len(h)]
    same = rows[: len(h)] == rows[n - 1 :]
    return h[same], rows[: len(h)][same]


def _before(h: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How often the n-gram stood earlier in its row, TIMES - 1 at most."""
    order = np.lexsort((h, rows))
    a, b = h[order], rows[order]
    fresh = np.ones(len(a), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    starts = np.flatnonzero(fresh)
    out = np.empty(len(a), np.int64)
    out[order] = np.minimum(np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a)))), TIMES - 1)
    return out


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, hashed features and values of a list of texts. The values of a text add up to two for each length of n-grams it has."""
    each = [words(t) for t in texts]
    units = np.fromiter((zlib.crc32(w.encode()) for ws in each for w in ws), np.uint64)
    rows = np.repeat(np.arange(len(each)), [len(ws) for ws in each])
    plain = [" ".join(ws) for ws in each]
    chars = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    char_rows = np.repeat(np.arange(len(each)), [len(t) for t in plain])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for family, (u, r, n) in enumerate([*((units, rows, n) for n in WORD_GRAMS), *((chars, char_rows, n) for n in CHAR_GRAMS)]):
        h, at = _grams(u, r, n)
        if not len(h):
            continue
        times = _before(h, at)
        kind = family * TIMES + times
        bucket = ((h ^ (kind.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))) * BASE) >> np.uint64(48)
        value = 1.0 / np.bincount(at, minlength=len(each))[at]
        out += [(at, kind, value), (at, bucket.astype(np.int64) % BUCKETS + TIMES * 8, value)]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


@dataclass
class Scorer:
    """The classifier, and the probability from which a text is checked."""

    model: logistic.Logistic
    checked: float = CHECKED

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        at, f, v = features(texts)
        return self.model.score(np.bincount(at, self.model.weights[f] * v, len(texts)))


def fit(texts: list[str | None], labels: list[bool]) -> Scorer:
    """The classifier of labelled rows, calibrated on every fourth of them."""
    held = np.arange(len(texts)) % 4 == 3
    y = np.array(labels, float)
    checked = CHECKED if y.sum() >= LEAST_LABELS else 0.0
    if not len(y):
        return Scorer(logistic.Logistic(np.zeros(BUCKETS + TIMES * 8), 0.0), checked)
    part = lambda keep: ([t for t, k in zip(texts, keep) if k], y[keep])
    own, own_y = part(~held)
    model = logistic.fit(*features(own), own_y, BUCKETS + TIMES * 8, rounds=120, rate=1.0, shrink=1e-7)
    kept, kept_y = part(held)
    at, f, v = features(kept)
    return Scorer(logistic.calibrate(model, np.bincount(at, model.weights[f] * v, len(kept)), kept_y), checked)


def fitted(df: DataFrame, key: str = "row_id", text: str = "text", size: int = FIT_ROWS) -> Scorer:
    """The classifier of a table, fitted on about ``size`` of its rows, picked by a hash of their key and labelled by the definition of a repetitive text."""
    every = max(1, df.count() // size)
    h = F.xxhash64(F.col(f"`{key}`"))
    texts = [r[0] for r in df.where(F.pmod(h, F.lit(every)) == 0).select(F.col(f"`{text}`"), h.alias("h")).orderBy("h").collect()]
    return fit(texts, [is_repetitive(t) for t in texts])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = [repeated_words(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in counts], pa.int64()), pa.array([r for _, r in counts], pa.int64())], names=["row_id", "words", "repeated"])


def _score(batches: Iterator[pa.RecordBatch], scorer: Scorer) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            b = batch.slice(at, ROWS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.probabilities(b.column(1).to_pylist()))], names=["row_id", "probability"])


def _find(batches: Iterator[pa.RecordBatch], scorer: Scorer) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            b = batch.slice(at, ROWS)
            texts = b.column(1).to_pylist()
            likely = np.flatnonzero(scorer.probabilities(texts) >= scorer.checked)
            found = [i for i in likely.tolist() if is_repetitive(texts[i])]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(found, pa.int64()))], names=["row_id"])


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").cast("bigint").alias("row_id"), F.col(f"`{text}`").alias("text"))


def repeated_shares(df: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """``row_id, words, repeated, share``: one row per row of ``df``. Counted exactly in every text; share is null where a text is null or has no words."""
    return _rows(df, key, text).mapInArrow(_count, "row_id bigint, words bigint, repeated bigint").withColumn("share", F.when(F.col("words") > 0, F.col("repeated") / F.col("words")))


def scored_rows(df: DataFrame, key: str = "row_id", text: str = "text", scorer: Scorer | None = None) -> DataFrame:
    """``row_id, probability, repetitive``: the classifier's calibrated probability of every row, and whether it is LIKELY. A null or empty text has the probability of a text without n-grams."""
    scorer = scorer or fitted(df, key, text)
    return _rows(df, key, text).mapInArrow(partial(_score, scorer=scorer), "row_id bigint, probability double").withColumn("repetitive", F.col("probability") >= LIKELY)


def repetitive_rows(df: DataFrame, key: str = "row_id", text: str = "text", scorer: Scorer | None = None) -> DataFrame:
    """``row_id`` of the repetitive texts: those that the classifier gives a probability of CHECKED or more and that the exact count confirms. Whole texts, without a shuffle."""
    return _rows(df, key, text).mapInArrow(partial(_find, scorer=scorer or fitted(df, key, text)), "row_id bigint")


def classifier_report(df: DataFrame, key: str = "row_id", text: str = "text") -> DataFrame:
    """``threshold, rows, repetitive, passed, both``: how the classifier, at either threshold, agrees with the exact count over all rows."""
    scorer = fitted(df, key, text)
    true = (F.col("words") >= LEAST_WORDS) & (2 * F.col("repeated") > F.col("words"))
    joined = scored_rows(df, key, text, scorer).join(repeated_shares(df, key, text), "row_id")
    at = F.explode(F.array(F.lit(CHECKED), F.lit(LIKELY))).alias("threshold")
    over = F.col("probability") >= F.col("threshold")
    return (
        joined.select("*", at)
        .groupBy("threshold")
        .agg(F.count("*").alias("rows"), F.count_if(true).alias("repetitive"), F.count_if(over).alias("passed"), F.count_if(over & true).alias("both"))
    )
