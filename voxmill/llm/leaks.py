"""Problem 8: passages of benchmark items in documents, whole or with a few words wrong.

Each passage is split into one piece more than words may be wrong, so that one piece stands unharmed in whatever holds the passage. Pieces
are found exactly by rolling hashes, and around each hit Myers' bit-parallel algorithm takes the edit distance in words. Passages of
distance 0 stand there word for word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: Words of a passage; shorter items count as a whole.
PASSAGE = 12
#: Words of a passage that may be wrong, missing or added; of short items one less than they have words.
ERRORS = 1
#: Texts searched at a time within a batch.
ROWS = 256
BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Unbroken runs of letters and digits of the lower-cased text."""
    return WORD.findall((text or "").lower())


def distance(pattern: list[int], text: list[int]) -> int:
    """Least edit distance, in words, of the pattern to any stretch of the text (Myers' bit-parallel algorithm)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    pv, mv, score = full, 0, m
    best = m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        best = min(best, score)
    return best


class Index:
    """Pieces of all passages of the items. A passage with at most ``errors`` wrong words has one of its ``errors + 1`` pieces unharmed."""

    def __init__(self, items: list[tuple[int, str | None]], errors: int = ERRORS, passage: int = PASSAGE):
        self.vocabulary: dict[str, int] = {}
        self.items = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(t)]) for i, t in items]
        places: dict[int, dict[tuple[int, ...], list[tuple[int, int, int, int, int]]]] = {}
        for k, (_, ids) in enumerate(self.items):
            w = min(passage, len(ids))
            if not w:
                continue
            budget = min(errors, w - 1)
            piece = w // (budget + 1)
            for start in range(len(ids) - w + 1):
                for j in range(budget + 1):
                    at = start + j * piece
                    places.setdefault(piece, {}).setdefault(tuple(ids[at : at + piece]), []).append((k, start, w, j * piece, budget))
        self.places = places
        self.bags = {(k, start): frozenset(self.items[k][1][start : start + w]) for d in places.values() for own in d.values() for k, start, w, *_ in own}
        self.hashes = {n: np.unique(np.array([self.hash(p) for p in d], np.uint64)) for n, d in places.items()}

    @staticmethod
    def hash(piece: tuple[int, ...]) -> int:
        h = 0
        for x in piece:
            h = (h * int(BASE) + x) & 0xFFFFFFFFFFFFFFFF
        return h

    def found(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(number of the text, item_id, distance) of each text that holds a passage of the item; distance is the least of any passage."""
        get, bags = self.vocabulary.get, self.bags
        docs = [[get(w, 0) for w in words(t)] for t in texts]
        # texts are kept apart by unknown words, which no piece holds
        ends = np.cumsum([len(d) + 1 for d in docs])
        ids = np.fromiter((x for d in docs for x in (*d, 0)), np.uint64, int(ends[-1]) if docs else 0)
        out: dict[tuple[int, int], int] = {}
        rolled = np.zeros(len(ids), np.uint64)
        for n in range(1, max(self.hashes, default=0) + 1):
            if n > len(ids):
                break
            rolled = rolled[: len(ids) - n + 1] * BASE + ids[n - 1 :]
            if n not in self.hashes:
                continue
            table = self.hashes[n]
            slot = np.minimum(np.searchsorted(table, rolled), len(table) - 1)
            hits = np.flatnonzero(table[slot] == rolled)
            for at, row in zip(hits.tolist(), np.searchsorted(ends, hits, side="right").tolist()):
                doc, local = docs[row], at - (int(ends[row - 1]) if row else 0)
                for k, start, w, skip, budget in self.places[n].get(tuple(doc[local : local + n]), ()):
                    item, own = self.items[k]
                    best = out.get((row, item), budget + 1)
                    if not best:
                        continue
                    window = doc[max(0, local - skip - budget) : local - skip + w + budget]
                    # each word of the passage that the window lacks is an error
                    if len(bags[k, start].difference(window)) > budget:
                        continue
                    d = distance(own[start : start + w], window)
                    if d < best:
                        out[row, item] = d
        return sorted((row, item, d) for (row, item), d in out.items())


def _search(batches: Iterator[pa.RecordBatch], items: list[tuple[int, str | None]], errors: int) -> Iterator[pa.RecordBatch]:
    index = Index(items, errors)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            b = batch.slice(at, ROWS)
            keys = b.column(0).to_pylist()
            found = index.found(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([keys[r] for r, _, _ in found], pa.int64()), pa.array([i for _, i, _ in found], pa.int64()), pa.array([d for _, _, d in found], pa.int32())], names=["doc_id", "item_id", "distance"])


def leaks(documents: DataFrame, benchmark: DataFrame, errors: int = ERRORS) -> DataFrame:
    """``doc_id, item_id, distance``: each document that holds PASSAGE consecutive words of an item, or all of a shorter one, with at most ``errors`` words wrong, and how many are at least.

    The benchmark has as many items at every scale and goes to every task. Documents are read once and whole, without a shuffle before the
    pairs. Items without words are in no document; null texts and rows without a key hold nothing; repeated keys count once.
    """
    items = [(r[0], r[1]) for r in benchmark.select(F.col("item_id").cast("bigint"), "text").collect()]
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    found = texts.mapInArrow(partial(_search, items=items, errors=errors), "doc_id bigint, item_id bigint, distance int")
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def leaked_passages(documents: DataFrame, benchmark: DataFrame, errors: int = ERRORS) -> DataFrame:
    """``doc_id, item_id`` of the passages that stand in a document word for word."""
    return leaks(documents, benchmark, errors).where("distance = 0").select("doc_id", "item_id")
