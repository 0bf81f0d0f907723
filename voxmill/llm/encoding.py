"""Problem 7: every text as its token ids, by a tree of halves that a monoid joins."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k"
#: Characters of a leaf of the tree.
LEAF = 32_768
#: Characters on either side of a seam that are encoded again at first; doubled until the ids outside are proven.
WINDOW = 32
#: Texts encoded at a time within a batch.
ROWS = 256
#: A place where the pre-tokeniser always splits, whatever stands before and behind: a space or line feed after a letter or digit. Ids on its two sides do not depend on each other.
CUT = re.compile(r"(?<=[^\W_])[ \n]")

#: Runs of so many spaces are too long for the pre-tokeniser's pattern and are cut out before it: such a run is one piece, less its last character where text follows.
SPACE_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")

Encode = Callable[[str], list[int]]


@cache
def vocabulary(name: str = VOCABULARY, path: str | None = None):
    """The public byte-level vocabulary ``name``, from the file at ``path`` or the installed package; names of special tokens are ordinary text."""
    import public_tokenizers as P
    import tiktoken

    with open(path or P.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(name: str = VOCABULARY, path: str | None = None) -> Encode:
    """The ids of a text, in one piece."""
    v = vocabulary(name, path)

    def encode(text: str) -> list[int]:
        out, at = [], 0
        for m in SPACE_RUN.finditer(text):
            end = m.end() - (m.end() < len(text))
            out += v.encode_ordinary(text[at : m.start()]) + v._encode_single_piece(text[m.start() : end].encode())
            at = end
        return out + v.encode_ordinary(text[at:]) if at else v.encode_ordinary(text)

    return encode


@dataclass(frozen=True)
class Part:
    """A stretch of a text and its ids, as if the text were no more than it. Parts are a monoid under join; Part("", []) is neutral."""

    text: str
    ids: list[int]


def join(a: Part, b: Part, encode: Encode, window: int = WINDOW) -> Part:
    """The part of two neighbours. A window around the seam is encoded again and grows on each side until it ends at a cut, beyond which no id can change, or takes in the whole side."""
    if not a.text or not b.text:
        return b if not a.text else a
    size = window
    while True:
        start = max(0, len(a.text) - size)
        cut = CUT.search(a.text, max(0, start - 1))
        if cut or not start:
            left = cut.start() if cut else 0
            break
        size *= 2
    size = window
    while True:
        right = None
        for m in CUT.finditer(b.text, 0, min(len(b.text), size)):
            right = m.start()
        if right is not None or size >= len(b.text):
            right = len(b.text) if right is None else right
            break
        size *= 2
    tail, head = a.text[left:], b.text[:right]
    # the ids of tail and head alone are the last ids of a and the first of b
    kept, dropped = len(a.ids) - len(encode(tail)), len(encode(head))
    return Part(a.text + b.text, [*a.ids[:kept], *encode(tail + head), *b.ids[dropped:]])


def encode_tree(text: str, encode: Encode, leaf: int = LEAF) -> Part:
    """The part of a text: leaves are encoded as they are, halves joined up the tree."""
    if len(text) <= leaf:
        return Part(text, encode(text))
    # halves of whole leaves, so that the depth is the logarithm of the leaves
    half = leaf * max(1, -(-len(text) // leaf) // 2)
    return join(encode_tree(text[:half], encode, leaf), encode_tree(text[half:], encode, leaf), encode)


def encode_text(text: str | None, encode: Encode, leaf: int = LEAF) -> list[int]:
    """The ids of a text. Null and empty texts have none."""
    return encode_tree(text, encode, leaf).ids if text else []


def decode(ids: list[int], name: str = VOCABULARY, path: str | None = None) -> str:
    """The text of ids: the bytes of halves, concatenated up the tree."""
    v = vocabulary(name, path)

    def tree(a: int, b: int) -> bytes:
        return v.decode_bytes(ids[a:b]) if b - a <= LEAF else tree(a, (a + b) // 2) + tree((a + b) // 2, b)

    return tree(0, len(ids)).decode("utf-8", "replace")


def _ids(batches: Iterator[pa.RecordBatch], name: str, path: str | None) -> Iterator[pa.RecordBatch]:
    encode = encoder(name, path)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            b = batch.slice(at, ROWS)
            each = [encode_text(t, encode) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
            flat = np.fromiter((i for ids in each for i in ids), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])


def _texts(batches: Iterator[pa.RecordBatch], name: str, path: str | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode(ids or [], name, path) for ids in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", name: str = VOCABULARY, path: str | None = None) -> DataFrame:
    """``doc_id, ids``: one row per row of ``df``, null and empty texts included (an empty list). Without a shuffle; each text is encoded whole in its own task."""
    return df.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(partial(_ids, name=name, path=path), "doc_id bigint, ids array<int>")


def texts_of(ids: DataFrame, name: str = VOCABULARY, path: str | None = None) -> DataFrame:
    """``doc_id, text``: the texts of rows ``doc_id, ids``; an empty list and null give the empty text."""
    return ids.select("doc_id", "ids").mapInArrow(partial(_texts, name=name, path=path), "doc_id bigint, text string")
