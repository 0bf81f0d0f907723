"""The models that a build calls: an interface, and how their answers become rows. None is bundled."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from voxmill.functions.text import MEMORY_ERRORS
from voxmill.schemas import SEGMENTS


class ModelProvider(Protocol):
    """What a provider offers; its object is sent to the executors and loads its models there, once per worker."""

    def diarize(self, path: str) -> list[tuple[float, float, str]]: ...

    def encode(self, path: str) -> list[float]: ...

    def separate(self, path: str) -> str: ...

    def transcribe(self, path: str, language: str | None) -> list[str]: ...


class NoModels:
    """The default: every call says what is missing."""

    def _missing(self, *_: object) -> None:
        raise RuntimeError("no model provider is configured; pass one that implements ModelProvider")

    diarize = encode = separate = transcribe = _missing


def diarized(chunks: DataFrame, provider: ModelProvider) -> DataFrame:
    """Segments of chunks ``source_id, chunk_idx, path``, in order of start, end and speaker."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r.source_id, r.chunk_idx, *s) for r in pdf.itertuples(index=False) for s in sorted(provider.diarize(r.path))]
            yield pd.DataFrame(rows, columns=["source_id", "chunk_idx", "start", "end", "speaker"])

    return chunks.select("source_id", "chunk_idx", "path").mapInPandas(work, SEGMENTS)


def encoded(clips: DataFrame, provider: ModelProvider) -> DataFrame:
    """``path, embedding``: the vector of each clip, normalised."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p in pdf["path"]:
                v = [float(x) for x in provider.encode(p)]
                n = sum(x * x for x in v) ** 0.5
                out.append([x / n for x in v] if n > 1e-12 else v)
            yield pd.DataFrame({"path": pdf["path"], "embedding": out})

    return clips.select("path").mapInPandas(work, "path string, embedding array<float>")


def separated(chunks: DataFrame, provider: ModelProvider) -> DataFrame:
    """``path, vocals``: where the voice of each chunk is."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "vocals": [provider.separate(p) for p in pdf["path"]]})

    return chunks.select("path").mapInPandas(work, "path string, vocals string")


def transcribed(clips: DataFrame, provider: ModelProvider, language: str | None = None) -> DataFrame:
    """``file, text`` of clips ``file, path`` that have no text yet: recognised parts stripped, empty ones dropped, joined by a space."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"file": pdf["file"], "text": [" ".join(" ".join(x.strip() for x in provider.transcribe(p, language) if x.strip()).split()) for p in pdf["path"]]})

    return clips.select("file", "path").mapInPandas(work, "file string, text string")


class Fallback:
    """A provider that asks ``first`` and, where its device runs out of memory, ``second`` (the same models on the CPU). Other errors are passed on."""

    def __init__(self, first: ModelProvider, second: ModelProvider):
        self.first, self.second = first, second

    def _ask(self, name: str, *args: object):
        try:
            return getattr(self.first, name)(*args)
        except RuntimeError as e:
            if not any(m in str(e).lower() for m in MEMORY_ERRORS):
                raise
            return getattr(self.second, name)(*args)

    def diarize(self, path: str) -> list[tuple[float, float, str]]:
        return self._ask("diarize", path)

    def encode(self, path: str) -> list[float]:
        return self._ask("encode", path)

    def separate(self, path: str) -> str:
        return self._ask("separate", path)

    def transcribe(self, path: str, language: str | None) -> list[str]:
        return self._ask("transcribe", path, language)
