"""Clip candidates: segments of the target speakers without foreign overlap, merged over short gaps and split where too long."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Foreign speech of at most this many seconds in a gap does not keep two segments apart.
SILENT = 0.03


def _overlap(start: np.ndarray, end: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Seconds of each segment that others speak in; others at the same time count each."""
    return np.array([np.maximum(0.0, np.minimum(e, others[:, 1]) - np.maximum(s, others[:, 0])).sum() for s, e in zip(start, end)])


def _split(start: float, end: float, least: float, most: float) -> list[tuple[float, float]]:
    out, pos = [], start
    while end - pos > most:
        out.append((pos, pos + most))
        pos += most
    return [*out, (pos, end)] if end - pos >= least else out


def chunk_merged(rows: list[tuple[float, float, float]], others: np.ndarray, max_overlap: float, max_gap: float, most: float) -> list[tuple[float, float, float]]:
    """``(start, end, similarity)`` of what one chunk's target segments merge to, of the ``(start, end, similarity)`` of these and the starts and ends of all others. The least similarity holds."""
    rows = sorted(rows)
    if rows:
        spoken = _overlap(*np.array(rows)[:, :2].T, others)
        rows = [r for r, o in zip(rows, spoken) if o <= max_overlap]
    merged: list[list[float]] = []
    for s, e, sim in rows:
        if merged:
            cur = merged[-1]
            foreign = s > cur[1] and bool((np.minimum(s, others[:, 1]) - np.maximum(cur[1], others[:, 0]) > SILENT).any())
            if s - cur[1] <= max_gap and e - cur[0] <= most and not foreign:
                cur[1:] = [max(cur[1], e), min(cur[2], sim)]
                continue
        merged.append([s, e, sim])
    return [(s, e, sim) for s, e, sim in merged]


def chunk_candidates(rows: list[tuple[float, float, float]], others: np.ndarray, max_overlap: float, max_gap: float, least: float, most: float) -> list[tuple[float, float, float]]:
    """As chunk_merged, split where longer than ``most``; rests shorter than ``least`` are dropped."""
    return [(a, b, sim) for s, e, sim in chunk_merged(rows, others, max_overlap, max_gap, most) for a, b in _split(s, e, least, most)]


def split(merged: DataFrame, least: float, most: float) -> DataFrame:
    """Rows longer than ``most`` as slices of that length, and the rest where it is at least ``least``."""
    span = F.col("end") - F.col("start")
    full = F.greatest(F.lit(0), F.ceil(span / most) - 1).cast("int")
    at = merged.withColumn("__full", full).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__full"))))
    start = F.col("start") + F.col("__i") * most
    sliced = at.withColumn("__s", start).withColumn("__e", F.when(F.col("__i") < F.col("__full"), start + most).otherwise(F.col("end")))
    return sliced.where((F.col("__i") < F.col("__full")) | (F.col("__e") - F.col("__s") >= least)).withColumn("start", F.col("__s")).withColumn("end", F.col("__e")).drop("__full", "__i", "__s", "__e")


def clip_candidates(segments: DataFrame, targets: list[str] | None, max_overlap: float, max_gap: float, least: float, most: float, keys: tuple[str, ...] = ("chunk_idx",)) -> DataFrame:
    """``keys, start, end, similarity`` of the clips of segments ``keys, start, end, speaker, similarity``: merged_segments, split."""
    return split(merged_segments(segments, targets, max_overlap, max_gap, most, keys), least, most)


def merged_segments(segments: DataFrame, targets: list[str] | None, max_overlap: float, max_gap: float, most: float, keys: tuple[str, ...] = ("chunk_idx",)) -> DataFrame:
    """``keys, start, end, similarity`` of what the target segments merge to; one chunk, which the diarization window bounds, is merged in one task.

    Segments whose times are null or NaN don't count. Segments of speakers other than ``targets``, those without a speaker included, are foreign;
    where ``targets`` is None the boolean column ``target`` tells which are not.
    """
    k = list(keys)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["target"] if targets is None else pdf["speaker"].isin(targets)
        clips = chunk_merged(list(pdf.loc[own, ["start", "end", "similarity"]].itertuples(index=False, name=None)), pdf.loc[~own, ["start", "end"]].to_numpy(float), max_overlap, max_gap, most)
        out = pd.DataFrame(clips, columns=["start", "end", "similarity"])
        for at, key in enumerate(k):
            out.insert(at, key, pdf[key].iloc[0])
        return out

    ok = lambda c: F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`"))
    types = dict(segments.dtypes)
    schema = ", ".join([*(f"`{x}` {types[x]}" for x in k), "`start` double", "`end` double", "similarity double"])
    return segments.where(ok("start") & ok("end")).groupBy(*k).applyInPandas(fold, schema)
