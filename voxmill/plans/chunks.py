"""Chunk plans over durations, and limits by device."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_plan(df: DataFrame, window: float, duration: str = "duration", least: float = 0.05) -> DataFrame:
    """``df's columns, chunk_idx, chunk_start, chunk_end``: tumbling chunks of ``window`` seconds. A chunk of ``least`` seconds or less ends the plan; a null or NaN duration has none."""
    d = F.col(f"`{duration}`")
    n = F.greatest(F.lit(1), F.ceil(d / window)).cast("int")
    rows = df.where(d.isNotNull() & ~F.isnan(d)).withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("chunk_idx") * F.lit(float(window))
    end = F.least(d, start + window)
    return rows.withColumn("chunk_start", start).withColumn("chunk_end", end).where(F.col("chunk_end") - F.col("chunk_start") > least)


def guard_plan(df: DataFrame, chunk: float, guard: float = 2.0, duration: str = "duration", least: float = 0.01) -> DataFrame:
    """``df's columns, index, core_start, core_duration, input_start, input_duration, trim_start``: chunks of at least 30 s that are read with ``guard`` seconds more on either side."""
    d, size, g = F.greatest(F.lit(0.0), F.col(f"`{duration}`")), float(max(30.0, chunk)), float(max(0.0, guard))
    rows = df.where(F.col(f"`{duration}`").isNotNull() & ~F.isnan(F.col(f"`{duration}`")) & (d > 0)).withColumn("index", F.explode(F.sequence(F.lit(0), F.ceil(d / size).cast("int") - 1)))
    start = F.col("index") * F.lit(size)
    end = F.least(d, start + size)
    begin, stop = F.greatest(F.lit(0.0), start - g), F.least(d, end + g)
    parts = {"core_start": start, "core_duration": end - start, "input_start": begin, "input_duration": stop - begin, "trim_start": start - begin}
    return rows.select("*", *[c.alias(n) for n, c in parts.items()]).where(F.col("core_duration") > least)


def outer_job(model: Column, duration: Column) -> Column:
    """Seconds of an outer separation job: 600 for the fine-tuned model, else 900; null where the recording is no longer than that and half a second."""
    size = F.when(model == "htdemucs_ft", 600.0).otherwise(900.0)
    return F.when(duration > size + 0.5, size)


def window_cap(base: Column, device: Column, vram_gb: Column) -> Column:
    """Seconds of a diarization window: at most 300 without an accelerator, of unknown or little memory (6.5 GB), at most 600 up to 10 GB."""
    small = (device != "cuda") | device.isNull() | vram_gb.isNull() | (vram_gb <= 6.5)
    return F.when(small, F.least(base, F.lit(300))).when(vram_gb <= 10.0, F.least(base, F.lit(600))).otherwise(base)


def model_segment(device: Column, model: Column, vram_gb: Column) -> Column:
    """Seconds of a separator's inner segment by accelerator memory; null where its own default holds."""
    hybrid = F.when(vram_gb.isNull() | (vram_gb <= 6.5), 6).when(vram_gb <= 10.0, 7)
    others = F.when(vram_gb.isNull(), 8).when(vram_gb <= 4.5, 6).when(vram_gb <= 6.5, 8).when(vram_gb <= 8.5, 12)
    return F.when(device == "cuda", F.when(F.startswith(model, F.lit("htdemucs")), hybrid).otherwise(others))


def still_valid(cached: Column, wanted: Column, kind: str, parts: Column | None = None) -> Column:
    """Whether a cached artifact's duration is near enough: ``merged`` within 1 s, ``core`` within 0.75 s, ``final`` within the larger of 1 s and 0.08 s a part."""
    limit = {"merged": F.lit(1.0), "core": F.lit(0.75), "final": F.greatest(F.lit(1.0), F.lit(0.08) * (parts if parts is not None else F.lit(1)))}[kind]
    return F.coalesce(F.abs(cached - wanted) <= limit, F.lit(False))


def chunks_without_cache(plan: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """The planned chunks of which no segments are cached."""
    return plan.join(cached.select(*keys).distinct(), keys, "left_anti")
