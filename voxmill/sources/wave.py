"""PCM16 WAV files as rows: a data source that reads frame ranges, cuts, and speaker profiles."""

from __future__ import annotations

import glob
import os
import shutil
import subprocess
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from voxmill.operators.quality import CLIPPED, SILENT
from voxmill.schemas import WAVE

#: Frames of a row of the data source: longer files come as several rows.
BLOCK = 1 << 20


class Block(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class WaveReader(DataSourceReader):
    """One partition per block of frames; only that range of the file is read."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.block = options["path"], int(options.get("block", BLOCK))

    def partitions(self) -> list[Block]:
        out = []
        for path in sorted(glob.glob(os.path.join(self.folder.removeprefix("file:"), "**", "*.[wW][aA][vV]"), recursive=True)):
            with wave.open(path, "rb") as w:
                n = w.getnframes()
            out += [Block(path, i, min(self.block, n - i)) for i in range(0, n, self.block)] or [Block(path, 0, 0)]
        return out

    def read(self, part: Block) -> Iterator[tuple]:
        with wave.open(part.path, "rb") as w:
            rate, channels, width, frames = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes()
            w.setpos(part.first)
            data = w.readframes(part.count)
        samples = np.frombuffer(data, "<i2").tolist() if width == 2 else None
        yield part.path, rate, channels, width, frames, part.first, samples


class WaveSource(DataSource):
    """``spark.read.format("pcm16").load(folder)``: ``path, rate, channels, width, frames, first, samples``. Of files that aren't 16 bits wide samples are null."""

    @classmethod
    def name(cls) -> str:
        return "pcm16"

    def schema(self) -> str:
        return WAVE.replace(", samples", ", first bigint, samples")

    def reader(self, schema) -> WaveReader:
        return WaveReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WaveSource)


def durations(files: DataFrame) -> DataFrame:
    """``path, seconds`` from the headers of the WAV files among ``files``; null where a header can't be read."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for p in pdf["path"]:
                try:
                    with wave.open(p.removeprefix("file:"), "rb") as w:
                        out.append(w.getnframes() / w.getframerate())
                except (OSError, EOFError, wave.Error, ZeroDivisionError):
                    out.append(None)
            yield pd.DataFrame({"path": pdf["path"], "seconds": pd.array(out, dtype="Float64")})

    return files.select("path").mapInPandas(probe, "path string, seconds double")


def waveform(samples, channels: int) -> np.ndarray:
    """Samples as float32 in [-1, 1], one row per channel; an empty recording raises ValueError."""
    a = np.asarray(samples, np.float32) / 32768.0
    if not a.size:
        raise ValueError("the recording is empty")
    return a.reshape(-1, channels).T


def cut(source: str, target: str, start: float, end: float, rate: int | None = None) -> float:
    """Writes [start, end) of a WAV file as mono PCM16, 0.01 s at least, resampled where ``rate`` differs; returns its seconds."""
    with wave.open(source, "rb") as w:
        own, channels = w.getframerate(), w.getnchannels()
        w.setpos(min(max(0, int(start * own)), max(0, w.getnframes() - 1)))
        a = np.frombuffer(w.readframes(max(1, int(max(0.01, end - start) * own))), "<i2").reshape(-1, channels).mean(1)
    if rate and rate != own and len(a):
        a = np.interp(np.arange(int(len(a) * rate / own)) * own / rate, np.arange(len(a)), a)
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    with wave.open(target, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate or own)
        w.writeframes(np.rint(a).astype("<i2").tobytes())
    return len(a) / (rate or own)


def concatenated(source: str, target: str, pieces: list[tuple[float, float]]) -> float:
    """Writes pieces ``(start, seconds)`` of a WAV file one after another, reading only these; returns the seconds written."""
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    written = 0
    with wave.open(source, "rb") as w, wave.open(target, "wb") as out:
        out.setparams(w.getparams())
        rate, n = w.getframerate(), w.getnframes()
        for start, seconds in pieces:
            w.setpos(min(max(0, int(start * rate)), max(0, n - 1)))
            data = w.readframes(max(1, int(seconds * rate)))
            out.writeframes(data)
            written += len(data) // (w.getsampwidth() * w.getnchannels())
    return written / rate


def measured(path: str) -> tuple[float, float, float, float, float, int]:
    """``duration, rms_dbfs, peak_dbfs, clipping_ratio, silence_ratio, width`` of a WAV file, as quality.clip_stats has them."""
    with wave.open(path, "rb") as w:
        width, rate, frames = w.getsampwidth(), w.getframerate(), w.getnframes()
        a = np.frombuffer(w.readframes(frames) if width == 2 else b"", "<i2").astype(np.int32)
    if not a.size:
        return 0.0, -120.0, -120.0, 1.0, 1.0, width
    level = np.abs(a)
    db = lambda x: 20 * float(np.log10(max(float(x), 1.0) / 32768.0))
    return frames / rate, db(np.sqrt(np.mean(a.astype(np.float64) ** 2))), db(level.max()), float(np.mean(level >= CLIPPED)), float(np.mean(level <= SILENT)), width


def measure_all(clips: DataFrame, path: str = "path") -> DataFrame:
    """``clips`` with the statistics of their files."""
    names = ["duration", "rms_dbfs", "peak_dbfs", "clipping_ratio", "silence_ratio", "width"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame([measured(p) for p in pdf[path]], columns=names)], axis=1)

    schema = ", ".join([*(f"`{n}` {t}" for n, t in clips.dtypes), *(f"{n} double" for n in names[:-1]), "width int"])
    return clips.mapInPandas(work, schema)


def decoded(source: str, target: str, rate: int, channels: int) -> None:
    """Writes any recording as PCM16 WAV by ffmpeg; RuntimeError where that is missing or fails."""
    if not (tool := shutil.which("ffmpeg")):
        raise RuntimeError("ffmpeg is needed for recordings that aren't WAV")
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
    done = subprocess.run([tool, "-y", "-hide_banner", "-loglevel", "error", "-i", source, "-vn", "-ac", str(channels), "-ar", str(rate), "-c:a", "pcm_s16le", target], stdin=subprocess.DEVNULL, capture_output=True)
    if done.returncode:
        raise RuntimeError(done.stderr.decode(errors="replace")[-500:])


def cut_all(clips: DataFrame) -> DataFrame:
    """``source, target, start, end`` cut by the executors, on a file system that all share: ``target, seconds``."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"target": pdf["target"], "seconds": [cut(r.source, r.target, r.start, r.end) for r in pdf.itertuples(index=False)]})

    return clips.select("source", "target", "start", "end").mapInPandas(work, "target string, seconds double")


def joined(parts: DataFrame, keys: list[str], order: str, samples: str = "samples") -> DataFrame:
    """Stems of the chunks of one recording as one, in order; a recording is bounded by its planned chunks."""
    own = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(samples).alias("s"))))
    return parts.groupBy(*keys).agg(F.flatten(F.transform(own, lambda x: x["s"])).alias(samples))
