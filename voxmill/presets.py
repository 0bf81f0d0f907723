"""Quality presets: the limits that the stages of a dataset build work by."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

#: Version of the rules that clips are selected by; datasets of different versions are not mixed.
ALGORITHM_VERSION = 2
# fixed values: suffixes of recordings
MEDIA_SUFFIXES = (".wav", ".flac", ".mp3", ".m4a", ".aac", ".ogg", ".opus", ".mp4", ".mkv", ".mov", ".webm", ".avi", ".mka")


@dataclass(frozen=True)
class Preset:
    """Limits of one quality level; seconds, dBFS, shares and cosine similarities."""

    name: str
    label: str
    use_separation: bool
    separation_model: str
    speaker_threshold: float
    speaker_margin: float
    segment_verify: bool
    segment_threshold: float
    min_clip: float
    max_clip: float
    merge_gap: float
    max_overlap: float
    min_rms_dbfs: float
    max_clipping_ratio: float
    max_silence_ratio: float
    asr_model: str
    diarization_window: int


# fixed values: the three levels
PRESETS = {
    p.name: p
    for p in (
        Preset("fast", "Быстро", False, "htdemucs", 0.34, 0.06, False, 0.30, 1.0, 18.0, 0.45, 0.20, -46.0, 0.015, 0.78, "small", 300),
        Preset("balanced", "Сбалансированно", True, "htdemucs", 0.42, 0.08, False, 0.38, 1.2, 14.0, 0.35, 0.10, -42.0, 0.006, 0.68, "turbo", 600),
        Preset("maximum", "Максимум", True, "htdemucs_ft", 0.50, 0.10, True, 0.44, 1.5, 12.0, 0.25, 0.05, -39.0, 0.0025, 0.58, "large-v3", 600),
    )
}


def preset(name: str = "maximum") -> Preset:
    """The preset of a name or label; an unknown one raises KeyError."""
    return PRESETS.get(name) or next((p for p in PRESETS.values() if p.label == name), None) or PRESETS[name]


def preset_table(spark: SparkSession) -> DataFrame:
    """The presets as a dimension of three rows."""
    return spark.createDataFrame([asdict(p) for p in PRESETS.values()], ", ".join(f"{f} {t}" for f, t in _TYPES.items()))


_TYPES = {f: {"bool": "boolean", "str": "string", "float": "double", "int": "int"}[t] for f, t in Preset.__annotations__.items()}
