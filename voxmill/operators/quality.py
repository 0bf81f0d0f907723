"""Clip statistics over PCM samples, the verdict on them, and what was rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.text import fixed, safe_name
from voxmill.presets import Preset

# fixed values: amplitudes from which a sample counts as clipped, and up to which as silent
CLIPPED, SILENT = int(32767 * 0.995), int(32768 * 10 ** (-50 / 20))


def dbfs(amplitude: Column) -> Column:
    """Decibels below full scale of an amplitude; less than one counts as one."""
    return 20 * F.log10(F.greatest(amplitude.cast("double"), F.lit(1.0)) / 32768.0)


def clip_stats(df: DataFrame, samples: str = "samples", rate: str = "rate", channels: str | None = None) -> DataFrame:
    """``df`` with ``duration, rms_dbfs, peak_dbfs, clipping_ratio, silence_ratio``; all channels together. Without samples: 0, -120, -120, 1, 1."""
    s, n = F.col(f"`{samples}`"), F.coalesce(F.size(F.col(f"`{samples}`")), F.lit(0))
    level = F.transform(s, lambda x: F.abs(x.cast("int")))
    square = F.aggregate(s, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    share = lambda keep: F.size(F.filter(level, keep)) / n
    per = F.col(f"`{channels}`") if channels else F.lit(1)
    empty = lambda c, other: F.when(n > 0, c).otherwise(F.lit(float(other)))
    return df.select(
        "*",
        empty(n / per / F.col(f"`{rate}`"), 0).alias("duration"),
        empty(dbfs(F.sqrt(square / n)), -120).alias("rms_dbfs"),
        empty(dbfs(F.array_max(level)), -120).alias("peak_dbfs"),
        empty(share(lambda x: x >= CLIPPED), 1).alias("clipping_ratio"),
        empty(share(lambda x: x <= SILENT), 1).alias("silence_ratio"),
    )


def verdict(min_seconds: float, max_seconds: float, min_rms: float, max_clipping: float, max_silence: float, width: Column | None = None) -> Column:
    """Why a clip is rejected, the first reason that holds, or the empty string where it is accepted. Half a second over the limit is no reason; limits themselves are kept."""
    c = F.col
    reason = F.when(width != 2, "unsupported_sample_width") if width is not None else F.when(F.lit(False), "")
    return (
        reason.when((c("duration") == 0) & (c("rms_dbfs") == -120), "empty")
        .when(c("duration") < min_seconds, "too_short")
        .when(c("duration") > max_seconds + 0.5, "too_long")
        .when(c("rms_dbfs") < min_rms, "too_quiet")
        .when(c("clipping_ratio") > max_clipping, "clipping")
        .when(c("silence_ratio") > max_silence, "too_much_silence")
        .otherwise("")
    )


def preset_verdict(p: Preset) -> Column:
    return verdict(p.min_clip, p.max_clip, p.min_rms_dbfs, p.max_clipping_ratio, p.max_silence_ratio)


def second_verification(reason: Column, clip_similarity: Column, p: Preset) -> Column:
    """The verdict after the clip's own similarity: only accepted clips, only where the preset verifies."""
    return F.when((reason == "") & F.lit(p.segment_verify) & (clip_similarity < p.segment_threshold), "speaker_low_confidence").otherwise(reason)


def reject_summary(judged: DataFrame, reason: str = "reason", duration: str = "duration") -> DataFrame:
    """``reason, clips, seconds`` of the rejected."""
    return judged.where(F.col(reason) != "").groupBy(F.col(reason).alias("reason")).agg(F.count("*").alias("clips"), F.sum(duration).alias("seconds"))


def rejected_path(fingerprint: Column, source: Column, start: Column, end: Column, reason: Column) -> Column:
    """Where a rejected clip is kept: ``rejected/reason/stem_tag.wav``."""
    tag = F.substring(F.sha1(F.concat_ws("|", fingerprint, fixed(start, 3), fixed(end, 3), reason)), 1, 12)
    stem = F.regexp_replace(source, r"(?<=.)\.[^./]*$", "")
    return F.concat(F.lit("rejected/"), safe_name(reason), F.lit("/"), F.substring(safe_name(stem), 1, 50), F.lit("_"), tag, F.lit(".wav"))
