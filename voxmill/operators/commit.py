"""Clips that enter a dataset once: keys, duplicates, numbers, new and known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.text import fixed, ms_key, path_key, sanitize, trim_space
from voxmill.ordered import numbered

KEY = ["source", "start_ms", "end_ms"]


def with_key(clips: DataFrame) -> DataFrame:
    """The clips with ``source`` trimmed and ``start_ms, end_ms``; clips whose source is null or blank or whose times are null, NaN or infinite can't be keyed and are left out."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < 9.0e12)
    rows = clips.withColumn("source", trim_space(F.col("source"))).where((F.col("source") != "") & finite("start") & finite("end"))
    return rows.withColumn("start_ms", ms_key(F.col("start"))).withColumn("end_ms", ms_key(F.col("end")))


def first_of_each(keyed: DataFrame, order: list[str], keys: list[str] = KEY) -> DataFrame:
    """One row per key: the first by ``order``. Combined before the shuffle, so a key that holds a third of all rows is no burden."""
    rest = [c for c in keyed.columns if c not in keys]
    first = keyed.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return first.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def new_or_known(keyed: DataFrame, existing: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The keyed clips with ``known_file`` and ``known_text`` of the dataset's clip of the same key (null where there is none). ``existing`` may hold a key more than once: its last file by name counts."""
    one = existing.groupBy(*keys).agg(F.max_by(F.struct("file", "text"), F.struct("file", "text")).alias("__known"))
    return keyed.join(one, keys, "left").withColumn("known_file", F.col("__known.file")).withColumn("known_text", F.col("__known.text")).drop("__known")


def next_index(listing: DataFrame, path: str = "path") -> Column:
    """Aggregate: one more than the highest number that names a file of the listing ``audio/NUMBER.wav``; 1 where there is none. Other names don't count."""
    stem = F.regexp_extract(path_key(F.col(path)), r"^audio/([0-9]{1,18})\.wav$", 1)
    return (F.coalesce(F.max(F.expr("try_cast(nullif(__stem, '') AS BIGINT)")), F.lit(0)) + 1).alias("next_index"), stem


def next_number(listing: DataFrame, path: str = "path") -> DataFrame:
    """``next_index``: one row."""
    agg, stem = next_index(listing, path)
    return listing.select(stem.alias("__stem")).agg(agg)


def clip_file(number: Column) -> Column:
    """``audio/000001.wav``; longer numbers keep all their digits."""
    return F.concat(F.lit("audio/"), F.format_string("%06d", number), F.lit(".wav"))


def numbered_clips(clips: DataFrame, order: list[str], start: int) -> DataFrame:
    """The clips with ``file``, densely numbered in the order of ``order``."""
    return numbered(clips, order, "__n", start).withColumn("file", clip_file(F.col("__n"))).drop("__n")


def commit(staged: DataFrame, existing: DataFrame, listing: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new, usable) of staged clips ``source, start, end, text, duration, ...``.

    Of staged clips of one key the first counts. A key that the dataset has is no new clip: it takes over file and text, and is usable where
    its file is listed. New clips get the next numbers and sanitised text, and are all usable. Running it again over the result adds none.
    """
    rest = [c for c in staged.columns if c not in ("file", "text")]
    judged = new_or_known(first_of_each(with_key(staged), order), with_key(existing))
    start = next_number(listing).first()[0]
    fresh = numbered_clips(judged.where(F.col("known_file").isNull()).drop("known_file", "known_text", "file"), order, start)
    fresh = fresh.select("file", sanitize(F.col("text")).alias("text"), *rest)
    there = listing.select(path_key(F.col("path")).alias("__p")).distinct()
    known = judged.where(F.col("known_file").isNotNull()).withColumn("__p", path_key(F.col("known_file"))).join(there, "__p", "left_semi")
    return fresh, fresh.unionByName(known.select(F.col("known_file").alias("file"), F.col("known_text").alias("text"), *rest))


def printed(clips: DataFrame) -> DataFrame:
    """The extended columns with the decimals that the dataset's CSV holds."""
    three = ("start", "end", "duration")
    return clips.select(
        "file", "text", "source", *[fixed(F.col(c), 3).alias(c) for c in three], fixed(F.col("speaker_similarity"), 5).alias("speaker_similarity"),
        *[fixed(F.col(c), 3).alias(c) for c in ("rms_dbfs", "peak_dbfs")], *[fixed(F.col(c), 7).alias(c) for c in ("clipping_ratio", "silence_ratio")],
    )
