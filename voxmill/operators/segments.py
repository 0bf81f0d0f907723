"""Diarized segments: durations, speakers' speech, target speakers, foreign speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxmill.operators.candidates import SILENT


def duration(start: Column, end: Column) -> Column:
    """Seconds between, never negative; null where either is null or NaN."""
    known = start.isNotNull() & end.isNotNull() & ~F.isnan(start) & ~F.isnan(end)
    return F.when(known, F.greatest(F.lit(0.0), end - start))


def profile_take(segments: DataFrame, keys: list[str], most: float = 60.0, least_segment: float = 0.25, least: float = 1.0) -> DataFrame:
    """``keys, start, end, take``: the first ``most`` seconds of each speaker's speech, in order; the last piece is cut.

    Segments shorter than ``least_segment`` give nothing, speakers with less than ``least`` seconds in all have no row. Keys end with the speaker;
    a null speaker is one of its own.
    """
    d = duration(F.col("start"), F.col("end"))
    rows = segments.withColumn("__d", d).where(F.col("__d") >= least_segment)
    order = W.partitionBy(*keys).orderBy("start", "end")
    prior = F.coalesce(F.sum("__d").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    taken = rows.withColumn("__prior", prior).where(F.col("__prior") < most).withColumn("take", F.least(F.col("__d"), most - F.col("__prior")))
    return taken.withColumn("__all", F.sum("take").over(W.partitionBy(*keys))).where(F.col("__all") >= least).drop("__d", "__prior", "__all")


def speech_by_speaker(segments: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, segments, seconds, first, last`` of each speaker of a chunk. Rows without times count as segments of no length."""
    d = F.coalesce(duration(F.col("start"), F.col("end")), F.lit(0.0))
    return segments.groupBy(*keys).agg(F.count("*").alias("segments"), F.sum(d).alias("seconds"), F.min("start").alias("first"), F.max("end").alias("last"))


def target_speakers(similarities: DataFrame, keys: list[str], threshold: float, margin: float) -> DataFrame:
    """``keys, speaker, similarity, runner_up, verdict``: one row per chunk.

    verdict is ``target`` where the best speaker reaches the threshold and leads the next by the margin (or is the only one), else ``below``
    or ``ambiguous``. Only the two best of a chunk are compared. Null similarities don't count; a chunk without any has no row.
    """
    best = W.partitionBy(*keys).orderBy(F.col("similarity").desc(), "speaker")
    two = similarities.where(F.col("similarity").isNotNull()).withColumn("__rank", F.row_number().over(best)).where("__rank <= 2")
    top = two.groupBy(*keys).agg(
        F.max(F.when(F.col("__rank") == 1, F.col("speaker"))).alias("speaker"),
        F.max(F.when(F.col("__rank") == 1, F.col("similarity"))).alias("similarity"),
        F.max(F.when(F.col("__rank") == 2, F.col("similarity"))).alias("runner_up"),
    )
    lead = F.col("similarity") - F.col("runner_up")
    verdict = F.when(F.col("similarity") < threshold, "below").when(lead < margin, "ambiguous").otherwise("target")
    return top.withColumn("verdict", verdict)


def best_speaker(similarities: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, speaker``: the speaker of the highest similarity; of equals the first by name."""
    return similarities.groupBy(*keys).agg(F.min_by("speaker", F.struct(-F.col("similarity"), F.col("speaker"))).alias("speaker"))


def of_targets(segments: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """The segments of target speakers, with the speaker's similarity: labels hold within their chunk only."""
    chosen = targets.where(F.col("verdict") == "target").select(*keys, "speaker", "similarity")
    return segments.join(chosen, [*keys, "speaker"])


def foreign_overlap(targets: DataFrame, foreign: DataFrame, keys: list[str], key: str) -> DataFrame:
    """``targets' columns, overlap``: seconds of each target segment that foreign segments of its chunk speak in. Foreign segments at the same instant count each. ``key`` tells target segments apart."""
    f = foreign.select(*keys, F.col("start").alias("__s"), F.col("end").alias("__e"))
    shared = F.least("end", "__e") - F.greatest("start", "__s")
    met = targets.join(f, keys).where((F.col("__s") < F.col("end")) & (F.col("__e") > F.col("start")))
    sums = met.groupBy(*keys, key).agg(F.sum(F.greatest(F.lit(0.0), shared)).alias("overlap"))
    return targets.join(sums, [*keys, key], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))


def foreign_gaps(targets: DataFrame, foreign: DataFrame, keys: list[str], key: str, silent: float = SILENT) -> DataFrame:
    """``keys, key, gap_start, gap_end, blocked``: the gaps between neighbouring target segments, and whether foreign speech of more than ``silent`` seconds lies in one."""
    before = F.max("end").over(W.partitionBy(*keys).orderBy("start", "end", key).rowsBetween(W.unboundedPreceding, -1))
    gaps = targets.withColumn("gap_start", before).where(F.col("start") > F.col("gap_start")).select(*keys, key, "gap_start", F.col("start").alias("gap_end"))
    f = foreign.select(*keys, F.col("start").alias("__s"), F.col("end").alias("__e"))
    hit = gaps.join(f, keys).where(F.least("gap_end", "__e") - F.greatest("gap_start", "__s") > silent).select(*keys, key, F.lit(True).alias("blocked")).distinct()
    return gaps.join(hit, [*keys, key], "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))


def at_source_time(candidates: DataFrame, chunk_start: Column) -> DataFrame:
    """Times of a chunk as times of its recording."""
    return candidates.withColumn("start", F.col("start") + chunk_start).withColumn("end", F.col("end") + chunk_start)
