"""Metadata that fits the files: rows kept and dropped, transcripts patched, totals, and the state of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.functions.text import is_blank, path_key, sanitize
from voxmill.operators.commit import first_of_each


def _there(listing: DataFrame, path: str = "path") -> DataFrame:
    return listing.select(path_key(F.col(path)).alias("__key")).where("__key IS NOT NULL").distinct()


def kept(rows: DataFrame, listing: DataFrame, file: str = "file") -> DataFrame:
    """The rows whose file is listed. A null or blank file is missing."""
    return rows.withColumn("__key", path_key(F.col(file))).join(_there(listing), "__key", "left_semi").drop("__key")


def dropped(rows: DataFrame, listing: DataFrame, file: str = "file") -> DataFrame:
    """The other rows."""
    return rows.withColumn("__key", path_key(F.col(file))).join(_there(listing), "__key", "left_anti").drop("__key")


def repair_counts(tables: list[DataFrame], listing: DataFrame, file: str = "file") -> DataFrame:
    """``kept, removed``: distinct files over all tables that are listed and that are not; all null and blank files count as one removed."""
    refs = None
    for t in tables:
        one = t.select(F.coalesce(path_key(F.col(file)), F.lit("")).alias("__key"))
        refs = one if refs is None else refs.unionByName(one)
    judged = refs.distinct().join(_there(listing).withColumn("__there", F.lit(True)), "__key", "left")
    return judged.agg(F.count_if("__there").alias("kept"), F.count_if(F.col("__there").isNull()).alias("removed"))


def needs_reset(counts: DataFrame, state: DataFrame, audio_exists: bool, metadata_exists: bool) -> bool:
    """Whether completed recordings must be done again: rows were dropped, or nothing is left of a dataset that has some."""
    done = state.where(F.col("status") == "done").limit(1).count() > 0
    return done and (counts.first()["removed"] > 0 or (not audio_exists and not metadata_exists))


def patched(rows: DataFrame, updates: DataFrame, file: str = "file", order: tuple[str, ...] = ("text",)) -> DataFrame:
    """The rows with the text of the update of the same file, sanitised, where there is one. Of several updates of one file the last by ``order`` counts; updates without a file are ignored."""
    keyed = updates.withColumn("__key", path_key(F.col(file))).where("__key IS NOT NULL")
    last = keyed.groupBy("__key").agg(F.max_by(F.struct(F.col("text").alias("t")), F.struct(*order)).alias("__u"))
    new = F.when(F.col("__u").isNotNull(), sanitize(F.col("__u.t"))).otherwise(F.col("text"))
    return rows.withColumn("__key", path_key(F.col(file))).join(last, "__key", "left").withColumn("text", new).drop("__key", "__u")


def pending_transcripts(clips: DataFrame) -> DataFrame:
    """The clips without text."""
    return clips.where(is_blank(F.col("text")))


def seconds_of(c: Column) -> Column:
    """A duration for sums: what is no number counts as zero."""
    v = c.try_cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v)


def totals(rows: DataFrame, duration: str = "duration") -> DataFrame:
    """``clips, seconds``: all rows, and the sum of the durations that are numbers. Of an empty table: 0 and 0."""
    return rows.agg(F.count("*").alias("clips"), F.coalesce(F.sum(seconds_of(F.col(duration))), F.lit(0.0)).alias("seconds"))


def run_summary(sources: DataFrame, before: DataFrame, after: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row of counters of a run: sources by what became of them (``outcome`` done, skipped or failed, ``seconds``), what the dataset gained, what was rejected (``duration``)."""
    s = sources.agg(
        F.count("*").alias("source_files"), F.count_if(F.col("outcome") == "skipped").alias("skipped_files"), F.count_if(F.col("outcome") == "failed").alias("failed_files"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "done", seconds_of(F.col("seconds")))), F.lit(0.0)).alias("source_seconds"),
    )
    a, b = totals(after), totals(before).withColumnsRenamed({"clips": "c0", "seconds": "s0"})
    gained = a.crossJoin(b).select(F.greatest(F.lit(0), F.col("clips") - F.col("c0")).alias("accepted_clips"), F.greatest(F.lit(0.0), F.col("seconds") - F.col("s0")).alias("accepted_seconds"))
    lost = totals(rejected).withColumnsRenamed({"clips": "rejected_clips", "seconds": "rejected_seconds"})
    return s.crossJoin(gained).crossJoin(lost)


def statistics_json(summary: DataFrame, dataset: DataFrame) -> DataFrame:
    """``value``: the run's counters and the dataset's totals as one JSON object."""
    return summary.select(F.struct("*").alias("run")).crossJoin(dataset.select(F.struct("clips", "seconds").alias("dataset_total"))).select(F.to_json(F.struct("run", "dataset_total")).alias("value"))


def latest_state(states: DataFrame) -> DataFrame:
    """One row per fingerprint: the latest by updated_at; of equals the last by status and path. Rows without a fingerprint are left out."""
    known = states.where(F.col("fingerprint").isNotNull())
    rest = [c for c in known.columns if c != "fingerprint"]
    last = known.groupBy("fingerprint").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "status", "path")).alias("__row"))
    return last.select("fingerprint", *[F.col("__row")[c].alias(c) for c in rest])


def upserted(states: DataFrame, updates: DataFrame) -> DataFrame:
    """The states with the updates over them."""
    return latest_state(states.unionByName(updates, allowMissingColumns=True))


def pending_sources(found: DataFrame, states: DataFrame) -> DataFrame:
    """The found recordings (``fingerprint, ...``) whose latest state is not done: new, failed or unfinished ones."""
    done = latest_state(states).where(F.col("status") == "done").select("fingerprint")
    return found.join(done, "fingerprint", "left_anti")


def any_done(states: DataFrame) -> DataFrame:
    """``any_done``: whether a recording is done; false for an empty table."""
    return states.agg(F.coalesce(F.bool_or(F.col("status") == "done"), F.lit(False)).alias("any_done"))


__all__ = ["any_done", "dropped", "first_of_each", "kept", "latest_state", "needs_reset", "patched", "pending_sources", "pending_transcripts", "repair_counts", "run_summary", "seconds_of", "statistics_json", "totals", "upserted"]
