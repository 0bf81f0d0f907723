"""A dataset from recordings and reference voices, end to end: one set of DataFrames over all recordings, each stage kept on shared storage."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill import models
from voxmill.functions.text import clock
from voxmill.operators import candidates, commit, quality, repair, segments, vectors
from voxmill.plans.chunks import chunk_plan
from voxmill.presets import ALGORITHM_VERSION, preset
from voxmill.schemas import EXTENDED, EXTENDED_NUMBERS, SEGMENTS
from voxmill.sources import dataset, media
from voxmill.sources import wave as pcm

CHUNK = ["source_id", "chunk_idx"]


@dataclass
class Project:
    """Folders of a dataset; all executors share them."""

    root: str

    def at(self, *parts: str) -> str:
        return os.path.join(self.root, *parts)


def _listing(spark: SparkSession, project: Project) -> DataFrame:
    audio = project.at("audio")
    names = sorted(os.listdir(audio)) if os.path.isdir(audio) else []
    return spark.createDataFrame([(f"audio/{n}",) for n in names], "path string")


def _log(spark: SparkSession, project: Project) -> DataFrame:
    current = dataset.current_snapshot(project.at("log"))
    return spark.read.parquet(current) if current else spark.createDataFrame([], EXTENDED)


def _replace_log(project: Project, rows: DataFrame) -> None:
    dataset.replace_snapshot(project.at("log"), lambda folder: rows.select("file", "text", "source", *EXTENDED_NUMBERS).write.parquet(folder))


def _stage(project: Project, name: str, rows: DataFrame) -> DataFrame:
    """The rows, written: later stages read them and nothing is computed twice."""
    folder = project.at(".stage", name)
    rows.write.mode("overwrite").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _prepared(files: DataFrame, project: Project) -> DataFrame:
    """``fingerprint, path, wav, error``: each recording as a WAV file, decoded where it isn't one. What fails says why and stops nothing else."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                wav, error = r.path.removeprefix("file:"), None
                if not wav.lower().endswith(".wav"):
                    source, wav = wav, project.at(".stage", "decoded", f"{r.fingerprint}.wav")
                    try:
                        pcm.decoded(source, wav, 48000, 2)
                    except RuntimeError as e:
                        error = str(e)
                out.append((r.fingerprint, r.path, wav, error))
            yield pd.DataFrame(out, columns=["fingerprint", "path", "wav", "error"])

    return files.select("fingerprint", "path").mapInPandas(work, "fingerprint string, path string, wav string, error string")


def _profiles(taken: DataFrame, project: Project) -> DataFrame:
    """``source_id, chunk_idx, speaker, path``: a file of each speaker's speech in a chunk."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values(["start", "end"])
        source, chunk, speaker = own.iloc[0][["source_id", "chunk_idx", "speaker"]]
        path = project.at(".stage", "profiles", f"{source}_{chunk:04d}_{hashlib.sha1(str(speaker).encode()).hexdigest()}.wav")
        pcm.concatenated(own.iloc[0]["wav"], path, list(zip(own["start"], own["take"])))
        return pd.DataFrame({"source_id": [source], "chunk_idx": [chunk], "speaker": [speaker], "path": [path]})

    return taken.groupBy(*CHUNK, "speaker").applyInPandas(work, "source_id string, chunk_idx int, speaker string, path string")


def build_dataset(
    spark: SparkSession, recordings: str, references: str, root: str, provider: models.ModelProvider, quality_name: str = "maximum", transcribe: bool = True, language: str | None = None, sample_rate: int = 48000, keep_rejected: bool = True
) -> dict:
    """Builds or continues the dataset below ``root`` and returns the counters of the run.

    Recordings whose state is done are skipped, failed and new ones are processed. Clips of one source, start and end are committed once.
    Log rows whose file is gone are dropped first; where that happens, everything is processed again. Raises ValueError without recordings or
    references and where ``root`` holds a dataset of another quality, sample rate or rule version.
    """
    p, project = preset(quality_name), Project(root)
    found, voices = media.discover(spark, recordings), media.discover(spark, references)
    if found.isEmpty() or voices.isEmpty():
        raise ValueError("no recordings, or no reference voices")
    listing = _listing(spark, project)
    dataset.check_project(project.at("settings.json"), not listing.isEmpty(), p.name, sample_rate, ALGORITHM_VERSION)
    for d in ("audio", ".stage"):
        os.makedirs(project.at(d), exist_ok=True)
    dataset.write_settings(project.at("settings.json"), {"quality": p.name, "output_sample_rate": sample_rate}, ALGORITHM_VERSION)

    # what the log and the state say of files that are gone
    log, state = _log(spark, project), dataset.read_state(spark, project.at("state.json"))
    counts = repair.repair_counts([log], listing)
    if repair.needs_reset(counts, state, not listing.isEmpty(), dataset.current_snapshot(project.at("log")) is not None):
        state = state.where("false")
    if counts.first()["removed"]:
        _replace_log(project, repair.kept(log, listing))
    before = _log(spark, project)

    prints = _stage(project, "found", media.fingerprints(found).dropDuplicates(["fingerprint"]))
    todo = prints.join(state.where("status = 'done'").select("fingerprint"), "fingerprint", "left_anti")
    ready = _stage(project, "ready", _prepared(todo, project))
    lengths = pcm.durations(ready.select(F.col("wav").alias("path"))).select(F.col("path").alias("wav"), F.col("seconds").alias("duration"))
    sources = _stage(project, "sources", ready.join(lengths, "wav").withColumn("error", F.when(F.col("error").isNull() & F.col("duration").isNull(), "the recording can't be read").otherwise(F.col("error"))))
    good = sources.where("error IS NULL").withColumnRenamed("fingerprint", "source_id")

    # chunks and their segments
    plan = chunk_plan(good, float(p.diarization_window)).withColumn("chunk", F.concat(F.lit(project.at(".stage", "chunks") + "/"), "source_id", F.format_string("_%04d.wav", "chunk_idx")))
    chunks = _stage(project, "plan", plan)
    _stage(project, "cut", pcm.cut_all(chunks.select(F.col("wav").alias("source"), F.col("chunk").alias("target"), F.col("chunk_start").alias("start"), F.col("chunk_end").alias("end"))))
    heard = chunks.select(*CHUNK, F.col("chunk").alias("path"))
    if p.use_separation:
        vocals = _stage(project, "vocals", models.separated(heard, provider))
        heard = heard.join(vocals, "path").select(*CHUNK, F.col("vocals").alias("path"))
    spoken = _stage(project, "segments", models.diarized(heard, provider)) if not chunks.isEmpty() else spark.createDataFrame([], SEGMENTS)

    # the speaker of each chunk that is the reference voice
    reference = vectors.centroids(models.encoded(voices.select(F.regexp_replace("path", "^file:", "").alias("path")), provider), "embedding", len(provider.encode(voices.first().path.removeprefix("file:"))))
    taken = segments.profile_take(spoken, [*CHUNK, "speaker"]).join(heard.withColumnRenamed("path", "wav"), CHUNK)
    profiles = _stage(project, "profiles_list", _profiles(taken, project))
    similar = profiles.join(vectors.similarity_to(models.encoded(profiles, provider), "embedding", _stage(project, "reference", reference)), "path")
    targets = _stage(project, "targets", segments.target_speakers(similar, CHUNK, p.speaker_threshold, p.speaker_margin).where("verdict = 'target'"))

    # clips of that speaker
    marked = spoken.join(targets.select(*CHUNK, F.col("speaker").alias("__t"), "similarity"), CHUNK).withColumn("target", F.col("speaker").eqNullSafe(F.col("__t"))).drop("__t")
    clips = candidates.clip_candidates(marked, None, p.max_overlap, p.merge_gap, p.min_clip, p.max_clip, tuple(CHUNK))
    clips = segments.at_source_time(clips.join(chunks.select(*CHUNK, "chunk_start", "wav", F.col("path").alias("recording")), CHUNK), F.col("chunk_start"))
    name = F.concat(F.lit(project.at(".stage", "clips") + "/"), "source_id", F.lit("_"), F.sha1(F.concat_ws("|", "start", "end")), F.lit(".wav"))
    staged = _stage(project, "candidates", clips.withColumn("path", name).withColumn("source", F.element_at(F.split("recording", "[/\\\\]"), -1)))
    _stage(project, "clips_cut", pcm.cut_all(staged.select(F.col("wav").alias("source"), F.col("path").alias("target"), "start", "end")))
    judged = pcm.measure_all(staged).withColumn("reason", quality.preset_verdict(p))
    if p.segment_verify:
        own = vectors.similarity_to(models.encoded(judged.where("reason = ''"), provider), "embedding", _stage(project, "reference2", reference)).select("path", F.col("similarity").alias("own"))
        judged = judged.join(own, "path", "left").withColumn("reason", quality.second_verification(F.col("reason"), F.col("own"), p)).withColumn("similarity", F.coalesce("own", "similarity")).drop("own")
    judged = _stage(project, "judged", judged)
    rejected = judged.where("reason <> ''")
    if keep_rejected:
        _moved(rejected.select(F.col("path").alias("source"), F.concat(F.lit(root + "/"), quality.rejected_path(F.col("source_id"), F.col("source"), F.col("start"), F.col("end"), F.col("reason"))).alias("target")))

    # into the dataset, each once
    accepted = judged.where("reason = ''").select("source", "start", "end", F.lit("").alias("text"), "duration", F.col("similarity").alias("speaker_similarity"), *EXTENDED_NUMBERS[4:], "path", "source_id", "chunk_idx")
    fresh, usable = commit.commit(accepted, before, _listing(spark, project), ["source_id", "chunk_idx", "start"])
    fresh = _stage(project, "fresh", fresh)
    usable = _stage(project, "usable", fresh.unionByName(usable.join(fresh.select("file"), "file", "left_anti")))
    _moved(fresh.select(F.col("path").alias("source"), F.concat(F.lit(root + "/"), "file").alias("target")))
    rows = before.unionByName(fresh.select(*before.columns))
    if transcribe:
        silent = repair.pending_transcripts(usable).select("file", F.concat(F.lit(root + "/"), "file").alias("path"))
        texts = _stage(project, "texts", models.transcribed(silent, provider, language))
        rows = repair.patched(rows, texts)
    _replace_log(project, _stage(project, "rows", rows))

    # what became of each recording
    by = fresh.groupBy(F.col("source_id").alias("fingerprint")).agg(F.count("*").alias("clips"), F.sum("duration").alias("seconds"))
    news = sources.join(by, "fingerprint", "left").select(
        "fingerprint", "path", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("status"), F.when(F.col("error").isNull(), F.coalesce("clips", F.lit(0))).alias("clips"), F.when(F.col("error").isNull(), F.coalesce("seconds", F.lit(0.0))).alias("seconds"), "error"
    )
    old = state.join(news.select("fingerprint"), "fingerprint", "left_anti")
    dataset.write_state(old.unionByName(news), project.at("state.json"))
    outcome = prints.join(sources.select("fingerprint", "duration", "error"), "fingerprint", "left").select(F.when(F.col("error").isNotNull(), "failed").when(F.col("duration").isNull(), "skipped").otherwise("done").alias("outcome"), F.col("duration").alias("seconds"))
    after = _log(spark, project)
    summary = repair.run_summary(outcome, before, after, rejected)
    total = repair.totals(after)
    with open(project.at("statistics.json"), "w", encoding="utf-8") as f:
        f.write(repair.statistics_json(summary, total).first().value)
    counters = summary.first().asDict()
    with open(project.at("dataset_report.txt"), "w", encoding="utf-8") as f:
        f.write(report_text(spark, counters, total.first().asDict()))
    shutil.rmtree(project.at(".stage"))
    return counters


def _moved(files: DataFrame) -> None:
    """Moves ``source`` to ``target`` on the executors; what has been moved before stays."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                os.makedirs(os.path.dirname(r.target), exist_ok=True)
                if os.path.exists(r.source):
                    shutil.copyfile(r.source, f"{r.target}.tmp")
                    os.replace(f"{r.target}.tmp", r.target)
            yield pd.DataFrame({"n": [len(pdf)]})

    files.mapInPandas(work, "n int").write.format("noop").mode("overwrite").save()


def report_text(spark: SparkSession, run: dict, total: dict) -> str:
    """The counters as lines to read."""
    spoken = lambda s: spark.range(1).select(clock(F.lit(float(s)))).first()[0]
    lines = [
        "Dataset report", "==============", f"Recordings found: {run['source_files']}", f"Skipped, already done: {run['skipped_files']}", f"Failed: {run['failed_files']}", f"Clips added: {run['accepted_clips']}",
        f"Speech added: {spoken(run['accepted_seconds'])}", f"Clips rejected: {run['rejected_clips']}", f"In the dataset: {total['clips']} clips, {spoken(total['seconds'])}",
    ]
    return "\n".join(lines) + "\n"


def export_logs(spark: SparkSession, root: str) -> None:
    """The log as ``metadata``, ``metadata_extended`` and ``metadata_jsonl`` folders of text files beside it."""
    rows, project = _log(spark, Project(root)), Project(root)
    dataset.write_metadata(rows, project.at("metadata"), "overwrite")
    dataset.write_extended(rows, project.at("metadata_extended"), "overwrite")
    dataset.write_jsonl(rows, project.at("metadata_jsonl"), "overwrite")


def statistics(root: str) -> dict:
    with open(Project(root).at("statistics.json"), encoding="utf-8") as f:
        return json.load(f)


__all__ = ["Project", "build_dataset", "export_logs", "report_text", "statistics"]
