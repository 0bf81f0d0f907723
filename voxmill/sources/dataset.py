"""A dataset's own files: metadata.csv, metadata_extended.csv, metadata.jsonl, statistics.json and the state of recordings."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.operators.commit import printed
from voxmill.schemas import EXTENDED, EXTENDED_NUMBERS, METADATA, STATE

_CSV = {"sep": "|", "quote": '"', "escape": '"', "multiLine": "true", "encoding": "UTF-8", "mode": "PERMISSIVE"}
_OUT = {"sep": "|", "quote": '"', "escape": '"', "emptyValue": "", "lineSep": "\r\n", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``file, text`` of the headerless log; empty lines give no row, a missing text is empty."""
    rows = spark.read.options(**_CSV).schema(METADATA).csv(path)
    return rows.where("file IS NOT NULL OR text IS NOT NULL").select(F.coalesce("file", F.lit("")).alias("file"), F.coalesce("text", F.lit("")).alias("text"))


def read_extended(spark: SparkSession, path: str) -> DataFrame:
    """The eleven columns of the extended log, with or without its header. A number that can't be read is null; the row stays."""
    names = ["file", "text", "source", *EXTENDED_NUMBERS]
    rows = spark.read.options(**_CSV).schema(", ".join(f"`{n}` string" for n in names)).csv(path)
    rows = rows.where("file IS NOT NULL AND NOT (file = 'file' AND source = 'source')")
    return rows.select("file", F.coalesce("text", F.lit("")).alias("text"), "source", *[F.col(f"`{c}`").try_cast("double").alias(c) for c in EXTENDED_NUMBERS])


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """The extended columns and ``line``, the line as it stands. Of a line that is no JSON object ``file`` and the rest are null and ``broken`` is true; blank lines give no row."""
    lines = spark.read.text(path).select(F.col("value").alias("line")).where("trim(line) <> ''")
    parsed = lines.withColumn("__j", F.from_json("line", EXTENDED + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    names = ["file", "text", "source", *EXTENDED_NUMBERS]
    return parsed.select(*[F.col("__j")[n].alias(n) for n in names], "line", F.col("__j._corrupt_record").isNotNull().alias("broken"))


def patched_jsonl(lines: DataFrame, updates: DataFrame) -> DataFrame:
    """``value``: the lines with the text of the update of the same file; broken lines are kept as they are."""
    from voxmill.operators.repair import patched

    whole = patched(lines.where("NOT broken"), updates)
    names = ["file", "text", "source", *EXTENDED_NUMBERS]
    return whole.select(F.to_json(F.struct(*names)).alias("value")).unionByName(lines.where("broken").select(F.col("line").alias("value")))


def write_metadata(clips: DataFrame, path: str, mode: str = "append") -> None:
    """``file|text`` without a header; text is expected to be sanitised."""
    clips.select("file", "text").write.mode(mode).options(**_OUT, header="false").csv(path)


def write_extended(clips: DataFrame, path: str, mode: str = "append") -> None:
    """The eleven columns with a header in each file and the decimals of the log."""
    printed(clips).write.mode(mode).options(**_OUT, header="true").csv(path)


def write_jsonl(clips: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON object a line, numbers in full."""
    clips.select("file", "text", "source", *EXTENDED_NUMBERS).write.mode(mode).json(path)


def write_rejected(rejected: DataFrame, path: str, mode: str = "append") -> None:
    """The rejected clips, one folder per reason."""
    rejected.write.mode(mode).partitionBy("reason").parquet(path)


def write_segments(segments: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The segment cache, one folder per recording."""
    segments.write.mode(mode).partitionBy("source_id").parquet(path)


def replace_snapshot(root: str, write: Callable[[str], None]) -> str:
    """A new snapshot below ``root``: ``write`` gets its folder, then the pointer ``CURRENT`` is replaced at once. A write that fails leaves the old snapshot in place."""
    os.makedirs(root, exist_ok=True)
    last = current_snapshot(root)
    name = f"{int(os.path.basename(last).removeprefix('v')) + 1 if last else 1:06d}"
    folder = os.path.join(root, f"v{name}")
    write(folder)
    with open(os.path.join(root, "CURRENT.tmp"), "w", encoding="utf-8") as f:
        f.write(f"v{name}")
    os.replace(os.path.join(root, "CURRENT.tmp"), os.path.join(root, "CURRENT"))
    return folder


def current_snapshot(root: str) -> str | None:
    """The folder that the pointer names."""
    try:
        with open(os.path.join(root, "CURRENT"), encoding="utf-8") as f:
            return os.path.join(root, f.read().strip())
    except FileNotFoundError:
        return None


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """``fingerprint, path, status, clips, seconds, error`` of a state file; none where the file is missing or corrupt."""
    try:
        with open(path, encoding="utf-8") as f:
            files = json.load(f).get("files", {})
        rows = [(k, *[v.get(c) for c in ("path", "status")], *[None if v.get(c) is None else t(v[c]) for c, t in (("clips", int), ("seconds", float))], v.get("error")) for k, v in files.items() if isinstance(v, dict)]
    except (OSError, ValueError, AttributeError):
        rows = []
    return spark.createDataFrame(rows, f"fingerprint string, {STATE}")


def write_state(state: DataFrame, path: str) -> None:
    """The state file, replaced at once. It holds one entry per recording of the project and is written by the driver."""
    files = {r.fingerprint: {k: v for k, v in r.asDict().items() if k != "fingerprint" and v is not None} for r in state.select("fingerprint", "path", "status", "clips", "seconds", "error").toLocalIterator()}
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump({"version": 1, "files": files}, f, ensure_ascii=False, indent=2)
    os.replace(f"{path}.tmp", path)


def check_project(settings_path: str, has_audio: bool, quality: str, sample_rate: int, version: int) -> None:
    """Raises ValueError where a dataset of another quality, sample rate or rule version would be mixed into. A settings file that is no JSON, and a dataset without audio, are no hindrance."""
    if not has_audio or not os.path.exists(settings_path):
        return
    with open(settings_path, encoding="utf-8") as f:
        try:
            old = json.load(f)
        except json.JSONDecodeError:
            return
    if int(old.get("dataset_algorithm_version", 1)) != version:
        raise ValueError("the dataset was built by other rules; choose an empty folder")
    if old.get("quality") and old["quality"] != quality:
        raise ValueError(f"the dataset was built with quality {old['quality']}; choose another folder for {quality}")
    if int(old.get("output_sample_rate", sample_rate)) != sample_rate:
        raise ValueError("the dataset has another sample rate; choose another folder")


def write_settings(path: str, settings: dict, version: int) -> None:
    """The settings without secrets, with the version of the rules."""
    public = {k: v for k, v in settings.items() if "token" not in k} | {"dataset_algorithm_version": version}
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(public, f, ensure_ascii=False, indent=2)
    os.replace(f"{path}.tmp", path)
