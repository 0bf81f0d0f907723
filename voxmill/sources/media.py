"""Recordings: which files they are, and what tells them apart."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.presets import MEDIA_SUFFIXES

#: Bytes at either end of a file that its fingerprint reads.
ENDS = 1 << 20


def is_media(path: Column) -> Column:
    """Whether a path ends as recordings do, in any case."""
    return F.coalesce(F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1)).isin(*MEDIA_SUFFIXES), F.lit(False))


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """``path, size, modified`` of the recordings below a folder, in order of their lower-case paths. No content is read; names that begin with ``_`` or ``.`` are not seen."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return files.where(is_media(F.col("path"))).orderBy(F.lower("path"), "path")


def fingerprint(path: str) -> str:
    """SHA-1 of the size, the first and, of longer files, the last megabyte: the same after a file is moved or renamed."""
    size = os.stat(path).st_size
    h = hashlib.sha1(str(size).encode())
    with open(path, "rb") as f:
        h.update(f.read(ENDS))
        if size > ENDS:
            f.seek(size - ENDS)
            h.update(f.read(ENDS))
    return h.hexdigest()


def _prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(fingerprint=[fingerprint(p.removeprefix("file:")) for p in pdf["path"]])


def fingerprints(files: DataFrame) -> DataFrame:
    """``files`` with ``fingerprint``; two megabytes are read of each file, on a file system that all executors share."""
    schema = ", ".join(f"`{n}` {t}" for n, t in files.dtypes)
    return files.mapInPandas(_prints, f"{schema}, fingerprint string")
