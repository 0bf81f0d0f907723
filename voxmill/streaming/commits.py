"""Clips committed as their chunks arrive, each once, whatever is started again."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxmill.operators.commit import clip_file, first_of_each, new_or_known, with_key
from voxmill.ordered import numbered


def commit_stream(staged: DataFrame, folder: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Starts a query that adds each micro-batch of staged clips ``source, start, end, text, ...`` to the Parquet table below ``folder``.

    A batch has a folder of its own, ``batch=N``, that a repeated batch replaces; keys that earlier batches hold are left out, so a clip is
    committed once whatever restarts. Numbers continue from those of earlier batches.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = committed(spark, folder, before=number)
        keyed = first_of_each(with_key(batch), order)
        fresh, start = keyed, 1
        if known is not None:
            fresh = new_or_known(keyed, known).where(F.col("known_file").isNull()).drop("known_file", "known_text")
            start = (known.agg(F.max(F.regexp_extract("file", r"([0-9]+)\.wav$", 1).cast("bigint"))).first()[0] or 0) + 1
        rows = numbered(fresh.drop("file"), ["source", "start_ms", "end_ms"], "__n", start)
        rows.withColumn("file", clip_file(F.col("__n"))).drop("__n").write.mode("overwrite").parquet(os.path.join(folder, f"batch={number}"))

    return staged.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The committed clips, of batches before ``before`` only where that is given; None where there are none."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.option("basePath", folder).parquet(folder)
    except AnalysisException:
        return None
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return rows if rows.take(1) else None
