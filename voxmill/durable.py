"""Cutting lineage and joining with tables whose size is checked first."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its rows hold at most this many bytes.
BROADCAST_BYTES = 8 << 20
#: Beyond that the keys are salted this many ways, so that no key stays in one task.
SALTS = 16


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the session's ``spark.checkpoint.dir``; a temporary one only where none is set and the master is local."""
    sc = spark.sparkContext
    if current := sc.getCheckpointDir():
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="voxmill-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder; survives the loss of executors. Set spark.cleaner.referenceTracking.cleanCheckpoints so that Spark deletes them once they are unreachable."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def size_of(df: DataFrame) -> int:
    """Bytes of all values: 8 for a number, the length of a string, and 16 for a row."""
    texts = [F.coalesce(F.octet_length(F.col(f"`{n}`")), F.lit(0)) for n, t in df.dtypes if t == "string"]
    row = sum(texts, F.lit(16 + 8 * len(df.dtypes)))
    return df.agg(F.coalesce(F.sum(row), F.lit(0))).first()[0]


def sized_join(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join many rows with a table of one row per key.

    ``small`` is measured (it should be durable, else it is computed twice). Up to ``limit`` bytes it is broadcast. Beyond, rows are
    salted and each row of ``small`` is repeated once per salt, so that a key that holds a third of all rows is spread over SALTS tasks.
    """
    if size_of(small) <= limit:
        return rows.join(F.broadcast(small), keys, how)
    salted = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")
