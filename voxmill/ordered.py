"""Work along a total order without one task for all rows: sorted ranges, and what one range hands to the next."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.durable import durable


def in_order(df: DataFrame, columns: list[str]) -> DataFrame:
    """The rows in sorted ranges, written to the checkpoint folder: a later pass finds the same rows in the same partitions."""
    return durable(df.repartitionByRange(*columns).sortWithinPartitions(*columns))


def numbered(df: DataFrame, columns: list[str], name: str = "number", start: int | Column = 1) -> DataFrame:
    """The rows with dense numbers in the order of ``columns``, from ``start``.

    Each range counts its rows; the sums of the ranges before it (one row per range, broadcast) are added to the place within the range.
    Rows equal in all of ``columns`` are numbered in any order; an empty table stays empty.
    """
    sorted_rows = in_order(df, columns).withColumn("__id", F.monotonically_increasing_id())
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    placed = sorted_rows.select("*", part.alias("__part"), place.alias("__place"))
    counts = {r[0]: r[1] for r in placed.groupBy("__part").count().collect()}
    offsets, total = [], 0
    for p in sorted(counts):
        offsets.append((p, total))
        total += counts[p]
    ranges = df.sparkSession.createDataFrame(offsets, "__part bigint, __before bigint")
    begin = start if isinstance(start, Column) else F.lit(start)
    return placed.join(F.broadcast(ranges), "__part").withColumn(name, (F.col("__before") + F.col("__place") + begin).cast("bigint")).drop("__id", "__part", "__place", "__before")


def begins(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Which rows of a sorted batch begin a group; the first one does."""
    fresh = np.zeros(batch.num_rows, bool)
    if batch.num_rows:
        fresh[0] = True
    for k in keys:
        codes = batch.column(batch.schema.get_field_index(k)).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        fresh[1:] |= codes[1:] != codes[:-1]
    return fresh


def key_at(batch: pa.RecordBatch, keys: list[str], row: int) -> tuple:
    return tuple(batch.column(batch.schema.get_field_index(k))[row].as_py() for k in keys)


def running(values: np.ndarray, fresh: np.ndarray, best: str = "max") -> np.ndarray:
    """The highest (or lowest) value so far within each group."""
    by = pd.Series(values).groupby(np.cumsum(fresh))
    return (by.cummax() if best == "max" else by.cummin()).to_numpy()


def handed_on(states: list[tuple[int, tuple, tuple, tuple]], merge: Callable[[tuple, tuple], tuple]) -> tuple[dict[int, tuple[tuple, tuple]], set[int]]:
    """From ``(partition, first group, last group, state of the last group)`` of all partitions that have rows: what each of them is handed, ``(group, state)``, and those whose last group goes on.

    There is one row per partition, so the driver can hold them. ``merge`` puts what is handed over before the state of a partition that is all one group.
    """
    given: dict[int, tuple[tuple, tuple]] = {}
    goes_on: set[int] = set()
    before: tuple[int, tuple, tuple] | None = None
    for part, first, last, state in sorted(states):
        if before and before[1] == first:
            given[part] = (before[1], before[2])
            goes_on.add(before[0])
            if first == last:
                state = merge(before[2], state)
        before = (part, last, state)
    return given, goes_on
