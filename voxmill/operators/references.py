"""Problem 3: references to files that do not exist, are deleted or are listed only later."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.functions.text import is_blank, path_key
from voxmill.ordered import begins, handed_on, in_order, key_at, running

#: Stands for a time that there is none of, and for one before every other.
NEVER, FIRST = (1 << 63) - 1, -(1 << 63) + 1
#: Kinds of rows in the merged stream, in the order they take at one time.
PATH, GONE, REFERENCE = 0, 1, 2
VALIDITY = np.array(["ok", "deleted_later", "deleted", "late", "missing"])


def _stream(tables: dict[str, DataFrame], files: DataFrame) -> DataFrame:
    """References and parent keys as one: ``path, at, kind, until, since, ref, row_id``.

    A path that is listed has one row before all others (``until``: since when a live row is listed, ``since``: the first listing of any) and
    one for each interval that ended (``at`` its start, ``until`` its end).
    """
    none = F.lit(NEVER).cast("bigint")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    parents = files.select(path_key(F.col("path")).alias("path"), us("listed_at").alias("listed"), us("deleted_at").alias("gone")).where("path IS NOT NULL AND listed IS NOT NULL")
    rest = [F.lit(None).cast("int").alias("ref"), F.lit(None).cast("bigint").alias("row_id")]
    paths = parents.groupBy("path").agg(F.coalesce(F.min(F.when(F.col("gone").isNull(), F.col("listed"))), none).alias("until"), F.min("listed").alias("since"))
    stream = paths.select("path", F.lit(FIRST - 1).cast("bigint").alias("at"), F.lit(PATH).alias("kind"), "until", "since", *rest)
    stream = stream.unionByName(parents.where("gone > listed").groupBy("path", "listed").agg(F.max("gone").alias("until")).select("path", F.col("listed").alias("at"), F.lit(GONE).alias("kind"), "until", none.alias("since"), *rest))
    for i, df in enumerate(tables.values()):
        rows = df.where(~is_blank(F.col("file"))).select(path_key(F.col("file")).alias("path"), F.coalesce(us("committed_at"), F.lit(FIRST)).alias("at"), F.col("row_id").cast("bigint").alias("row_id"))
        stream = stream.unionByName(rows.select("path", "at", F.lit(REFERENCE).alias("kind"), none.alias("until"), none.alias("since"), F.lit(i).alias("ref"), "row_id"))
    return stream


class _Merge:
    """What is known of the path at hand: since when it is live, when it was first listed, how long an interval that began reaches."""

    def __init__(self, state: tuple[tuple, tuple] | None = None):
        self.group, self.known = state or (None, (NEVER, NEVER, FIRST))

    def add(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row of a sorted batch: since when its path is live, when it was first listed, how far the intervals reach that began by then."""
        kind, until, since = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("kind", "until", "since"))
        fresh = begins(batch, ["path"])
        goes_on = self.group is not None and self.group == key_at(batch, ["path"], 0)
        live = running(np.where(kind == PATH, until, NEVER), fresh, "min")
        first = running(np.where(kind == PATH, since, NEVER), fresh, "min")
        reach = running(np.where(kind == GONE, until, FIRST), fresh)
        if goes_on:
            own = slice(0, int(fresh[1:].argmax()) + 1 if fresh[1:].any() else len(kind))
            live[own], first[own], reach[own] = np.minimum(live[own], self.known[0]), np.minimum(first[own], self.known[1]), np.maximum(reach[own], self.known[2])
        self.group, self.known = key_at(batch, ["path"], len(kind) - 1), (int(live[-1]), int(first[-1]), int(reach[-1]))
        return live, first, reach


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    merge, first = _Merge(), None
    for b in batches:
        if b.num_rows:
            first = first or key_at(b, ["path"], 0)
            merge.add(b)
    if first:
        row = [TaskContext.get().partitionId(), *first, *merge.group, *merge.known]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 3])], names=["part", "first", "last", "live", "since", "reach"])


def _judge(batches: Iterator[pa.RecordBatch], names: list[str], given: dict) -> Iterator[pa.RecordBatch]:
    merge = _Merge(given.get(TaskContext.get().partitionId()))
    tables = pa.array(names, pa.string())
    for b in batches:
        if not b.num_rows:
            continue
        live, first, reach = merge.add(b)
        kind, at = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("kind", "at"))
        rows = np.flatnonzero(kind == REFERENCE)
        t, live, first, reach = at[rows], live[rows], first[rows], reach[rows]
        judged = np.select([live <= t, reach > t, first <= t, first < NEVER], [0, 1, 2, 3], 4)
        own = b.take(pa.array(rows))
        column = lambda c: own.column(own.schema.get_field_index(c))  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays(
            [tables.take(column("ref")), column("row_id"), column("path"), pa.array(t, mask=t == FIRST), pa.array(VALIDITY[judged])], names=["ref_table", "row_id", "path", "committed", "validity"]
        )


def checked_references(tables: dict[str, DataFrame], files: DataFrame) -> DataFrame:
    """``ref_table, row_id, path, committed_at, validity`` of every row whose file isn't null or blank.

    A row of the listing makes its path valid from listed_at, to deleted_at where that isn't null. validity is the first that holds of:
    ``ok`` (a row that isn't deleted is listed by committed_at), ``deleted_later`` (an interval holds committed_at, the file has been deleted
    since), ``deleted`` (listed by committed_at, but no interval holds it), ``late`` (all listings come after it), ``missing`` (no listing).
    A null listed_at is no listing, a null committed_at comes before every listing, an interval that ends no later than it begins holds
    nothing. A file such as ``./``, of which no path is left, is ``missing``. Repeated rows are each judged.

    References and parent keys are sorted together by path and time into ranges, and both streams are merged linearly; a range hands what it
    knows of its last path to the next (one row per range goes over the driver), so a path that holds a third of all rows spreads over many.
    """
    ordered = in_order(_stream(tables, files), ["path", "at", "kind"])
    rows = ordered.mapInArrow(_states, "part bigint, first string, last string, live bigint, since bigint, reach bigint").collect()
    given, _ = handed_on([(r.part, (r.first,), (r.last,), (r.live, r.since, r.reach)) for r in rows], lambda a, b: (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2])))
    judged = ordered.mapInArrow(partial(_judge, names=list(tables), given=given), "ref_table string, row_id bigint, path string, committed bigint, validity string")
    return judged.select("ref_table", "row_id", "path", F.timestamp_micros("committed").alias("committed_at"), "validity")


def orphans(tables: dict[str, DataFrame], files: DataFrame) -> DataFrame:
    """``ref_table, row_id, validity`` of the rows whose file isn't there."""
    return checked_references(tables, files).where(F.col("validity") != "ok").select("ref_table", "row_id", "validity")


def orphan_report(tables: dict[str, DataFrame], files: DataFrame) -> DataFrame:
    """Rows, orphan rows and orphan rows by validity, per table and month of committed_at (``unknown`` where that is null)."""
    judged = checked_references(tables, files).withColumn("month", F.coalesce(F.date_format("committed_at", "yyyy-MM"), F.lit("unknown")))
    n = lambda s: F.count_if(F.col("validity") == s).alias(s)
    return judged.groupBy("ref_table", "month").agg(F.count("*").alias("refs"), F.count_if(F.col("validity") != "ok").alias("orphans"), *[n(v) for v in VALIDITY.tolist()[1:]])
