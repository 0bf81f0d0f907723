"""Problem 2: intervals of an entity that overlap, nest, touch or leave gaps, as continuous periods and the gaps between them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.durable import durable
from voxmill.functions.text import trim_space
from voxmill.ordered import begins, handed_on, in_order, key_at, running

#: Width of a time shard.
SHARD_MS = 60_000
#: Rows of pieces that are merged locally at a time.
LOCAL_ROWS = 1 << 16
#: Times beyond this many ms either way count as this: it is the range of whole ms that fit a BIGINT with room for a shard.
MOST_MS = 9.0e18


def clean_intervals(df: DataFrame, start: str = "start", end: str = "end", speaker: str = "speaker", keys: tuple[str, ...] = ("source_id", "chunk_idx")) -> DataFrame:
    """Rows that count, as ``keys, speaker, s, e`` in whole ms.

    Null and NaN times, null and blank speakers and ends not after the start are left out. Infinite times and times beyond the range of
    BIGINT count as the end of that range. Null keys count as a key of their own.
    """
    ms = lambda c: F.when(c.isNotNull() & ~F.isnan(c), F.greatest(F.lit(-MOST_MS), F.least(F.lit(MOST_MS), F.round(c.cast("double") * 1000)))).cast("bigint")
    return (
        df.select(*[F.col(f"`{k}`") for k in keys], F.upper(trim_space(F.col(f"`{speaker}`"))).alias("speaker"), ms(F.col(f"`{start}`")).alias("s"), ms(F.col(f"`{end}`")).alias("e"))
        .where(F.col("speaker").isNotNull() & (F.col("speaker") != "") & F.col("s").isNotNull() & (F.col("e") > F.col("s")))
    )


def merged_in_shards(df: DataFrame, keys: list[str], width: int = SHARD_MS) -> DataFrame:
    """``keys, s, e``: coverage within time shards, merged where the rows are, before any shuffle. An interval gives its part of the first and the last shard it lies in, and one row for all whole shards between, however many."""
    shard_of = lambda c: F.call_function("div", c - F.pmod(c, F.lit(width)), F.lit(width))
    piece = lambda level, shard, s, e: F.struct(F.lit(level).alias("level"), shard.alias("shard"), s.cast("bigint").alias("s"), e.cast("bigint").alias("e"))
    a, b = F.col("__a"), F.col("__b")
    cut = F.array_compact(
        F.array(
            piece(0, a, F.col("s"), F.least(F.col("e"), (a + 1) * width)),
            F.when(b > a, piece(0, b, b * width, F.col("e"))),
            F.when(b > a + 1, piece(1, a + 1, (a + 1) * width, b * width)),
        )
    )
    pieces = df.withColumn("__a", shard_of(F.col("s"))).withColumn("__b", shard_of(F.col("e") - 1)).select(*keys, F.explode(cut).alias("x")).select(*keys, "x.level", "x.shard", "x.s", "x.e")
    types = dict(df.dtypes)
    return pieces.mapInArrow(partial(_locally, keys=keys), ", ".join([*(f"`{k}` {types[k]}" for k in keys), "s bigint", "e bigint"]))


def _locally(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Merges what overlaps or touches within an entity's shard, as far as it comes in one stretch of LOCAL_ROWS; this is what is combined before the shuffle."""
    held: list[pa.RecordBatch] = []

    def merge() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        group = [*keys, "level", "shard"]
        codes = [whole.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in keys] + [whole.column(c).to_numpy() for c in ("level", "shard")]
        s, e = whole.column("s").to_numpy(), whole.column("e").to_numpy()
        order = np.lexsort((s, *reversed(codes)))
        s, e = s[order], e[order]
        fresh = np.ones(len(s), bool)
        fresh[1:] = False
        for c in codes:
            fresh[1:] |= c[order][1:] != c[order][:-1]
        top = running(e, fresh)
        new = fresh.copy()
        new[1:] |= s[1:] > top[:-1]
        at = np.flatnonzero(new)
        named = whole.select(group[: len(keys)]).take(pa.array(order[at])).combine_chunks()
        ends = top[np.append(at[1:], len(s)) - 1]
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in named.columns), pa.array(s[at]), pa.array(ends)], names=[*keys, "s", "e"])

    rows = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= LOCAL_ROWS:
            yield merge()
            rows = 0
    if held:
        yield merge()


class _Coverage:
    """Coverage of sorted rows ``keys, s, e``: the open period of the group at hand and what is finished."""

    def __init__(self, keys: list[str], state: tuple[tuple, tuple] | None = None):
        self.keys, self.group, self.open = keys, *(state or (None, None))

    def add(self, batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array | tuple, np.ndarray, np.ndarray]]:
        """Yields ``kind, rows of the batch that name the group (or the group itself), starts, ends`` of what a batch finishes."""
        s, e = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("s", "e"))
        fresh = begins(batch, self.keys)
        goes_on = self.group is not None and self.group == key_at(batch, self.keys, 0)
        top = running(e, fresh)
        before = np.empty_like(top)
        before[1:] = top[:-1]
        first_group = int(fresh[1:].argmax()) + 1 if fresh[1:].any() else len(s)
        if goes_on:
            # what was handed over lies before the first group
            top[:first_group] = np.maximum(top[:first_group], self.open[1])
            before[0] = self.open[1]
            before[1:first_group] = top[: first_group - 1]
            fresh[0] = False
        new = fresh | (s > before)
        at = np.flatnonzero(new)
        ends = top[np.append(at[1:], len(s)) - 1]
        gaps = at[~fresh[at]]
        yield "gap", gaps, before[gaps], s[gaps]
        if len(at):
            if self.group is not None:
                last = top[at[0] - 1] if goes_on and at[0] > 0 else self.open[1]
                yield "period", self.group, np.array([self.open[0]]), np.array([last])
            yield "period", at[:-1], s[at[:-1]], ends[:-1]
            self.group, self.open = key_at(batch, self.keys, int(at[-1])), (int(s[at[-1]]), int(ends[-1]))
        else:
            self.open = (self.open[0], int(top[-1]))


def _states(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """One row per partition: its first group, its last one and the open period of that."""
    scan, first = _Coverage(keys), None
    for b in batches:
        if b.num_rows:
            first = first or key_at(b, keys, 0)
            for _ in scan.add(b):
                pass
            types = [b.schema.field(k).type for k in keys]
    if first:
        row = [TaskContext.get().partitionId(), *first, *scan.group, *scan.open]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32(), *types, *types, pa.int64(), pa.int64()])], names=["part", *(f"f_{k}" for k in keys), *(f"l_{k}" for k in keys), "s", "e"])


def _found(batches: Iterator[pa.RecordBatch], keys: list[str], given: dict, goes_on: set[int]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    scan, schema = _Coverage(keys, given.get(part)), None
    named = lambda group, kind, a, b: pa.RecordBatch.from_arrays([*(pa.array([v] * len(a), schema.field(k).type) for k, v in zip(keys, group)), pa.array([kind] * len(a)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=[*keys, "kind", "start_ms", "end_ms"])
    for batch in batches:
        if not batch.num_rows:
            continue
        schema = batch.schema
        for kind, rows, a, b in scan.add(batch):
            if isinstance(rows, tuple):
                yield named(rows, kind, a, b)
            elif len(rows):
                taken = batch.take(pa.array(rows))
                own = [taken.column(schema.get_field_index(k)) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array([kind] * len(rows)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=[*keys, "kind", "start_ms", "end_ms"])
    if schema is not None and part not in goes_on:
        yield named(scan.group, "period", [scan.open[0]], [scan.open[1]])


def _put_before(handed: tuple, state: tuple) -> tuple:
    """The open period of a partition that is all one group, after what it was handed: one with it where that reaches its start."""
    return (handed[0], max(handed[1], state[1])) if handed[1] >= state[0] else state


def periods_and_gaps(df: DataFrame, keys: tuple[str, ...] = ("source_id", "chunk_idx", "speaker"), width: int = SHARD_MS) -> DataFrame:
    """``keys, kind, start_ms, end_ms``: maximal covered periods and the gaps between neighbours, of rows ``keys, s, e`` (whole ms, s < e).

    Two levels, so that an entity with any number of intervals, however long, is spread over tasks: intervals are clipped into time shards of
    fixed width and merged within them; the results are sorted into ranges of (entity, start), and each range stitches what touches, handing
    its open period to the next (one row per range goes over the driver). Repeated rows change nothing; an empty table gives no rows.
    """
    k = list(keys)
    types = dict(df.dtypes)
    names = [f"`{x}` {types[x]}" for x in k]
    ordered = in_order(durable(merged_in_shards(df, k, width)), [*k, "s"])
    schema = ", ".join(["part int", *(n.replace("`", "`f_", 1) for n in names), *(n.replace("`", "`l_", 1) for n in names), "s bigint", "e bigint"])
    states = [(r[0], tuple(r[1 : 1 + len(k)]), tuple(r[1 + len(k) : 1 + 2 * len(k)]), tuple(r[-2:])) for r in ordered.mapInArrow(partial(_states, keys=k), schema).collect()]
    given, goes_on = handed_on(states, _put_before)
    return ordered.mapInArrow(partial(_found, keys=k, given=given, goes_on=goes_on), ", ".join([*names, "kind string", "start_ms bigint", "end_ms bigint"]))


def speech_periods(segments: DataFrame) -> DataFrame:
    """Continuous speech periods and the gaps between them, per source, chunk and speaker label (trimmed, upper case)."""
    return periods_and_gaps(clean_intervals(segments))
