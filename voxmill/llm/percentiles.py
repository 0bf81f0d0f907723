"""Problem 5: percentiles per group of very large numeric columns, exactly and in a form that can be combined."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxmill.functions.text import trim_space
from voxmill.ordered import begins, in_order, key_at

METRICS = ("duration", "speaker_similarity")
PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
#: Relative error of a percentile from combined day summaries.
ERROR = 0.005
#: Values nearer to zero than this count as zero in day summaries.
LEAST = 1e-9
#: Bin of infinite values.
ENDLESS = 1 << 30


def long_values(df: DataFrame, metrics: tuple[str, ...] = METRICS, source: str = "source", extra: tuple[str, ...] = ()) -> DataFrame:
    """``extra, source, metric, value``: one row per value that is neither null nor NaN. source is trimmed; null and blank become the empty string. -0.0 counts as 0.0."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("value")) for m in metrics])
    return (
        df.select(*[F.col(f"`{x}`") for x in extra], F.coalesce(trim_space(F.col(f"`{source}`")), F.lit("")).alias("source"), F.explode(pairs).alias("x"))
        .select(*extra, "source", "x.metric", (F.col("x.value") + 0.0).alias("value"))
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
    )


def value_counts(values: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """``extra, source, metric, value, cnt``: equal values counted together, before any shuffle. Such runs of separate days or partitions are combined by combined_counts, without loss."""
    return values.groupBy(*extra, "source", "metric", "value").agg(F.count("*").alias("cnt"))


def combined_counts(runs: DataFrame) -> DataFrame:
    """One run of runs of separate days or partitions."""
    return runs.groupBy("source", "metric", "value").agg(F.sum("cnt").alias("cnt"))


KEYS = ["source", "metric"]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per partition: its first and its last group and how many values it has of each."""
    first = last = None
    first_n = last_n = 0
    for b in batches:
        if not b.num_rows:
            continue
        at = np.flatnonzero(begins(b, KEYS))
        sums = np.add.reduceat(b.column(b.schema.get_field_index("cnt")).to_numpy(), at)
        for row, n in zip((at[0], at[-1]) if len(at) > 1 else (at[0],), (sums[0], sums[-1]) if len(at) > 1 else (sums[0],)):
            key = key_at(b, KEYS, int(row))
            if first is None:
                first, first_n = key, 0
            if key == first:
                first_n += int(n)
            last, last_n = key, (last_n if key == last else 0) + int(n)
    if first:
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "s0": [first[0]], "m0": [first[1]], "n0": [first_n], "s1": [last[0]], "m1": [last[1]], "n1": [last_n]})


def _offsets(ends: list[tuple[int, tuple, int, tuple, int]]) -> dict[int, dict[tuple, tuple[int, int]]]:
    """For each partition, of its first and last group: the values before it and in all. Groups between lie in one partition and need neither."""
    total: dict[tuple, int] = {}
    where: list[tuple[int, tuple, int]] = []
    for part, g0, n0, g1, n1 in sorted(ends):
        for g, n in ((g0, n0), (g1, n1)) if g0 != g1 else ((g0, n0),):
            where.append((part, g, total.get(g, 0)))
            total[g] = total.get(g, 0) + n
    out: dict[int, dict[tuple, tuple[int, int]]] = {}
    for part, g, before in where:
        out.setdefault(part, {})[g] = (before, total[g])
    return out


def _pick(batches: Iterator[pa.RecordBatch], percentiles: tuple[float, ...], offsets: dict[int, dict[tuple, tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """The neighbours of each target rank that lie in the partition; a group is held until its rows in the partition are all there."""
    known = offsets.get(TaskContext.get().partitionId(), {})
    group, values, counts = None, [], []
    out: list[tuple] = []

    def finish() -> None:
        v, cum = np.concatenate(values), np.cumsum(np.concatenate(counts))
        before, n = known.get(group, (0, int(cum[-1])))
        for p in percentiles:
            h = p * (n - 1)
            low = math.floor(h)
            for rank in dict.fromkeys((low, math.ceil(h))):
                if before <= rank < before + cum[-1]:
                    out.append((*group, p, n, h - low, rank - low, float(v[np.searchsorted(cum, rank - before, side="right")])))

    def flush() -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.int32(), pa.float64()]
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["source", "metric", "p", "n", "frac", "side", "value"])
        out.clear()
        return batch

    for b in batches:
        if not b.num_rows:
            continue
        v, c = (b.column(b.schema.get_field_index(x)).to_numpy() for x in ("value", "cnt"))
        at = np.flatnonzero(begins(b, KEYS)).tolist()
        for a, e in zip(at, [*at[1:], len(v)]):
            key = key_at(b, KEYS, a)
            if key != group and group is not None:
                finish()
                values, counts = [], []
            group = key
            values.append(v[a:e])
            counts.append(c[a:e])
        if out:
            yield flush()
    if group is not None:
        finish()
        yield flush()


def percentiles_of_counts(counts: DataFrame, percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """``source, metric, p, n, value``: exact percentiles, with linear interpolation between neighbouring order statistics, of rows ``source, metric, value, cnt``.

    Full distributed sort with counts per partition: the distinct values are range-partitioned by (source, metric, value) and sorted, so that a
    group with a third of all rows spreads over many partitions; each partition counts what it has of its first and last group (one row per
    partition goes over the driver); these offsets locate each target rank in the partition that holds it, where the neighbours are read
    and then interpolated. Nothing that grows with the groups is broadcast. Groups without values give no row.
    """
    ordered = in_order(counts.select("source", "metric", "value", F.col("cnt").cast("bigint").alias("cnt")), ["source", "metric", "value"])
    ends = ordered.mapInArrow(_ends, "part bigint, s0 string, m0 string, n0 bigint, s1 string, m1 string, n1 bigint").collect()
    offsets = _offsets([(r.part, (r.s0, r.m0), r.n0, (r.s1, r.m1), r.n1) for r in ends])
    found = ordered.mapInArrow(partial(_pick, percentiles=tuple(map(float, percentiles)), offsets=offsets), "source string, metric string, p double, n bigint, frac double, side int, value double")
    return _interpolated(found)


def _interpolated(found: DataFrame) -> DataFrame:
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("value")))
    both = found.groupBy("source", "metric", "p").agg(F.first("n").alias("n"), F.first("frac").alias("frac"), side(0).alias("a"), side(1).alias("b"))
    # an infinite neighbour that isn't the only one outweighs the other, the lower one first
    endless = F.when(F.col("a") == float("-inf"), F.col("a")).when(F.col("b") == float("inf"), F.col("b")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("frac"))
    value = F.when(F.col("b").isNull() | (F.col("frac") == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise(endless)
    return both.select("source", "metric", "p", "n", value.alias("value"))


def exact_percentiles(values: DataFrame, percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """As percentiles_of_counts, of rows ``source, metric, value``."""
    return percentiles_of_counts(value_counts(values), percentiles)


def day_summaries(values: DataFrame, day: str = "day", error: float = ERROR) -> DataFrame:
    """``day, source, metric, bin, cnt``: counts of values in bins whose ends differ by a factor of (1 + error) / (1 - error), of a size that does not grow with the rows.

    Summaries of any days, partitions or runs are combined by adding the counts of equal bins. Infinite values have bins of their own.
    """
    step = math.log((1 + error) / (1 - error))
    v = F.col("value")
    place = F.ceil(F.log(F.greatest(F.abs(v), F.lit(LEAST)) / LEAST) / step).cast("int") + 1
    size = F.when(F.abs(v) == float("inf"), ENDLESS).when(F.abs(v) < LEAST, 0).otherwise(place)
    return values.groupBy(day, "source", "metric", F.when(v < 0, -size).otherwise(size).alias("bin")).agg(F.count("*").alias("cnt"))


def combine_summaries(summaries: DataFrame) -> DataFrame:
    """One summary per source and metric of summaries of separate days."""
    return summaries.groupBy("source", "metric", "bin").agg(F.sum("cnt").alias("cnt"))


def summary_percentiles(combined: DataFrame, percentiles: tuple[float, ...] = PERCENTILES, error: float = ERROR) -> DataFrame:
    """``source, metric, p, n, value, bound``: percentiles from a combined summary, interpolated as the exact ones are, and how far each can be from the exact one at most.

    Each neighbour is within the relative ``error`` of its order statistic (within LEAST near zero).
    """
    step = math.log((1 + error) / (1 - error))
    group = W.partitionBy("source", "metric")
    run = combined.withColumn("n", F.sum("cnt").over(group)).withColumn("cum", F.sum("cnt").over(group.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)))
    h = F.col("p") * (F.col("n") - 1)
    asked = run.select("*", F.explode(F.array(*[F.lit(float(p)) for p in percentiles])).alias("p")).withColumn("frac", h - F.floor(h))
    ranks = asked.select("*", F.explode(F.array_distinct(F.array(F.floor(h), F.ceil(h)))).alias("rank")).withColumn("side", (F.col("rank") - F.floor(h)).cast("int"))
    k = F.abs(F.col("bin")) - 1
    middle = F.when(F.abs("bin") == ENDLESS, float("inf")).otherwise(LEAST * F.exp(k * step) * 2 / (1 + math.exp(step))) * F.signum(F.col("bin").cast("double"))
    hit = ranks.where((F.col("rank") < F.col("cum")) & (F.col("rank") >= F.col("cum") - F.col("cnt"))).withColumn("value", F.when(F.col("bin") == 0, F.lit(0.0)).otherwise(middle))
    finite = F.when(F.abs("value") == float("inf"), 0.0).otherwise(F.abs("value"))
    weight = F.when(F.col("side") == 0, 1 - F.col("frac")).otherwise(F.col("frac"))
    bounds = hit.groupBy("source", "metric", "p").agg(F.sum(finite * weight * (error / (1 - error)) * (1 + 1e-9) + LEAST).alias("bound"))
    return _interpolated(hit).join(bounds, ["source", "metric", "p"])
