"""Problem 1: a score cutoff per source that keeps a target share of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxmill.durable import durable, sized_join
from voxmill.functions.text import trim_space

#: Target share as a fraction, so that rank arithmetic is exact.
TARGET = (3, 5)
BINS = 1024


def counted_scores(df: DataFrame, source: str = "source", score: str = "speaker_similarity", low: float = -1.0, high: float = 1.0, extra: tuple[str, ...] = ()) -> DataFrame:
    """``source, score`` and the columns ``extra`` of the rows that count: source (trimmed) not null or blank, score neither null nor NaN and within [low, high]."""
    v = F.col(f"`{score}`").cast("double")
    return df.select(*[F.col(f"`{x}`") for x in extra], trim_space(F.col(f"`{source}`")).alias("source"), v.alias("score")).where(
        F.col("source").isNotNull() & (F.col("source") != "") & F.col("score").isNotNull() & ~F.isnan("score") & F.col("score").between(low, high)
    )


def _narrow(binned: DataFrame, target: tuple[int, int] | None = None) -> DataFrame:
    """From ``source, bin, cnt, lo, hi`` (and ``n, need``, unless they follow from the target) the bin that holds the rank ``need``, counted from the top, and the rank within it."""
    per = W.partitionBy("source")
    down = per.orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0)
    state = binned.withColumn("above", F.sum("cnt").over(down) - F.col("cnt"))
    if target:
        num, den = target
        state = state.withColumn("n", F.sum("cnt").over(per)).withColumn("need", F.call_function("div", F.col("n") * num + (den - 1), F.lit(den)))
    hit = (F.col("above") < F.col("need")) & (F.col("need") <= F.col("above") + F.col("cnt"))
    return state.where(hit).select("source", "n", (F.col("need") - F.col("above")).alias("need"), "lo", "hi")


def score_cutoffs(counted: DataFrame, target: tuple[int, int] = TARGET, bins: int = BINS, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """``source, n, cutoff``: the highest score value of each source such that at least target of its n rows have that score or more.

    Iterative histogram refinement. Scores are counted per source into ``bins`` bins over [low, high]; the bin that holds the target rank
    becomes the new range, its least and largest value the new ends; only what lies within the ranges is counted again, until every range
    is one value. After the first round that is a table of value counts about 1024 times smaller. A range loses at least one end in each round, so it ends; bins shrink 1024-fold a round. Counts are combined before the
    shuffle, so a source with a third of all rows sends at most ``bins`` rows per task. Ties count in full; sources of one row keep it.
    """
    b = F.least(F.lit(bins - 1), F.floor((F.col("score") - low) / (high - low) * bins)).cast("int")
    binned = counted.groupBy("source", b.alias("bin")).agg(F.count("*").alias("cnt"), F.min("score").alias("lo"), F.max("score").alias("hi"))
    state = durable(_narrow(binned, target))
    done = state.where(F.col("lo") == F.col("hi"))
    wide = state.where(F.col("lo") < F.col("hi"))
    rest = None
    while not wide.isEmpty():
        if rest is None:
            # the second and last read of all rows: what lies in the ranges, as counts of values
            inside = sized_join(counted.select("source", "score"), wide, ["source"]).where(F.col("score").between(F.col("lo"), F.col("hi")))
            rest = durable(inside.groupBy("source", "score").agg(F.count("*").alias("cnt")))
        inside = sized_join(rest, wide, ["source"]).where(F.col("score").between(F.col("lo"), F.col("hi")))
        b = F.least(F.lit(bins - 1), F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
        binned = inside.groupBy("source", b.alias("bin")).agg(
            F.sum("cnt").alias("cnt"), F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.first("n").alias("n"), F.first("need").alias("need")
        )
        state = durable(_narrow(binned.withColumnsRenamed({"_lo": "lo", "_hi": "hi"})))
        done = done.unionByName(state.where(F.col("lo") == F.col("hi")))
        wide = state.where(F.col("lo") < F.col("hi"))
    return done.select("source", "n", F.col("lo").alias("cutoff"))


def kept_rows(df: DataFrame, key: str = "row_id") -> DataFrame:
    """``key``: the rows at or above the cutoff of their source."""
    counted = counted_scores(df, extra=(key,))
    cut = durable(score_cutoffs(counted))
    return sized_join(counted, cut.select("source", "cutoff"), ["source"]).where(F.col("score") >= F.col("cutoff")).select(key)


def cutoff_report(df: DataFrame) -> DataFrame:
    """``source, n, cutoff, kept, kept_share``: the cutoff of each source and what it keeps."""
    counted = counted_scores(df)
    cut = durable(score_cutoffs(counted))
    kept = sized_join(counted, cut, ["source"]).where(F.col("score") >= F.col("cutoff")).groupBy("source").agg(F.first("n").alias("n"), F.first("cutoff").alias("cutoff"), F.count("*").alias("kept"))
    return kept.withColumn("kept_share", F.col("kept") / F.col("n"))
