"""Speaker vectors: normal form, cosine, centroids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """The vector over its length; one of length 1e-12 or less stays as it is."""
    n = F.sqrt(dot(v, v))
    return F.when(n > EPS, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of both normal forms; null where a vector is null."""
    return dot(normalised(a), normalised(b))


def centroids(df: DataFrame, vector: str, size: int, keys: list[str] | None = None) -> DataFrame:
    """``keys, n, centroid``: the normalised mean of the normalised vectors. One average per place, so rows are combined before the shuffle and none is exploded. Null vectors don't count; without any there is no row per key."""
    v = df.where(F.col(f"`{vector}`").isNotNull()).withColumn("__v", normalised(F.col(f"`{vector}`")))
    means = v.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.array(*[F.avg(F.get("__v", F.lit(i))) for i in range(size)]).alias("centroid"))
    return means.where("n > 0").withColumn("centroid", normalised(F.col("centroid")))


def usable_centroid(c: Column) -> Column:
    """Whether a cached centroid can be used: not empty, all finite."""
    return F.coalesce((F.size(c) > 0) & F.forall(c, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def similarity_to(df: DataFrame, vector: str, centroid: DataFrame) -> DataFrame:
    """``df`` with ``similarity``: the cosine to the one centroid (one row, broadcast)."""
    one = F.broadcast(centroid.select(F.col("centroid").alias("__c")).limit(1))
    return df.crossJoin(one).withColumn("similarity", cosine(F.col(f"`{vector}`"), F.col("__c"))).drop("__c")
