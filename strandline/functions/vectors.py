"""Vector arithmetic on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def unit(a: Column) -> Column:
    """A vector of length 1 along ``a``; null if it's empty, zero or not finite."""
    length = norm(a)
    return F.when((F.size(a) > 0) & (length > 0) & (length < F.lit(float("inf"))), F.transform(a, lambda v: v.cast("double") / length))


def cosine(a: Column, b: Column) -> Column:
    """Null if either has no direction."""
    lengths = norm(a) * norm(b)
    return F.when((lengths > 0) & (lengths < F.lit(float("inf"))), dot(a, b) / lengths)


def weighted_mean(a: Column, weight_a: Column, b: Column, weight_b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x * weight_a + y * weight_b) / (weight_a + weight_b))


#: What a short utterance weighs at least, and how many exemplars stay.
LEAST_WEIGHT, EXEMPLARS = 0.25, 8


def centroid_fold(observed: Column) -> Column:
    """Running speaker profile over an ordered array of (vector, seconds).

    The centroid is a weighted mean brought to unit length after each vector,
    so order matters.  Returns (centroid, total_seconds, embedding_count,
    exemplars), null for an empty array.
    """

    def step(state: Column, x: Column) -> Column:
        vector, seconds = unit(x["vector"]), F.greatest(F.lit(0.0), x["seconds"].cast("double"))
        fresh = state["centroid"].isNull() | (state["total_seconds"] <= 0)
        merged = unit(weighted_mean(state["centroid"], state["total_seconds"], vector, F.greatest(seconds, F.lit(LEAST_WEIGHT))))
        kept = F.concat(state["exemplars"], F.array(vector))
        return F.struct(
            F.when(fresh, vector).otherwise(merged).alias("centroid"),
            F.when(fresh, seconds).otherwise(state["total_seconds"] + seconds).alias("total_seconds"),
            F.when(fresh, F.lit(1)).otherwise(state["embedding_count"] + 1).cast("int").alias("embedding_count"),
            F.when(fresh, F.array(vector)).otherwise(F.when(F.size(kept) > EXEMPLARS, F.slice(kept, -EXEMPLARS, EXEMPLARS)).otherwise(kept)).alias("exemplars"),
        )

    empty = F.struct(
        F.lit(None).cast("array<double>").alias("centroid"), F.lit(0.0).alias("total_seconds"),
        F.lit(0).alias("embedding_count"), F.lit(None).cast("array<array<double>>").alias("exemplars"),
    )
    shape = "struct<centroid:array<double>,total_seconds:double,embedding_count:int,exemplars:array<array<double>>>"
    return F.aggregate(F.filter(observed, lambda x: unit(x["vector"]).isNotNull()), empty.cast(shape), lambda s, x: step(s, x).cast(shape))
