"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.scalar import col


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def unit(v, floor: float = 1e-8) -> Column:
    """v over its length, or over floor if that is more."""
    n = F.greatest(norm(v), F.lit(floor))
    return F.transform(col(v), lambda x: x / n)


def minus(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def mean_vector(df: DataFrame, v: str, *keys: str, weight: str | None = None, alias: str = "mean") -> DataFrame:
    """keys and the (weighted) mean of the vectors, by position: sums of partial sums, no vector is gathered in one task."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    flat = df.select(*keys, w.alias("_w"), F.posexplode(v).alias("_i", "_x"))
    means = flat.groupBy(*keys, "_i").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_m"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(alias))


def softmax_expectation(logits, values: list[float]) -> Column:
    """Expected value under the softmax of logits."""
    v = col(logits)
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return dot(e, F.array(*(F.lit(float(x)) for x in values))) / total
