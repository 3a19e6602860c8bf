"""Token windows, prompt budgets, centred vectors and differences of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import vectors
from tidepanel.functions.scalar import col


def token_windows(tokens, length: int, overlap: int) -> Column:
    """Overlapping windows as structs of start, tokens and weight, the tokens that no window before has; the last covers the end."""
    t, step = col(tokens), length - overlap
    n = F.size(t)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s - step + length < n))

    def window(s):
        part = F.slice(t, s + 1, F.lit(length))
        return F.struct(s.alias("start"), part.alias("tokens"), F.when(s == 0, F.size(part)).otherwise(F.greatest(F.size(part) - overlap, F.lit(1))).alias("weight"))

    return F.transform(starts, window)


def fit_budget(prefix, text, suffix, most: int) -> Column:
    """text cut so that prefix, text and suffix hold at most `most` tokens; with its first and end place in the whole."""
    p, t, s = col(prefix), col(text), col(suffix)
    kept = F.slice(t, F.lit(1), F.greatest(F.lit(most) - F.size(p) - F.size(s), F.lit(0)))
    return F.struct(kept.alias("text"), F.size(p).alias("first"), (F.size(p) + F.size(kept)).alias("last"))


def centred(df: DataFrame, vec: str, *keys: str, fit=None) -> DataFrame:
    """df with vec less the mean vector of its keys (of rows where fit holds, if given; then unseen keys stay as they are)."""
    means = vectors.mean_vector(df.filter(fit) if fit is not None else df, vec, *keys, alias="_mean")
    out = df.join(means, list(keys), "left")
    return out.withColumn(vec, F.when(F.col("_mean").isNull(), F.col(vec)).otherwise(vectors.minus(vec, "_mean"))).drop("_mean")


def pair_deltas(pairs: DataFrame, table: DataFrame, vec: str = "vec", item: str = "item_id") -> DataFrame:
    """high_id, low_id, delta: the high row's vector less the low row's."""
    side = lambda p: table.select(F.col(item).alias(f"{p}_id"), F.col(vec).alias(f"_{p}"))
    return pairs.join(side("high"), "high_id").join(side("low"), "low_id").select("high_id", "low_id", vectors.minus("_high", "_low").alias("delta"))
