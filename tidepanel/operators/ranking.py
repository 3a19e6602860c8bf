"""Ranks and quantiles over whole tables: ranges of the order are counted apart, then set off by what lies before them."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalar import col
from tidepanel.sources.sinks import checkpointed


def _set_off(ranged: DataFrame, n: str, keys: list[str], order: list[str]) -> DataFrame:
    """ranged (with _part, a range of the order), _first: the sum of n over all rows of its keys before it, and _all: over all of its keys."""
    sizes = ranged.groupBy("_part", *keys).agg(F.sum(n).alias("_n"))  # a row for each range and key
    of_key = Window.partitionBy(*(F.col(k) for k in keys))
    offsets = sizes.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_{k}") for k in keys), F.coalesce(F.sum("_n").over(of_key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"), F.sum("_n").over(of_key).alias("_all"))
    own = F.coalesce(F.sum(n).over(Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.col("_part") == F.col("_p"))
    return ranged.withColumn("_own", own).join(offsets, same).withColumn("_first", F.col("_own") + F.col("_off")).drop("_own", "_off", "_p", "_part", *(f"_{k}" for k in keys))


def _ranged(df: DataFrame, *order: str) -> DataFrame:
    """df with _part, the range of the order that a row is in; written once, so that ranges stay as they are."""
    return checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def dense_ids(df: DataFrame, order: list[str], name: str = "dense_id") -> DataFrame:
    """df with ids from 0 in an order that tells all rows apart; no task numbers more than a range of it."""
    return _set_off(_ranged(df.withColumn("_one", F.lit(1)), *order), "_one", [], order).withColumn(name, F.col("_first").cast("long")).drop("_first", "_all", "_one")


def numbered(df: DataFrame, order: list[str], *keys: str, name: str = "_at", of: str = "_of") -> DataFrame:
    """df with the number of each row from 1 within keys, in an order that tells its rows apart, and the rows of its keys.

    A key of many rows lies in many ranges, so that no task numbers it alone. Null keys are a key.
    """
    out = _set_off(_ranged(df.withColumn("_one", F.lit(1)), *keys, *order), "_one", list(keys), order)
    return out.withColumn(name, (F.col("_first") + 1).cast("long")).withColumn(of, F.col("_all").cast("long")).drop("_first", "_all", "_one")


def running_least(df: DataFrame, value: str, keys: list[str], order: list[str], name: str = "_least") -> DataFrame:
    """df with the least known value over the rows of its keys up to it, in order, for keys without nulls.

    As in the ranks, ranges of (keys, order) run apart and take the least of those before.
    """
    ranged = _ranged(df, *keys, *order)
    ends = ranged.groupBy("_part", *keys).agg(F.min(value).alias("_end"))  # a row for each range and key
    before = ends.select("_part", *keys, F.min("_end").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = F.min(value).over(Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.withColumn("_own", own).join(before, ["_part", *keys]).withColumn(name, F.least("_own", "_before")).drop("_own", "_before", "_part")


def cumulated(df: DataFrame, x: str, *keys: str) -> DataFrame:
    """keys, x, n, first, all: each known value of x with its rows, the number of rows below it and of all, within keys."""
    values = df.filter(col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("n"))
    return _set_off(_ranged(values, *keys, x), "n", list(keys), [x]).select(*keys, x, "n", F.col("_first").alias("first"), F.col("_all").alias("all"))


def with_average_ranks(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """df with {column}_rank for each of columns: the rank from 1 of its value within keys, ties by their average; null for a
    missing value. The values of all columns are counted in one pass by ranges of (keys, value), and meet df by join."""
    stacked = df.select(*keys, F.explode(F.array(*(F.struct(F.lit(i).alias("_of"), F.col(c).cast("double").alias("_value")) for i, c in enumerate(columns)))).alias("_s")).select(*keys, "_s.*")
    ranks = cumulated(stacked, "_value", *keys, "_of").select(*(F.col(k).alias(f"_{k}") for k in keys), "_of", "_value", (F.col("first") + (F.col("n") + 1) / 2).alias("_rank"))
    for i, c in enumerate(columns):
        own = ranks.filter(F.col("_of") == i).drop("_of")
        same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.col(c).cast("double") == F.col("_value"))
        df = df.join(own, same, "left").withColumnRenamed("_rank", f"{c}_rank").drop("_value", *(f"_{k}" for k in keys))
    return df


def quantiles(df: DataFrame, x: str, shares: list[float], *keys: str) -> DataFrame:
    """keys and q, the exact quantiles of x with linear interpolation; a key without a known value has no row, a table
    without one a null.

    Only the values at the places that the shares ask for are gathered.
    """
    c = cumulated(df.withColumn(x, F.col(x).cast("double")), x, *keys)
    asked = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(s) * (F.col("all") - 1)).alias("at")) for i, s in enumerate(shares)))
    at = lambda p: (p >= F.col("first")) & (p < F.col("first") + F.col("n"))
    low, high = F.floor("p.at"), F.ceil("p.at")
    met = c.select(*keys, x, "first", "n", F.explode(asked).alias("p")).filter(at(low) | at(high))
    ends = met.groupBy(*keys, "p").agg(F.max(F.when(at(low), F.col(x))).alias("_low"), F.max(F.when(at(high), F.col(x))).alias("_high"))
    value = F.col("_low") + (F.col("p.at") - F.floor("p.at")) * (F.col("_high") - F.col("_low"))
    listed = F.collect_list(F.struct("p.i", value.alias("v")))
    return ends.groupBy(*keys).agg(F.when(F.count("*") > 0, F.transform(F.array_sort(listed), lambda s: s["v"])).alias("q"))
