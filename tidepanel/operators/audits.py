"""Audits and grouped reports: closures, quantiles, duplicates, deciles, standard scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.windows import by_ticker


def carried_closures(df: DataFrame, min_tickers: int = 20, min_share: float = 0.95, close: float = 1e-12) -> DataFrame:
    """date, comparable, unchanged, share, closed: dates on which nearly all tickers repeat the bar before."""
    parts = ("open", "high", "low", "close")
    before = [F.lag(c).over(by_ticker()) for c in parts]
    pairs = df.select("date", *parts, *(b.alias(f"_{c}") for b, c in zip(before, parts, strict=True)))
    comparable, same = F.lit(True), F.lit(True)
    for c in parts:
        comparable = comparable & F.col(c).isNotNull() & F.col(f"_{c}").isNotNull()
        same = same & (F.abs(F.col(c) - F.col(f"_{c}")) <= close)
    n, unchanged = F.sum(F.when(comparable, 1).otherwise(0)), F.sum(F.when(comparable & same, 1).otherwise(0))
    out = pairs.groupBy("date").agg(n.alias("comparable"), unchanged.alias("unchanged"))
    out = out.withColumn("share", F.col("unchanged") / F.greatest("comparable", F.lit(1)))
    return out.withColumn("closed", (F.col("comparable") >= min_tickers) & (F.col("share") >= min_share))


def key_violations(df: DataFrame, *keys: str) -> DataFrame:
    """Keys of several rows, with their number: empty where keys are unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, or an error that names a repeated key."""
    bad = key_violations(df, *keys).limit(1).collect()
    if bad:
        raise ValueError(f"{', '.join(keys)} not unique: {bad[0].asDict()}")
    return df


def shard_report(whole: DataFrame, shards: DataFrame, key: str, n: int) -> DataFrame:
    """shard, n, uncovered, missing: of each shard that should be there, 0 to n - 1, the rows of whole that the union of
    shards (key, shard) holds, those it doesn't, and whether it holds none at all."""
    planned = whole.select(key, F.pmod(key, F.lit(n)).alias("shard"))
    met = planned.join(shards.select(key, "shard").withColumn("_held", F.lit(True)), [key, "shard"], "left")
    all_ = met.groupBy("shard").agg(F.count("_held").alias("n"), F.count_if(F.col("_held").isNull()).alias("uncovered"))
    return all_.withColumn("missing", F.col("n") == 0)


def require_covered(whole: DataFrame, shards: DataFrame, key: str, n: int) -> DataFrame:
    """shards, or an error that names the shards which are missing or don't cover their rows."""
    bad = [r.asDict() for r in shard_report(whole, shards, key, n).filter("missing or uncovered > 0").collect()]  # n rows at most
    if bad:
        raise ValueError(f"shards not whole: {bad}")
    return shards


def top_one(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key by order; order must end in a unique column."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def or_all(df: DataFrame, flag, *keys: str) -> DataFrame:
    """Rows with flag, or all rows of a key that has none."""
    marked = df.withColumn("_f", flag)
    return marked.withColumn("_any", F.max("_f").over(Window.partitionBy(*keys))).filter("_f or not _any").drop("_f", "_any")


def train_standardised(df: DataFrame, columns: list[str], key: str, floor: float = 1e-8) -> DataFrame:
    """df with z_ columns: less the key's training mean, over its population deviation or floor."""
    train = df.filter("split = 'train'").groupBy(key).agg(*(e for c in columns for e in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))))
    out = df.join(train, key, "left")
    return out.select(*df.columns, *(((F.col(c) - F.col(f"_m_{c}")) / F.greatest(F.col(f"_s_{c}"), F.lit(floor))).alias(f"z_{c}") for c in columns))
