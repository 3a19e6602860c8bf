"""Logical tables of the library, derived from stored ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.functions.scalar import split_of

#: Ends of the train and validation spans of the bars that events give.
TRAIN_END, VAL_END = "2024-01-15 00:00:00", "2024-01-22 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(unit: str, ts: str = "ts") -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def bars_of(ticks: DataFrame, ticker: Column, date: Column, order: Column, price: str, volume: str) -> DataFrame:
    """Daily-style bars: first, highest, lowest and last price of each ticker and date, and the volume's sum."""
    return ticks.groupBy(ticker.alias("ticker"), date.alias("date")).agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(volume).alias("volume"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as tickers, hours as sessions."""
    return bars_of(read(spark, sf_dir, "events"), F.col("event_type"), bucket("hour"), F.col("ts"), "value", "value")


def valid_bars(df: DataFrame) -> DataFrame:
    """Bars whose four prices are positive."""
    return df.filter("open > 0 and high > 0 and low > 0 and close > 0")


def bars_xs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A broad cross section: 25 groups of users by six-hour sessions."""
    hour = F.floor(F.hour("ts") / 6) * 6
    date = (F.date_trunc("day", "ts") + F.make_dt_interval(hours=hour.cast("int"))).cast("timestamp_ntz")
    return bars_of(read(spark, sf_dir, "events"), (F.col("user_id") % 25).cast("string"), date, F.col("ts"), "value", "value")


def bars_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part brands by week of shipment; ties of the ship date are broken by the whole row."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price")
    return bars_of(lines, F.col("p_brand"), bucket("week", "l_shipdate"), order, "price", "l_quantity")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a ticker (their source), a date within a fortnight and a split by it."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(14)).cast("int"))
    split = F.when(F.pmod("doc_id", F.lit(14)) < 8, "train").when(F.pmod("doc_id", F.lit(14)) < 11, "val").otherwise("test")
    return read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("ticker"), day.alias("date"), "text", "lang", "n_chars", split.alias("split"))


def vectors(spark: SparkSession, sf_dir: str, layers: int = 4, width: int = 16) -> DataFrame:
    """A row for each item and layer: slices of an embedding as layers."""
    layer = F.explode(F.sequence(F.lit(1), F.lit(layers)))
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("label").alias("grp"), layer.alias("layer"), F.col("embedding").cast("array<double>").alias("whole"))
    return rows.select("item_id", "grp", F.col("layer").cast("long").alias("layer"), F.slice("whole", (F.col("layer") - 1) * width + 1, F.lit(width)).alias("vec"))


def with_split(df: DataFrame) -> DataFrame:
    return df.withColumn("split", split_of("date", TRAIN_END, VAL_END))
