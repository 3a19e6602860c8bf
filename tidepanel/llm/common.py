"""What the text-corpus operators share: reading, sizing of Python batches, durable intermediate tables."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Rows of whole texts that a Python worker holds at once.
BATCH_ROWS = 128
#: Rows of a rule list that goes to all tasks.
SMALL = 50_000
#: The white space that the word-based contracts name.
ASCII_SPACE = " \t\n\x0b\x0c\r"


_SHIPPED: set[str] = set()


def packed_up() -> str:
    """A zip of this package; the driver serves it, so its folder needn't be shared."""
    return shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/tidepanel", "zip", ROOT, "tidepanel")


def session(spark: SparkSession) -> SparkSession:
    """The session, set up so that Python workers find this package and take whole texts in small batches.

    On a cluster the package goes to the executors as a zip; where they run on this machine its folder is named to them.
    """
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        sc.environment.setdefault("PYTHONPATH", ROOT)
    elif sc.applicationId not in _SHIPPED:
        sc.addPyFile(packed_up())
        _SHIPPED.add(sc.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:  # else files are cut by the cores there are at the time
        spark.conf.set("spark.sql.files.minPartitionNum", str(sc.defaultParallelism))
    return spark


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, of rows rows, with a hint to broadcast it if they are at most SMALL; else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if rows <= SMALL else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a new local one only where that is unset and Spark runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None))
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df as a table written once to the shared folder: its lineage ends here, whichever executor is lost later."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pinned(df: DataFrame) -> DataFrame:
    """df as a scan that gives the same rows in the same places each time: itself if it only reads files, else durable."""
    session(df.sparkSession)
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = set(re.findall(r"^[ :|+-]*(\w+)", plan.toString(), re.MULTILINE))
    return df if plan.deterministic() and nodes <= {"Project", "Filter", "Relation", "LocalRelation"} else durable(df)


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """df with a number for each row, so that repeated rows and repeated or null ids keep results of their own.

    The number is the row's place in the scan, and session() fixes into how many parts files are cut, so that each
    evaluation numbers alike though executors come and go; what isn't a scan of files is written to a table first (pinned).
    Numbers are good within an application, not beyond.
    """
    return pinned(df).withColumn(name, F.monotonically_increasing_id())


def in_order(df: DataFrame, ranges: list, then: list | None = None, name: str = "_place") -> DataFrame:
    """df with each row's place, from 0, in the order of ranges and then of then.

    Ranges of the order are sorted apart and written once; a row's place is its number there plus what the ranges before
    hold. Only a row for each range goes to all tasks. Rows that are equal in the whole order take places in any order.
    """
    at, below = F.col("_at"), (1 << 33) - 1
    held = durable(df.repartitionByRange(*ranges).sortWithinPartitions(*ranges, *(then or [])).withColumn("_at", F.monotonically_increasing_id()))
    sizes = held.groupBy(F.shiftright(at, 33).alias("_range")).agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return held.withColumn("_range", F.shiftright(at, 33)).join(F.broadcast(before), "_range").select(*df.columns, (F.col("_before") + at.bitwiseAND(F.lit(below))).alias(name))


def text_of(name: str = "text"):
    """A text column with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(col):
    """A-Z lower-cased, all else as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
