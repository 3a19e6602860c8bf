"""Writing result tables, and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a new local one only where it is unset and Spark runs on this machine alone."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def lines(df: DataFrame, compression: str = "none", by: tuple[str, ...] = (), each: bool = False) -> str:
    """df, one string column besides those of by, as text files in folders of by; each: every row is a file. Returns the path."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/text-{uuid.uuid4().hex}"
    out = df.write.option("compression", compression).option("maxRecordsPerFile", 1 if each else 0)
    (out.partitionBy(*by) if by else out).text(path)
    return path


def written(df: DataFrame, kind: str, *by: str, path: str | None = None) -> str:
    """df written as parquet, csv or json (one object a line), in folders of by; returns the path."""
    path = path or f"{shared_dir(df.sparkSession).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    out = df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")
    (out.option("header", True) if kind == "csv" else out).format(kind).save(path)
    return path
