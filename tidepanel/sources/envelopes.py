"""Raw API envelopes: one JSON object with _meta and data in each line or file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = "endpoint string, retrieved_at_utc string, response_count bigint"


def opened(raw: DataFrame, row: str, body: str = "value") -> DataFrame:
    """The data rows of envelopes in column body, with their endpoint; an envelope that lacks a part gives none."""
    both = raw.select(F.from_json(body, f"_meta struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in META.split(','))}>, data array<struct<{row}>>").alias("e"))
    return both.filter("e._meta is not null and e.data is not null").select(F.col("e._meta.endpoint").alias("endpoint"), F.inline("e.data"))


def read_envelopes(spark: SparkSession, path: str, row: str, whole: bool = True) -> DataFrame:
    """Envelopes in files, gzip or plain: each file is one, or, if not whole, each line."""
    return opened(spark.read.text(path, wholetext=whole), row)


def collection_summary(spark: SparkSession, path: str, deep: tuple[str, ...] = ()) -> DataFrame:
    """grp, files, rows, downloaded_bytes, stored_bytes of the envelopes (one a file) under path, and in total.

    grp is the first folder under path, or the first two where it is one of deep; a folder kind=x counts as x. A file that
    isn't an envelope is left out; data that isn't a list has no rows.
    """
    stored = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select("value", "_metadata.file_path", "_metadata.file_size")
    inside = F.split(F.regexp_replace(F.substring_index("file_path", path.rstrip("/").rpartition("/")[2] + "/", -1), "[^/=]*=", ""), "/")
    grp = F.when(inside[0].isin(*deep), F.concat_ws("/", F.slice(inside, 1, 2))).otherwise(inside[0])
    opened_ = stored.select(grp.alias("grp"), "file_size", F.from_json("value", "_meta struct<downloaded_bytes: bigint>, data string").alias("e")).filter("e._meta is not null and e.data is not null")
    sums = [F.count("*").alias("files"), F.sum(F.coalesce(F.json_array_length("e.data"), F.lit(0))).alias("rows"), F.sum(F.coalesce("e._meta.downloaded_bytes", F.lit(0))).alias("downloaded_bytes"), F.sum("file_size").alias("stored_bytes")]
    return opened_.rollup("grp").agg(*sums).withColumn("grp", F.coalesce("grp", F.lit("total")))


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object for each line that isn't blank."""
    return spark.read.schema(schema).json(path)
