"""The corpus pipeline: quality rules, near copies, long repeats, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import packing, personal_data, repetition, simhash, suffix_dedup
from tidepanel.llm.common import durable, session, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: No stage but the first could be told in SQL: hashes, suffix order, EM and packing aren't; tests compare by brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go; so do null and empty texts."""
    return repetition.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (least doc_id, null first): SimHash, then min-hashes, each link a similarity of 0.8 or more of five-word shingles."""
    return simhash.one_of_each(docs)


def _counted(docs: DataFrame) -> DataFrame:
    """docs with n_chars, where there is one, as the text now has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 100 that stand earlier in the corpus (by doc_id, null first) are cut out of the texts; null stays null."""
    return _counted(suffix_dedup.without_repeats(docs))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind's name; null texts stay null."""
    return _counted(personal_data.redacted(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048; a null or empty text is the end id alone."""
    return packing.packed_documents(docs, TOKENIZER)


STAGES = [("quality", quality), ("near_copies", near_copies), ("long_repeats", long_repeats), ("private", private), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on documents, each written and read again."""
    docs = table(session(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
