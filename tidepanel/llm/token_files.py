"""Token ids in files: fixed-size blocks of ids, transposed into planes, each plane compressed, and an index of the blocks.

A folder of two tables. chunks: shard, chunk, first (ids of the shard before it), n_ids, unit, width (bytes of an id), crc32
of its ids, planes (zstandard), sizes (of the planes), docs (the parts of documents in it). index: shard, chunk, first (ids
of all shards before it), n_ids, n_docs (documents that end in it), sizes. Shards follow each other by doc_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm.checksums import joined
from tidepanel.llm.common import durable, session, text_of
from tidepanel.llm.pieces import encoder, gathered

#: Ids of a block.
CHUNK = 65_536
LEVEL = 3
_FORMAT = "shard int, chunk int, first long, n_ids int, unit string, width int, crc32 long, planes array<binary>, sizes array<int>"
_PART = "doc_id {kind}, nth: long, start: long, at: int, n: int, begins: boolean, ends: boolean"


def to_planes(ids: np.ndarray, width: int, unit: str) -> list[bytes]:
    """The planes of a block of ids (<u4): byte k of every id, or bit k of every id, least first."""
    columns = np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4)[:, :width].T)
    if unit == "byte":
        return [c.tobytes() for c in columns]
    return [b for c in columns for b in map(bytes, np.packbits(np.unpackbits(c[:, None], axis=1, bitorder="little").T, axis=1))]


def from_planes(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    """The ids (<u4) of n-id planes."""
    rows = np.array([np.frombuffer(p, np.uint8) for p in planes])
    if unit == "bit":
        bits = np.unpackbits(rows, axis=1, count=n).reshape(-1, 8, n)
        rows = np.packbits(bits, axis=1, bitorder="little")[:, 0]
    out = np.zeros((n, 4), np.uint8)
    out[:, : len(rows)] = rows.T
    return out.view("<u4")[:, 0]


def _chunks(tokenizer: str, end_id: int, chunk: int, unit: str):
    """A mapInArrow function: sorted rows (doc_id, text, shard) of one shard to its chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        known, end, zip_ = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), zstandard.ZstdCompressor(LEVEL, write_content_size=True)
        width = max(1, (max(len(known.ends) - 1, end_id).bit_length() + 7) // 8)
        held, docs, shard, first, nth, n_chunks, kind = bytearray(), [], 0, 0, 0, 0, pa.null()

        def out() -> pa.RecordBatch:
            nonlocal first, n_chunks
            ids = np.frombuffer(bytes(held), "<u4")
            planes = [zip_.compress(p) for p in to_planes(ids, width, unit)]
            part = pa.StructArray.from_arrays([pa.array([d[k] for d in docs], t) for k, t in enumerate((kind, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()))], names=["doc_id", "nth", "start", "at", "n", "begins", "ends"])
            columns = [pa.array([shard], pa.int32()), pa.array([n_chunks], pa.int32()), pa.array([first]), pa.array([len(ids)], pa.int32()), pa.array([unit]), pa.array([width], pa.int32()), pa.array([zlib.crc32(held)], pa.int64()), pa.array([planes], pa.list_(pa.binary())), pa.array([[len(p) for p in planes]], pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), part)]
            first += len(ids)
            n_chunks += 1
            held.clear()
            docs.clear()
            return pa.RecordBatch.from_arrays(columns, names=["shard", "chunk", "first", "n_ids", "unit", "width", "crc32", "planes", "sizes", "docs"])

        for batch in gathered(batches):
            kind, shard = batch.schema.types[0], batch.column(2)[0].as_py() if len(batch) else shard
            for doc_id, raw in zip(batch.column(0).to_pylist(), known.texts(batch.column(1)), strict=True):
                raw += end
                start, done = first + len(held) // 4, 0
                while done < len(raw):
                    take = min(len(raw) - done, 4 * chunk - len(held))
                    docs.append((doc_id, nth, start, len(held) // 4, take // 4, done == 0, done + take == len(raw)))
                    held += raw[done : done + take]
                    done += take
                    if len(held) == 4 * chunk:
                        yield out()
                nth += 1
        if held:
            yield out()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, chunk: int = CHUNK, unit: str = "byte") -> None:
    """The ids of docs (doc_id, text), each with end_id after them, to the folder path, in ascending order of doc_id.

    Null ids come first; rows of one id go by a hash of their text, so that no id is one task's. A null or empty text is
    end_id alone. Repeated rows are written each; an empty table is a folder without chunks. Texts are shuffled once, by
    ranges of the order; Spark's writer commits each shard, so a task that is run again leaves nothing twice.
    """
    spark = session(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", text_of().alias("text"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    shards = own.repartitionByRange(*order).sortWithinPartitions(*order, "text").withColumn("shard", F.spark_partition_id())
    part = _PART.replace("doc_id {kind}", f"doc_id: {kind}")
    shards.mapInArrow(_chunks(tokenizer, end_id, chunk, unit), f"{_FORMAT}, docs array<struct<{part}>>").write.option("compression", "none").parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks").select("shard", "chunk", "first", "n_ids", "sizes", F.size(F.filter("docs", lambda d: d["ends"])).alias("n_docs"))
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("_n"))  # a row for each shard
    before = totals.select("shard", F.coalesce(F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    index = chunks.join(F.broadcast(before), "shard").select("shard", "chunk", (F.col("first") + F.col("_before")).alias("first"), "n_ids", "n_docs", "sizes")
    index.write.parquet(f"{path}/index")


def _decoded(row: dict) -> np.ndarray:
    """The ids of a chunk; an error where they aren't what was written."""
    import zstandard

    ids = from_planes([zstandard.decompress(p) for p in row["planes"]], row["n_ids"], row["unit"])
    if zlib.crc32(ids.tobytes()) != row["crc32"]:
        raise ValueError(f"chunk {row['chunk']} of shard {row['shard']} is damaged")
    return ids


def ids_between(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """place, id of the ids at places first to last - 1: only the chunks that the index names are read."""
    wanted = session(spark).read.parquet(f"{path}/index").filter((F.col("first") < last) & (F.col("first") + F.col("n_ids") > first)).select("shard", "chunk", F.col("first").alias("_from"))
    chunks = spark.read.parquet(f"{path}/chunks").drop("docs", "first").join(wanted, ["shard", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = _decoded(row)[max(0, first - row["_from"]) : last - row["_from"]]
                yield pa.RecordBatch.from_arrays([pa.array(max(first, row["_from"]) + np.arange(len(ids))), pa.array(ids.astype(np.int32))], names=["place", "id"])

    return chunks.mapInArrow(run, "place long, id int")


def documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids_le, little-endian) of each document.

    Chunks are decoded once, where they are read, and the parts of documents written. Only documents that lie in several chunks meet again, by the CRCs of their
    parts (and their ids, where those are asked for).
    """
    chunks = session(spark).read.parquet(f"{path}/chunks")
    kind = chunks.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {k: batch.column(k)[i].as_py() for k in ("shard", "chunk", "n_ids", "unit", "crc32", "planes")}
                raw, docs = _decoded(row).tobytes(), batch.column("docs")[i].values
                at, n = (docs.field(k).to_numpy() for k in ("at", "n"))
                parts = [raw[4 * a : 4 * (a + b)] for a, b in zip(at.tolist(), n.tolist(), strict=True)]
                alone = lambda v, t: pa.array([v] * len(parts), t)
                ids = [pa.array(parts, pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays([docs.field("doc_id"), alone(row["shard"], pa.int32()), docs.field("nth"), docs.field("start"), alone(row["chunk"], pa.int32()), docs.field("begins"), docs.field("ends"), docs.field("n").cast(pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()), *ids], names=["doc_id", "shard", "nth", "start", "chunk", "begins", "ends", "n_tokens", "ids_crc32", *["ids_le"] * with_ids])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs, sizes = [], []
            for parts in batch.column("parts").to_pylist():
                crc, n = np.array([0], np.uint32), 0
                for p in parts:
                    crc, n = joined(crc, np.array([p["ids_crc32"]]), np.array([4 * p["n_tokens"]])), n + p["n_tokens"]
                crcs.append(int(crc[0]))
                sizes.append(n)
            ids = [pa.array([b"".join(p["ids_le"] for p in parts) for parts in batch.column("parts").to_pylist()], pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), batch.column("start"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), *ids], names=["doc_id", "shard", "start", "n_tokens", "ids_crc32", *["ids_le"] * with_ids])

    more = ", ids_le binary" * with_ids
    parts = durable(chunks.select("shard", "chunk", "n_ids", "unit", "crc32", "planes", "docs").mapInArrow(run, f"doc_id {kind}, shard int, nth long, start long, chunk int, begins boolean, ends boolean, n_tokens long, ids_crc32 long{more}"))
    columns = ["doc_id", "shard", "start", "n_tokens", "ids_crc32", *["ids_le"] * with_ids]
    several = parts.filter("not (begins and ends)").groupBy("shard", "nth", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("chunk", "n_tokens", "ids_crc32", *["ids_le"] * with_ids))).alias("parts"))
    both = parts.filter("begins and ends").select(*columns).unionByName(several.mapInArrow(composed, f"doc_id {kind}, shard int, start long, n_tokens long, ids_crc32 long{more}"))
    before = spark.read.parquet(f"{path}/index").groupBy("shard").agg(F.min("first").alias("_before"))  # a row for each shard
    return both.join(F.broadcast(before), "shard").withColumn("start", F.col("start") + F.col("_before")).drop("shard", "_before")
