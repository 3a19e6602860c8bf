"""Best-fit packing of token sequences: length patterns fitted to the histogram by non-negative least squares."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import durable, numbered
from tidepanel.llm.pieces import encoder, gathered

#: Rows of one length that are ranked in one task, roughly.
RANKED = 4096


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32 (and ids) of each piece of each row of docs (doc_id, text).

    A document is its token ids and then end_id, cut every capacity ids. row tells repeated rows apart. A null or empty
    text is the piece of end_id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in gathered(batches):
            of, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, raw in enumerate(known.texts(batch.column(1))):
                raw += end
                for k, s in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[s : s + 4 * capacity]
                    of.append(i)
                    piece.append(k)
                    start.append(s // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            at = pa.array(of, pa.int64())
            more = [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), *more], names=["doc_id", "row", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return numbered(docs.select("doc_id", "text"), "row").mapInArrow(run, f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All ways to fill a sequence exactly with one, two or three of the lengths; a row each, 0 where fewer."""
    here = np.zeros(capacity + 1, bool)
    here[lengths] = True
    out = [np.array([[capacity, 0, 0]])] if here[capacity] else []
    a = lengths[(lengths * 2 <= capacity) & here[capacity - lengths]] if len(lengths) else lengths
    out.append(np.stack([a, capacity - a, 0 * a], axis=1))
    for x in lengths[lengths * 3 <= capacity].tolist():
        b = lengths[(lengths >= x) & (lengths * 2 <= capacity - x)]
        b = b[here[capacity - x - b]]
        out.append(np.stack([0 * b + x, b, capacity - x - b], axis=1))
    return np.concatenate(out)


def repeat_counts(shapes: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeats whose lengths come closest to the histogram in least squares: accelerated projected gradient.

    Row 0 of the histogram stands for no document and is left out.
    """
    if not len(shapes):
        return np.zeros(0)
    used = shapes > 0
    flat = np.where(used, shapes, 0).ravel()
    apply = lambda x: np.bincount(flat, np.repeat(x, 3), len(histogram)) * live
    live = np.ones(len(histogram))
    live[0] = 0
    back = lambda r: r[shapes].sum(axis=1)
    v = np.ones(len(shapes))
    for _ in range(30):  # largest eigenvalue: the step
        v = back(apply(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(rounds):
        z = np.maximum(0, y - back(apply(y) - histogram * live) / (1.02 * norm))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = z + (t - 1) / s * (z - x), z, s
    return x


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Groups of equal sequences, (lengths, repeats), that hold the whole histogram (counts by length, 0 to capacity).

    Fitted patterns are rounded down to what the histogram still has; best fit, longest first, packs the residual by
    groups of equal bins, so the work depends on the number of lengths and not of documents.
    """
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    shapes = patterns(np.flatnonzero(left), capacity)
    fitted = repeat_counts(shapes, left.astype(float))
    for i in np.argsort(-fitted, kind="stable").tolist():
        if fitted[i] < 0.5:
            break
        shape = [int(v) for v in shapes[i] if v]
        need = {v: shape.count(v) for v in shape}
        n = min(int(fitted[i] + 0.5), *(int(left[v]) // m for v, m in need.items()))
        if n > 0:
            out.append((tuple(shape), n))
            for v, m in need.items():
                left[v] -= n * m
    bins: dict[int, list[list]] = defaultdict(list)  # by free space: [lengths, count]
    spaces: list[int] = []
    for v in range(capacity, 0, -1):
        n = int(left[v])
        while n:
            k = bisect_left(spaces, v)
            if k < len(spaces):
                free = spaces[k]
                group = bins[free][-1]
                take = min(n, group[1])
                shape = (*group[0], v)
                group[1] -= take
                if not group[1]:
                    bins[free].pop()
                    if not bins[free]:
                        spaces.pop(k)
            else:
                free, shape = capacity, (v,)
                take = max(1, n // (capacity // v)) if capacity // v > 1 else n
            n -= take
            free -= v
            if free:
                if not bins[free]:
                    insort(spaces, free)
                bins[free].append([shape, take])
            else:
                out.append((shape, take))
    return out + [(tuple(shape), n) for groups in bins.values() for shape, n in groups]


def slots(groups: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank of each run of places, the sequence of that rank, and the offset there."""
    by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    first = 0
    for shape, n in groups:
        offset = 0
        for v in shape:
            by[v].append((used[v], first, offset))
            used[v] += n
            offset += v
        first += n
    return {v: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for v, rows in by.items()}


def pack(pieces: DataFrame, capacity: int = 2048, key: tuple[str, ...] = ("row", "piece")) -> DataFrame:
    """pieces (length of 1 to capacity, unique key) with sequence_id and offset: gapless from 0 in each sequence.

    Only the histogram of lengths, capacity rows at most, comes to the driver. Each piece's rank among its length is
    counted in dealt groups of about RANKED rows plus what the groups before hold, so that a length of many pieces is
    nobody's single task; the rank says the place. pieces is read more than once: give a durable table. Pieces of equal
    length are told apart by key; an empty table gives an empty one.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    histogram = np.zeros(capacity + 1, np.int64)
    histogram[list(counts)] = list(counts.values())
    places = slots(plan(histogram, capacity), capacity)
    deals = max(1, -(-int(histogram.sum()) // RANKED))
    dealt = pieces.withColumn("_deal", F.pmod(F.xxhash64(*key), F.lit(deals)))
    sizes = dealt.groupBy("length", "_deal").agg(F.count("*").alias("n"))
    before = sizes.withColumn("_before", F.sum("n").over(Window.partitionBy("length").orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_deal", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_deal").orderBy(*key)) - 1).join(before, ["length", "_deal"])
    ranked = ranked.select(*pieces.columns, (F.col("_rank") + F.col("_before")).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("length", "_rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for v in np.unique(length).tolist():
                own = length == v
                begin, first, at = places[v]
                k = np.searchsorted(begin, rank[own], side="right") - 1
                sequence[own], offset[own] = first[k] + rank[own] - begin[k], at[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Each piece of each row of docs with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone; equal rows are packed each; an empty table gives an empty one.
    """
    pieces = durable(token_pieces(docs, tokenizer, capacity))
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
