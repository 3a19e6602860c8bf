"""Sums of vectors and of their outer products by key: partial sums in each task, wide matrices in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Side of a block of a matrix, and the bytes of partial sums that a task holds before it sends them on.
BLOCK, HELD = 512, 1 << 29


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of an array column of equal lengths; an error where they aren't."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError(f"vectors of {sizes.min()} and of {sizes.max()} numbers")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)


def whole(df: DataFrame, vec: Column) -> DataFrame:
    """Rows whose vector is there, without a missing number in it."""
    return df.filter(vec.isNotNull() & ~F.exists(vec, lambda x: x.isNull()))


def _own(batch: pa.RecordBatch, n: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """The keys (first n columns) of a batch with the places of their rows."""
    if not n:
        yield (), np.arange(len(batch))
        return
    places: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in range(n)), strict=True)):
        places.setdefault(key, []).append(i)
    for key, at in places.items():
        yield key, np.array(at)


def _typed(columns: list, types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def summed(df: DataFrame, vec: Column, *keys: str) -> DataFrame:
    """keys, n, total: the rows of each key and the sum of their vectors (array<double>). Keys are spread; a task holds partial
    sums of bounded size, and those of one key meet as a sorted stream. Rows with a missing vector or number are left out."""
    names = [*keys, "n", "total"]
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, n long, total array<double>"

    def sent(held: dict, types: list) -> pa.RecordBatch:
        columns = [*zip(*held, strict=True), [n for n, _ in held.values()], [t.tolist() for _, t in held.values()]]
        return _typed(columns, [*types, pa.int64(), pa.list_(pa.float64())], names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, types, size = {}, [], 0
        for b in batches:
            types = b.schema.types[: len(keys)]
            rows = matrix_of(b.column(len(keys)))
            for key, at in _own(b, len(keys)):
                n, total = held.get(key, (0, 0.0))
                held[key] = (n + len(at), total + rows[at].sum(axis=0))
            size = len(held) * rows.shape[1] * 8
            if size > HELD // 8:
                yield sent(held, types)
                held = {}
        if held:
            yield sent(held, types)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, total, types = None, 0, 0.0, []
        for b in batches:
            types = b.schema.types[: len(keys)]
            for *key, m, t in zip(*(b.column(k).to_pylist() for k in range(len(keys) + 2)), strict=True):
                if last is not None and key != last:
                    yield sent({tuple(last): (n, total)}, types)
                    n, total = 0, 0.0
                last, n, total = key, n + m, total + np.array(t)
        if last is not None:
            yield sent({tuple(last): (n, total)}, types)

    parts = whole(df, vec).select(*keys, vec.cast("array<double>").alias("v")).mapInArrow(partial, schema)
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merged, schema)


def products(df: DataFrame, vec: Column, *keys: str, block: int = BLOCK) -> dict[tuple, np.ndarray]:
    """By keys, the sum over rows of a vector's outer product with itself.

    Each task sums up its own rows and sends blocks of the upper half; blocks of one place meet in one task as a stream; the
    driver fetches them one partition after another, so that it holds the matrices and no rows. Rows with a missing vector
    or number are left out; vectors of several lengths under one key are an error. Keys are few: they and the matrices are
    what comes back.
    """
    kinds = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)
    names, schema = [*keys, "i", "j", "cells"], f"{kinds}i int, j int, cells binary"

    def blocks(held: dict, types: list) -> Iterator[pa.RecordBatch]:
        for key, total in held.items():
            for i in range(0, len(total), block):
                for j in range(i, len(total), block):
                    part = np.ascontiguousarray(total[i : i + block, j : j + block])
                    yield _typed([*([k] for k in key), [i], [j], [part.tobytes()]], [*types, pa.int32(), pa.int32(), pa.binary()], names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, types = {}, []
        for b in batches:
            if not len(b):
                continue
            types, rows = b.schema.types[: len(keys)], matrix_of(b.column(len(keys)))
            for key, at in _own(b, len(keys)):
                own = rows[at]
                if key in held and len(held[key]) != own.shape[1]:
                    raise ValueError(f"vectors of {len(held[key])} and of {own.shape[1]} numbers")
                held[key] = held.get(key, 0.0) + own.T @ own
            if sum(t.nbytes for t in held.values()) > HELD:
                yield from blocks(held, types)
                held = {}
        yield from blocks(held, types)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, types = None, 0.0, []
        make = lambda: _typed([*([k] for k in last), [total.tobytes()]], [*types, pa.binary()], names)
        for b in batches:
            types = b.schema.types[: len(keys) + 2]
            for *key, raw in zip(*(b.column(k).to_pylist() for k in range(len(keys) + 3)), strict=True):
                cells = np.frombuffer(raw)
                if last is not None and key != last:
                    yield make()
                    total = 0.0
                elif last is not None and len(cells) != len(total):
                    raise ValueError("vectors of several lengths")
                last, total = key, total + cells
        if last is not None:
            yield make()

    spots = [*keys, "i", "j"]
    parts = whole(df, vec).select(*keys, vec.cast("array<double>").alias("v")).mapInArrow(partial, schema)
    sums = parts.repartition(*spots).sortWithinPartitions(*spots).mapInArrow(merged, schema)
    found: dict[tuple, dict] = {}
    for r in sums.toLocalIterator():
        found.setdefault(tuple(r[k] for k in keys), {})[r["i"], r["j"]] = np.frombuffer(bytes(r["cells"]))
    out = {}
    for key, own in found.items():
        last = max(i for i, _ in own)
        k = last + int(round(len(own[last, last]) ** 0.5))
        out[key] = np.zeros((k, k))
        for (i, j), cells in own.items():
            part = cells.reshape(min(block, k - i), -1)
            out[key][i : i + len(part), j : j + part.shape[1]] = part
            out[key][j : j + part.shape[1], i : i + len(part)] = part.T
    return out
