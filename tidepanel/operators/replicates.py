"""Rank correlations over bootstrap replicates without copies of rows: weights of units, cumulated by value for all replicates at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.statistics import draw
from tidepanel.sources.sinks import checkpointed

#: Numbers in the matrix of units by replicates that goes to all tasks: replicates are taken in blocks so that it holds no
#: more. Numbers of a block of ranks in a task.
MATRIX, HELD = 1 << 23, 1 << 21


def _units(df: DataFrame, unit: str) -> DataFrame:
    """unit and its number from 0."""
    return checkpointed(df.select(unit).distinct().select(unit, (F.row_number().over(Window.orderBy(unit)) - 1).cast("long").alias("_u")))


def _draws(df: DataFrame, units: int, first: int, last: int, seed: int) -> np.ndarray:
    """Times each unit is drawn (rows) in replicates first to last - 1 (columns): as many draws as units in each."""
    slots = df.sparkSession.range(first, last).withColumnRenamed("id", "rep").select("rep", F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("slot"))
    counts = slots.groupBy("rep", draw(seed, "rep", "slot", size=F.lit(units)).alias("u")).agg(F.count("*").alias("n")).toArrow()
    out = np.zeros((units, last - first), np.int32)
    out[counts["u"].to_numpy(), counts["rep"].to_numpy() - first] = counts["n"].to_numpy()
    return out


def _places(values: DataFrame, basis) -> DataFrame:
    """v and q: what lies below each value and half of what is at it, in the columns of basis (of units), as bytes.

    values: v, u, c (rows of a unit at a value). Ranges of values are cumulated apart and set off by what those before hold:
    a row of basis' width for each range comes to the driver.
    """
    ranged = checkpointed(values.repartitionByRange("v").sortWithinPartitions("v").withColumn("part", F.spark_partition_id()))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, part, total = basis.value, None, 0
        for b in batches:
            if len(b):
                part, total = b.column("part")[0].as_py(), total + b.column("c").to_numpy() @ of[b.column("u").to_numpy()]
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.astype(float).tobytes()], pa.binary())], names=["part", "total"])

    sums = sorted((r["part"], np.frombuffer(bytes(r["total"]))) for r in ranged.mapInArrow(totals, "part int, total binary").collect())
    before, below = {}, 0.0
    for part, total in sums:
        before[part] = below
        below = below + total
    shared = values.sparkSession.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, now, below, at, v_out, q_out = basis.value, None, None, None, [], []
        step = max(1, HELD // of.shape[1])

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(v_out, pa.float64()), pa.array(q_out, pa.binary())], names=["v", "q"])
            v_out.clear()
            q_out.clear()
            return made

        for b in batches:
            for v, u, c, part in zip(*(b.column(k).to_pylist() for k in ("v", "u", "c", "part")), strict=True):
                if below is None:
                    below, at, now = np.zeros(of.shape[1]) + shared.value[part], np.zeros(of.shape[1]), v
                if v != now:
                    v_out.append(now)
                    q_out.append((below + at / 2).tobytes())
                    below, at, now = below + at, np.zeros(of.shape[1]), v
                    if len(v_out) >= step:
                        yield out()
                at += c * of[u]
        if below is not None:
            v_out.append(now)
            q_out.append((below + at / 2).tobytes())
            yield out()

    return ranged.mapInArrow(run, "v double, q binary")


def replicate_rhos(df: DataFrame, x: str, y: str, unit: str, reps: int, seed: int = 7, matrix: int = MATRIX) -> DataFrame:
    """rep, rho: the Spearman of x and y over resamples of units (as many as there are, with replacement), without copies.

    A unit drawn k times weighs k. Values carry what lies below them, by unit where there are no more units than replicates
    and else by replicate; rows meet the two of theirs, and the moments of all replicates are summed where they meet. rho is
    null under three rows or for a constant; rows with a missing value, and those of a null unit, count for nothing.
    """
    spark = df.sparkSession
    listed = _units(df.filter(F.col(unit).isNotNull()), unit)
    n_units = listed.count()
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(unit, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = checkpointed(known.join(listed, unit).groupBy(F.col("_u").alias("u"), "x", "y").agg(F.count("*").alias("c")))
    out, block = None, max(1, min(reps, matrix // max(1, n_units)))
    for first in range(0, reps if n_units else 0, block):
        last = min(reps, first + block)
        drawn = _draws(df, n_units, first, last, seed)
        by_unit = n_units <= last - first
        weights = spark.sparkContext.broadcast(drawn)
        basis = spark.sparkContext.broadcast(np.eye(n_units) if by_unit else drawn.astype(float))
        sizes = rows.groupBy("u").agg(F.sum("c").alias("c")).toArrow()  # a row for each unit, as many as the matrix has
        n = sizes["c"].to_numpy() @ drawn[sizes["u"].to_numpy()]
        side = lambda v: _places(rows.groupBy(F.col(v).alias("v"), "u").agg(F.sum("c").alias("c")), basis).select(F.col("v").alias(v), F.col("q").alias(f"q{v}"))  # noqa: B023, E731
        both = rows.join(side("x"), "x").join(side("y"), "y").select("u", "c", "qx", "qy")

        def run(batches: Iterator[pa.RecordBatch], n=n, first=first, weights=weights, by_unit=by_unit) -> Iterator[pa.RecordBatch]:
            w, total = weights.value, np.zeros((3, weights.value.shape[1]))
            step = max(1, HELD // w.shape[1])
            for b in batches:
                for s in range(0, len(b), step):
                    part = b.slice(s, step)
                    rank = [np.array([np.frombuffer(q) for q in part.column(k).to_pylist()]) for k in (2, 3)]
                    p, q = ((r @ w if by_unit else r) - n / 2 for r in rank)  # about the mean rank
                    own = w[part.column(0).to_numpy()] * part.column(1).to_numpy()[:, None]
                    total += np.stack([(own * p * q).sum(axis=0), (own * p * p).sum(axis=0), (own * q * q).sum(axis=0)])
            yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(w.shape[1])), *map(pa.array, total)], names=["rep", "xy", "xx", "yy"])

        sums = both.mapInArrow(run, "rep long, xy double, xx double, yy double").groupBy("rep").agg(*(F.sum(k).alias(k) for k in ("xy", "xx", "yy")))
        sizes_of = spark.createDataFrame([(first + k, int(v)) for k, v in enumerate(n)], "rep long, n long")
        one = sums.join(sizes_of, "rep").select("rep", F.when(F.col("n") >= 3, F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))).alias("rho"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "rep long, rho double")


def replicate_sums(df: DataFrame, columns: list[str], unit: str, reps: int, seed: int = 7, matrix: int = MATRIX) -> DataFrame:
    """rep and the sums of columns (doubles, none missing) over resamples of units: each task adds its units' sums times their draws."""
    spark = df.sparkSession
    listed = _units(df.filter(F.col(unit).isNotNull()), unit)
    n_units = listed.count()
    rows = checkpointed(df.join(listed, unit).select("_u", *columns))
    out, block = None, max(1, min(reps, matrix // max(1, n_units)))
    for first in range(0, reps if n_units else 0, block):
        last = min(reps, first + block)
        weights = spark.sparkContext.broadcast(_draws(df, n_units, first, last, seed))

        def run(batches: Iterator[pa.RecordBatch], first=first, weights=weights) -> Iterator[pa.RecordBatch]:
            w = weights.value
            total = np.zeros((w.shape[1], len(columns)))
            step = max(1, HELD // w.shape[1])
            for b in batches:
                for s in range(0, len(b), step):
                    part = b.slice(s, step)
                    total += w[part.column(0).to_numpy()].T @ np.stack([part.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(columns))], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(first + np.arange(len(total))), *(pa.array(c) for c in total.T)], names=["rep", *columns])

        one = rows.mapInArrow(run, "rep long, " + ", ".join(f"{c} double" for c in columns)).groupBy("rep").agg(*(F.sum(c).alias(c) for c in columns))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "rep long, " + ", ".join(f"{c} double" for c in columns))
