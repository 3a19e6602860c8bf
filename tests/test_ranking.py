"""Ranks by ranges and weighted replicates against plain ones."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions.statistics import draw, spearman
from tidepanel.operators import evaluation as ev
from tidepanel.operators.ranking import cumulated, numbered, with_average_ranks
from tidepanel.operators.replicates import replicate_rhos, replicate_sums


@pytest.fixture(scope="module")
def frame():
    """A key that holds nearly all rows, a key of one row, null keys and values, and many ties."""
    rng = random.Random(2)
    return pd.DataFrame([(i, rng.choice(["big"] * 9 + ["small", None]) if i else "one", None if rng.random() < 0.05 else float(rng.randrange(60)), None if rng.random() < 0.05 else rng.gauss(0, 1)) for i in range(900)], columns=["id", "k", "x", "y"])


@pytest.fixture(scope="module")
def table(spark, frame):
    return spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False)], "id long, k string, x double, y double")


def test_numbers_within_a_key_of_many_ranges(spark, frame, table):
    got = numbered(table, ["x", "id"], "k").toPandas()
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and len(got) == len(frame)
    for _, own in frame.fillna({"k": "?"}).groupby("k"):
        order = own.sort_values(["x", "id"], na_position="first")["id"].tolist()
        mine = got[got["id"].isin(order)].sort_values("_at")
        assert mine["id"].tolist() == order and mine["_at"].tolist() == list(range(1, len(order) + 1)) and set(mine["_of"]) == {len(order)}


def test_average_ranks_within_keys(frame, table):
    got = with_average_ranks(table, ["x", "y"], "k").toPandas().sort_values("id")
    for c in "xy":
        want = frame.fillna({"k": "?"}).groupby("k")[c].rank(method="average")
        assert np.allclose(got[f"{c}_rank"], want.to_numpy(), equal_nan=True)
    counted = cumulated(table, "x", "k").toPandas()
    assert (counted.groupby("k", dropna=False)["n"].sum() == counted.groupby("k", dropna=False)["all"].max()).all()


def test_spearman_within_keys(frame, table):
    got = {r.k: (r.n, r.rho) for r in spearman(table, "x", "y", "k").collect()}
    for k, own in frame.dropna(subset=["x", "y"]).fillna({"k": "?"}).groupby("k"):
        n, rho = got[None if k == "?" else k]
        assert n == len(own) and (rho is None if n < 3 else abs(rho - own["x"].rank().corr(own["y"].rank())) < 1e-12)


def test_ranking_report_on_an_empty_table(table):
    assert ev.ranking(table.filter("false"), "x", "y", "id", "k").count() == 0


@pytest.mark.parametrize("reps,matrix", [(40, 1 << 20), (12, 1 << 20), (9, 75)])
def test_replicates_are_resamples(spark, frame, table, reps, matrix):
    """More replicates than units, fewer, and blocks of one or three replicates."""
    units = frame.assign(u=[None if i % 50 == 7 else i % 25 for i in frame["id"]])
    df = table.withColumn("u", F.when(F.col("id") % 50 == 7, None).otherwise(F.col("id") % 25))
    got = {r.rep: r.rho for r in replicate_rhos(df, "x", "y", "u", reps, matrix=matrix).collect()}
    listed = sorted(units["u"].dropna().unique())
    slots = spark.range(reps).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(len(listed) - 1))).alias("slot"))
    drawn = slots.select("rep", draw(7, "rep", "slot", size=F.lit(len(listed))).alias("i")).toPandas()
    assert len(got) == reps
    for rep, picks in drawn.groupby("rep"):
        rows = pd.concat([units[units["u"] == listed[i]] for i in picks["i"]]).dropna(subset=["x", "y"])
        assert abs(got[rep] - rows["x"].rank().corr(rows["y"].rank())) < 1e-12


def test_replicates_of_little(spark, table):
    few = spark.createDataFrame([("a", 1.0, 2.0), ("b", 2.0, 1.0)], "u string, x double, y double")
    assert {r.rho for r in replicate_rhos(few, "x", "y", "u", 5).collect()} == {None}
    flat = spark.createDataFrame([("a", 1.0, 2.0)] * 4 + [("b", 1.0, 1.0)] * 4, "u string, x double, y double")
    assert {r.rho for r in replicate_rhos(flat, "x", "y", "u", 5).collect()} == {None}
    assert replicate_rhos(flat.filter("false"), "x", "y", "u", 5).count() == 0


@pytest.mark.parametrize("matrix", [1 << 20, 40])
def test_replicate_sums_are_sums_of_resamples(spark, matrix):
    """All replicates in one block, and a few in each."""
    rng, reps = random.Random(8), 11
    rows = [(f"u{rng.randrange(9)}", rng.random(), float(rng.randrange(5))) for _ in range(70)] + [(None, 5.0, 5.0)]
    got = {r.rep: (r.a, r.b) for r in replicate_sums(spark.createDataFrame(rows, "u string, a double, b double"), ["a", "b"], "u", reps, matrix=matrix).collect()}
    units = sorted({u for u, _, _ in rows if u})
    slots = spark.range(reps).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(len(units) - 1))).alias("slot"))
    want = {k: [0.0, 0.0] for k in range(reps)}
    for r in slots.select("rep", draw(7, "rep", "slot", size=F.lit(len(units))).alias("i")).collect():
        for u, a, b in rows:
            if u == units[r.i]:
                want[r.rep][0] += a
                want[r.rep][1] += b
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
