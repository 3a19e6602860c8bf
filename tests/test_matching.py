"""Matched pairs against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import matching


def nearest(ids, score, key, step, size, flags):
    """high id: (low id, distance), by comparing each high row with each low one."""
    low, high = np.quantile(score, [0.25, 0.75])
    out = {}
    for h in np.flatnonzero(score >= high):
        own = np.flatnonzero((score <= low) & (key == key[h]))
        if len(own):
            d = np.abs(step[h] - step[own]) * (1 / 365) + np.abs(flags[h] - flags[own]).sum(axis=1) / flags.shape[1] + np.abs(size[h] - size[own]) * 0.25
            least = d.min()
            out[int(ids[h])] = (int(ids[own[np.isclose(d, least, rtol=0, atol=1e-12)]].min()), float(least))
    return out


@pytest.mark.parametrize("n,keys,days", [(400, 3, 9), (1500, 1, 1), (6_000, 1, 300)])
def test_matched_pairs(spark, n, keys, days):
    """The last case is one key of many rows."""
    rng = np.random.default_rng(n)
    ids, key, step = rng.permutation(n), rng.integers(0, keys, n), rng.integers(-days, days, n)
    size, flags = np.round(rng.normal(size=n), 2 if n < 5000 else 6), (rng.random((n, 7)) < 0.15).astype(int)
    score = np.round(rng.normal(size=n), 1)
    table = spark.createDataFrame([(int(i), str(k), int(s), float(z), f.tolist(), float(y)) for i, k, s, z, f, y in zip(ids, key, step, size, flags, score, strict=True)], "id long, k string, step int, z double, f array<int>, y double")
    got = matching.matched_pairs(table, "y", ["k"], ("step", 1 / 365), (F.col("z"), 0.25), lambda: [F.get("f", F.lit(i)) for i in range(7)])
    want = nearest(ids, score, key, step, size, flags)
    got = {r.high_id: (r.low_id, r.distance) for r in got.collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def test_matched_pairs_of_nothing(spark):
    table = spark.createDataFrame([(1, "a", 3, 0.0), (2, None, 3, 9.0), (3, "a", None, 9.0)], "id long, k string, step int, y double")
    assert matching.matched_pairs(table, "y", ["k"], ("step", 1.0)).count() == 0
    assert matching.matched_pairs(table.filter("false"), "y", ["k"], ("step", 1.0)).count() == 0


def token_sets(spark, sets):
    rows = spark.createDataFrame([("a" if i % 5 else "b", sorted(s)) for i, s in enumerate(sets)], "ticker string, tokens array<string>")
    return rows.select("ticker", F.xxhash64(F.array_sort("tokens")).alias("same"), "tokens")


@pytest.mark.parametrize("threshold", [0.92, 0.7])
def test_similar_sets_by_all_pairs(spark, threshold):
    """Sets of all sizes with copies that lack, have or change some tokens; the pairs at the threshold itself are found."""
    rng = np.random.default_rng(7)
    sets = [set(), {"w1"}, {f"w{i}" for i in range(23)}, {f"w{i}" for i in range(25)}, {f"w{i}" for i in range(12)}, {f"w{i}" for i in range(13)}]
    for n in [*range(1, 60), 150, 400, 900]:
        own = [f"w{int(i)}" for i in rng.choice(3000, n, replace=False)]
        for changed in {0, 1, int(0.04 * n), int(0.08 * n), int(0.12 * n)}:
            sets += [set(own[changed:]), set(own[changed:]) | {f"new{n}-{i}" for i in range(changed)}, set(own) | {f"more{n}-{i}" for i in range(changed)}]
    rows = token_sets(spark, sets).localCheckpoint()
    held = {(r.ticker, r.same): set(r.tokens) for r in rows.collect()}
    alike = lambda p, q: len(p & q) >= threshold * len(p | q) - 1e-9
    want = {(t, x, y) for (t, x), p in held.items() for (u, y), q in held.items() if t == u and x < y and p and q and alike(p, q)}
    got = [tuple(r) for r in matching.similar_sets(rows, threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_unlike_sets_are_no_candidates(spark):
    """Sets of frequent tokens alone share some of their rarest, but no whole part."""
    rng = np.random.default_rng(3)
    rows = token_sets(spark, [{f"w{int(i)}" for i in rng.choice(600, 200, replace=False)} for _ in range(400)])
    assert matching.candidate_sets(rows, 0.92).count() < 40
