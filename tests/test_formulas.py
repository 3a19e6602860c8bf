"""Literal cases and properties of single functions."""

from __future__ import annotations

import datetime as dt
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import estimators as est
from tidepanel.functions import statistics as st
from tidepanel.functions import texts as tx
from tidepanel.functions import vectors as vec
from tidepanel.functions.scalar import at_least, known
from tidepanel.operators import calendar as cal
from tidepanel.operators import audits, chunks, matching, models, panels, ranking
from tidepanel.operators.labels import expansion_of


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_parkinson_is_positive_and_zero_for_a_flat_bar(spark):
    r = one(spark, a=est.parkinson(F.lit(105.0), F.lit(100.0)), b=est.parkinson(F.lit(100.0), F.lit(100.0)), c=est.parkinson(F.lit(1.0), F.lit(0.0)))
    assert r.a > 0 and r.b == 0 and r.c is None


def test_expansion_and_qlike(spark):
    r = one(spark, e=0.5 * expansion_of(F.lit(4.0), F.lit(1.0)) - 0.5 * expansion_of(F.lit(1.44), F.lit(1.0)), z=st.qlike(F.lit(0.3), F.lit(0.3)), p=st.qlike(F.lit(0.002), F.lit(0.001)))
    assert math.isclose(r.e, math.log(2 / 1.2)) and r.z == 0 and r.p > 0


def test_missing_stays_missing(spark):
    r = one(spark, a=at_least(F.lit(None).cast("double"), 1.0), b=known(F.lit(float("nan"))), c=known(F.lit(float("-inf"))), d=at_least(F.lit(0.5), 1.0))
    assert r.a is None and r.b is None and r.c is None and r.d == 1.0


def test_month_and_day_windows(spark):
    day = lambda s: F.lit(s).cast("date")
    r = one(spark, m=cal.month_windows(day("2024-01-15"), day("2024-03-02")), d=cal.day_windows(day("2024-01-01"), day("2024-01-25"), 10))
    d = dt.date
    assert [(x.key, x["first"], x["last"]) for x in r.m] == [("2024-01", d(2024, 1, 15), d(2024, 1, 31)), ("2024-02", d(2024, 2, 1), d(2024, 2, 29)), ("2024-03", d(2024, 3, 1), d(2024, 3, 2))]
    assert [(x["first"].day, x["last"].day) for x in r.d] == [(1, 10), (11, 20), (21, 25)]


def test_macro_names(spark):
    kept = ["Core CPI MoM (Dec)", "Non Farm Payrolls (Dec)", "ISM Services PMI (Jun)", "GDP Growth Rate QoQ Adv (Q1)", "Fed Interest Rate Decision"]
    out = ["Atlanta Fed GDPNow (Q4)", "FOMC Minutes", "CFTC Corn speculative net positions"]
    df = spark.createDataFrame([(x,) for x in kept + out], "e string")
    assert {r.e for r in df.filter(tx.is_macro("e")).collect()} == set(kept)


def test_alternatives_are_the_pattern(spark):
    rng = random.Random(6)
    parts = [p for x in tx.EVENT_PATTERNS.values() for p in re.split(r"[|()?:.]+", x)] + ["stock ", "shares ", " ", "acqui", "52", "week", "-", "regula"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) for _ in range(400)] + ["52-week", "52 week", "shares up", "stock up", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", *tx.event_flags("t")).collect()
    for r in got:
        want = [None if r.t is None else int(re.search(p, r.t.lower()) is not None) for p in tx.EVENT_PATTERNS.values()]
        assert list(r)[1:] == want


def test_compact_text(spark):
    r = one(spark, t=tx.compact([F.lit("  a\t b "), F.lit("a b"), F.lit(None).cast("string"), F.lit(" "), F.lit("c")], 4))
    assert r.t == "a b\n"


def test_token_windows_cover_all(spark):
    for n in (0, 1, 9, 10, 11, 16, 17, 40):
        t = one(spark, w=chunks.token_windows(F.array(*(F.lit(str(i)) for i in range(n))) if n else F.expr("cast(array() as array<string>)"), 10, 4)).w
        assert [x for w in t for x in w.tokens[len(w.tokens) - w.weight if w.start else 0 :]][:n] == [str(i) for i in range(n)]


def test_deciles_follow_equal_cuts(spark):
    for n in (1, 7, 10, 11, 57):
        got = [r.d for r in spark.range(1, n + 1).select(st.rank_decile(F.col("id"), F.lit(n)).alias("d")).orderBy("id").collect()]
        edges = np.quantile(np.arange(1, n + 1), np.linspace(0, 1, 11))
        assert got == [max(1, int(np.searchsorted(edges[1:-1], r - 1e-9, side="left")) + 1) if n > 1 else 1 for r in range(1, n + 1)]


def test_spearman_of_a_constant_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("a", 1.0, 4.0), ("b", 1.0, 1.0), ("b", 2.0, 5.0), ("b", 3.0, 9.0), ("c", 1.0, 1.0)], "k string, x double, y double")
    got = {r.k: r.rho for r in st.spearman(df, "x", "y", "k").collect()}
    assert got == {"a": None, "b": 1.0, "c": None}


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4))
    y = 3 + x @ np.array([1.0, -2.0, 0.5, 0.0]) + rng.normal(size=200)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y, strict=True)], "x array<double>, y double")
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(models.ridge(df, "x", "y", 7.0), np.linalg.solve(xc.T @ xc + 7 * np.eye(4), xc.T @ yc), atol=1e-6)
    n, g, c, _ = models.gram(df, "x", ["y"])
    assert n == 200 and np.allclose(g, xc.T @ xc) and np.allclose(c[:, 0], xc.T @ yc)


def test_axes_recover_a_planted_direction(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(400, 8))
    rows = [(i, "abcd"[i % 4], "train", (v[i] + (np.arange(8) == 3) * 2 * s).tolist(), float(s)) for i, s in enumerate(rng.normal(size=400))]
    df = spark.createDataFrame(rows, "item_id long, ticker string, split string, vec array<double>, y double").cache()
    axes = [models.contrast_axis(df, "vec", "y"), models.logistic_axis(df, "vec", "y"), models.unit_axis(models.ridge(df, "vec", "y", 1.0)), models.oriented(df, "vec", -models.unit_axis(models.ridge(df, "vec", "y", 1.0)), "y")]
    pairs = matching.matched_pairs(df.select(F.col("item_id").alias("id"), "ticker", "y"), "y", ["ticker"], ("id", 1.0))
    axes.append(models.first_direction(chunks.pair_deltas(pairs, df.select("item_id", "vec")), "delta"))
    for w in axes:
        assert st.spearman(models.score(df, "vec", w), "score", "y").first().rho > 0.7


def test_within_fit_is_least_squares_with_levels(spark):
    rng = np.random.default_rng(3)
    x, g = rng.normal(size=(90, 2)), rng.integers(0, 3, 90)
    y = x @ np.array([0.4, -1.0]) + np.array([1.0, 2.0, 5.0])[g] + rng.normal(size=90) * 0.1
    df = spark.createDataFrame([(float(a), float(b), str(k), float(v)) for (a, b), k, v in zip(x, g, y, strict=True)], "a double, b double, ticker string, y double")
    w, levels, mean = models.within_fit(df, ["a", "b"], "y")
    design = np.column_stack([x, *(g == k for k in range(3))])
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    assert np.allclose(w, want[:2]) and np.allclose(sorted(r.level for r in levels.collect()), sorted(want[2:])) and math.isclose(mean, want[2:].mean())


def test_two_way_demeaning_leaves_no_means(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(str(t), d, rng.gauss(t, d + 1)) for t in range(4) for d in range(6)], "ticker string, date int, v double")
    out = panels.two_way_demeaned(df, "v", rounds=4, cut=2).cache()
    for key in ("ticker", "date"):
        assert all(abs(r.m) < 1e-8 for r in out.groupBy(key).agg(F.avg("v").alias("m")).collect())


def test_student_p(spark):
    """Against closed forms: one degree is Cauchy's, two have a root, many are close to normal; and points of the tables."""
    cases = [(t, d) for t in (0.0, 0.3, 1.0, 2.5, 12.0) for d in (1, 2)] + [(1.96, 10**7), (2.228, 10), (2.571, 5), (3.0, 30)]
    df = spark.createDataFrame([(t, d) for t, d in cases], "t double, d long").select("t", "d", st.student_p("t", F.col("d")).alias("p"))
    want = {1: lambda t: 1 - 2 / math.pi * math.atan(t), 2: lambda t: 1 - t / math.sqrt(2 + t * t), 10**7: lambda t: math.erfc(t / math.sqrt(2)), 10: lambda t: 0.05, 5: lambda t: 0.05, 30: lambda t: 0.0054}
    for r in df.collect():
        assert abs(r.p - want[r.d](r.t)) < (1e-6 if r.d <= 2 or r.d > 100 else 1e-4), r
    r = one(spark, a=st.spearman_p(F.lit(1.0), F.lit(9)), b=st.spearman_p(F.lit(0.0), F.lit(9)), c=st.spearman_p(F.lit(0.5), F.lit(2)))
    assert r.a == 0 and abs(r.b - 1) < 1e-9 and r.c is None


def test_ranks_quantiles_and_ids_of_whole_tables(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(20)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, x int, i int").repartition(7)
    values = sorted(x for _, x, _ in rows if x is not None)
    want = {v: 1 + sum(u < v for u in values) + (values.count(v) - 1) / 2 for v in values}
    assert {r.x: r.x_rank for r in ranking.with_average_ranks(df, ["x"]).filter("x is not null").collect()} == want
    shares = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    for r in ranking.quantiles(df, "x", shares, "k").collect():
        assert np.allclose(r.q, np.quantile([x for k, x, _ in rows if x is not None and k == r.k], shares))
    assert np.allclose(ranking.quantiles(df, "x", shares).first().q, np.quantile(values, shares))
    ids = {(r.k, r.x, r.i): r.dense_id for r in ranking.dense_ids(df, ["k", "x", "i"]).collect()}
    order = sorted(ids, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2]))
    assert [ids[r] for r in order] == list(range(500))
    assert ranking.quantiles(df.filter("false"), "x", shares).first().q is None and st.spearman(df.filter("false"), "x", "i").first().n == 0


def test_shards_that_are_missing_or_not_whole_are_named(spark):
    whole = spark.range(40).withColumnRenamed("id", "k")
    shards = whole.select("k", F.pmod("k", F.lit(4)).alias("shard"))
    assert audits.require_covered(whole, shards, "k", 4) is shards
    got = {r.shard: (r.n, r.uncovered, r.missing) for r in audits.shard_report(whole, shards.filter("shard <> 2 and k <> 5"), "k", 4).collect()}
    assert got == {0: (10, 0, False), 1: (9, 1, False), 2: (0, 10, True), 3: (10, 0, False)}
    with pytest.raises(ValueError, match="'shard': 2"):
        audits.require_covered(whole, shards.filter("shard <> 2"), "k", 4)


def test_nearest_dates_are_the_matched_pairs_of_days(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("ab"), dt.date(2024, 1, 1) + dt.timedelta(rng.randrange(40)), rng.randrange(30)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, ticker string, date date, y int")
    by_pairs = matching.matched_pairs(df.withColumn("day", F.unix_date("date")), "y", ["ticker"], ("day", 1.0))
    near = sorted(map(tuple, matching.nearest_dates(df, "y", ["ticker"]).collect()))
    assert near == sorted(map(tuple, by_pairs.collect())) and len(near) > 40


def test_midas_selection_is_the_fit_of_each_candidate(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        x = rng.normal(size=3)
        split = "train" if i % 3 else "val"
        rows.append((f"t{i % 4}", split, *(float(v) if rng.random() > 0.1 else None for v in x), float(np.exp(0.7 * x[1] + 0.2 * rng.normal() + i % 4))))
    df = spark.createDataFrame(rows, "ticker string, split string, a double, b double, c double, y double")
    best, table = models.select_midas(df, ["a", "b", "c"], "y")
    got = {r.candidate: (r.n, r.qlike) for r in table.collect()}
    for c in "abc":
        own = models.panel_forecast(models.complete(df, [c], "y"), [c], "y", ("train",)).filter("split = 'val'")
        n, loss = own.agg(F.count("*"), F.avg(st.qlike("y", "prediction"))).first()
        assert got[c][0] == n and math.isclose(got[c][1], loss, rel_tol=1e-9)
    assert best == "b"


def test_midas_terms_weigh_recent_lags_most(spark):
    w = one(spark, w=panels.beta_weights(30, 4.0)).w
    assert math.isclose(sum(w), 1) and w == sorted(w, reverse=True)


def test_forward_session_of_a_large_key_is_linear(spark):
    """A key of 120,000 rows: a frame that is rebuilt for each row would take hours."""
    events = spark.range(60_000).select(F.lit("a").alias("ticker"), (F.col("id") * 2).alias("date"))
    sessions = spark.range(60_000).select(F.lit("a").alias("ticker"), (F.col("id") * 2 + 1).alias("session"))
    got = cal.forward_session(events, sessions, "ticker")
    assert got.filter(F.col("at.session") != F.col("date") + 1).count() == 0 and got.count() == 60_000


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows, base = [], [rng.sample(words, 30) for _ in range(4)]
    for i in range(120):
        own = list(base[i % 4])
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(30)] = rng.choice(words)
        rows.append((i, "ab"[i % 2], dt.date(2024, 1, 1) + dt.timedelta(rng.randint(0, 20)), " ".join(own) if i % 17 else ""))
    kept: dict[str, list] = {"a": [], "b": []}
    want = {}
    for i, t, d, text in sorted(rows, key=lambda r: (r[2], r[0])):
        s = set(re.findall("[a-z0-9]+", text))
        want[i] = any((d - e).days <= 7 and len(s & o) / max(len(s | o), 1) >= 0.92 for e, o in kept[t])
        if not want[i]:
            kept[t].append((d, s))
    df = spark.createDataFrame(rows, "doc_id long, ticker string, date date, text string")
    assert {r.doc_id: r.duplicate for r in matching.near_duplicates(df).collect()} == want and any(want.values())


def test_mean_vector_and_softmax(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 1.0), ("a", [3.0, 6.0], 3.0)], "k string, v array<double>, w double")
    assert vec.mean_vector(df, "v", "k", weight="w").first()["mean"] == [2.5, 5.0]
    assert math.isclose(one(spark, e=vec.softmax_expectation(F.array(F.lit(0.0), F.lit(0.0)), [1.0, 9.0])).e, 5.0)


def test_forward_session_and_short_tail(spark):
    sessions = spark.createDataFrame([("a", dt.date(2024, 1, d), float(d)) for d in (2, 3, 5)], "k string, session date, x double")
    events = spark.createDataFrame([(1, "a", dt.date(2024, 1, 1)), (2, "a", dt.date(2024, 1, 4)), (3, "a", dt.date(2024, 1, 6)), (4, "z", dt.date(2024, 1, 1)), (5, None, None)], "id long, k string, date date")
    got = {r.id: r["at"] and r["at"].session.day for r in cal.forward_session(events.filter("k is not null"), sessions, "k").collect()}
    assert got == {1: 2, 2: 5, 3: None, 4: None}
