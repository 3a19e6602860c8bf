"""Resampling (L): draws are hashes, so any engine repeats them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators import evaluation as ev
from tidepanel.plans.metrics import LEN, NAIVE, lengths, naive, rho_sql
from tidepanel.plans.registry import query


def drawn(seed: int, size: str, *parts: str) -> str:
    text = " || '-' || ".join((f"'{seed}'", *(f"CAST({p} AS VARCHAR)" for p in parts)))
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) % ({size})"


REPS, BLOCK = 2000, 5
SERIES = f"(SELECT row_number() OVER (ORDER BY date) - 1 AS i, v FROM (SELECT date, avg(predicted - actual) AS v FROM {NAIVE} GROUP BY date))"


@query("l1_date_block_bootstrap", f"WITH s AS (SELECT * FROM {SERIES}), n AS (SELECT count(*) AS n FROM s), d AS (SELECT rep, slot, n, {drawn(7, f'n - {BLOCK} + 1', 'rep', 'slot')} AS start FROM (SELECT unnest(range(0, {REPS})) AS rep), (SELECT n, unnest(range(0, CAST(ceil(n / {BLOCK}.0) AS BIGINT))) AS slot FROM n)), m AS (SELECT rep, avg(v) AS m FROM (SELECT rep, start + k AS i FROM d, (SELECT unnest(range(0, {BLOCK})) AS k) WHERE slot * {BLOCK} + k < n) JOIN s USING (i) GROUP BY rep) SELECT (SELECT avg(v) FROM s) AS mean, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, (1 + sum(CASE WHEN round(m, 10) <= 0 THEN 1 ELSE 0 END)) / ({REPS} + 1.0) AS p FROM m", "valid", doubles="mean low high p", digits=6)
def l1(spark, sf):
    losses = naive(spark, sf).groupBy("date").agg(F.avg(F.col("predicted") - F.col("actual")).alias("v"))
    return ev.block_bootstrap(losses, "v", "date", BLOCK, REPS)


def picked(unit: str, reps: int, seed: int = 7) -> str:
    listed = f"(SELECT {unit}, row_number() OVER (ORDER BY {unit}) - 1 AS u FROM (SELECT DISTINCT {unit} FROM {LEN}))"
    return f"(SELECT rep, l.* FROM (SELECT rep, {drawn(seed, 'n', 'rep', 'slot')} AS u FROM (SELECT unnest(range(0, {reps})) AS rep), (SELECT n, unnest(range(0, n)) AS slot FROM (SELECT count(DISTINCT {unit}) AS n FROM {LEN}))) JOIN {listed} USING (u) JOIN {LEN} l USING ({unit}))"


@query("l2_company_bootstrap_rho", f"SELECT quantile_cont(rho, 0.025) AS low, quantile_cont(rho, 0.975) AS high, count(*) AS reps FROM ({rho_sql(picked('ticker', 500), 'n_chars', 'es', 'rep')}) WHERE rho IS NOT NULL", "docs", doubles="low high", digits=6)
def l2(spark, sf):
    return ev.bootstrap_rho(lengths(spark, sf), "n_chars", "es", "ticker", 500)


def _difference(unit: str, reps: int) -> str:
    p = picked(unit, reps)
    return f"SELECT avg(d) AS mean, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, (1 + sum(CASE WHEN d <= 0 THEN 1 ELSE 0 END)) / (count(*) + 1.0) AS p FROM (SELECT round(a.rho - b.rho, 10) AS d FROM ({rho_sql(p, 'n_chars', 'es', 'rep')}) a JOIN ({rho_sql(p, 'doc_id', 'es', 'rep')}) b USING (rep))"


@query("l3_paired_date_bootstrap", _difference("date", 1000), "docs", doubles="mean low high p", digits=6)
def l3(spark, sf):
    return ev.bootstrap_difference(lengths(spark, sf), "n_chars", "doc_id", "es", "date", 1000)


_PICK = picked("ticker", 2000)


@query("l4_paired_block_bootstrap", f"SELECT avg(d) AS mean, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, (1 + sum(CASE WHEN d <= 0 THEN 1 ELSE 0 END)) / (count(*) + 1.0) AS p FROM (SELECT round(corr(n_chars, es) - corr(doc_id, es), 10) AS d FROM {_PICK} GROUP BY rep)", "docs", doubles="mean low high p", digits=6)
def l4(spark, sf):
    return ev.bootstrap_difference(lengths(spark, sf), "n_chars", "doc_id", "es", "ticker", 2000, "pearson")
