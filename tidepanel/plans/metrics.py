"""Metrics (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions.statistics import FAR, NODES, pearson, qlike, spearman, spearman_p
from tidepanel.operators import evaluation as ev
from tidepanel.operators import models, panels
from tidepanel.plans.panel import PK, demeaned_sql, mean_if
from tidepanel.plans.registry import query
from tidepanel.sources.tables import bars, bars_xs, docs, read, valid_bars
from tidepanel.functions import estimators as est
from tidepanel.functions.windows import rolling_mean, shifted


def naive(spark, sf):
    """Forecast of the next session's variance by the last five's mean."""
    pk = valid_bars(bars(spark, sf)).select("ticker", "date", est.parkinson().alias("pk"))
    return pk.select("ticker", "date", shifted("pk", -1).alias("actual"), rolling_mean("pk", 5).alias("predicted")).filter("actual is not null and predicted is not null")


NAIVE = f"(SELECT * FROM (SELECT ticker, date, lead(pk) OVER (PARTITION BY ticker ORDER BY date) AS actual, {mean_if('pk', -4, 0, 5)} AS predicted FROM (SELECT ticker, date, {PK} AS pk FROM valid)) WHERE actual IS NOT NULL AND predicted IS NOT NULL)"
Q = "greatest(actual, 1e-10) / greatest(predicted, 1e-10)"


@query("k1_qlike", f"SELECT ticker, date, {Q} - ln({Q}) - 1 AS qlike FROM {NAIVE}", "valid", doubles="qlike", digits=5)
def k1(spark, sf):
    return naive(spark, sf).select("ticker", "date", qlike("actual", "predicted").alias("qlike"))


LA, LP = "ln(greatest(actual, 1e-10))", "ln(greatest(predicted, 1e-10))"


def rho_sql(table: str, x: str, y: str, *keys: str) -> str:
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    also = f"PARTITION BY {', '.join((*keys, '{}'))}"
    rank = lambda v: f"rank() OVER ({part} ORDER BY {v}) + (count(*) OVER ({also.format(v)}) - 1) / 2.0"
    k = ", ".join(keys) + ", " if keys else ""
    return f"SELECT {k}count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END AS rho FROM (SELECT {k}{rank(x)} AS rx, {rank(y)} AS ry FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL){' GROUP BY ' + ', '.join(keys) if keys else ''}"


def student_sql(t: str, degrees: str) -> str:
    """student_p() in SQL: the same rule at the same places."""
    root = f"sqrt({degrees}::DOUBLE)"
    end = f"least({root} * pi() / 2, {FAR})"
    mass = lambda low: f"({end} - {low}) / {NODES} / 3 * list_sum(list_transform(range(0, {NODES + 1}), lambda i: (CASE WHEN i IN (0, {NODES}) THEN 1.0::DOUBLE WHEN i % 2 = 1 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END) * exp(({degrees} - 1) * ln(greatest(cos(({low} + i * ({end} - {low}) / {NODES}) / {root}), 1e-300)))))"
    return f"({mass(f'least(atan(abs({t}) / {root}) * {root}, {end})')}) / ({mass('0.0::DOUBLE')})"


@query("k2_prediction_metrics", f"SELECT m.*, s.rho AS spearman FROM (SELECT ticker, count(*) AS n, avg({LA} * {LA} - 2 * {LA} * {LP} + {LP} * {LP}) AS log_mse, 1 - sum(pow({LA} - {LP}, 2)) / (count(*) * var_pop({LA})) AS log_r2, avg(pow(actual - predicted, 2)) AS mse, 1 - sum(pow(actual - predicted, 2)) / (count(*) * var_pop(actual)) AS r2, sqrt(avg(pow(actual - predicted, 2))) AS rmse, corr(actual, predicted) AS corr FROM {NAIVE} GROUP BY ticker) m JOIN ({rho_sql(NAIVE, 'actual', 'predicted', 'ticker')}) s USING (ticker)", "valid", doubles="log_mse log_r2 mse r2 rmse corr spearman", digits=5)
def k2(spark, sf):
    rows = naive(spark, sf)
    rho = spearman(rows, "actual", "predicted", "ticker").select("ticker", F.col("rho").alias("spearman"))
    return rows.groupBy("ticker").agg(*models.fit_metrics("actual", "predicted")).drop("qlike").join(rho, "ticker")


LEN = "(SELECT doc_id, ticker, lang, date, n_chars, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS es FROM docs)"


def lengths(spark, sf):
    return docs(spark, sf).select("doc_id", "ticker", "lang", "date", "n_chars", (F.length("text") - F.length(F.replace("text", F.lit("e")))).cast("double").alias("es"))


@query("k3_spearman", f"SELECT ticker, n, rho, CASE WHEN n < 3 THEN NULL WHEN 1 - rho * rho <= 1e-15 THEN 0 ELSE {student_sql('rho * sqrt((n - 2) / greatest(1 - rho * rho, 1e-15))', '(n - 2)')} END AS p FROM ({rho_sql(LEN, 'n_chars', 'es', 'ticker')})", "docs", doubles="rho p")
def k3(spark, sf):
    return spearman(lengths(spark, sf), "n_chars", "es", "ticker").withColumn("p", spearman_p("rho", "n"))


@query("k4_pearson", f"SELECT ticker, corr(n_chars, es) AS r FROM {LEN} GROUP BY ticker", "docs", doubles="r")
def k4(spark, sf):
    return lengths(spark, sf).groupBy("ticker").agg(pearson("n_chars", "es").alias("r"))


_DEM = f"(SELECT round(n_chars - avg(n_chars) OVER (PARTITION BY ticker), 10) AS x, round(es - avg(es) OVER (PARTITION BY ticker), 10) AS y FROM {LEN})"


@query("k5_within_ticker_rho_demeaned", f"SELECT n, rho, (SELECT corr(x, y) FROM {_DEM}) AS r FROM ({rho_sql(_DEM, 'x', 'y')})", "docs", doubles="rho r", digits=6)
def k5(spark, sf):
    return ev.within_rho_demeaned(lengths(spark, sf), "n_chars", "es")


@query("k6_within_ticker_rho_averaged", f"SELECT count(*) AS groups, avg(rho) AS rho FROM ({rho_sql(LEN, 'n_chars', 'es', 'ticker')}) WHERE n >= 5 AND rho IS NOT NULL", "docs", doubles="rho")
def k6(spark, sf):
    return ev.within_rho_averaged(lengths(spark, sf), "n_chars", "es")


_FLAT = f"(SELECT round(x, 9) AS x, round(y, 9) AS y FROM {demeaned_sql('(SELECT ticker, date, close AS x, volume AS y FROM bars_xs)', ('x', 'y'))})"


@query("k7_two_way_fe_rho", rho_sql(_FLAT, "x", "y"), "bars_xs", doubles="rho", digits=6)
def k7(spark, sf):
    """Spearman of close and volume after two-way demeaning, which leaves noise beyond nine digits."""
    rows = bars_xs(spark, sf).select("ticker", "date", F.col("close").alias("x"), F.col("volume").alias("y"))
    flat = panels.two_way_demeaned(panels.two_way_demeaned(rows, "x"), "y")
    return spearman(flat.select(F.round("x", 9).alias("x"), F.round("y", 9).alias("y")), "x", "y")


_Z = "(SELECT ticker, date, (close - mx) / sx AS z, (volume - my) / sy AS w, cxy / sx / sy AS beta, n FROM bars_xs, (SELECT avg(close) AS mx, avg(volume) AS my, stddev_pop(close) AS sx, stddev_pop(volume) AS sy, covar_pop(close, volume) AS cxy, count(*) AS n FROM bars_xs))"


def _meat(*keys: str) -> str:
    return f"(SELECT count(*) / (count(*) - 1.0) * (first(n) - 1.0) / (first(n) - 2.0) * sum(s * s) AS m, count(*) AS g, first(n) AS n, first(beta) AS beta FROM (SELECT sum(z * (w - beta * z)) AS s, first(n) AS n, first(beta) AS beta FROM {_Z} GROUP BY {', '.join(keys)}))"


_K8 = f"SELECT a.beta, sqrt(greatest(a.m + b.m - c.m, 0)) / a.n AS se, a.beta / greatest(sqrt(greatest(a.m + b.m - c.m, 0)) / a.n, 1e-12) AS t, a.g AS groups_a, b.g AS groups_b FROM {_meat('ticker')} a, {_meat('date')} b, {_meat('ticker', 'date')} c"


@query("k8_two_way_cluster_beta", f"SELECT *, {student_sql('t', 'greatest(least(groups_a, groups_b) - 1, 1)')} AS p FROM ({_K8})", "bars_xs", doubles="beta se t p", digits=6)
def k8(spark, sf):
    return ev.clustered_slope(bars_xs(spark, sf), "volume", "close")


LOGS = f"(SELECT *, ln(es + 1) AS le FROM {LEN})"
_TEN = "CAST(CASE WHEN n = 1 THEN 1 ELSE greatest(1, floor((10 * ({} - 1) + n - 2) / (n - 1))) END AS BIGINT)"
_PLACED = f"(SELECT lang, le, {_TEN.format('r')} AS decile, {_TEN.format('q')} AS own FROM (SELECT lang, le, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS r, row_number() OVER (PARTITION BY lang ORDER BY le, doc_id) AS q, count(*) OVER (PARTITION BY lang) AS n FROM {LOGS}))"
_DEC = f"(SELECT lang, decile, count(*) AS n, avg(le) AS mean_label FROM {_PLACED} GROUP BY 1, 2)"


@query("k9_ranking_metrics", f"SELECT s.lang, spread, exp(spread) AS multiple, rises, rho AS decile_rho, precision FROM (SELECT lang, arg_max(mean_label, decile) - arg_min(mean_label, decile) AS spread, CAST(sum(CASE WHEN mean_label > p THEN 1 ELSE 0 END) AS BIGINT) AS rises FROM (SELECT *, lag(mean_label) OVER (PARTITION BY lang ORDER BY decile) AS p FROM {_DEC}) GROUP BY lang) s JOIN ({rho_sql(_DEC, 'decile', 'mean_label', 'lang')}) USING (lang) LEFT JOIN (SELECT lang, avg(CASE WHEN own = 10 THEN 1.0::DOUBLE ELSE 0 END) AS precision FROM {_PLACED} WHERE decile = 10 GROUP BY lang) USING (lang)", "docs", doubles="spread multiple decile_rho precision", digits=6)
def k9(spark, sf):
    return ev.ranking(lengths(spark, sf).withColumn("le", F.ln(F.col("es") + 1)), "n_chars", "le", "doc_id", "lang")


@query("k10_improvement_pct", "SELECT o_custkey, 100 * (max(o_totalprice) - avg(o_totalprice)) / max(o_totalprice) AS gain FROM orders GROUP BY 1", doubles="gain", digits=6)
def k10(spark, sf):
    base, ours = F.max("o_totalprice"), F.avg("o_totalprice")
    return read(spark, sf, "orders").groupBy("o_custkey").agg((100 * F.try_divide(base - ours, base)).alias("gain"))


_IN = f"(SELECT lang, round(n_chars - avg(n_chars) OVER (PARTITION BY lang, ticker), 10) AS x, round(es - avg(es) OVER (PARTITION BY lang, ticker), 10) AS y FROM {LEN})"


@query("k11_evaluate_axis", f"SELECT lang, a.rho, b.rho AS within_rho, avg(a.rho) OVER () AS macro, avg(b.rho) OVER () AS macro_within FROM ({rho_sql(LEN, 'n_chars', 'es', 'lang')}) a JOIN ({rho_sql(_IN, 'x', 'y', 'lang')}) b USING (lang)", "docs", doubles="rho within_rho macro macro_within")
def k11(spark, sf):
    return ev.evaluate_axis(lengths(spark, sf), "n_chars", "es", "lang")
