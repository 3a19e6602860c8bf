"""Variance estimators (D) and panel windows (E) over bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions import estimators as est
from tidepanel.functions.scalar import log_of, ratio
from tidepanel.functions.statistics import rank_decile
from tidepanel.functions.windows import demeaned, forward_mean, future_mean, rolling_mean, shifted
from tidepanel.operators import panels
from tidepanel.operators.ranking import numbered, quantiles
from tidepanel.plans.registry import query
from tidepanel.sources.tables import bars, bars_long, bars_xs, docs, valid_bars, with_split

PK = "pow(ln(high / low), 2) / (4 * ln(2))"
GK = "0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2)"
RS = "ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)"
W = "WINDOW w AS (PARTITION BY ticker ORDER BY date)"
R = "close / lag(close) OVER w - 1"


def _valid(spark, sf):
    return valid_bars(bars(spark, sf))


def _pk(spark, sf):
    return _valid(spark, sf).select("ticker", "date", est.parkinson().alias("pk"))


def frame(lo: int, hi: int) -> str:
    at = lambda k: f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING" if k else "CURRENT ROW"
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {at(lo)} AND {at(hi)})"


def mean_if(x: str, lo: int, hi: int, least: int) -> str:
    return f"CASE WHEN count({x}) {frame(lo, hi)} >= {least} THEN avg({x}) {frame(lo, hi)} END"


@query("d1_close_variance", f"SELECT ticker, date, pow({R}, 2) AS simple, pow(ln(close / lag(close) OVER w), 2) AS logged FROM valid {W}", "valid", doubles="simple logged")
def d1(spark, sf):
    return _valid(spark, sf).select("ticker", "date", panels.close_variance("simple").alias("simple"), panels.close_variance("log").alias("logged"))


@query("d2_parkinson", f"SELECT ticker, date, {PK} AS any_range, CASE WHEN high > low AND {PK} > 1e-10 THEN {PK} END AS strict, CASE WHEN high >= low THEN {PK} END AS ordered FROM valid", "valid", doubles="any_range strict ordered")
def d2(spark, sf):
    return _valid(spark, sf).select("ticker", "date", est.parkinson().alias("any_range"), est.parkinson(policy="strict").alias("strict"), est.parkinson(policy="ordered").alias("ordered"))


@query("d3_garman_klass", f"SELECT ticker, date, CASE WHEN {GK} > 1e-10 THEN {GK} END AS masked, greatest({GK}, 0) AS clipped FROM valid", "valid", doubles="masked clipped")
def d3(spark, sf):
    return _valid(spark, sf).select("ticker", "date", est.garman_klass("mask").alias("masked"), est.garman_klass("clip").alias("clipped"))


@query("d4_rogers_satchell", f"SELECT ticker, date, CASE WHEN {RS} > 1e-10 THEN {RS} END AS masked, greatest({RS}, 0) AS clipped FROM valid", "valid", doubles="masked clipped")
def d4(spark, sf):
    return _valid(spark, sf).select("ticker", "date", est.rogers_satchell("mask").alias("masked"), est.rogers_satchell("clip").alias("clipped"))


@query("d5_ohlc_mean", f"SELECT ticker, date, ({PK} + greatest({GK}, 0) + greatest({RS}, 0)) / 3 AS ohlc_mean FROM valid", "valid", doubles="ohlc_mean")
def d5(spark, sf):
    return _valid(spark, sf).select("ticker", "date", est.ohlc_mean().alias("ohlc_mean"))


@query("e1_returns", f"SELECT ticker, date, {R} AS simple, ln(close / lag(close) OVER w) AS logged FROM valid {W}", "valid", doubles="simple logged")
def e1(spark, sf):
    return _valid(spark, sf).select("ticker", "date", (ratio("close", shifted("close")) - 1).alias("simple"), log_of(ratio("close", shifted("close"))).alias("logged"))


@query("e2_rolling_mean", f"SELECT ticker, date, {mean_if('pk', -4, 0, 3)} AS week, {mean_if('pk', -21, 0, 10)} AS month FROM (SELECT ticker, date, {PK} AS pk FROM valid)", "valid", doubles="week month")
def e2(spark, sf):
    return _pk(spark, sf).select("ticker", "date", rolling_mean("pk", 5, 3).alias("week"), rolling_mean("pk", 22, 10).alias("month"))


@query("e3_forward_mean", f"SELECT ticker, date, {mean_if('pk', 1, 5, 5)} AS from_next, {mean_if('pk', 0, 4, 5)} AS from_now FROM (SELECT ticker, date, {PK} AS pk FROM valid)", "valid", doubles="from_next from_now")
def e3(spark, sf):
    return _pk(spark, sf).select("ticker", "date", forward_mean("pk", 1, 5).alias("from_next"), forward_mean("pk", 0, 5).alias("from_now"))


@query("e4_future_mean", f"SELECT ticker, date, avg(pk) {frame(1, 5)} AS h5 FROM (SELECT ticker, date, {PK} AS pk FROM valid)", "valid", doubles="h5")
def e4(spark, sf):
    return _pk(spark, sf).select("ticker", "date", future_mean("pk", 5).alias("h5"))


def har_sql(skip: int, weekly: int, monthly: int, start: int, source: str = f"SELECT ticker, date, {PK} AS pk FROM valid") -> str:
    floor = lambda x: f"CASE WHEN ({x}) IS NOT NULL THEN ln(greatest(({x}), 1e-10)) END"
    return f"SELECT ticker, date, {floor(f'avg(pk) {frame(-skip, -skip)}')} AS har_d, {floor(mean_if('pk', -4 - skip, -skip, weekly))} AS har_w, {floor(mean_if('pk', -21 - skip, -skip, monthly))} AS har_m, {mean_if('pk', start, start, 1)} AS target_h1, {mean_if('pk', start, start + 4, 5)} AS target_h5 FROM ({source})"


@query("e5_har_end_of_day", har_sql(0, 3, 10, 1), "valid", doubles="har_d har_w har_m target_h1 target_h5")
def e5a(spark, sf):
    return panels.har_features(_pk(spark, sf), "pk").drop("pk")


@query("e5_har_session_open", har_sql(1, 5, 22, 0), "valid", doubles="har_d har_w har_m target_h1 target_h5")
def e5b(spark, sf):
    return panels.har_features(_pk(spark, sf), "pk", "session_open").drop("pk")


@query("e6_market_controls", f"SELECT ticker, date, abs(r) AS x_abs_return, CASE WHEN r IS NOT NULL THEN least(r, 0) END AS x_negative_return, m AS x_momentum20, ln(greatest(volume, 1)) AS x_log_volume FROM (SELECT ticker, date, volume, {R} AS r, close / lag(close, 20) OVER w - 1 AS m FROM valid {W})", "valid", doubles="x_abs_return x_negative_return x_momentum20 x_log_volume")
def e6(spark, sf):
    return panels.market_controls(_valid(spark, sf)).select("ticker", "date", "x_abs_return", "x_negative_return", "x_momentum20", "x_log_volume")


LAGS = "list_transform(range(0, 80), lambda j: CASE WHEN len(l) > j THEN l[len(l) - j] END)"
LAG_ROWS = f"(SELECT ticker, date, {LAGS} AS lags FROM (SELECT ticker, date, list(pk) {frame(-79, 0)} AS l FROM (SELECT ticker, date, {PK} AS pk FROM valid)))"


@query("e7_lag_matrix", f"SELECT ticker, date, CAST(len(list_filter(lags, lambda x: x IS NOT NULL)) AS BIGINT) AS n, lags[1] AS lag1, lags[5] AS lag5, lags[80] AS lag80 FROM {LAG_ROWS}", "valid", doubles="lag1 lag5 lag80")
def e7(spark, sf):
    lags = _pk(spark, sf).select("ticker", "date", panels.lag_array("pk", 80).alias("lags"))
    return lags.select("ticker", "date", F.size(F.filter("lags", lambda x: x.isNotNull())).cast("long").alias("n"), *(F.get("lags", F.lit(k - 1)).alias(f"lag{k}") for k in (1, 5, 80)))


@query("e8_log_lags", f"SELECT ticker, date, CASE WHEN lags[1] > 0 THEN ln(lags[1]) END AS log1, CASE WHEN lags[5] > 0 THEN ln(lags[5]) END AS log5 FROM {LAG_ROWS}", "valid", doubles="log1 log5")
def e8(spark, sf):
    lags = _pk(spark, sf).select("ticker", "date", panels.log_lags(panels.lag_array("pk", 80)).alias("lags"))
    return lags.select("ticker", "date", F.get("lags", F.lit(0)).alias("log1"), F.get("lags", F.lit(4)).alias("log5"))


def _weights(k: int, theta: float) -> str:
    raw = f"list_transform(range(1, {k + 1}), lambda j: pow(1 - j / {k + 1}.0, {theta - 1}))"
    return f"list_transform({raw}, lambda x: x / list_sum({raw}))"


@query("e9_beta_weights", f"SELECT brand, weight, CAST(place AS BIGINT) AS place FROM (SELECT p_brand AS brand, unnest({_weights(30, 4.0)}) AS weight, unnest(range(1, 31)) AS place FROM (SELECT DISTINCT p_brand FROM part))", doubles="weight")
def e9(spark, sf):
    from tidepanel.sources.tables import read

    brands = read(spark, sf, "part").select(F.col("p_brand").alias("brand")).distinct()
    return brands.select("brand", F.posexplode(panels.beta_weights(30, 4.0)).alias("place", "weight")).select("brand", (F.col("place") + 1).cast("long").alias("place"), "weight")


#: The terms' weights, each list once.
WEIGHTS = "(SELECT " + ", ".join(f"{_weights(k, t)} AS w{k}_{t:.0f}" for k in panels.MIDAS_LAGS for t in panels.MIDAS_THETAS) + ")"


def midas_sql(k: int, theta: float) -> str:
    return f"CASE WHEN len(list_filter(lags[1:{k}], lambda x: x > 0)) = {k} THEN ln(list_dot_product(list_transform(lags[1:{k}], lambda x: coalesce(x, 0)), w{k}_{theta:.0f})) END"


GRID = [(k, t) for k in panels.MIDAS_LAGS for t in panels.MIDAS_THETAS]


@query("e10_midas_features", f"SELECT ticker, date, {', '.join(f'{midas_sql(k, t)} AS k{k}_t{t:.0f}' for k, t in GRID)} FROM {LAG_ROWS}, {WEIGHTS}", "valid", doubles=tuple(f"k{k}_t{t:.0f}" for k, t in GRID))
def e10(spark, sf):
    lags = _pk(spark, sf).select("ticker", "date", panels.lag_array("pk", 80).alias("lags"))
    return lags.select("ticker", "date", *(panels.midas_term("lags", k, t).alias(f"k{k}_t{t:.0f}") for k, t in GRID))


@query("e11_pre_post_windows", f"SELECT ticker, date, {mean_if('pk', -20, -1, 20)} AS pre, {mean_if('pk', 1, 5, 5)} AS post FROM (SELECT ticker, date, {PK} AS pk FROM valid)", "valid", doubles="pre post")
def e11(spark, sf):
    return panels.pre_post(panels.first_of_date(_pk(spark, sf), "pk"), "pk").drop("pk")


MARKET = f"SELECT date, CASE WHEN count(m) OVER a = 20 THEN avg(m) OVER a END AS market_pre, CASE WHEN count(m) OVER b = 5 THEN avg(m) OVER b END AS market_post FROM (SELECT date, avg(pk) AS m FROM (SELECT date, {PK} AS pk FROM valid) GROUP BY date) WINDOW a AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), b AS (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"


@query("e12_market_pre_post", MARKET, "valid", doubles="market_pre market_post")
def e12(spark, sf):
    return panels.market_pre_post(_pk(spark, sf), "pk")


@query("e13_cross_section_mean", "SELECT ticker, date, avg(close) OVER (PARTITION BY date) AS market, close - avg(close) OVER (PARTITION BY date) AS adjusted FROM bars_xs", "bars_xs", doubles="market adjusted")
def e13(spark, sf):
    return bars_xs(spark, sf).select("ticker", "date", F.avg("close").over(Window.partitionBy("date")).alias("market"), demeaned("close", "date").alias("adjusted"))


@query("e14_benchmark_features", f"SELECT v.ticker, v.date, h.har_d AS bench_d, h.har_w AS bench_w FROM valid v LEFT JOIN (SELECT * FROM ({har_sql(0, 3, 10, 1)}) WHERE ticker = 'click') h ON v.date = h.date", "valid", doubles="bench_d bench_w")
def e14(spark, sf):
    pk = _pk(spark, sf)
    bench = panels.har_features(pk.filter("ticker = 'click'"), "pk").select("date", F.col("har_d").alias("bench_d"), F.col("har_w").alias("bench_w"))
    return pk.select("ticker", "date").join(bench, "date", "left").select("ticker", "date", "bench_d", "bench_w")


@query("e15_group_demean", "SELECT ticker, date, close - avg(close) OVER (PARTITION BY ticker) AS demeaned FROM bars", "bars", doubles="demeaned")
def e15(spark, sf):
    return bars(spark, sf).select("ticker", "date", demeaned("close", "ticker").alias("demeaned"))


def demeaned_sql(table: str, columns: tuple[str, ...], rounds: int = 20) -> str:
    """two_way_demeaned() in SQL: rounds of means by ticker and by date, one inside the other."""
    for key in ("ticker", "date") * rounds:
        table = f"(SELECT ticker, date, {', '.join(f'{c} - avg({c}) OVER (PARTITION BY {key}) AS {c}' for c in columns)} FROM {table})"
    return table


@query("e16_two_way_demean", f"SELECT ticker, date, value FROM {demeaned_sql('(SELECT ticker, date, close AS value FROM bars_xs)', ('value',))}", "bars_xs", doubles="value", digits=6)
def e16(spark, sf):
    return panels.two_way_demeaned(bars_xs(spark, sf).select("ticker", "date", F.col("close").alias("value")), "value")


@query("e17_train_center", "SELECT ticker, date, split, close - coalesce(own, (SELECT avg(close) FROM split_bars WHERE split = 'train')) AS centred FROM split_bars LEFT JOIN (SELECT ticker, avg(close) AS own FROM split_bars WHERE split = 'train' GROUP BY ticker) USING (ticker)", "split_bars", doubles="centred")
def e17(spark, sf):
    return panels.train_centred(with_split(_valid(spark, sf)), "close").select("ticker", "date", "split", F.col("close_centred").alias("centred"))


@query("e18_rank_deciles", "SELECT doc_id, ticker, CAST(CASE WHEN n = 1 THEN 1 ELSE greatest(1, floor((10 * (r - 1) + n - 2) / (n - 1))) END AS BIGINT) AS decile FROM (SELECT doc_id, ticker, row_number() OVER (PARTITION BY ticker ORDER BY n_chars, doc_id) AS r, count(*) OVER (PARTITION BY ticker) AS n FROM docs)", "docs")
def e18(spark, sf):
    ranked = numbered(docs(spark, sf).select("doc_id", "ticker", "n_chars"), ["n_chars", "doc_id"], "ticker")
    return ranked.select("doc_id", "ticker", rank_decile(F.col("_at"), F.col("_of")).alias("decile"))


EDGES = "(SELECT ticker AS t, quantile_cont(CAST(n_chars AS DOUBLE), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM docs GROUP BY ticker)"


@query("e18_value_deciles", f"SELECT doc_id, ticker, CAST(len(list_filter(list_distinct(e), lambda x: x < n_chars)) AS BIGINT) AS decile FROM docs JOIN {EDGES} ON ticker = t", "docs")
def e18b(spark, sf):
    d = docs(spark, sf).select("doc_id", "ticker", F.col("n_chars").cast("double").alias("x"))
    edges = quantiles(d, "x", [i / 10 for i in range(1, 10)], "ticker").withColumnRenamed("q", "e")
    return d.join(edges, "ticker").select("doc_id", "ticker", F.size(F.filter(F.array_distinct("e"), lambda e: e < F.col("x"))).cast("long").alias("decile"))


_BY_DECILE = "SELECT ticker, decile, avg(spaces) AS m FROM (SELECT ticker, spaces, CAST(CASE WHEN n = 1 THEN 1 ELSE greatest(1, floor((10 * (r - 1) + n - 2) / (n - 1))) END AS BIGINT) AS decile FROM (SELECT ticker, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS spaces, row_number() OVER (PARTITION BY ticker ORDER BY n_chars, doc_id) AS r, count(*) OVER (PARTITION BY ticker) AS n FROM docs)) GROUP BY 1, 2"


@query("e19_adjacent_increases", f"SELECT ticker, CAST(sum(CASE WHEN m > prev THEN 1 ELSE 0 END) AS BIGINT) AS rises FROM (SELECT ticker, m, lag(m) OVER (PARTITION BY ticker ORDER BY decile) AS prev FROM ({_BY_DECILE})) GROUP BY ticker", "docs")
def e19(spark, sf):
    """Rises between neighbouring decile means: spaces of documents by deciles of their size."""
    rows = docs(spark, sf).select("ticker", "doc_id", "n_chars", (F.length("text") - F.length(F.replace("text", F.lit(" ")))).cast("double").alias("spaces"))
    placed = numbered(rows, ["n_chars", "doc_id"], "ticker").withColumn("decile", rank_decile(F.col("_at"), F.col("_of")))
    means = placed.groupBy("ticker", "decile").agg(F.avg("spaces").alias("m"))
    rises = means.withColumn("prev", F.lag("m").over(Window.partitionBy("ticker").orderBy("decile")))
    return rises.groupBy("ticker").agg(F.sum(F.when(F.col("m") > F.col("prev"), 1).otherwise(0)).alias("rises"))


@query("e20_sequence_samples", f"SELECT ticker, date, coalesce(code, 0) AS code, CASE WHEN len(list_filter(lags[1:7], lambda x: x > 0)) = 7 THEN ln(lags[7]) END AS oldest, CASE WHEN len(list_filter(lags[1:7], lambda x: x > 0)) = 7 THEN ln(lags[1]) END AS newest FROM {LAG_ROWS} LEFT JOIN (SELECT ticker, CAST(dense_rank() OVER (ORDER BY ticker) AS BIGINT) AS code FROM (SELECT DISTINCT ticker FROM split_bars WHERE split = 'train')) USING (ticker)", "split_bars", doubles="oldest newest")
def e20(spark, sf):
    pk = with_split(_pk(spark, sf))
    codes = pk.filter("split = 'train'").select("ticker").distinct().select("ticker", F.dense_rank().over(Window.orderBy("ticker")).cast("long").alias("code"))
    seq = pk.withColumn("l", F.reverse(panels.log_lags(panels.lag_array("pk", 7)))).join(codes, "ticker", "left")
    ok = F.forall("l", lambda x: x.isNotNull())
    return seq.select("ticker", "date", F.coalesce("code", F.lit(0)).alias("code"), F.when(ok, F.get("l", F.lit(0))).alias("oldest"), F.when(ok, F.get("l", F.lit(6))).alias("newest"))


@query("e2_rolling_mean_long", f"SELECT ticker, date, {mean_if('close', -4, 0, 5)} AS week5 FROM bars_long", "bars_long", doubles="week5")
def e2_long(spark, sf):
    return bars_long(spark, sf).select("ticker", "date", rolling_mean("close", 5).alias("week5"))
