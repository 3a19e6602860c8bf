"""Impact labels (H)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions import estimators as est
from tidepanel.functions.scalar import log_of, ratio
from tidepanel.functions.windows import rolling_mean, shifted, simple_return
from tidepanel.operators import labels as lab
from tidepanel.operators import matching, models, panels
from tidepanel.plans.linear_sql import fit_sql
from tidepanel.plans.matching import FORWARD
from tidepanel.plans.panel import GK, PK, RS, R, W, frame, mean_if
from tidepanel.plans.registry import query
from tidepanel.sources.tables import bars, bars_long, docs, read, valid_bars, with_split


def _valid(spark, sf):
    return valid_bars(bars(spark, sf))


def _features_sql() -> str:
    rolls = ", ".join(f"{mean_if(f'hist_{s}_d', -(n - 1), 0, m)} AS hist_{s}_{c}" for s in ("var", "range") for c, n, m in (("w", 5, 3), ("m", 22, 10)))
    targets = ", ".join(f"lead(hist_{s}_d) OVER w AS target_{s}_h1, avg(hist_{s}_d) {frame(1, 5)} AS target_{s}_h5" for s in ("var", "range"))
    one = f"SELECT *, {R} AS ret0, {PK} AS hist_range_d, pow({R}, 2) AS hist_var_d FROM valid {W}"
    two = f"SELECT *, {rolls}, abs(ret0) AS current_abs_return, CASE WHEN ret0 IS NOT NULL THEN greatest(-ret0, 0) END AS current_negative_return, close / lag(close, 20) OVER w - 1 AS momentum20, lead(ret0) OVER w AS fwd_ret1, {targets} FROM ({one}) {W}"
    three = f"SELECT *, avg(fwd_ret1) OVER (PARTITION BY date) AS market_fwd_ret1, fwd_ret1 - avg(fwd_ret1) OVER (PARTITION BY date) AS abret1 FROM ({two})"
    logs = ", ".join(f"ln(hist_{s}_{c} + 1e-10) AS log_hist_{s}_{c}" for s in ("var", "range") for c in "dwm")
    four = f"SELECT *, ln(abs(abret1) + 1e-6) AS log_abs_abret1, ln(target_var_h5 + 1e-10) AS log_rv5, ln(target_range_h5 + 1e-10) AS log_range5, {logs} FROM ({three})"
    market = ", ".join(f"avg(log_hist_var_{c}) OVER (PARTITION BY date) AS market_log_var_{c}" for c in "dwm")
    return f"SELECT *, log_rv5 - avg(log_rv5) OVER (PARTITION BY date) AS market_adjusted_log_rv5, log_range5 - avg(log_range5) OVER (PARTITION BY date) AS market_adjusted_log_range5, {market} FROM ({four})"


_H1 = "ret0 hist_var_d hist_range_d hist_var_w hist_var_m hist_range_w hist_range_m current_abs_return current_negative_return momentum20 fwd_ret1 target_var_h1 target_var_h5 target_range_h1 target_range_h5 market_fwd_ret1 abret1 log_abs_abret1 log_rv5 log_range5 log_hist_var_d log_hist_var_w log_hist_var_m log_hist_range_d log_hist_range_w log_hist_range_m market_adjusted_log_rv5 market_adjusted_log_range5 market_log_var_d market_log_var_w market_log_var_m open high low close volume"


@query("h1_news_market_features", _features_sql(), "valid", doubles=_H1, digits=6)
def h1(spark, sf):
    return panels.market_features(_valid(spark, sf))


@query("h2_impact_ratio", f"SELECT ticker, date, sqrt(post) / sqrt(pre) AS impact_ratio, ln(sqrt(post) / sqrt(pre)) AS log_impact_ratio FROM (SELECT ticker, date, {mean_if('pk', -19, 0, 20)} AS pre, {mean_if('pk', 1, 5, 5)} AS post FROM (SELECT ticker, date, {PK} AS pk FROM valid)) WHERE pre > 1e-12 AND post > 1e-12", "valid", doubles="impact_ratio log_impact_ratio")
def h2(spark, sf):
    return lab.impact_ratio(_valid(spark, sf).select("ticker", "date", est.parkinson().alias("pk")), "pk")


def _expansion_sql(value: str, post: int) -> str:
    end = post + 4
    m = f"SELECT date, CASE WHEN count(m) OVER a = 20 THEN avg(m) OVER a END AS market_pre, CASE WHEN count(m) OVER b = 5 THEN avg(m) OVER b END AS market_post FROM (SELECT date, avg(v) AS m FROM est GROUP BY date) WINDOW a AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), b AS (ORDER BY date ROWS BETWEEN {post} FOLLOWING AND {end} FOLLOWING)"
    logs = "ln(CASE WHEN post IS NOT NULL THEN greatest(post, 1e-12) END / CASE WHEN pre IS NOT NULL THEN greatest(pre, 1e-12) END)"
    market = logs.replace("post", "market_post").replace("pre", "market_pre")
    return f"WITH est AS (SELECT ticker, date, {value} AS v FROM valid {W}) SELECT * FROM (SELECT ticker, date, 0.5 * {logs} AS firm_only, 0.5 * ({logs} - {market}) AS expansion FROM (SELECT ticker, date, {mean_if('v', -20, -1, 20)} AS pre, {mean_if('v', post, end, 5)} AS post FROM est) JOIN ({m}) USING (date)) WHERE expansion IS NOT NULL"


_VALUES = {"parkinson": PK, "garman_klass": f"greatest({GK}, 0)", "rogers_satchell": f"greatest({RS}, 0)", "ohlc_mean": f"({PK} + greatest({GK}, 0) + greatest({RS}, 0)) / 3", "close": "pow(ln(close / lag(close) OVER w), 2)"}


def _expansion(name: str, estimator: str, post: int):
    @query(name, _expansion_sql(_VALUES[estimator], post), "valid", doubles="firm_only expansion")
    def label(spark, sf):
        return lab.market_adjusted_expansion(_valid(spark, sf), estimator, post)


_expansion("h3_market_adjusted_expansion", "parkinson", 1)
for _e in ("garman_klass", "rogers_satchell", "ohlc_mean", "close"):
    _expansion(f"h3_market_adjusted_expansion_{_e}", _e, 1)
for _e in ("parkinson", "garman_klass", "rogers_satchell", "ohlc_mean", "close"):
    _expansion(f"h4_filing_expansion_{_e}", _e, 0)


@query("h5_scaled_abs_abnormal_return", f"SELECT ticker, date, ln(abs(next)) - 0.5 * ln(pre) AS label FROM (SELECT ticker, date, lead(a) OVER w AS next, {mean_if('v', -20, -1, 20)} AS pre FROM (SELECT ticker, date, r - avg(r) OVER (PARTITION BY date) AS a, pow(l, 2) AS v FROM (SELECT ticker, date, {R} AS r, ln(close / lag(close) OVER w) AS l FROM valid {W})) {W}) WHERE abs(next) > 1e-9 AND pre > 0", "valid", doubles="label", digits=6)
def h5(spark, sf):
    df = _valid(spark, sf).select("ticker", "date", simple_return().alias("r"), panels.close_variance("log").alias("v"))
    df = df.withColumn("a", F.col("r") - F.avg("r").over(Window.partitionBy("date")))
    df = df.select("ticker", "date", F.abs(shifted("a", -1)).alias("next"), rolling_mean("v", 20, 20, skip=1).alias("pre"))
    return df.filter("next > 1e-9 and pre > 0").select("ticker", "date", (F.ln("next") - 0.5 * F.ln("pre")).alias("label"))


NUISANCES = ["log_hist_var_d", "log_hist_var_w", "log_hist_range_d", "current_abs_return", "momentum20"]
#: Columns of the kinds in the oracle: as many tickers and months as the hourly bars can have.
_TICKERS, _MONTHS = 5, 2


def _residual_sql() -> str:
    """The ridge in SQL: scaled controls and a column for each ticker and month of the training rows."""
    n, k = len(NUISANCES), len(NUISANCES) + _TICKERS + _MONTHS
    known = " AND ".join(f"{c} IS NOT NULL" for c in (*NUISANCES, "log_abs_abret1"))
    rows = f"SELECT ticker, date, CASE WHEN date <= TIMESTAMP '2024-01-15' THEN 'train' WHEN date <= TIMESTAMP '2024-01-22' THEN 'val' ELSE 'test' END AS split, strftime(date, '%m') AS month, log_abs_abret1 AS y, [{', '.join(NUISANCES)}] AS c FROM ({_features_sql()}) WHERE {known}"
    scale = ", ".join(f"avg(c[{i}]) AS m{i}, greatest(stddev_pop(c[{i}]), 1e-12) AS s{i}" for i in range(1, n + 1))
    hot = [f"CASE WHEN coalesce({c} = {c}s[{i}], false) THEN 1.0::DOUBLE ELSE 0 END" for c, most in (("ticker", _TICKERS), ("month", _MONTHS)) for i in range(1, most + 1)]
    z = f"SELECT ticker, date, split, y, [{', '.join([*(f'(c[{i}] - m{i}) / s{i}' for i in range(1, n + 1)), *hot])}] AS x FROM o, (SELECT {scale}, list(DISTINCT ticker ORDER BY ticker) AS tickers, list(DISTINCT month ORDER BY month) AS months FROM o WHERE split = 'train')"
    mean = f"(SELECT [{', '.join(f'avg(x[{i}])' for i in range(1, k + 1))}] AS mx, avg(y) AS my FROM z WHERE split = 'train')"
    return (
        f"WITH RECURSIVE o AS MATERIALIZED ({rows}), z AS MATERIALIZED ({z}), "
        + fit_sql("SELECT x, y FROM z WHERE split = 'train'", k, 10.0)
        + f", raw AS (SELECT ticker, date, split, y - my - list_dot_product(list_transform(range(1, {k + 1}), lambda i: x[i] - mx[i]), w) AS raw FROM z, fit, {mean}) "
        "SELECT ticker, date, split, raw / greatest((SELECT stddev_pop(raw) FROM raw WHERE split = 'train'), 1e-12) AS residual FROM raw"
    )


@query("h6_nuisance_residual", _residual_sql(), "valid", doubles="residual", digits=6)
def h6(spark, sf):
    """Residual of the label on controls, tickers and months, fitted on training rows."""
    panel = with_split(panels.market_features(_valid(spark, sf))).withColumn("event_month", F.date_format("date", "MM"))
    return models.nuisance_residual(panel.dropna(subset=[*NUISANCES, "log_abs_abret1"]), "log_abs_abret1", NUISANCES, ["ticker", "event_month"]).select("ticker", "date", "split", "residual")


COMPOSITE = "SELECT doc_id, split, ((a - ma) / greatest(sa, 1e-8) + (b - mb) / greatest(sb, 1e-8) + (c - mc) / greatest(sc, 1e-8)) / 3 AS composite FROM (SELECT doc_id, split, ln(n_chars + 1) AS a, ln(length(text) - length(replace(text, ' ', '')) + 1) AS b, ln(length(text) - length(replace(text, 'e', '')) + 1) AS c FROM docs), (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc FROM (SELECT ln(n_chars + 1) AS a, ln(length(text) - length(replace(text, ' ', '')) + 1) AS b, ln(length(text) - length(replace(text, 'e', '')) + 1) AS c FROM docs WHERE split = 'train'))"


def composite(spark, sf):
    less = lambda s: F.ln(F.length("text") - F.length(F.replace("text", F.lit(s))) + 1)
    d = docs(spark, sf).select("doc_id", "ticker", "lang", "date", "split", F.ln(F.col("n_chars") + 1).alias("a"), less(" ").alias("b"), less("e").alias("c"), F.lit(1).alias("one"))
    return lab.composite(d, ["a", "b", "c"], "one")


@query("h7_impact_composite", COMPOSITE, "docs", doubles="composite")
def h7(spark, sf):
    return composite(spark, sf).select("doc_id", "split", "composite")


@query("h8_high_impact", f"WITH x AS ({COMPOSITE}) SELECT doc_id, composite >= (SELECT quantile_cont(composite, 0.75) FROM x WHERE split = 'train') + 1e-9 AS high FROM x", "docs")
def h8(spark, sf):
    return lab.high_impact(composite(spark, sf), "composite", margin=1e-9).select("doc_id", "high")


@query("h9_filing_raw_labels", f"SELECT e.event_id, ln(abs(e.value - m.m) + 1e-6) AS raw_absar1, ln(e.value * e.value / 5 + 1e-10) AS raw_rv5, CASE WHEN s.value + 1e-10 > 0 THEN ln(s.value + 1e-10) END AS raw_range5 FROM events e ASOF LEFT JOIN ({FORWARD}) s ON e.event_type = s.ticker AND e.ts <= s.date LEFT JOIN (SELECT CAST(ts AS DATE) AS d, avg(value) AS m FROM events GROUP BY 1) m ON CAST(e.ts AS DATE) = m.d", "valid", doubles="raw_absar1 raw_rv5 raw_range5", digits=6)
def h9(spark, sf):
    events = read(spark, sf, "events")
    market = events.groupBy(F.to_date("ts").alias("d")).agg(F.avg("value").alias("m"))
    own = events.select("event_id", F.col("event_type").alias("ticker"), F.col("ts").alias("date"), F.col("value").alias("x"))
    found = matching.forward_parkinson(own, _valid(spark, sf)).withColumn("d", F.to_date("date")).join(market, "d", "left")
    return found.select("event_id", *lab.raw_terms(F.col("x") - F.col("m"), "x", "value"))


@query("h2_impact_ratio_long", f"SELECT ticker, date, sqrt(post) / sqrt(pre) AS impact_ratio FROM (SELECT ticker, date, {mean_if('pk', -20, -1, 20)} AS pre, {mean_if('pk', 0, 4, 5)} AS post FROM (SELECT ticker, date, {PK} AS pk FROM bars_long WHERE low > 0)) WHERE pre > 1e-12 AND post > 1e-12", "bars_long", doubles="impact_ratio")
def h2_long(spark, sf):
    rows = bars_long(spark, sf).filter("low > 0").select("ticker", "date", (F.pow(log_of(ratio("high", "low")), 2) / (4 * est.LN2)).alias("pk"))
    return lab.impact_ratio(rows, "pk", include_event=False, post_start=0).select("ticker", "date", "impact_ratio")
