"""Linear models, selection and forecasts (J)."""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import and_

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions import estimators as est
from tidepanel.functions import vectors as vec
from tidepanel.functions.scalar import split_of
from tidepanel.functions.statistics import qlike
from tidepanel.operators import axis_sweep, chunks, models, panels
from tidepanel.operators import evaluation as ev
from tidepanel.plans.linear_sql import first_sql, fit_sql
from tidepanel.plans.metrics import rho_sql
from tidepanel.plans.panel import GRID, LAGS, PK, WEIGHTS, frame, har_sql, midas_sql
from tidepanel.plans.registry import query
from tidepanel.plans.vector_plans import PAIRS, pairs
from tidepanel.sources.sinks import checkpointed
from tidepanel.sources.tables import bars, bars_long, bucket, docs, read, valid_bars, vectors, with_split


def labelled(spark, sf):
    """Vectors of documents with a label, a group and a split."""
    d = docs(spark, sf).select(F.col("doc_id").alias("item_id"), "ticker", "lang", "date", "split", F.ln(F.col("n_chars") + 1).alias("y"))
    return vectors(spark, sf).join(d, "item_id")


def _axis(spark, w, method):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "place int, weight double").select(F.lit(method).alias("method"), "place", F.round("weight", 6).alias("weight"))


@query("j1_mean_contrast_axis", "WITH x AS (SELECT v.vec, ln(d.n_chars + 1) AS y FROM vectors v JOIN docs d ON item_id = doc_id WHERE layer = 1 AND split = 'train'), q AS (SELECT quantile_cont(y, 0.25) AS lo, quantile_cont(y, 0.75) AS hi FROM x), m AS (SELECT i, avg(CASE WHEN y >= hi THEN v END) - avg(CASE WHEN y <= lo THEN v END) AS d FROM (SELECT y, unnest(vec) AS v, CAST(unnest(range(0, 16)) AS INTEGER) AS i FROM x), q GROUP BY i) SELECT 'contrast' AS method, i AS place, d / (SELECT sqrt(sum(d * d)) FROM m) AS weight FROM m", "docs", "vectors", doubles="weight", digits=6)
def j1(spark, sf):
    rows = labelled(spark, sf).filter("layer = 1 and split = 'train'")
    return _axis(spark, models.contrast_axis(rows, "vec", "y"), "contrast")


@query("j2_logistic_axis")
def j2(spark, sf):
    return _axis(spark, models.logistic_axis(labelled(spark, sf).filter("layer = 1 and split = 'train'"), "vec", "y"), "logistic")


_TRAIN = "SELECT v.vec AS x, ln(d.n_chars + 1) AS y, d.ticker FROM vectors v JOIN docs d ON item_id = doc_id WHERE layer = 1 AND split = 'train'"
_LEVELLED = f"SELECT list(x ORDER BY i) AS x, any_value(y) AS y FROM (SELECT id, i, x - avg(x) OVER (PARTITION BY ticker, i) AS x, y - avg(y) OVER (PARTITION BY ticker, i) AS y FROM (SELECT id, ticker, y, unnest(x) AS x, unnest(range(1, 17)) AS i FROM (SELECT row_number() OVER () AS id, * FROM ({_TRAIN})))) GROUP BY id"
_PARTED = f"SELECT list_transform(range(1, 17), lambda i: a.vec[i] - b.vec[i]) AS x FROM ({PAIRS}) JOIN vectors a ON a.item_id = high_id AND a.layer = 1 JOIN vectors b ON b.item_id = low_id AND b.layer = 1"


def _axis_sql(tables: str, method: str, sign: str = "1") -> str:
    """place and weight of the direction of fit (w), of length one."""
    return f"WITH RECURSIVE {tables} SELECT '{method}' AS method, CAST(unnest(range(0, 16)) AS INTEGER) AS place, unnest(w) * {sign} / sqrt(list_dot_product(w, w)) AS weight FROM fit"


_SIGN = f"(SELECT CASE WHEN rho < 0 THEN -1 ELSE 1 END FROM ({rho_sql(f'(SELECT list_dot_product(x, (SELECT w FROM fit)) AS s, y FROM ({_TRAIN}))', 's', 'y')}))"


@query("j3_ridge_axis", _axis_sql(fit_sql(_TRAIN, 16, 10.0), "ridge"), "docs", "vectors", doubles="weight", digits=6)
def j3(spark, sf):
    rows = labelled(spark, sf).filter("layer = 1 and split = 'train'")
    return _axis(spark, models.unit_axis(models.ridge(rows, "vec", "y", 10.0)), "ridge")


@query("j4_within_ticker_ridge_axis", _axis_sql(fit_sql(_LEVELLED, 16, 10.0), "within_ridge"), "docs", "vectors", doubles="weight", digits=6)
def j4(spark, sf):
    rows = chunks.centred(labelled(spark, sf).filter("layer = 1 and split = 'train'"), "vec", "ticker")
    rows = rows.withColumn("y", F.col("y") - F.avg("y").over(Window.partitionBy("ticker")))
    return _axis(spark, models.unit_axis(models.ridge(rows, "vec", "y", 10.0)), "within_ridge")


@query("j5_matched_delta_pc1_axis", _axis_sql(first_sql(_PARTED, 16), "pc1"), "docs", "vectors", doubles="weight", digits=6)
def j5(spark, sf):
    d = chunks.pair_deltas(pairs(spark, sf), vectors(spark, sf).filter("layer = 1"))
    return _axis(spark, models.first_direction(d, "delta"), "pc1")


@query("j6_orient_axis", _axis_sql(fit_sql(_TRAIN, 16, 1.0), "oriented", _SIGN), "docs", "vectors", doubles="weight", digits=6)
def j6(spark, sf):
    rows = labelled(spark, sf).filter("layer = 1")
    w = models.unit_axis(models.ridge(rows.filter("split = 'train'"), "vec", "y", 1.0))
    return _axis(spark, models.oriented(rows, "vec", -w, "y"), "oriented")


ALPHAS = [0.1, 1.0, 10.0]
#: Ends of the train and validation spans of weekly bars, and the ticker that stands for the market of filings.
SPANS, BENCHMARK = ("1996-01-01 00:00:00", "1997-01-01 00:00:00"), "Brand#11"
MIDAS_NAMES = [f"midas_{k}_{t:.0f}" for k, t in GRID]


DOMAINS, LABELS = ("english", "other"), ["size", "spaces"]


def swept(spark, sf):
    """Axes for two labels (sizes in characters and in spaces) of two domains: English documents and all others."""
    d = docs(spark, sf).select(F.col("doc_id").alias("item_id"), "ticker", "date", "split", F.when(F.col("lang") == "en", DOMAINS[0]).otherwise(DOMAINS[1]).alias("domain"), F.ln(F.col("n_chars") + 1).alias("size"), F.ln(F.length("text") - F.length(F.replace("text", F.lit(" "))) + 1).alias("spaces"))
    own = vectors(spark, sf).select("item_id", "layer", vec.unit("vec").alias("vec"))
    items = checkpointed(d.join(own.select("item_id").distinct(), "item_id"))
    return axis_sweep.sweep(items, checkpointed(own), LABELS, DOMAINS, ALPHAS)


@query("j7_layer_alpha_sweep", doubles="rho within_rho", digits=6)
def j7(spark, sf):
    """Five methods by layer, label, version and alpha, with the rank correlations of their scores."""
    return swept(spark, sf)[1].drop("candidate")


@query("j8_select_on_validation", doubles="rho_english rho_other within_rho_english within_rho_other macro macro_within score cosine_english cosine_other cosine_joint", digits=6)
def j8(spark, sf):
    """The best axis of each version on validation rows, whether it would replicate, and the cosines between the chosen."""
    axes, metrics = swept(spark, sf)
    return axis_sweep.cosines(axis_sweep.selected(metrics, DOMAINS), axes, (*DOMAINS, axis_sweep.JOINT)).drop("candidate")


_AX = "[" + ", ".join(str(i / 16) for i in range(1, 17)) + "]"


@query("j9_frozen_scores", f"WITH s AS (SELECT item_id, lang, split, list_sum(list_transform(range(1, 17), lambda i: vec[i] * ({_AX})[i])) AS score FROM vectors JOIN docs ON item_id = doc_id WHERE layer = 2) SELECT item_id, split, score, (score - m) / greatest(d, 1e-8) AS z_score FROM s JOIN (SELECT lang, avg(score) AS m, stddev_pop(score) AS d FROM s WHERE split = 'train' GROUP BY lang) USING (lang)", "docs", "vectors", doubles="score z_score", digits=6)
def j9(spark, sf):
    import numpy as np

    rows = labelled(spark, sf).filter("layer = 2")
    return models.calibrated(rows, "vec", np.arange(1, 17) / 16, "lang").select("item_id", "split", "score", "z_score")


def forecast_panel(spark, sf, origin: str = "end_of_day", domain: str = "news"):
    """HAR, AR, control, market and MIDAS terms of weekly bars with targets of one and five sessions, known at the origin's time.

    The market's terms are the date's means for news and a benchmark ticker's for filings.
    """
    skip = 0 if origin == "end_of_day" else 1
    table = valid_bars(bars_long(spark, sf)).select("*", est.parkinson(policy="strict").alias("pk"))
    table = panels.har_features(panels.market_controls(table, origin), "pk", origin)
    table = panels.market_har(table, None if domain == "news" else BENCHMARK)
    table = table.withColumn("lags", panels.lag_array("pk", max(panels.MIDAS_LAGS), skip=skip))
    logs = panels.log_lags(F.slice("lags", 1, 5))
    terms = [panels.midas_term("lags", k, t).alias(n) for n, (k, t) in zip(MIDAS_NAMES, GRID, strict=True)]
    return table.select("*", split_of("date", *SPANS).alias("split"), *(F.get(logs, F.lit(i)).alias(f"lag{i + 1}") for i in range(5)), *terms).drop("lags")


def har_panel(spark, sf):
    """HAR terms and targets of the hourly bars."""
    table = valid_bars(bars(spark, sf)).select("*", est.parkinson(policy="strict").alias("pk"))
    return with_split(panels.har_features(table, "pk"))


def scores(spark, sf):
    """ticker, date, embedding_score, activation_score: mean projections of the vectors (two layers) of a bar's suppliers."""
    axis = F.array(*(F.lit(i / 16) for i in range(1, 17)))
    own = vectors(spark, sf).filter("layer in (1, 2)").groupBy("item_id").agg(*(F.max(F.when(F.col("layer") == k, vec.dot("vec", axis))).alias(n) for k, n in ((1, "embedding_score"), (2, "activation_score"))))
    ticks = read(spark, sf, "lineitem").join(read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker")), "l_partkey").select("ticker", bucket("week", "l_shipdate").alias("date"), F.col("l_suppkey").alias("item_id"))
    return ticks.join(own, "item_id").groupBy("ticker", "date").agg(F.avg("embedding_score").alias("embedding_score"), F.avg("activation_score").alias("activation_score"))


_J10 = "WITH p AS (SELECT ticker, date, split, ln(greatest(pk, 1e-10)) AS x, lead(pk) OVER (PARTITION BY ticker ORDER BY date) AS target FROM (SELECT *, pow(ln(high / low), 2) / (4 * ln(2)) AS pk FROM split_bars)), f AS (SELECT ticker, x, ln(target) AS y FROM p WHERE target > 0 AND split IN ('train', 'val')), m AS (SELECT ticker, avg(x) AS mx, avg(y) AS my FROM f GROUP BY ticker), b AS (SELECT sum((x - mx) * (y - my)) / sum(pow(x - mx, 2)) AS w FROM f JOIN m USING (ticker)) SELECT ticker, date, exp(greatest(-30, least(5, w * x + my - w * mx))) AS prediction FROM p JOIN m USING (ticker), b WHERE target > 0 AND split = 'test'"


@query("j10_panel_ols_fe", _J10, "split_bars", doubles="prediction", digits=7)
def j10(spark, sf):
    from tidepanel.functions.scalar import log_floored
    from tidepanel.functions.windows import shifted

    rows = with_split(valid_bars(bars(spark, sf)).select("ticker", "date", est.parkinson().alias("pk")))
    rows = rows.select("ticker", "date", "split", log_floored("pk").alias("x"), shifted("pk", -1).alias("target"))
    return models.panel_forecast(models.complete(rows, ["x"], "target"), ["x"], "target").filter("split = 'test'").select("ticker", "date", "prediction")


_STRICT = f"CASE WHEN high > low AND {PK} > 1e-10 THEN {PK} END"
_HAR_ROWS = f"SELECT ticker, date, CASE WHEN date <= TIMESTAMP '2024-01-15' THEN 'train' WHEN date <= TIMESTAMP '2024-01-22' THEN 'val' ELSE 'test' END AS split, [har_d, har_w, har_m] AS x, ln(target_h1) AS y, target_h1 FROM ({har_sql(0, 3, 10, 1, f'SELECT ticker, date, {_STRICT} AS pk FROM valid')}) WHERE har_d IS NOT NULL AND har_w IS NOT NULL AND har_m IS NOT NULL AND target_h1 > 0"
_MEANS = f"SELECT ticker, [avg(x[1]), avg(x[2]), avg(x[3])] AS mx, avg(y) AS my FROM ({_HAR_ROWS}) WHERE split <> 'test' GROUP BY ticker"
_HAR_FIT = fit_sql(f"SELECT list_transform(range(1, 4), lambda i: x[i] - mx[i]) AS x, y - my AS y FROM ({_HAR_ROWS}) JOIN ({_MEANS}) USING (ticker) WHERE split <> 'test'", 3)
_J11 = f"WITH RECURSIVE {_HAR_FIT} SELECT unnest(['har_d', 'har_w', 'har_m']) AS feature, unnest([s[1] * w[1], s[2] * w[2], s[3] * w[3]]) AS loading FROM fit, (SELECT [stddev_pop(x[1]), stddev_pop(x[2]), stddev_pop(x[3])] AS s FROM ({_HAR_ROWS}) WHERE split <> 'test')"


@query("j11_axis_loading", _J11, "valid", doubles="loading", digits=6)
def j11(spark, sf):
    """Coefficient of a feature for one deviation, with the model's others beside it."""
    rows = models.complete(har_panel(spark, sf), models.FEATURE_SETS["har"], "target_h1").filter("split <> 'test'").withColumn("_y", F.ln("target_h1"))
    w, _, _ = models.within_fit(rows, models.FEATURE_SETS["har"], "_y")
    dev = rows.agg(*(F.stddev_pop(c).alias(c) for c in models.FEATURE_SETS["har"]))
    return dev.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), (F.col(c) * float(b)).alias("loading")) for c, b in zip(models.FEATURE_SETS["har"], w, strict=True)))).alias("r")).select("r.*")


def _counted() -> str:
    """Rows of each model's complete sample in SQL: what each model needs is there, by counts over frames of rows."""
    base = f"SELECT ticker, date, close, {_STRICT} AS pk FROM bars_long WHERE open > 0 AND high > 0 AND low > 0 AND close > 0"
    out = []
    for domain, (origin, skip, weekly, monthly, start) in product(models.CONTROLS, (("end_of_day", 0, 3, 10, 1), ("session_open", 1, 5, 22, 0))):
        seen = lambda n, least: f"count(pk) {frame(-(n - 1) - skip, -skip)} >= {least}"  # noqa: B023, E731
        own = f"SELECT ticker, date, {seen(1, 1)} AND {seen(5, weekly)} AND {seen(22, monthly)} AS har, {seen(5, 5)} AS ar5, {seen(30, 30)} AS midas, lag(close, {20 + skip}) OVER (PARTITION BY ticker ORDER BY date) IS NOT NULL AND lag(close, {1 + skip}) OVER (PARTITION BY ticker ORDER BY date) IS NOT NULL AS controls, count(pk) {frame(start, start)} = 1 AS target FROM ({base})"
        market = "har" if domain == "news" else f"date IN (SELECT date FROM ({own}) WHERE ticker = '{BENCHMARK}' AND har)"
        for model, names in models.feature_sets(MIDAS_NAMES[0], domain).items():
            needs = f"har AND controls AND {market}" if model == "harx" else model
            out.append(f"SELECT '{domain}' AS domain, '{origin}' AS origin, '{model}' AS model, '{','.join(names)}' AS features, count(*) FILTER (target AND {needs}) AS n FROM ({own})")
    return " UNION ALL ".join(out)


@query("j12_feature_sets", _counted(), "bars_long")
def j12(spark, sf):
    """Rows of each model's complete sample, by domain and by the time at which its terms are known."""
    out = None
    for domain, origin in product(models.CONTROLS, ("end_of_day", "session_open")):
        panel = forecast_panel(spark, sf, origin, domain)
        sets = models.feature_sets(MIDAS_NAMES[0], domain)
        whole = lambda fs: F.count_if(reduce(and_, (F.col(c).isNotNull() for c in fs), F.col("target_h1") > 0))
        one = panel.agg(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(",".join(fs)).alias("features"), whole(fs).alias("n")) for m, fs in sets.items())).alias("r"))
        one = one.select(F.lit(domain).alias("domain"), F.lit(origin).alias("origin"), F.explode("r").alias("r")).select("domain", "origin", "r.*")
        out = one if out is None else out.unionByName(one)
    return out


def _selected() -> str:
    """The MIDAS selection in SQL: a regression with levels by ticker for each candidate, from its sums over the training rows."""
    strict = f"CASE WHEN high > low AND {PK} > 1e-10 THEN {PK} END"
    rows = f"SELECT ticker, date, lead(pk) OVER (PARTITION BY ticker ORDER BY date) AS target, {LAGS} AS lags FROM (SELECT ticker, date, pk, list(pk) {frame(-79, 0)} AS l FROM (SELECT ticker, date, {strict} AS pk FROM bars_long WHERE open > 0 AND high > 0 AND low > 0 AND close > 0))"
    terms = ", ".join(f"{{'c': '{n}', 'x': {midas_sql(k, t)}}}" for n, (k, t) in zip(MIDAS_NAMES, GRID, strict=True))
    log = "w * x + coalesce(level, (SELECT coalesce(avg(level), 0) FROM level l WHERE l.c = r.c))"
    ratio = f"(greatest(target, 1e-10) / greatest(exp(greatest(-30, least(5, {log}))), 1e-10))"
    return (
        f"WITH panel AS (SELECT ticker, CASE WHEN date <= TIMESTAMP '{SPANS[0]}' THEN 'train' WHEN date <= TIMESTAMP '{SPANS[1]}' THEN 'val' ELSE 'test' END AS split, target, unnest([{terms}], recursive := true) FROM ({rows}), {WEIGHTS}), "
        "known AS (SELECT *, ln(target) AS y FROM panel WHERE x IS NOT NULL AND target > 0), "
        "sums AS (SELECT c, ticker, count(*) AS n, avg(x) AS mx, avg(y) AS my, sum(x * x) AS xx, sum(x * y) AS xy FROM known WHERE split = 'train' GROUP BY 1, 2), "
        "slope AS (SELECT c, coalesce(sum(xy - n * mx * my) / nullif(sum(xx - n * mx * mx), 0), 0) AS w FROM sums GROUP BY c), "
        "level AS (SELECT c, ticker, my - w * mx AS level FROM sums JOIN slope USING (c)), "
        f"loss AS (SELECT c, {ratio} - ln({ratio}) - 1 AS loss FROM (SELECT k.c, k.x, k.target, coalesce(w, 0) AS w, level FROM known k LEFT JOIN slope s ON k.c = s.c LEFT JOIN level v ON k.c = v.c AND k.ticker = v.ticker WHERE split = 'val') r) "
        f"SELECT a.c AS candidate, count(loss) AS n, avg(loss) AS qlike FROM (SELECT unnest({MIDAS_NAMES}) AS c) a LEFT JOIN loss USING (c) GROUP BY a.c"
    )


@query("j13_select_midas", _selected(), "bars_long", doubles="qlike", digits=6)
def j13(spark, sf):
    return models.select_midas(checkpointed(forecast_panel(spark, sf)), MIDAS_NAMES, "target_h1")[1]


VARIANTS = {"baseline": [], "embedding": ["embedding_score"], "activation": ["activation_score"]}


def forecasts(spark, sf):
    """horizon, model, variant, ticker, date, actual, prediction, loss, base_loss of test rows, and the score's loading.

    Horizons by models, the MIDAS term selected on validation rows; the variants of a model share one complete sample.
    """
    panel = checkpointed(forecast_panel(spark, sf).join(scores(spark, sf), ["ticker", "date"], "left"))
    out = None
    for horizon in (1, 5):
        target = f"target_h{horizon}"
        sets = models.feature_sets(models.select_midas(panel, MIDAS_NAMES, target)[0])
        for name, base in sets.items():
            rows = models.complete(panel, [*base, "embedding_score", "activation_score"], target)
            for variant, more in VARIANTS.items():
                rows = models.panel_forecast(rows, [*base, *more], target).withColumnRenamed("prediction", f"p_{variant}")
            each = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(f"p_{v}").alias("prediction")) for v in VARIANTS))).alias("v")
            test = rows.filter("split = 'test'").select(F.lit(horizon).alias("horizon"), F.lit(name).alias("model"), "ticker", "date", F.col(target).alias("actual"), "p_baseline", each)
            one = test.select("horizon", "model", "v.*", "ticker", "date", "actual", qlike("actual", "v.prediction").alias("loss"), qlike("actual", "p_baseline").alias("base_loss"))
            out = one if out is None else out.unionByName(one)
    return checkpointed(out)


@query("j14_forecast_comparison", doubles="qlike log_mse log_r2 mse r2 rmse corr improvement mean low high p", digits=6)
def j14(spark, sf):
    """Each variant's test metrics, its gain in percent of the baseline's QLIKE, and what a bootstrap of date blocks says of it."""
    rows = forecasts(spark, sf)
    keys = ["horizon", "model", "variant"]
    gain = 100 * F.try_divide(F.avg("base_loss") - F.avg("loss"), F.avg("base_loss"))
    table = rows.groupBy(*keys).agg(*models.fit_metrics("actual", "prediction"), gain.alias("improvement"))
    by_date = rows.filter("variant <> 'baseline'").groupBy(*keys, "date").agg(F.avg(F.col("base_loss") - F.col("loss")).alias("v"))
    tests = [ev.block_bootstrap(by_date.filter(F.col("horizon") == h), "v", "date", h, 2000, keys=tuple(keys)) for h in (1, 5)]
    return table.join(tests[0].unionByName(tests[1]), keys, "left")


@query("j1_group_mean_axis", "SELECT grp, i AS place, avg(x) AS weight FROM (SELECT grp, unnest(vec) AS x, CAST(unnest(range(0, 16)) AS INTEGER) AS i FROM vectors WHERE layer = 1) GROUP BY 1, 2", "vectors", doubles="weight")
def j1_groups(spark, sf):
    means = vec.mean_vector(vectors(spark, sf).filter("layer = 1"), "vec", "grp")
    return means.select("grp", F.posexplode("mean").alias("place", "weight"))


_FORECAST = "greatest(target_h1, 1e-10) / greatest(exp(greatest(-30, least(5, list_dot_product(x, w) + coalesce(level, (SELECT coalesce(avg(level), 0) FROM levels))))), 1e-10)"
_LOSSES = f"WITH RECURSIVE {_HAR_FIT}, levels AS (SELECT ticker, my - list_dot_product(mx, w) AS level FROM ({_MEANS}), fit) SELECT ticker, avg({_FORECAST} - ln({_FORECAST}) - 1) AS qlike, count(*) AS n FROM ({_HAR_ROWS}) LEFT JOIN levels USING (ticker), fit WHERE split = 'test' GROUP BY ticker"


@query("k1_model_losses", _LOSSES, "valid", doubles="qlike", digits=6)
def model_losses(spark, sf):
    """Mean QLIKE of the HAR forecast by ticker on test rows."""
    rows = models.complete(har_panel(spark, sf), models.FEATURE_SETS["har"], "target_h1")
    test = models.panel_forecast(rows, models.FEATURE_SETS["har"], "target_h1").filter("split = 'test'")
    return test.groupBy("ticker").agg(F.avg(qlike("target_h1", "prediction")).alias("qlike"), F.count("*").alias("n"))
