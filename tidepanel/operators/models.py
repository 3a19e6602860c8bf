"""Linear models by sufficient statistics, and axes in vector space. Only k x k systems come to the driver."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import vectors
from tidepanel.functions.statistics import pearson, qlike, spearman
from tidepanel.operators.gram import products
from tidepanel.operators.ranking import quantiles

#: Column lists of forecast models; variance terms carry their own names.
FEATURE_SETS = {
    "ar5": [f"lag{k}" for k in range(1, 6)],
    "har": ["har_d", "har_w", "har_m"],
}
#: What HAR-X adds to HAR: the ticker's own controls, and the market's HAR terms.
CONTROLS = {"news": ["x_abs_return", "x_negative_return", "x_momentum20"], "filing": ["x_abs_return", "x_negative_return", "x_momentum20", "x_log_volume"]}
MARKET_TERMS = [f"market_{c}" for c in FEATURE_SETS["har"]]


def feature_sets(midas: str | None, domain: str = "news") -> dict[str, list[str]]:
    """The models of a domain with their columns: the fixed ones and, if one was selected, the MIDAS term."""
    harx = {"harx": [*FEATURE_SETS["har"], *CONTROLS[domain], *MARKET_TERMS]}
    return FEATURE_SETS | harx | ({"midas": [midas]} if midas else {})


def moments(df: DataFrame, features: list[str], target: str, *keys: str) -> DataFrame:
    """keys, n, sx (k sums), sy, syy, sxy (k), sxx (k x k by rows): all that a linear fit needs, in one aggregate."""
    x, y = [F.col(f).cast("double") for f in features], F.col(target).cast("double")
    sums = [F.count(F.lit(1)).alias("n"), F.array(*(F.sum(a) for a in x)).alias("sx"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.array(*(F.sum(a * y) for a in x)).alias("sxy"), F.array(*(F.sum(a * b) for a in x for b in x)).alias("sxx")]
    return df.groupBy(*keys).agg(*sums) if keys else df.agg(*sums)


def within_fit(df: DataFrame, features: list[str], target: str, group: str = "ticker", alpha: float = 0.0) -> tuple[np.ndarray, DataFrame, float]:
    """Coefficients of target on features with a free level for each group (alpha: ridge on the coefficients only).

    The group sums are subtracted inside Spark, so a k x k system is all that is collected. Also each group's level, and
    the unweighted mean level, which an unseen group takes.
    """
    k = len(features)
    by = moments(df, features, target, group)
    cross = [F.sum(F.get("sxx", F.lit(i * k + j)) - F.get("sx", F.lit(i)) * F.get("sx", F.lit(j)) / F.col("n")) for i in range(k) for j in range(k)]
    rhs = [F.sum(F.get("sxy", F.lit(i)) - F.get("sx", F.lit(i)) * F.col("sy") / F.col("n")) for i in range(k)]
    row = by.agg(F.array(*cross).alias("a"), F.array(*rhs).alias("b")).first()
    a, b = (np.nan_to_num(np.array(row[c], float)) for c in ("a", "b"))  # no rows: no slope
    a = a.reshape(k, k)
    w = np.linalg.lstsq(a + alpha * np.eye(k), b, rcond=None)[0]
    level = F.col("sy") / F.col("n")
    for i, c in enumerate(w.tolist()):
        level = level - F.lit(c) * F.get("sx", F.lit(i)) / F.col("n")
    levels = by.select(group, level.alias("level"))
    mean = levels.agg(F.avg("level")).first()[0]
    return w, levels, float(mean or 0.0)


def linear(features: list[str], w) -> Column:
    return sum((F.col(f) * float(c) for f, c in zip(features, w, strict=True)), F.lit(0.0))


def panel_forecast(df: DataFrame, features: list[str], target: str, fit_splits: tuple[str, ...] = ("train", "val"), clip: tuple[float, float] | None = (-30.0, 5.0), group: str = "ticker") -> DataFrame:
    """df with prediction: the exponential of a within-group fit of ln(target) on rows of fit_splits, logs clipped."""
    fit = df.filter(F.col("split").isin(*fit_splits)).withColumn("_y", F.ln(target))
    w, levels, unseen = within_fit(fit, features, "_y", group)
    log = linear(features, w) + F.coalesce("level", F.lit(unseen))
    log = F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), log)) if clip else log
    return df.join(levels, group, "left").withColumn("prediction", F.exp(log)).drop("level")


def complete(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Rows where all columns are known and the target is positive: one sample for all models that are compared."""
    return df.dropna(subset=[*columns, target]).filter(F.col(target) > 0)


def select_midas(df: DataFrame, candidates: list[str], target: str, clip: tuple[float, float] = (-30.0, 5.0), group: str = "ticker") -> tuple[str | None, DataFrame]:
    """The candidate term of least validation QLIKE (each on its own complete sample), and the table of all.

    Sums of all candidates are columns of one aggregate by group over the training rows, and their losses of another over
    the validation rows.
    """
    y = F.ln(target)
    sums = []
    for i, c in enumerate(candidates):
        x = F.when(F.col(target) > 0, F.col(c).cast("double"))
        known = F.when(x.isNotNull(), y)
        sums += [F.count(x).alias(f"n{i}"), F.sum(x).alias(f"x{i}"), F.sum(known).alias(f"y{i}"), F.sum(x * x).alias(f"xx{i}"), F.sum(x * known).alias(f"xy{i}")]
    by = df.filter("split = 'train'").groupBy(group).agg(*sums)
    part = lambda i, a, b: F.sum(F.col(f"{a}{b}{i}") - F.try_divide(F.col(f"{a}{i}") * F.col(f"{b}{i}"), F.col(f"n{i}")))
    row = by.agg(*(F.try_divide(part(i, "x", "y"), part(i, "x", "x")).alias(f"w{i}") for i in range(len(candidates)))).first()
    slopes = [float(w or 0.0) for w in row]
    levels = by.select(group, *(F.try_divide(F.col(f"y{i}") - w * F.col(f"x{i}"), F.col(f"n{i}")).alias(f"_l{i}") for i, w in enumerate(slopes)))
    unseen = [float(v or 0.0) for v in levels.agg(*(F.avg(f"_l{i}") for i in range(len(candidates)))).first()]
    rows = df.filter("split = 'val'").join(levels, group, "left")
    losses = []
    for i, (c, w) in enumerate(zip(candidates, slopes, strict=True)):
        log = F.col(c) * w + F.coalesce(f"_l{i}", F.lit(unseen[i]))
        loss = F.when((F.col(target) > 0) & F.col(c).isNotNull(), qlike(target, F.exp(F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), log)))))
        losses.append(F.struct(F.lit(c).alias("candidate"), F.count(loss).alias("n"), F.avg(loss).alias("qlike")))
    out = rows.agg(F.array(*losses).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    best = out.filter("n > 0").orderBy("qlike", "candidate").first()
    return best["candidate"] if best else None, out


def ridge(df: DataFrame, features: str, target: str, alpha: float) -> np.ndarray:
    """Coefficients that minimise the squared error plus alpha times their squares, level free: Spark's own solver.

    Its penalty is on a target scaled to unit deviation, so regParam is alpha * deviation / n.
    """
    rows = df.select(array_to_vector(features).alias("features"), F.col(target).cast("double").alias("label")).filter("label is not null")
    n, dev = rows.agg(F.count("*"), F.stddev_pop("label")).first()
    model = LinearRegression(solver="normal", standardization=False, elasticNetParam=0.0, regParam=alpha * dev / n).fit(rows)
    return np.array(model.coefficients.toArray())


def unit_axis(w: np.ndarray) -> np.ndarray:
    return w / max(float(np.linalg.norm(w)), 1e-8)


def axis_column(w: np.ndarray) -> Column:
    return F.array(*(F.lit(float(x)) for x in w))


def score(df: DataFrame, vec: str, w: np.ndarray, alias: str = "score") -> DataFrame:
    return df.withColumn(alias, vectors.dot(vec, axis_column(w)))


def contrast_axis(df: DataFrame, vec: str, target: str, group: str | None = None) -> np.ndarray:
    """Mean vector of the top quarter less that of the bottom quarter, by group and averaged if one is named."""
    keys = [group] if group else []
    cut = quantiles(df, target, [0.25, 0.75], *keys).withColumnRenamed("q", "_q")
    rows = df.join(cut, keys) if keys else df.join(F.broadcast(cut))  # one row
    side = F.when(F.col(target) >= F.col("_q")[1], "high").when(F.col(target) <= F.col("_q")[0], "low")
    means = vectors.mean_vector(rows.withColumn("_side", side).filter("_side is not null"), vec, *keys, "_side").collect()  # two for each group
    by: dict = {}
    for r in means:
        by.setdefault(r[group] if group else None, {})[r["_side"]] = np.array(r["mean"])
    return unit_axis(np.mean([unit_axis(v["high"] - v["low"]) if group else v["high"] - v["low"] for v in by.values() if len(v) == 2], axis=0))


def logistic_axis(df: DataFrame, vec: str, target: str, penalty: float = 1e-4, weight: str | None = None) -> np.ndarray:
    """Direction that parts the top from the bottom quarter, by Spark's logistic regression."""
    low, high = quantiles(df, target, [0.25, 0.75]).first()["q"]
    rows = df.filter((F.col(target) >= high) | (F.col(target) <= low)).select(array_to_vector(vec).alias("features"), (F.col(target) >= high).cast("double").alias("label"), (F.col(weight) if weight else F.lit(1.0)).alias("w"))
    model = LogisticRegression(regParam=penalty, elasticNetParam=0.0, standardization=False, weightCol="w", maxIter=100).fit(rows)
    return unit_axis(np.array(model.coefficients.toArray()))


def gram(df: DataFrame, vec: str, targets: list[str]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """n, centred Gram matrix of vec, and centred products with each target: one distributed pass for all alphas."""
    found = products(df, F.concat(F.col(vec), F.array(*(F.col(t).cast("double") for t in targets)), F.array(F.lit(1.0))))
    whole = found[()] if found else np.zeros((len(targets) + 1,) * 2)
    n = max(whole[-1, -1], 1.0)
    centred = whole[:-1, :-1] - np.outer(whole[-1, :-1], whole[-1, :-1]) / n
    k = centred.shape[0] - len(targets)
    return int(whole[-1, -1]), centred[:k, :k], centred[:k, k:], whole[-1, :-1] / n


def first_direction(df: DataFrame, vec: str) -> np.ndarray:
    """First right singular vector of the rows, uncentred, signed by their mean: the products' first eigenvector."""
    v = np.linalg.eigh(products(df, F.col(vec))[()])[1][:, -1]
    mean = np.array(vectors.mean_vector(df, vec).first()["mean"])
    return unit_axis(v if v @ mean >= 0 else -v)


def oriented(df: DataFrame, vec: str, w: np.ndarray, target: str) -> np.ndarray:
    """w, turned round if its training scores fall as the target rises."""
    rho = spearman(score(df.filter("split = 'train'"), vec, w), "score", target).first()["rho"]
    return -w if rho is not None and rho < 0 else w


def calibrated(df: DataFrame, vec: str, w: np.ndarray, group: str) -> DataFrame:
    """df with score and z_score: by group, less the training mean over the training deviation."""
    from tidepanel.operators.audits import train_standardised

    return train_standardised(score(df, vec, w), ["score"], group)


def nuisance_residual(df: DataFrame, target: str, numeric: list[str], kinds: list[str], alpha: float = 10.0) -> DataFrame:
    """df with residual: target less a training ridge on scaled numbers and one-hot kinds, over its training deviation.

    Every seen kind has a column and an unseen one is all zero.
    """
    from tidepanel.operators.audits import train_standardised

    df = train_standardised(df.withColumn("_all", F.lit(1)), numeric, "_all", 1e-12)
    train = df.filter("split = 'train'")
    indexer = StringIndexer(inputCols=kinds, outputCols=[f"_i_{k}" for k in kinds], handleInvalid="keep").fit(train)
    hot = OneHotEncoder(inputCols=[f"_i_{k}" for k in kinds], outputCols=[f"_h_{k}" for k in kinds], dropLast=True).fit(indexer.transform(train))
    assemble = VectorAssembler(inputCols=[*(f"z_{c}" for c in numeric), *(f"_h_{k}" for k in kinds)], outputCol="features")
    whole = assemble.transform(hot.transform(indexer.transform(df))).withColumn("_x", vector_to_array("features"))
    _, g, c, mean = gram(whole.filter("split = 'train'"), "_x", [target])
    w = np.linalg.solve(g + alpha * np.eye(len(g)), c[:, 0])
    level = float(mean[-1] - mean[:-1] @ w)
    out = whole.withColumn("_raw", F.col(target) - level - vectors.dot("_x", axis_column(w)))
    spread = out.filter("split = 'train'").agg(F.stddev_pop("_raw").alias("_dev"))
    return out.join(F.broadcast(spread)).withColumn("residual", F.col("_raw") / F.greatest("_dev", F.lit(1e-12)))


def fit_metrics(actual: str, predicted: str) -> list[Column]:
    """QLIKE, squared log error, R2 of logs and of values, and error size, as aggregates."""
    a, p = F.col(actual), F.col(predicted)
    la, lp = F.ln(F.greatest(a, F.lit(1e-10))), F.ln(F.greatest(p, F.lit(1e-10)))
    r2 = lambda y, f: 1 - F.try_divide(F.sum(F.pow(y - f, 2)), F.count(F.lit(1)) * F.var_pop(y))
    return [F.count("*").alias("n"), F.avg(qlike(a, p)).alias("qlike"), F.avg(F.pow(la - lp, 2)).alias("log_mse"), r2(la, lp).alias("log_r2"), F.avg(F.pow(a - p, 2)).alias("mse"), r2(a, p).alias("r2"), F.sqrt(F.avg(F.pow(a - p, 2))).alias("rmse"), pearson(a, p).alias("corr")]

