"""Evaluation: grouped rank correlations, clustered errors, ranking reports, bootstraps with repeatable draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.statistics import draw, pearson, rank_decile, spearman, student_p
from tidepanel.functions.windows import demeaned
from tidepanel.operators.ranking import numbered
from tidepanel.operators.replicates import replicate_rhos, replicate_sums


def within_rho_demeaned(df: DataFrame, x: str, y: str, key: str = "ticker") -> DataFrame:
    """n, rho, r: pooled Spearman and Pearson after each key's mean is taken off both."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.round(demeaned(x, key), 10).alias("x"), F.round(demeaned(y, key), 10).alias("y"))
    return spearman(d, "x", "y").join(F.broadcast(d.agg(pearson("x", "y").alias("r"))))


def within_rho_averaged(df: DataFrame, x: str, y: str, key: str = "ticker", least: int = 5) -> DataFrame:
    """groups, rho: the mean over keys of at least `least` rows of their own Spearman."""
    own = spearman(df, x, y, key).filter((F.col("n") >= least) & F.col("rho").isNotNull())
    return own.agg(F.count("*").alias("groups"), F.avg("rho").alias("rho"))


def clustered_slope(df: DataFrame, y: str, x: str, a: str = "ticker", b: str = "date") -> DataFrame:
    """beta, se, t, p, groups_a, groups_b of the standardised slope with errors clustered by a, by b and less by both."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    whole = rows.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"), F.covar_pop(x, y).alias("cxy"), F.count("*").alias("n"))
    z = rows.join(F.broadcast(whole)).select(a, b, "n", ((F.col(x) - F.col("mx")) / F.greatest("sx", F.lit(1e-12))).alias("z"), ((F.col(y) - F.col("my")) / F.greatest("sy", F.lit(1e-12))).alias("w"), (F.col("cxy") / F.greatest("sx", F.lit(1e-12)) / F.greatest("sy", F.lit(1e-12))).alias("beta"))
    s = z.withColumn("s", F.col("z") * (F.col("w") - F.col("beta") * F.col("z")))

    def meat(name: str, *keys: str) -> DataFrame:
        own = s.groupBy(*keys).agg(F.sum("s").alias("s"), F.first("n").alias("n"), F.first("beta").alias("beta"))
        g = F.count("*")
        scale = g / F.greatest(g - 1, F.lit(1)) * (F.first("n") - 1) / F.greatest(F.first("n") - 2, F.lit(1))
        return own.agg((scale * F.sum(F.col("s") * F.col("s"))).alias(f"m_{name}"), g.alias(f"g_{name}"), F.first("n").alias(f"n_{name}"), F.first("beta").alias(f"b_{name}"))

    # x is standardised, so the slope's bread is 1 / n and the constant is orthogonal
    all_ = meat("a", a).join(F.broadcast(meat("b", b))).join(F.broadcast(meat("c", a, b)))
    se = F.sqrt(F.greatest(F.col("m_a") + F.col("m_b") - F.col("m_c"), F.lit(0.0))) / F.col("n_a")
    out = all_.select(F.col("b_a").alias("beta"), se.alias("se"), (F.col("b_a") / F.greatest(se, F.lit(1e-12))).alias("t"), F.col("g_a").alias("groups_a"), F.col("g_b").alias("groups_b"))
    degrees = F.greatest(F.least("groups_a", "groups_b") - 1, F.lit(1))
    return out.select("beta", "se", "t", student_p("t", degrees).alias("p"), "groups_a", "groups_b")


def decile_report(df: DataFrame, score: str, label: str, id_: str, *keys: str) -> DataFrame:
    """keys, decile, n, mean_label by rank deciles of score, ties by id."""
    rows = numbered(df.select(*keys, score, id_, F.col(label).alias("_y")), [score, id_], *keys).withColumn("decile", rank_decile(F.col("_at"), F.col("_of")))
    return rows.groupBy(*keys, "decile").agg(F.count("*").alias("n"), F.avg("_y").alias("mean_label"))


def ranking(df: DataFrame, score: str, label: str, id_: str, *keys: str) -> DataFrame:
    """keys, spread of the top over the bottom decile's mean (of logs) and its exponential, rises between neighbours, rank
    correlation of decile means, and the share of the top decile by score that is in the top decile by label."""
    rows = numbered(df.select(*keys, score, label, id_), [score, id_], *keys)
    rows = numbered(rows.withColumn("decile", rank_decile(F.col("_at"), F.col("_of"))).drop("_at", "_of"), [label, id_], *keys)
    own = rank_decile(F.col("_at"), F.col("_of")) == 10
    deciles = rows.groupBy(*keys, "decile").agg(F.count("*").alias("n"), F.avg(label).alias("mean_label"), F.avg(own.cast("double")).alias("precision"))
    w = Window.partitionBy(*keys).orderBy("decile")
    steps = deciles.withColumn("_prev", F.lag("mean_label").over(w))
    shape = steps.groupBy(*keys).agg((F.max_by("mean_label", "decile") - F.min_by("mean_label", "decile")).alias("spread"), F.sum(F.when(F.col("mean_label") > F.col("_prev"), 1).otherwise(0)).alias("rises"), F.max(F.when(F.col("decile") == 10, F.col("precision"))).alias("precision"))
    return shape.withColumn("multiple", F.exp("spread")).join(spearman(deciles, "decile", "mean_label", *keys).drop("n").withColumnRenamed("rho", "decile_rho"), list(keys))


def evaluate_axis(df: DataFrame, score: str, label: str, domain: str, key: str = "ticker") -> DataFrame:
    """domain, rho, within_rho (after each key's mean within the domain is taken off both), and the mean of each over domains."""
    own = spearman(df, score, label, domain).select(domain, "rho")
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).select(domain, F.round(demeaned(score, domain, key), 10).alias("_s"), F.round(demeaned(label, domain, key), 10).alias("_l"))
    within = spearman(rows, "_s", "_l", domain).select(domain, F.col("rho").alias("within_rho"))
    both = own.join(within, domain)
    return both.join(F.broadcast(both.agg(F.avg("rho").alias("macro"), F.avg("within_rho").alias("macro_within"))))


def block_bootstrap(losses: DataFrame, value: str, order: str, block: int, reps: int, seed: int = 7, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, mean, low, high, p of moving-block resamples of short series (one row a date): 2.5 and 97.5 %, and (1 + #(<= 0)) / (reps + 1)."""
    series = losses.select(*keys, (F.row_number().over(Window.partitionBy(*(F.col(k) for k in keys)).orderBy(order)) - 1).cast("long").alias("i"), F.col(value).alias("_v"))
    n = series.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))
    plan = series.sparkSession.range(reps).withColumnRenamed("id", "rep").join(F.broadcast(n))
    starts = plan.select(*keys, "rep", "n", "mean", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block) - 1)).alias("slot"))
    starts = starts.withColumn("start", draw(seed, "rep", "slot", size=F.greatest(F.col("n") - block + 1, F.lit(1))))
    picks = starts.select(*keys, "rep", "n", "mean", "slot", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("k"), "start").filter(F.col("slot") * block + F.col("k") < F.col("n"))
    drawn = picks.select(*keys, "rep", "mean", (F.col("start") + F.col("k")).alias("i")).join(series, [*keys, "i"])
    means = drawn.groupBy(*keys, "rep").agg(F.avg("_v").alias("m"), F.first("mean").alias("mean"))
    return means.groupBy(*keys).agg(F.first("mean").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), ((1 + F.sum(F.when(F.round("m", 10) <= 0, 1).otherwise(0))) / (reps + 1)).alias("p"))


def bootstrap_rho(df: DataFrame, x: str, y: str, unit: str, reps: int, seed: int = 7) -> DataFrame:
    """low, high, reps of the Spearman over resamples of units."""
    rho = replicate_rhos(df, x, y, unit, reps, seed).filter("rho is not null")
    return rho.agg(F.percentile("rho", 0.025).alias("low"), F.percentile("rho", 0.975).alias("high"), F.count("*").alias("reps"))


def _resampled_pearsons(df: DataFrame, a: str, b: str, y: str, unit: str, reps: int, seed: int) -> DataFrame:
    """rep, _a, _b: correlations of a and of b with y over resamples, from each unit's moments, which a draw only adds up."""
    rows = df.agg(*(F.avg(c).alias(f"_m{c}") for c in (a, b, y)))  # sums about the means keep their digits
    less = lambda c: F.col(c) - F.col(f"_m{c}")
    centred = df.join(F.broadcast(rows)).select(unit, less(a).alias("_p"), less(b).alias("_q"), less(y).alias("_y"))
    terms = {"_n": F.lit(1.0), **{f"_{s}": F.col(f"_{s}") for s in "pqy"}, **{f"_{s}{t}": F.col(f"_{s}") * F.col(f"_{t}") for s, t in ("pp", "qq", "yy", "py", "qy")}}
    moments = centred.dropna().groupBy(unit).agg(*(F.sum(e).alias(n) for n, e in terms.items()))
    all_ = replicate_sums(moments, list(terms), unit, reps, seed)

    def r(s: str):
        own = lambda u, v, w: F.col("_n") * F.col(w) - F.col(u) * F.col(v)
        return F.try_divide(own(f"_{s}", "_y", f"_{s}y"), F.sqrt(F.greatest(own(f"_{s}", f"_{s}", f"_{s}{s}"), F.lit(0.0)) * F.greatest(own("_y", "_y", "_yy"), F.lit(0.0))))

    return all_.select("rep", r("p").alias("_a"), r("q").alias("_b"))


def bootstrap_difference(df: DataFrame, a: str, b: str, y: str, unit: str, reps: int, kind: str = "spearman", seed: int = 7) -> DataFrame:
    """mean, low, high, p of the correlation of a with y less that of b, over resamples of units."""
    if kind == "spearman":
        one = lambda s, n: replicate_rhos(df, s, y, unit, reps, seed).withColumnRenamed("rho", n)
        both = one(a, "_a").join(one(b, "_b"), "rep")
    else:
        both = _resampled_pearsons(df, a, b, y, unit, reps, seed)
    d = both.select(F.round(F.col("_a") - F.col("_b"), 10).alias("d")).filter("d is not null")
    return d.agg(F.avg("d").alias("mean"), F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"), ((1 + F.sum(F.when(F.col("d") <= 0, 1).otherwise(0))) / (F.count("*") + 1)).alias("p"))
