"""Panel features: returns, HAR terms, controls, lags, MIDAS terms, pre and post windows, centring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import vectors
from tidepanel.functions.scalar import EPS_FORECAST, EPS_RETURN, at_least, known, log_floored, log_of, log_shifted, ratio
from tidepanel.functions.windows import by_ticker, demeaned, forward_mean, future_mean, rolling_mean, shifted, simple_return

#: Fixed grid of MIDAS terms.
MIDAS_LAGS, MIDAS_THETAS = (30, 50, 80), (1.0, 2.0, 4.0, 6.0, 8.0, 10.0)


def close_variance(kind: str = "simple", by=None) -> Column:
    """Squared return of the close: simple, or log as labels take it."""
    return F.pow(simple_return("close", by), 2) if kind == "simple" else F.pow(log_of(ratio("close", shifted("close", 1, by))), 2)


def har_features(df: DataFrame, variance: str, origin: str = "end_of_day", by=None) -> DataFrame:
    """df with har_d, har_w, har_m, target_h1 and target_h5 of a variance column.

    end_of_day knows today's value and aims at the next sessions; session_open knows yesterday's and aims from today on.
    """
    late = origin == "end_of_day"
    skip, weekly, monthly, start = (0, 3, 10, 1) if late else (1, 5, 22, 0)
    return df.select(
        "*",
        log_floored(shifted(variance, skip, by)).alias("har_d"),
        log_floored(rolling_mean(variance, 5, weekly, by, skip)).alias("har_w"),
        log_floored(rolling_mean(variance, 22, monthly, by, skip)).alias("har_m"),
        forward_mean(variance, start, 1, by).alias("target_h1"),
        forward_mean(variance, start, 5, by).alias("target_h5"),
    )


def market_controls(df: DataFrame, origin: str = "end_of_day") -> DataFrame:
    """df with absolute and negative return (at most 0), 20-session momentum and log volume (1 at least)."""
    k = 0 if origin == "end_of_day" else 1
    df = df.withColumn("_r", simple_return())
    r = shifted("_r", k) if k else F.col("_r")
    momentum = ratio(shifted("close", k) if k else F.col("close"), shifted("close", 20 + k)) - 1
    volume = at_least(shifted("volume", k) if k else F.col("volume"), 1.0)
    return df.select("*", F.abs(r).alias("x_abs_return"), F.when(r.isNotNull(), F.least(r, F.lit(0.0))).alias("x_negative_return"), momentum.alias("x_momentum20"), F.ln(volume).alias("x_log_volume")).drop("_r")


def market_har(df: DataFrame, benchmark: str | None = None) -> DataFrame:
    """df with market_har_d, market_har_w and market_har_m: the date's means over tickers, or the benchmark ticker's own terms."""
    terms = ("har_d", "har_w", "har_m")
    rows = df.groupBy("date").agg(*(F.avg(c).alias(f"market_{c}") for c in terms)) if benchmark is None else df.filter(F.col("ticker") == benchmark).select("date", *(F.col(c).alias(f"market_{c}") for c in terms))
    return df.join(rows, "date", "left")


def lag_array(x: str, k: int, by=None, skip: int = 0) -> Column:
    """The last k values, newest first, nulls in place; null in front of the first row."""
    boxed = F.collect_list(F.struct(F.col(x).alias("v"))).over((by or by_ticker()).rowsBetween(-(k - 1) - skip, -skip))
    held = F.transform(F.reverse(boxed), lambda s: s["v"])
    return F.concat(held, F.array_repeat(F.lit(None).cast("double"), F.lit(k) - F.size(held)))


def log_lags(lags) -> Column:
    return F.transform(lags, lambda x: log_of(known(x)))


def beta_weights(k: int, theta: float) -> Column:
    """(1 - j / (k + 1)) ^ (theta - 1) for j of 1 to k, summing to one: constants, so a literal array."""
    raw = [(1 - j / (k + 1)) ** (theta - 1) for j in range(1, k + 1)]
    return F.array(*(F.lit(w / sum(raw)) for w in raw))


def midas_term(lags: str, k: int, theta: float) -> Column:
    """Log of the beta-weighted sum of the first k lags; null if one of them is missing or not positive."""
    first = F.slice(lags, 1, k)
    bad = F.exists(first, lambda x: F.coalesce(known(x) <= 0, F.lit(True)))
    return F.when(~bad & (F.size(first) == k), log_of(vectors.dot(first, beta_weights(k, theta))))


def pre_post(df: DataFrame, variance: str, pre: int = 20, post: int = 5, include_event: bool = False, post_start: int = 1, by=None) -> DataFrame:
    """df with strict pre and post means; the event session is in pre if include_event, post begins post_start on."""
    return df.select("*", rolling_mean(variance, pre, pre, by, 0 if include_event else 1).alias("pre"), forward_mean(variance, post_start, post, by).alias("post"))


def market_pre_post(df: DataFrame, variance: str, pre: int = 20, post: int = 5, include_event: bool = False, post_start: int = 1) -> DataFrame:
    """date, market_pre, market_post of the equal-weight mean over tickers: one row for each date, so one small series."""
    series = df.groupBy("date").agg(F.avg(variance).alias(variance))
    by = Window.orderBy("date")
    return pre_post(series, variance, pre, post, include_event, post_start, by).select("date", F.col("pre").alias("market_pre"), F.col("post").alias("market_post"))


def first_of_date(df: DataFrame, *order: str) -> DataFrame:
    """One row for each ticker and date: the first by order."""
    w = Window.partitionBy("ticker", "date").orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def two_way_demeaned(df: DataFrame, x: str, a: str = "ticker", b: str = "date", rounds: int = 20, cut: int = 5) -> DataFrame:
    """x less its means by a and by b in turn; lineage is cut by a checkpoint every few rounds."""
    from tidepanel.sources.sinks import checkpointed

    for i in range(rounds):
        df = df.withColumn(x, demeaned(x, a)).withColumn(x, demeaned(x, b))
        if i % cut == cut - 1:
            df = checkpointed(df)
    return df


def train_centred(df: DataFrame, x: str, key: str = "ticker") -> DataFrame:
    """df with x_centred: x less its key's mean over training rows, or less the mean of all of them for an unseen key."""
    train = df.filter("split = 'train'")
    means = train.groupBy(key).agg(F.avg(x).alias("_own"))
    overall = train.agg(F.avg(x).alias("_all"))
    return df.join(means, key, "left").join(F.broadcast(overall)).withColumn(f"{x}_centred", F.col(x) - F.coalesce("_own", "_all")).drop("_own", "_all")


def market_features(df: DataFrame) -> DataFrame:
    """The complete panel of features and targets of valid bars, 32 added columns but the split."""
    from tidepanel.functions.estimators import parkinson

    df = df.select("*", simple_return().alias("ret0"), parkinson().alias("hist_range_d")).withColumn("hist_var_d", F.pow("ret0", 2))
    r = F.col("ret0")
    df = df.select(
        "*",
        *(rolling_mean(f"hist_{s}_d", n, m).alias(f"hist_{s}_{c}") for s in ("var", "range") for c, n, m in (("w", 5, 3), ("m", 22, 10))),
        F.abs(r).alias("current_abs_return"),
        at_least(-r, 0.0).alias("current_negative_return"),
        (ratio("close", shifted("close", 20)) - 1).alias("momentum20"),
        shifted("ret0", -1).alias("fwd_ret1"),
        *(e for s in ("var", "range") for e in (shifted(f"hist_{s}_d", -1).alias(f"target_{s}_h1"), future_mean(f"hist_{s}_d", 5).alias(f"target_{s}_h5"))),
    )
    date = Window.partitionBy("date")
    df = df.withColumn("market_fwd_ret1", F.avg("fwd_ret1").over(date))
    df = df.withColumn("abret1", F.col("fwd_ret1") - F.col("market_fwd_ret1"))
    df = df.select("*", log_shifted(F.abs("abret1"), EPS_RETURN).alias("log_abs_abret1"), log_shifted("target_var_h5", EPS_FORECAST).alias("log_rv5"), log_shifted("target_range_h5", EPS_FORECAST).alias("log_range5"), *(log_shifted(f"hist_{s}_{c}", EPS_FORECAST).alias(f"log_hist_{s}_{c}") for s in ("var", "range") for c in "dwm"))
    return df.select("*", *((F.col(c) - F.avg(c).over(date)).alias(f"market_adjusted_{c}") for c in ("log_rv5", "log_range5")), *(F.avg(f"log_hist_var_{c}").over(date).alias(f"market_log_var_{c}") for c in "dwm"))
