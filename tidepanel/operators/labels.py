"""Impact labels composed of estimators, windows and market averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.estimators import LABEL_ESTIMATORS
from tidepanel.functions.scalar import EPS_FORECAST, EPS_LABEL, EPS_RETURN, at_least, col, log_of, log_shifted, ratio
from tidepanel.operators.audits import train_standardised
from tidepanel.operators.ranking import quantiles
from tidepanel.operators.panels import close_variance, market_pre_post, pre_post


def impact_ratio(df: DataFrame, variance: str, include_event: bool = True, post_start: int = 1) -> DataFrame:
    """Ratio of volatility after and before, where both variances are over the floor."""
    rows = pre_post(df, variance, include_event=include_event, post_start=post_start).filter((F.col("pre") > EPS_LABEL) & (F.col("post") > EPS_LABEL))
    r = F.sqrt("post") / F.sqrt("pre")
    return rows.select("ticker", "date", r.alias("impact_ratio"), F.ln(r).alias("log_impact_ratio"))


def expansion_of(post, pre) -> Column:
    """Log growth of variance, both floored."""
    return log_of(ratio(at_least(post, EPS_LABEL), at_least(pre, EPS_LABEL)))


def market_adjusted_expansion(bars: DataFrame, estimator: str = "parkinson", post_start: int = 1) -> DataFrame:
    """ticker, date, firm_only, expansion: half the log growth of a ticker's variance, alone and less the market's.

    post_start is 1 for news (after the session) and 0 for filings (from the session on). Market terms are joined by date.
    """
    value = close_variance("log") if estimator == "close" else LABEL_ESTIMATORS[estimator]()
    rows = bars.select("ticker", "date", value.alias("v"))
    market = market_pre_post(rows, "v", post_start=post_start)
    firm = pre_post(rows, "v", post_start=post_start).join(market, "date")
    own, all_ = expansion_of("post", "pre"), expansion_of("market_post", "market_pre")
    return firm.select("ticker", "date", (0.5 * own).alias("firm_only"), (0.5 * (own - all_)).alias("expansion")).filter("expansion is not null")


def composite(df: DataFrame, parts: list[str], key: str) -> DataFrame:
    """df with composite: the mean of the parts' training z-scores within key."""
    z = train_standardised(df, parts, key)
    return z.withColumn("composite", sum((F.col(f"z_{p}") for p in parts), F.lit(0.0)) / len(parts))


def high_impact(df: DataFrame, x: str, q: float = 0.75, margin: float = 0.0) -> DataFrame:
    """df with high: x at or over its training quantile (plus a margin that keeps rounding from deciding)."""
    cut = quantiles(df.filter("split = 'train'"), x, [q]).select(F.get("q", F.lit(0)).alias("_cut"))
    return df.join(F.broadcast(cut)).withColumn("high", F.col(x) >= F.col("_cut") + margin).drop("_cut")


def raw_terms(abnormal, rv5, range5) -> list[Column]:
    """Log terms of an event: size of the abnormal return, realised variance of five sessions, Parkinson range."""
    return [log_shifted(F.abs(col(abnormal)), EPS_RETURN).alias("raw_absar1"), log_shifted(F.pow(col(rv5), 2) / 5, EPS_FORECAST).alias("raw_rv5"), log_shifted(range5, EPS_FORECAST).alias("raw_range5")]
