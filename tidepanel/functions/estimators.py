"""Range-based variance estimators of one bar, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepanel.functions.scalar import EPS_FORECAST, col, log_of, ratio

LN2 = math.log(2.0)


def parkinson(high="high", low="low", policy: str = "any") -> Column:
    """ln(h / l)^2 / (4 ln 2). policy: any; strict (h > l and a value over the floor); ordered (h >= l)."""
    value = F.pow(log_of(ratio(high, low)), 2) / (4 * LN2)
    if policy == "strict":
        return F.when((col(high) > col(low)) & (value > EPS_FORECAST), value)
    if policy == "ordered":
        return F.when(col(high) >= col(low), value)
    return value


def _policy(value: Column, policy: str) -> Column:
    """mask: null at the floor or under; clip: 0 under 0."""
    if policy == "mask":
        return F.when(value > EPS_FORECAST, value)
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0))) if policy == "clip" else value


def garman_klass(policy: str = "clip") -> Column:
    return _policy(0.5 * F.pow(log_of(ratio("high", "low")), 2) - (2 * LN2 - 1) * F.pow(log_of(ratio("close", "open")), 2), policy)


def rogers_satchell(policy: str = "clip") -> Column:
    part = lambda a, b: log_of(ratio(a, b))
    return _policy(part("high", "close") * part("high", "open") + part("low", "close") * part("low", "open"), policy)


def ohlc_mean() -> Column:
    return (parkinson() + garman_klass() + rogers_satchell()) / 3


LABEL_ESTIMATORS = {"parkinson": parkinson, "garman_klass": garman_klass, "rogers_satchell": rogers_satchell, "ohlc_mean": ohlc_mean}
