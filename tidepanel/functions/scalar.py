"""Scalar rules: what is missing, floors that keep the missing missing, logs, ratios, splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed floors: variances in forecasts, variances in labels, returns.
EPS_FORECAST, EPS_LABEL, EPS_RETURN = 1e-10, 1e-12, 1e-6


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def known(x: Column | str) -> Column:
    """x with NaN and infinities as null; applied once at the scan."""
    x = col(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def at_least(x: Column | str, floor: float | Column) -> Column:
    """x raised to floor; null stays null, where greatest() would give the floor."""
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(floor) if not isinstance(floor, Column) else floor))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(col(a), col(b))


def log_of(x: Column | str) -> Column:
    """ln(x), null where x isn't positive."""
    x = col(x)
    return F.when(x > 0, F.ln(x))


def log_floored(x: Column | str, floor: float = EPS_FORECAST) -> Column:
    return F.ln(at_least(x, floor))


def log_shifted(x: Column | str, shift: float) -> Column:
    """ln(x + shift) for an x of 0 or more."""
    return log_of(col(x) + shift)


def split_of(when: Column | str, train_end, val_end) -> Column:
    """train up to train_end, val up to val_end, else test."""
    when = col(when)
    return F.when(when <= F.lit(train_end).cast("timestamp_ntz"), "train").when(when <= F.lit(val_end).cast("timestamp_ntz"), "val").otherwise("test")
