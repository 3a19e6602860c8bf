"""Window functions by session offset: a ticker's rows in date order, frames of rows."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalar import col, ratio


def by_ticker():
    """All ticker windows share this one, so one exchange and one sort serve them."""
    return Window.partitionBy("ticker").orderBy("date")


def shifted(x, k: int = 1, by=None) -> Column:
    """The value k sessions ago (ahead if negative)."""
    by = by or by_ticker()
    return F.lag(col(x), k).over(by) if k >= 0 else F.lead(col(x), -k).over(by)


def rolling_mean(x, n: int, least: int | None = None, by=None, skip: int = 0) -> Column:
    """Mean of the last n rows (ending skip rows back), null with fewer than least values."""
    x, frame = col(x), (by or by_ticker()).rowsBetween(-(n - 1) - skip, -skip)
    return F.when(F.count(x).over(frame) >= (least or n), F.avg(x).over(frame))


def forward_mean(x, start: int, n: int, by=None) -> Column:
    """Mean of n rows from start on, null unless all are there."""
    x, frame = col(x), (by or by_ticker()).rowsBetween(start, start + n - 1)
    return F.when(F.count(x).over(frame) == n, F.avg(x).over(frame))


def future_mean(x, n: int, by=None) -> Column:
    """Mean of what the next n rows hold."""
    return F.avg(col(x)).over((by or by_ticker()).rowsBetween(1, n))


def simple_return(x="close", by=None) -> Column:
    return ratio(x, shifted(x, 1, by)) - 1


def demeaned(x, *keys: str) -> Column:
    x = col(x)
    return x - F.avg(x).over(Window.partitionBy(*keys))
