"""Calendar windows, splits by time, and the session that reacts to an event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalar import col


def month_windows(start, end) -> Column:
    """Calendar months clipped to start and end: an array of key, first, last."""
    start, end = col(start), col(end)
    months = F.sequence(F.trunc(start, "MM"), end, F.expr("interval 1 month"))
    return F.transform(months, lambda m: F.struct(F.date_format(m, "yyyy-MM").alias("key"), F.greatest(m, start).alias("first"), F.least(F.last_day(m), end).alias("last")))


def day_windows(start, end, days: int) -> Column:
    """Windows of at most days days, ends included."""
    start, end = col(start), col(end)
    return F.transform(F.sequence(start, end, F.expr(f"interval {days} days")), lambda d: F.struct(d.alias("first"), F.least(F.date_add(d, days - 1), end).alias("last")))


def each_day(start, end) -> Column:
    return F.sequence(col(start), col(end), F.expr("interval 1 day"))


def forward_session(events: DataFrame, sessions: DataFrame, key: str, date: str = "date", session: str = "session") -> DataFrame:
    """events with the first session of their key at or after their date; null if none follows.

    Both sides are stacked, latest first, and a running window holds the last session met, so no range join is made and the
    work is linear in a key's rows. sessions: key, session; other columns of it come along as a struct named at.
    """
    rest = [c for c in sessions.columns if c != key]
    a = events.select("*", F.lit(0).alias("_is"), F.lit(None).cast(sessions.select(F.struct(*rest).alias("s")).schema["s"].dataType).alias("at"), F.col(date).alias("_when"))
    b = sessions.select(key, *(F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns if c != key), F.lit(1).alias("_is"), F.struct(*rest).alias("at"), F.col(session).alias("_when"))
    back = Window.partitionBy(key).orderBy(F.desc("_when"), F.desc("_is")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b).withColumn("at", F.last("at", ignorenulls=True).over(back))
    return both.filter("_is = 0").drop("_is", "_when")


def reaction_date(ts, zone: str = "America/New_York", opens: str = "09:30") -> Column:
    """The local date of a UTC time before the opening, else the next day."""
    local = F.from_utc_timestamp(col(ts).cast("timestamp"), zone)
    return F.when(F.date_format(local, "HH:mm") < opens, F.to_date(local)).otherwise(F.date_add(F.to_date(local), 1))
