"""Calendar, dates and splits (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions.scalar import split_of
from tidepanel.functions.windows import by_ticker
from tidepanel.operators import calendar as cal
from tidepanel.operators.audits import carried_closures
from tidepanel.plans.registry import query
from tidepanel.sources.tables import TRAIN_END, VAL_END, bars, bars_xs, read


def _spans(spark, sf):
    """First and last day on which a customer ordered."""
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))


SPANS = "(SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY 1)"


@query("b1_month_windows", f"SELECT o_custkey, strftime(m, '%Y-%m') AS key, greatest(CAST(m AS DATE), a) AS first, least(last_day(m), b) AS last FROM (SELECT o_custkey, a, b, unnest(generate_series(date_trunc('month', a), CAST(b AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM {SPANS})")
def b1(spark, sf):
    return _spans(spark, sf).select("o_custkey", F.inline(cal.month_windows("a", "b")))


@query("b2_day_windows", f"SELECT o_custkey, CAST(d AS DATE) AS first, least(CAST(d AS DATE) + 89, b) AS last FROM (SELECT o_custkey, b, unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 90 DAY)) AS d FROM {SPANS})")
def b2(spark, sf):
    return _spans(spark, sf).select("o_custkey", F.inline(cal.day_windows("a", "b", 90)))


@query("b3_day_sequence", "SELECT user_id, count(*) AS days FROM (SELECT user_id, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS d FROM (SELECT user_id, date_trunc('day', min(ts)) AS a, date_trunc('day', max(ts)) AS b FROM events GROUP BY 1)) GROUP BY 1")
def b3(spark, sf):
    spans = read(spark, sf, "events").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    return spans.select("user_id", F.explode(cal.each_day("a", "b")).alias("d")).groupBy("user_id").agg(F.count("*").alias("days"))


@query("b4_assign_split", "SELECT ticker, date, CASE WHEN date <= TIMESTAMP '2024-01-15' THEN 'train' WHEN date <= TIMESTAMP '2024-01-22' THEN 'val' ELSE 'test' END AS split FROM bars", "bars")
def b4(spark, sf):
    return bars(spark, sf).select("ticker", "date", split_of("date", TRAIN_END, VAL_END).alias("split"))


@query("b5_event_month", "SELECT o_orderkey, strftime(o_orderdate, '%m') AS event_month FROM orders")
def b5(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM").alias("event_month"))


def _sessions(spark, sf):
    """Days of a user with an event, as sessions."""
    return read(spark, sf, "events").filter("event_type = 'purchase'").select("user_id", F.to_date("ts").alias("session")).distinct()


@query("b6_reaction_session", "SELECT event_id, (SELECT min(s.session) FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS session FROM events WHERE event_type = 'purchase') s WHERE s.user_id = e.user_id AND s.session >= e.d) AS session FROM (SELECT event_id, user_id, CASE WHEN strftime(ts - INTERVAL 5 HOUR, '%H:%M') < '09:30' THEN CAST(ts - INTERVAL 5 HOUR AS DATE) ELSE CAST(ts - INTERVAL 5 HOUR AS DATE) + 1 END AS d FROM events WHERE event_type = 'error') e")
def b6(spark, sf):
    errors = read(spark, sf, "events").filter("event_type = 'error'").select("event_id", "user_id", cal.reaction_date("ts").alias("date"))
    return cal.forward_session(errors, _sessions(spark, sf), "user_id").select("event_id", F.col("at.session").alias("session"))


@query("b7_naive_time", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def b7(spark, sf):
    return read(spark, sf, "events").select("event_id", F.to_date(F.col("ts").cast("timestamp_ntz")).alias("day"))


XS_CLOSED = "SELECT date FROM (SELECT date, sum(c) AS n, sum(u) AS same FROM (SELECT date, CASE WHEN p IS NOT NULL THEN 1 ELSE 0 END AS c, CASE WHEN abs(close - p) <= 1e-12 AND abs(open - o) <= 1e-12 AND abs(high - h) <= 1e-12 AND abs(low - l) <= 1e-12 THEN 1 ELSE 0 END AS u FROM (SELECT *, lag(close) OVER w AS p, lag(open) OVER w AS o, lag(high) OVER w AS h, lag(low) OVER w AS l FROM bars_xs WINDOW w AS (PARTITION BY ticker ORDER BY date))) GROUP BY date) WHERE n >= 5 AND same >= 0.95 * n"


@query("b8_next_session_target", f"SELECT ticker, date, lead(date) OVER (PARTITION BY ticker ORDER BY date) AS target FROM bars_xs WHERE date NOT IN ({XS_CLOSED})", "bars_xs")
def b8(spark, sf):
    table = bars_xs(spark, sf)
    closed = carried_closures(table, 5, 0.95).filter("closed").select("date")
    return table.join(closed, "date", "left_anti").select("ticker", "date", F.lead("date").over(by_ticker()).alias("target"))
