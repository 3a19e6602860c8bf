"""Joins (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions.texts import EVENT_PATTERNS, event_flags
from tidepanel.operators import matching
from tidepanel.operators.audits import key_violations
from tidepanel.operators.panels import simple_return
from tidepanel.plans.panel import PK, R, W
from tidepanel.plans.registry import query
from tidepanel.sources.tables import bars, bars_xs, docs, read, valid_bars, vectors, with_split


@query("f1_panel_join_scores", "SELECT b.ticker, b.date, b.close, s.score FROM bars b JOIN (SELECT event_type AS ticker, date_trunc('hour', ts) AS date, max(user_id) AS score FROM events GROUP BY 1, 2) s ON b.ticker = s.ticker AND b.date = s.date", "bars", doubles="close")
def f1(spark, sf):
    from tidepanel.sources.tables import bucket

    scores = read(spark, sf, "events").groupBy(F.col("event_type").alias("ticker"), bucket("hour").alias("date")).agg(F.max("user_id").alias("score"))
    return bars(spark, sf).select("ticker", "date", "close").join(scores, ["ticker", "date"])


@query("f2_left_many_to_one", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderstatus, p_brand FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey")
def f2(spark, sf):
    urgent = read(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    lines = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return lines.join(urgent, "l_orderkey", "left").join(read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey", "left")


@query("f3_assert_key_cardinality", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def f3(spark, sf):
    return key_violations(read(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("f4_chained_lookup", "SELECT d.doc_id, l.quality, e.label AS direct FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN embeddings e ON l.doc_id = e.vec_id")
def f4(spark, sf):
    """Document to its label row, and from there to a score; null where a link is missing."""
    labels = read(spark, sf, "labels").select("doc_id", "quality", F.col("doc_id").alias("vec_id"))
    scores = read(spark, sf, "embeddings").select("vec_id", F.col("label").alias("direct"))
    return read(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left").join(scores, "vec_id", "left").select("doc_id", "quality", "direct")


FORWARD = f"SELECT ticker, date, CASE WHEN count(*) OVER f = 5 THEN avg({PK}) OVER f END AS value FROM valid WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)"


@query("f5_asof_forward_window", f"SELECT event_id, s.date AS session, s.value FROM events e ASOF LEFT JOIN ({FORWARD}) s ON e.event_type = s.ticker AND e.ts <= s.date", "valid", doubles="value")
def f5(spark, sf):
    events = read(spark, sf, "events").select("event_id", F.col("event_type").alias("ticker"), F.col("ts").alias("date"))
    return matching.forward_parkinson(events, valid_bars(bars(spark, sf))).select("event_id", "session", "value")


@query("f6_market_adjusted_return", f"SELECT ticker, date, r - avg(r) FILTER (ticker <> 'error') OVER (PARTITION BY date) AS adjusted, ln(abs(r - avg(r) FILTER (ticker <> 'error') OVER (PARTITION BY date)) + 1e-6) AS log_abs FROM (SELECT ticker, date, {R} AS r FROM valid {W})", "valid", doubles="adjusted log_abs", digits=6)
def f6(spark, sf):
    rows = valid_bars(bars(spark, sf)).select("ticker", "date", simple_return().alias("r"))
    return matching.market_adjusted(rows, "r", exclude=("error",)).select("ticker", "date", "adjusted", "log_abs")


FLAGS = ", ".join(f"CAST(regexp_matches(lower(text), '{p}') AS INTEGER)" for p in EVENT_PATTERNS.values())


@query("f7_matched_pairs", f"WITH e AS (SELECT *, [{FLAGS}] AS flags FROM docs) SELECT high_id, arg_min(low_id, {{'d': dist, 'l': low_id}}) AS low_id, min(dist) AS distance FROM (SELECT h.doc_id AS high_id, l.doc_id AS low_id, abs(h.date - l.date) / 365.0 + list_avg(list_transform(range(1, 8), lambda i: CAST(abs(h.flags[i] - l.flags[i]) AS DOUBLE))) + 0.25 * abs(ln(h.n_chars + 1) - ln(l.n_chars + 1)) AS dist FROM e h JOIN e l ON h.ticker = l.ticker WHERE h.n_chars >= (SELECT quantile_cont(n_chars, 0.75) FROM docs) AND l.n_chars <= (SELECT quantile_cont(n_chars, 0.25) FROM docs)) GROUP BY high_id", "docs", doubles="distance")
def f7(spark, sf):
    """Distance: years apart, mean difference of the event flags, and a quarter of the difference in log size."""
    rows = docs(spark, sf).select(F.col("doc_id").alias("id"), "ticker", F.unix_date("date").alias("day"), "n_chars", "text")
    return matching.matched_pairs(rows, "n_chars", ["ticker"], ("day", 1 / 365), (F.ln(F.col("n_chars") + 1), 0.25), lambda: event_flags("text"))


_TOKENS = "list_distinct(regexp_extract_all(regexp_replace(lower(text), '\\s+', ' ', 'g'), '[a-z0-9]+'))"
#: In order of date and id, each document meets the earlier ones of its language: a walk keeps those that no kept one is near.
_F8 = (
    f"WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, lang, date, {_TOKENS} AS w, row_number() OVER (ORDER BY date, doc_id) AS i FROM docs), "
    "e AS MATERIALIZED (SELECT a.i, list(b.i) AS near FROM t a JOIN t b ON a.lang = b.lang AND b.i < a.i AND a.date - b.date <= 7 AND len(a.w) > 0 AND len(b.w) >= 0.92 * len(a.w) - 1e-9 AND len(a.w) >= 0.92 * len(b.w) - 1e-9 WHERE len(list_intersect(a.w, b.w)) >= 0.92 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) - 1e-9 GROUP BY a.i), "
    "s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY i) AS k, i, near FROM e), "
    "walk AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone UNION ALL SELECT s.k, CASE WHEN len(list_filter(s.near, lambda n: NOT list_contains(gone, n))) > 0 THEN list_append(gone, s.i) ELSE gone END FROM walk JOIN s ON s.k = walk.k + 1) "
    "SELECT doc_id, list_contains((SELECT gone FROM walk ORDER BY k DESC LIMIT 1), i) AS duplicate FROM t"
)


@query("f8_near_duplicates", _F8, "docs")
def f8(spark, sf):
    rows = docs(spark, sf).select("doc_id", F.col("lang").alias("ticker"), "date", "text")
    return matching.near_duplicates(rows)


@query("f9_semi_split", "SELECT ticker, date, close FROM split_bars b WHERE split IN ('val', 'test') AND EXISTS (SELECT 1 FROM events e WHERE e.event_type = b.ticker AND date_trunc('hour', e.ts) = b.date AND e.value >= 75)", "split_bars", doubles="close")
def f9(spark, sf):
    from tidepanel.sources.tables import bucket

    some = read(spark, sf, "events").filter("value >= 75").select(F.col("event_type").alias("ticker"), bucket("hour").alias("date"))
    return with_split(valid_bars(bars(spark, sf))).filter(F.col("split").isin("val", "test")).join(some, ["ticker", "date"], "left_semi").select("ticker", "date", "close")


@query("f1_cross_section_join", "SELECT x.ticker, x.date, x.close, v.vec[1] AS v1 FROM bars_xs x JOIN vectors v ON CAST(x.ticker AS BIGINT) = v.item_id WHERE v.layer = 1", "bars_xs", "vectors", doubles="close v1")
def f1_xs(spark, sf):
    one = vectors(spark, sf).filter("layer = 1").select(F.col("item_id").cast("string").alias("ticker"), F.get("vec", F.lit(0)).alias("v1"))
    return bars_xs(spark, sf).select("ticker", "date", "close").join(one, "ticker")
