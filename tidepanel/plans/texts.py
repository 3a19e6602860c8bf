"""Projections, filters and text scalars (C)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions import texts as tx
from tidepanel.functions.scalar import known, log_shifted, ratio
from tidepanel.operators.audits import carried_closures
from tidepanel.operators.ranking import dense_ids
from tidepanel.plans.calendars import XS_CLOSED
from tidepanel.plans.registry import query
from tidepanel.sources.tables import bars, bars_xs, read, valid_bars


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query("c1_compact_text", f"SELECT o_orderkey, left(array_to_string(list_filter([{squeezed('o_orderpriority')}, CASE WHEN {squeezed('o_orderstatus')} <> {squeezed('o_orderpriority')} THEN {squeezed('o_orderstatus')} END], lambda p: p IS NOT NULL AND p <> ''), chr(10)), 12) AS text FROM orders")
def c1(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", tx.compact(["o_orderpriority", "o_orderstatus", "o_orderpriority", F.lit("  ")], 12).alias("text"))


@query("c2_normalized_text", f"SELECT doc_id, md5({squeezed('lower(text)')}) AS text_md5 FROM documents")
def c2(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(tx.normalized("text")).alias("text_md5"))


@query("c3_text_sha256", f"SELECT doc_id, sha256({squeezed('lower(text)')}) AS sha256 FROM documents")
def c3(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.sha2(tx.normalized("text"), 256).alias("sha256"))


@query("c4_content_hash64", "SELECT doc_id, count(*) OVER (PARTITION BY text) AS same FROM documents")
def c4(spark, sf):
    """How many documents share a text, by a 64-bit hash."""
    return read(spark, sf, "documents").select("doc_id", F.count("*").over(Window.partitionBy(F.xxhash64("text"))).alias("same"))


@query("c5_min_length_filter", "SELECT doc_id FROM documents WHERE length(text) >= 500")
def c5(spark, sf):
    return read(spark, sf, "documents").filter(F.length("text") >= 500).select("doc_id")


@query("c6_text_len", "SELECT doc_id, CAST(length(text) AS BIGINT) AS text_len FROM documents")
def c6(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("text_len"))


@query("c7_event_flags", "SELECT doc_id, " + ", ".join(f"CAST(regexp_matches(lower(text), '{p}') AS INTEGER) AS {n}" for n, p in tx.EVENT_PATTERNS.items()) + " FROM documents")
def c7(spark, sf):
    return read(spark, sf, "documents").select("doc_id", *tx.event_flags("text"))


MACRO = "(contains(lower(e), 'gdp') AND NOT contains(lower(e), 'gdpnow') AND NOT contains(lower(e), 'nowcast') OR " + " OR ".join(f"regexp_matches(e, '(?i){p}')" for p in tx.MACRO_PATTERNS) + ")"
#: Release names that a user's event number picks.
NAMES = ("Core CPI MoM (Dec)", "Non Farm Payrolls (Dec)", "ISM Services PMI (Jun)", "GDP Growth Rate QoQ Adv (Q1)", "Fed Interest Rate Decision", "Atlanta Fed GDPNow (Q4)", "FOMC Minutes", "CFTC Corn speculative net positions")
NAMED = "(SELECT *, [" + ", ".join(f"'{n}'" for n in NAMES) + "][event_id % 8 + 1] AS e, CASE WHEN user_id % 5 = 0 THEN 'DE' ELSE 'US' END AS country FROM events)"


def releases(spark, sf):
    """Events as calendar rows: a release name and a country."""
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("event_id") % 8).cast("int") + 1)
    return read(spark, sf, "events").withColumn("event", name).withColumn("country", F.when(F.col("user_id") % 5 == 0, "DE").otherwise("US"))


@query("c8_macro_event_filter", f"SELECT event_id, e AS event FROM {NAMED} WHERE {MACRO}")
def c8(spark, sf):
    return releases(spark, sf).filter(tx.is_macro("event")).select("event_id", "event")


@query("c9_finite_required", "SELECT ticker, date, ln(r) AS log_r FROM (SELECT ticker, date, close / nullif(lag(close) OVER w, 0) AS r FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE r > 0", "bars", doubles="log_r")
def c9(spark, sf):
    table = bars(spark, sf)
    r = ratio("close", F.lag("close").over(Window.partitionBy("ticker").orderBy("date")))
    logged = table.select("ticker", "date", F.when(r == 0, float("-inf")).otherwise(F.ln(r)).alias("log_r"))
    return logged.withColumn("log_r", known("log_r")).dropna(subset=["log_r"])


@query("c10_valid_ohlc", "SELECT ticker, date, close FROM valid", "valid", doubles="close")
def c10(spark, sf):
    return valid_bars(bars(spark, sf)).select("ticker", "date", "close")


@query("c11_dense_ids", "SELECT doc_id, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST) - 1 AS dense_id FROM documents")
def c11(spark, sf):
    """Ids from 0 in a stable order over all rows."""
    return dense_ids(read(spark, sf, "documents").select("source", "doc_id"), ["source", "doc_id"]).select("doc_id", "dense_id")


@query("c12_rescale_open", "SELECT b.ticker, b.date, b.open * b.close / nullif(r.ref, 0) AS open FROM bars b LEFT JOIN (SELECT ticker, date, close AS ref FROM bars WHERE volume >= 40) r ON b.ticker = r.ticker AND b.date = r.date", "bars", doubles="open")
def c12(spark, sf):
    """Opens scaled by close over a second source's close; missing where that is 0 or absent."""
    table = bars(spark, sf)
    ref = table.filter("volume >= 40").select("ticker", "date", F.col("close").alias("ref"))
    return table.join(ref, ["ticker", "date"], "left").select("ticker", "date", ratio(F.col("open") * F.col("close"), "ref").alias("open"))


@query("c13_safe_log_terms", "SELECT event_id, ln(value + 1e-10) AS log_value, ln(abs(value - 10) + 1e-6) AS log_gap FROM events", doubles="log_value log_gap")
def c13(spark, sf):
    return read(spark, sf, "events").select("event_id", log_shifted("value", 1e-10).alias("log_value"), log_shifted(F.abs(F.col("value") - 10), 1e-6).alias("log_gap"))


@query("c14_country_filter", f"SELECT event_id FROM {NAMED} WHERE country = 'US'")
def c14(spark, sf):
    return releases(spark, sf).filter("country = 'US'").select("event_id")


@query("c15_exclude_closures", f"SELECT ticker, date, close FROM bars_xs WHERE date NOT IN ({XS_CLOSED})", "bars_xs", doubles="close")
def c15(spark, sf):
    table = bars_xs(spark, sf)
    return table.join(carried_closures(table, 5, 0.95).filter("closed").select("date"), "date", "left_anti").select("ticker", "date", "close")
