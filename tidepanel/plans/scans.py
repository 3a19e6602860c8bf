"""Sources and sinks (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.operators.audits import shard_report
from tidepanel.plans.registry import query
from tidepanel.sources import envelopes, sinks
from tidepanel.sources.tables import bars, docs, read, vectors


@query("a1_scan_bars", "SELECT ticker, date, open, high, low, close, volume FROM bars", "bars", doubles="open high low close volume")
def a1(spark, sf):
    return bars(spark, sf)


def _envelopes(spark, sf):
    """Events of a day as an envelope; every seventh day's lacks its data."""
    day = F.date_format("ts", "yyyy-MM-dd")
    packed = read(spark, sf, "events").groupBy(day.alias("day"), (F.col("event_id") % 64).alias("part")).agg(F.collect_list(F.struct("event_id", "value")).alias("data"))
    whole = F.to_json(F.struct(F.struct(F.col("day").alias("endpoint"), F.lit("").alias("retrieved_at_utc"), F.size("data").cast("long").alias("response_count")).alias("_meta"), "data"))
    cut = F.to_json(F.struct(F.struct(F.col("day").alias("endpoint")).alias("_meta")))
    return packed.select("day", F.when(F.dayofmonth(F.to_date("day")) % 7 == 0, cut).otherwise(whole).alias("value"))


@query("a2_scan_envelope_json", "SELECT strftime(ts, '%Y-%m-%d') AS endpoint, event_id, value FROM events WHERE day(ts) % 7 <> 0", doubles="value")
def a2(spark, sf):
    """Envelopes written to gzip files, one a line, and read again."""
    path = sinks.lines(_envelopes(spark, sf).select("value"), compression="gzip")
    return envelopes.read_envelopes(spark, path, "event_id: bigint, value: double", whole=False)


@query("a3_scan_ndjson", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def a3(spark, sf):
    """Objects written one a line, every fifth with a blank line after it, and read again."""
    one = F.to_json(F.struct("event_id", F.from_json("props", "k bigint")["k"].alias("k")))
    path = sinks.lines(read(spark, sf, "events").select(F.concat(one, F.when(F.col("event_id") % 5 == 0, "\n").otherwise("")).alias("value")))
    return envelopes.read_ndjson(spark, path, "event_id bigint, k bigint")


@query("a4_sink_tables", "SELECT kind, count(*) AS n, sum(close) AS total FROM bars, (SELECT unnest(['parquet', 'csv', 'json']) AS kind) GROUP BY kind", "bars", doubles="total", digits=4)
def a4(spark, sf):
    table, out = bars(spark, sf), None
    for kind in ("parquet", "csv", "json"):
        path = sinks.written(table, kind, "ticker")
        back = spark.read.format(kind).option("header", True).schema("date timestamp_ntz, open double, high double, low double, close double, volume double, ticker string").load(path)
        one = back.groupBy(F.lit(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum("close").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


@query("a5_gather_vectors", "SELECT doc_id, vec[1] AS first, vec[16] AS last FROM docs JOIN vectors ON doc_id = item_id WHERE layer = 3", "docs", "vectors", doubles="first last")
def a5(spark, sf):
    return docs(spark, sf).join(vectors(spark, sf).filter("layer = 3"), F.col("doc_id") == F.col("item_id")).select("doc_id", F.get("vec", F.lit(0)).alias("first"), F.get("vec", F.lit(15)).alias("last"))


@query("a6_shard_union_check", "SELECT d.doc_id % 4 AS shard, count(l.doc_id) AS n, count(*) - count(l.doc_id) AS uncovered, count(l.doc_id) = 0 AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def a6(spark, sf):
    """Which documents the shards of the labels cover."""
    shards = read(spark, sf, "labels").select("doc_id", F.pmod("doc_id", F.lit(4)).alias("shard"))
    return shard_report(read(spark, sf, "documents").select("doc_id"), shards, "doc_id", 4)


@query("a7_missing_windows", "SELECT u.user_id, d.day FROM (SELECT DISTINCT user_id FROM events) u, (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS day) d WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND CAST(e.ts AS DATE) = d.day)")
def a7(spark, sf):
    """Planned user days that no event covers yet."""
    seen = read(spark, sf, "events").select("user_id", F.to_date("ts").alias("day")).distinct()
    planned = seen.select("user_id").distinct().select("user_id", F.explode(F.expr("sequence(date'2024-01-01', date'2024-01-30', interval 1 day)")).alias("day"))
    return planned.join(seen, ["user_id", "day"], "left_anti")


#: Events of a kind and a day that share an envelope, about.
PACKED = 500
_PARTS = f"(SELECT greatest(1, count(*) // {150 * PACKED}) FROM events)"


def stored(spark, sf) -> str:
    """The events as gzip files of one envelope each, in folders by kind and day; returns the path."""
    events = read(spark, sf, "events")
    parts = max(1, events.count() // (150 * PACKED))
    packed = events.groupBy(F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("event_id") % parts).alias("part")).agg(F.collect_list(F.struct("event_id", "value")).alias("data"), F.sum(F.octet_length("props")).alias("size"))
    meta = F.struct(F.col("kind").alias("endpoint"), F.lit("").alias("retrieved_at_utc"), F.size("data").cast("long").alias("response_count"), F.col("size").alias("downloaded_bytes"))
    return sinks.lines(packed.select("kind", "day", F.to_json(F.struct(meta.alias("_meta"), "data")).alias("value")), "gzip", ("kind", "day"), True)


@query("a2_scan_envelope_files", "SELECT event_type AS endpoint, event_id, value FROM events", doubles="value")
def a2_files(spark, sf):
    """Envelopes of one object a file, read again."""
    return envelopes.read_envelopes(spark, stored(spark, sf), "event_id: bigint, value: double").select("endpoint", "event_id", "value")


@query("a8_collection_summary", f"SELECT coalesce(grp, 'total') AS grp, count(*) AS files, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(bytes) AS BIGINT) AS downloaded_bytes FROM (SELECT CASE WHEN event_type IN ('click', 'purchase') THEN event_type || '/' || strftime(ts, '%Y-%m-%d') ELSE event_type END AS grp, count(*) AS n, sum(strlen(props)) AS bytes FROM events GROUP BY event_type, strftime(ts, '%Y-%m-%d'), event_id % {_PARTS}, grp) GROUP BY ROLLUP (grp)")
def a8(spark, sf):
    """Files, rows and bytes of a written folder by the first part of a path, or two parts for some roots, and in total."""
    return envelopes.collection_summary(spark, stored(spark, sf), ("click", "purchase")).drop("stored_bytes")


@query("a9_response_fingerprint", "SELECT page_id, sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS bytes, CAST(len(string_split(html, '<')) - 1 AS BIGINT) AS n FROM pages")
def a9(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("bytes"), (F.size(F.split("html", "<", -1)) - 1).cast("long").alias("n"))
