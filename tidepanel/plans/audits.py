"""Aggregations, audits, set operations and ordering (G)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions.statistics import rank_decile
from tidepanel.operators import audits
from tidepanel.operators.ranking import numbered, quantiles
from tidepanel.plans.panel import PK, R, W
from tidepanel.plans.registry import query
from tidepanel.plans.texts import MACRO, NAMED, releases
from tidepanel.sources.tables import bars, bars_xs, docs, read, valid_bars, with_split
from tidepanel.functions import texts as tx
from tidepanel.functions.windows import simple_return

AUDIT = "SELECT date, sum(c) AS comparable, sum(u) AS unchanged FROM (SELECT date, CASE WHEN p IS NOT NULL THEN 1 ELSE 0 END AS c, CASE WHEN abs(close - p) <= 1e-12 AND abs(open - o) <= 1e-12 AND abs(high - h) <= 1e-12 AND abs(low - l) <= 1e-12 THEN 1 ELSE 0 END AS u FROM (SELECT *, lag(close) OVER w AS p, lag(open) OVER w AS o, lag(high) OVER w AS h, lag(low) OVER w AS l FROM bars_xs WINDOW w AS (PARTITION BY ticker ORDER BY date))) GROUP BY date"


@query("g1_carried_closure_dates", f"SELECT date, CAST(comparable AS BIGINT) AS comparable, CAST(unchanged AS BIGINT) AS unchanged, unchanged / greatest(comparable, 1) AS share, comparable >= 20 AND unchanged >= 0.95 * comparable AS closed FROM ({AUDIT})", "bars_xs", doubles="share")
def g1(spark, sf):
    return audits.carried_closures(bars_xs(spark, sf))


@query("g2_session_max_score", "SELECT ticker, date, split, max(n_chars) AS max_chars, max(length(text)) AS max_len, count(*) AS n FROM docs GROUP BY ALL", "docs")
def g2(spark, sf):
    return docs(spark, sf).groupBy("ticker", "date", "split").agg(F.max("n_chars").alias("max_chars"), F.max(F.length("text")).cast("long").alias("max_len"), F.count("*").alias("n"))


@query("g3_split_counts_pivot", "SELECT lang, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM docs GROUP BY lang", "docs")
def g3(spark, sf):
    return docs(spark, sf).groupBy("lang").pivot("split", ["train", "val", "test"]).count().fillna(0)


@query("g4_group_quantiles", "SELECT lang, split, q[1] AS p01, q[2] AS p10, q[3] AS p50, q[4] AS p90, q[5] AS p99 FROM (SELECT lang, split, quantile_cont(CAST(n_chars AS DOUBLE), [0.01, 0.1, 0.5, 0.9, 0.99]) AS q FROM docs GROUP BY 1, 2)", "docs", doubles="p01 p10 p50 p90 p99", digits=6)
def g4(spark, sf):
    q = quantiles(docs(spark, sf).select("lang", "split", "n_chars"), "n_chars", [0.01, 0.1, 0.5, 0.9, 0.99], "lang", "split")
    return q.select("lang", "split", *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p01", "p10", "p50", "p90", "p99"))))


@query("g5_data_audit", "SELECT count(*) AS n, count(DISTINCT ticker) AS tickers, min(date) AS first, max(date) AS last, count(*) FILTER (NOT (low > 0)) AS removed FROM bars", "bars")
def g5(spark, sf):
    return bars(spark, sf).agg(F.count("*").alias("n"), F.countDistinct("ticker").alias("tickers"), F.min("date").alias("first"), F.max("date").alias("last"), F.count_if(~(F.col("low") > 0)).alias("removed"))


@query("g6_cross_split_hashes", "SELECT sha256(text) AS hash, count(DISTINCT split) AS splits FROM docs GROUP BY 1 HAVING count(DISTINCT split) > 1", "docs")
def g6(spark, sf):
    return docs(spark, sf).groupBy(F.sha2("text", 256).alias("hash")).agg(F.countDistinct("split").alias("splits")).filter("splits > 1")


@query("g7_duplicate_key_rows", "SELECT doc_id, ticker, date FROM docs QUALIFY count(*) OVER (PARTITION BY ticker, date) > 1", "docs")
def g7(spark, sf):
    return docs(spark, sf).select("doc_id", "ticker", "date", F.count("*").over(Window.partitionBy("ticker", "date")).alias("n")).filter("n > 1").drop("n")


@query("g8_decile_table", "SELECT lang, decile, count(*) AS n, avg(x) AS mean, quantile_cont(x, 0.5) AS median, exp(avg(ln(x + 1))) AS geometric FROM (SELECT lang, CAST(n_chars AS DOUBLE) AS x, CAST(greatest(1, floor((10 * (r - 1) + n - 2) / (n - 1))) AS BIGINT) AS decile FROM (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM docs)) GROUP BY 1, 2", "docs", doubles="mean median geometric", digits=6)
def g8(spark, sf):
    placed = numbered(docs(spark, sf).select("lang", "doc_id", F.col("n_chars").cast("double").alias("x")), ["doc_id"], "lang")
    rows = placed.select("lang", "x", rank_decile(F.col("_at"), F.col("_of")).alias("decile"))
    medians = quantiles(rows, "x", [0.5], "lang", "decile").select("lang", "decile", F.get("q", F.lit(0)).alias("median"))
    return rows.groupBy("lang", "decile").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.exp(F.avg(F.ln(F.col("x") + 1))).alias("geometric")).join(medians, ["lang", "decile"])


@query("g9_market_return", f"SELECT date, avg(r) AS market FROM (SELECT date, {R} AS r FROM valid {W}) GROUP BY date", "valid", doubles="market")
def g9(spark, sf):
    return valid_bars(bars(spark, sf)).withColumn("r", simple_return()).groupBy("date").agg(F.avg("r").alias("market"))


@query("g10_macro_clusters", f"SELECT date_trunc('hour', ts) AS event_time, count(*) AS releases, string_agg(e || ':' || event_id, '|' ORDER BY e, event_id) AS names FROM {NAMED} WHERE country = 'US' AND {MACRO} GROUP BY 1")
def g10(spark, sf):
    """Releases of one time together, nested and sorted."""
    rows = releases(spark, sf).filter("country = 'US'").filter(tx.is_macro("event"))
    clusters = rows.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("event_time")).agg(F.sort_array(F.collect_list(F.struct("event", "event_id"))).alias("r"))
    return clusters.select("event_time", F.size("r").cast("long").alias("releases"), F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["event"], x["event_id"].cast("string"))), "|").alias("names"))


@query("g11_event_dates", "SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' ORDER BY 1")
def g11(spark, sf):
    return read(spark, sf, "events").select(F.to_date("ts").alias("day")).filter("day between date'2024-01-05' and date'2024-01-19'").distinct().orderBy("day")


@query("g12_train_standardize", "SELECT doc_id, (n_chars - m) / greatest(s, 1e-8) AS z FROM docs JOIN (SELECT lang, avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM docs WHERE split = 'train' GROUP BY lang) USING (lang)", "docs", doubles="z")
def g12(spark, sf):
    return audits.train_standardised(docs(spark, sf), ["n_chars"], "lang").select("doc_id", F.col("z_n_chars").alias("z"))


@query("g13_date_mean_loss", f"SELECT date, avg(abs(close - open) - pk) AS gain FROM (SELECT date, close, open, {PK} AS pk FROM valid) GROUP BY date", "valid", doubles="gain")
def g13(spark, sf):
    from tidepanel.functions.estimators import parkinson

    return valid_bars(bars(spark, sf)).groupBy("date").agg(F.avg(F.abs(F.col("close") - F.col("open")) - parkinson()).alias("gain"))


@query("g14_union_domains", "SELECT 'docs' AS domain, doc_id AS id, length(text) AS size, lang FROM documents UNION ALL SELECT 'benchmark', item_id, length(text), NULL FROM benchmark")
def g14(spark, sf):
    a = read(spark, sf, "documents").select(F.lit("docs").alias("domain"), F.col("doc_id").alias("id"), F.length("text").cast("long").alias("size"), "lang")
    b = read(spark, sf, "benchmark").select(F.lit("benchmark").alias("domain"), F.col("item_id").alias("id"), F.length("text").cast("long").alias("size"))
    return a.unionByName(b, allowMissingColumns=True)


@query("g15_dedup_first", "SELECT doc_id, ticker, date FROM docs QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY doc_id) = 1", "docs")
def g15(spark, sf):
    return audits.top_one(docs(spark, sf).select("doc_id", "ticker", "date"), ["ticker", "date"], "doc_id")


@query("g16_top1_per_group", "SELECT lang, split, doc_id, n_chars FROM docs QUALIFY row_number() OVER (PARTITION BY lang, split ORDER BY n_chars DESC, doc_id) = 1", "docs")
def g16(spark, sf):
    return audits.top_one(docs(spark, sf).select("lang", "split", "doc_id", "n_chars"), ["lang", "split"], F.desc("n_chars"), "doc_id")


@query("g17_fallback_filter", "SELECT ticker, doc_id FROM docs QUALIFY n_chars > 20000 OR max(CASE WHEN n_chars > 20000 THEN 1 ELSE 0 END) OVER (PARTITION BY ticker) = 0", "docs")
def g17(spark, sf):
    return audits.or_all(docs(spark, sf).select("ticker", "doc_id", "n_chars"), F.col("n_chars") > 20000, "ticker").select("ticker", "doc_id")


@query("g5_split_audit", "SELECT split, count(*) AS n, sum(volume) AS volume FROM split_bars GROUP BY split", "split_bars", doubles="volume", digits=4)
def g5_split(spark, sf):
    return with_split(valid_bars(bars(spark, sf))).groupBy("split").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"))
