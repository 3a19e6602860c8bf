"""Array and vector operators (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepanel.functions import vectors as vec
from tidepanel.operators import chunks, matching
from tidepanel.plans.registry import query
from tidepanel.sources.tables import docs, read, vectors

NORM = "sqrt(list_sum(list_transform(vec, lambda x: x * x)))"


@query("i1_l2_normalize", f"SELECT item_id, layer, vec[1] / greatest({NORM}, 1e-8) AS first, vec[16] / greatest({NORM}, 1e-8) AS last FROM vectors", "vectors", doubles="first last")
def i1(spark, sf):
    u = vectors(spark, sf).select("item_id", "layer", vec.unit("vec").alias("u"))
    return u.select("item_id", "layer", F.get("u", F.lit(0)).alias("first"), F.get("u", F.lit(15)).alias("last"))


@query("i2_project", "SELECT item_id, layer, list_sum(list_transform(range(1, 17), lambda i: vec[i] * i / 16.0)) AS score FROM vectors", "vectors", doubles="score")
def i2(spark, sf):
    axis = F.array(*(F.lit(i / 16) for i in range(1, 17)))
    return vectors(spark, sf).select("item_id", "layer", vec.dot("vec", axis).alias("score"))


@query("i3_token_windows", "SELECT doc_id, s AS start, CAST(least(n - s, 64) AS BIGINT) AS size, CAST(CASE WHEN s = 0 THEN least(64, n) ELSE greatest(least(n - s, 64) - 16, 1) END AS BIGINT) AS weight FROM (SELECT doc_id, n, unnest(range(0, greatest(n, 1), 48)) AS s FROM (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents)) WHERE s = 0 OR s - 48 + 64 < n")
def i3(spark, sf):
    tokens = read(spark, sf, "documents").select("doc_id", F.split("text", " ", -1).alias("tokens"))
    return tokens.select("doc_id", F.inline(chunks.token_windows("tokens", 64, 16))).select("doc_id", F.col("start").cast("long").alias("start"), F.size("tokens").cast("long").alias("size"), F.col("weight").cast("long").alias("weight"))


@query("i4_mean_pool", "SELECT grp, layer, i, avg(x) AS m FROM (SELECT grp, layer, unnest(vec) AS x, CAST(unnest(range(0, 16)) AS INTEGER) AS i FROM vectors) GROUP BY 1, 2, 3", "vectors", doubles="m")
def i4(spark, sf):
    return vec.mean_vector(vectors(spark, sf), "vec", "grp", "layer").select("grp", "layer", F.posexplode("mean").alias("i", "m"))


@query("i5_weighted_chunk_mean", "SELECT item_id, i, sum(x * layer) / sum(layer) AS m FROM (SELECT item_id, layer, unnest(vec) AS x, CAST(unnest(range(0, 16)) AS INTEGER) AS i FROM vectors) GROUP BY 1, 2", "vectors", doubles="m", digits=6)
def i5(spark, sf):
    return vec.mean_vector(vectors(spark, sf), "vec", "item_id", weight="layer").select("item_id", F.posexplode("mean").alias("i", "m"))


@query("i6_fit_budget", "SELECT doc_id, CAST(least(n, 128 - 10 - 4) AS BIGINT) AS kept, CAST(10 AS BIGINT) AS first, CAST(10 + least(n, 128 - 10 - 4) AS BIGINT) AS last FROM (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents)")
def i6(spark, sf):
    tokens = read(spark, sf, "documents").select("doc_id", F.split("text", " ", -1).alias("tokens"))
    fitted = tokens.select("doc_id", chunks.fit_budget(F.array_repeat(F.lit("<p>"), 10), "tokens", F.array_repeat(F.lit("<s>"), 4), 128).alias("f"))
    return fitted.select("doc_id", F.size("f.text").cast("long").alias("kept"), F.col("f.first").cast("long").alias("first"), F.col("f.last").cast("long").alias("last"))


@query("i7_expected_rating", "SELECT item_id, layer, list_sum(list_transform(range(1, 10), lambda i: i * exp(vec[i] - list_max(vec[1:9])))) / list_sum(list_transform(range(1, 10), lambda i: exp(vec[i] - list_max(vec[1:9])))) AS rating FROM vectors", "vectors", doubles="rating")
def i7(spark, sf):
    return vectors(spark, sf).withColumn("v", F.slice("vec", 1, 9)).select("item_id", "layer", vec.softmax_expectation("v", [float(i) for i in range(1, 10)]).alias("rating"))


@query("i8_center_vectors", "SELECT v.item_id, v.layer, v.vec[1] - m.a AS first, v.vec[16] - m.b AS last FROM vectors v JOIN (SELECT grp, layer, avg(vec[1]) AS a, avg(vec[16]) AS b FROM vectors GROUP BY 1, 2) m ON v.grp = m.grp AND v.layer = m.layer", "vectors", doubles="first last")
def i8(spark, sf):
    c = chunks.centred(vectors(spark, sf), "vec", "grp", "layer")
    return c.select("item_id", "layer", F.get("vec", F.lit(0)).alias("first"), F.get("vec", F.lit(15)).alias("last"))


PAIRS = "SELECT high_id, low_id FROM (SELECT h.doc_id AS high_id, arg_min(l.doc_id, {'d': abs(h.date - l.date), 'l': l.doc_id}) AS low_id FROM docs h JOIN docs l ON h.ticker = l.ticker WHERE h.n_chars >= (SELECT quantile_cont(n_chars, 0.75) FROM docs) AND l.n_chars <= (SELECT quantile_cont(n_chars, 0.25) FROM docs) GROUP BY 1)"


def pairs(spark, sf):
    rows = docs(spark, sf).select(F.col("doc_id").alias("id"), "ticker", "date", "n_chars")
    return matching.nearest_dates(rows, "n_chars", ["ticker"])


@query("i9_pair_deltas", f"SELECT high_id, low_id, a.vec[1] - b.vec[1] AS first, a.vec[16] - b.vec[16] AS last FROM ({PAIRS}) JOIN vectors a ON a.item_id = high_id AND a.layer = 2 JOIN vectors b ON b.item_id = low_id AND b.layer = 2", "docs", "vectors", doubles="first last")
def i9(spark, sf):
    d = chunks.pair_deltas(pairs(spark, sf), vectors(spark, sf).filter("layer = 2"))
    return d.select("high_id", "low_id", F.get("delta", F.lit(0)).alias("first"), F.get("delta", F.lit(15)).alias("last"))


@query("i10_domain_weights", "SELECT doc_id, 0.5 * count(*) OVER () / count(*) OVER (PARTITION BY d) AS weight FROM (SELECT doc_id, lang = 'en' AS d FROM documents)", doubles="weight")
def i10(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", (F.col("lang") == "en").alias("d"))
    sizes = d.groupBy("d").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("all"))
    weights = sizes.join(F.broadcast(total)).select("d", (0.5 * F.col("all") / F.col("n")).alias("weight"))
    return d.join(F.broadcast(weights), "d").select("doc_id", "weight")


@query("i11_axis_cosines", f"WITH u AS (SELECT layer, grp, vec, {NORM} AS n FROM (SELECT grp, layer, list(m ORDER BY i) AS vec FROM (SELECT grp, layer, i, avg(x) AS m FROM (SELECT grp, layer, unnest(vec) AS x, unnest(range(0, 16)) AS i FROM vectors) GROUP BY 1, 2, 3) GROUP BY 1, 2)) SELECT a.layer, a.grp AS g, b.grp AS h, list_sum(list_transform(range(1, 17), lambda i: a.vec[i] * b.vec[i])) / (a.n * b.n) AS cosine FROM u a JOIN u b ON a.layer = b.layer AND a.grp < b.grp", "vectors", doubles="cosine", digits=6)
def i11(spark, sf):
    axes = vec.mean_vector(vectors(spark, sf), "vec", "layer", "grp").select("layer", "grp", vec.unit("mean").alias("u"))
    a, b = axes.select("layer", F.col("grp").alias("g"), F.col("u").alias("a")), axes.select("layer", F.col("grp").alias("h"), F.col("u").alias("b"))
    return a.join(b, "layer").filter("g < h").select("layer", "g", "h", vec.dot("a", "b").alias("cosine"))


@query("i4_mean_pool_documents", "SELECT d.ticker, i, avg(x) AS m, count(*) AS n FROM docs d JOIN (SELECT item_id, unnest(vec) AS x, CAST(unnest(range(0, 16)) AS INTEGER) AS i FROM vectors WHERE layer = 4) ON item_id = doc_id GROUP BY 1, 2", "docs", "vectors", doubles="m")
def i4_docs(spark, sf):
    rows = docs(spark, sf).join(vectors(spark, sf).filter("layer = 4"), F.col("doc_id") == F.col("item_id"))
    sizes = rows.groupBy("ticker").agg(F.count("*").alias("n"))
    return vec.mean_vector(rows, "vec", "ticker").select("ticker", F.posexplode("mean").alias("i", "m")).join(sizes, "ticker")


