"""Joins of events with panels: chained lookups, forward windows, matched pairs, near-duplicate documents."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.estimators import parkinson
from tidepanel.functions.scalar import log_shifted
from tidepanel.operators.calendar import forward_session
from tidepanel.operators.ranking import quantiles, running_least
from tidepanel.sources.sinks import checkpointed, written


def forward_parkinson(events: DataFrame, bars: DataFrame, n: int = 5, key: str = "ticker") -> DataFrame:
    """events with session and value: the first session at or after date, and the mean Parkinson of n sessions from it.

    Null where fewer than n sessions are left; missing bars in between are passed over.
    """
    ahead = Window.partitionBy(key).orderBy("date").rowsBetween(0, n - 1)
    value = parkinson()
    prepared = bars.select(key, F.col("date").alias("session"), F.when(F.count(F.lit(1)).over(ahead) == n, F.avg(value).over(ahead)).alias("value"))
    found = forward_session(events, prepared, key)
    return found.withColumn("session", F.col("at.session")).withColumn("value", F.col("at.value")).drop("at")


def market_adjusted(df: DataFrame, value: str, date: str = "date", exclude: tuple[str, ...] = ()) -> DataFrame:
    """df with adjusted, value less the date's equal-weight mean (of tickers not excluded), and its log size."""
    rows = df.filter(~F.col("ticker").isin(*exclude)) if exclude else df
    market = rows.groupBy(date).agg(F.avg(value).alias("_m"))
    out = df.join(market, date, "left").withColumn("adjusted", F.col(value) - F.col("_m")).drop("_m")
    return out.withColumn("log_abs", log_shifted(F.abs("adjusted"), 1e-6))


def _sides(df: DataFrame, score: str, high: float, low: float) -> tuple[DataFrame, DataFrame]:
    """Rows at or over the high quantile of score, and those at or under the low one."""
    rows = df.join(F.broadcast(quantiles(df, score, [low, high])))
    return rows.filter(F.col(score) >= F.col("q")[1]).drop("q"), rows.filter(F.col(score) <= F.col("q")[0]).drop("q")


def matched_pairs(df: DataFrame, score: str, keys: list[str], step: tuple[str, float], size: tuple[Column, float] | None = None, flags: Callable[[], list[Column]] | None = None, id_: str = "id", high: float = 0.75, low: float = 0.25) -> DataFrame:
    """high_id, low_id, distance: each row at or over the high quantile with the nearest at or under the low one, of its keys.

    The distance adds a whole-numbered column's difference (step: a day number, say) and a size's, each times its weight, and
    the mean difference of the flags, which are told only of rows at either end; ties go to the smaller low id. No pairs are
    made: of low rows with one pattern of flags, the nearest in step and size that lie on one side in both is the least of a
    sum, so a binary tree over the steps leaves running minima by size. The work is that of a sort of rows x patterns x
    levels. Rows without a step, size or key match nothing.
    """
    (a, wa), (b, wb) = step, size or (F.lit(0.0), 0.0)
    told = F.array(*(c.cast("int") for c in flags())) if flags else F.array().cast("array<int>")
    highs, lows = (rows.select(*keys, F.col(id_).alias("_id"), F.col(a).cast("long").alias("_a"), b.cast("double").alias("_b"), told.alias("_f")).dropna(subset=[*keys, "_a", "_b"]) for rows in _sides(df, score, high, low))
    lows, highs = checkpointed(lows), checkpointed(highs)
    first, last = lows.select("_a").unionByName(highs.select("_a")).agg(F.min("_a"), F.max("_a")).first()
    if first is None:
        return highs.select(F.col("_id").alias("high_id"), F.col("_id").alias("low_id"), F.lit(0.0).alias("distance")).filter("false")
    levels = F.sequence(F.lit(0), F.lit((last - first + 1).bit_length() - 1))
    ways = F.explode(F.array(*(F.struct(F.lit(x).alias("_down"), F.lit(y).alias("_small")) for x in (False, True) for y in (False, True))))
    turned = lambda rows: rows.select("*", ways.alias("_w")).select("*", "_w.*").drop("_w").withColumn("_i", F.when(F.col("_down"), last - F.col("_a")).otherwise(F.col("_a") - first)).withColumn("_s", F.when(F.col("_small"), -F.col("_b")).otherwise(F.col("_b")))
    # a low row is in one node of each level; the steps up to a high row's are one node for each bit of their number
    nodes = turned(lows).select("*", F.explode(levels).alias("_level")).withColumn("_node", F.expr("shiftright(_i, _level)"))
    patterns = lows.select(*keys, F.col("_f").alias("_g")).distinct()
    apart = F.aggregate(F.zip_with("_f", "_g", lambda x, y: F.abs(x - y)), F.lit(0), lambda n, x: n + x) / F.greatest(F.size("_f"), F.lit(1))
    asked = turned(highs.join(patterns, keys).withColumn("_far", apart)).select("*", F.explode(F.filter(levels, lambda k: F.call_function("getbit", F.col("_i") + 1, k) == 1)).alias("_level"))
    asked = asked.withColumn("_node", F.expr("shiftright(_i + 1, _level)") - 1).drop("_f").withColumnRenamed("_g", "_f")
    spots = [*keys, "_f", "_down", "_small", "_level", "_node"]
    near = F.struct((-(F.col("_i") * F.lit(float(wa)) + F.col("_s") * F.lit(float(wb)))).alias("c"), F.col("_id").alias("l"), F.col("_a").alias("a"), F.col("_b").alias("b"))
    both = nodes.select(*spots, "_s", F.lit(0).alias("_kind"), near.alias("_near")).unionByName(asked.select(*spots, "_s", F.lit(1).alias("_kind"), F.struct("_id", "_a", "_b", "_far").alias("_ask")), allowMissingColumns=True)
    spot = F.concat_ws("/", F.concat_ws("", "_f"), "_down", "_small", "_level", "_node")  # one column to sort by
    found = running_least(both.withColumn("_spot", spot).drop(*spots[len(keys) :]), "_near", [*keys, "_spot"], ["_s", "_kind"]).filter("_kind = 1 and _least is not null")
    distance = F.abs(F.col("_ask._a") - F.col("_least.a")) * F.lit(float(wa)) + F.col("_ask._far") + F.abs(F.col("_ask._b") - F.col("_least.b")) * F.lit(float(wb))
    best = found.groupBy(F.col("_ask._id").alias("high_id")).agg(F.min(F.struct(distance.alias("distance"), F.col("_least.l").alias("low_id"))).alias("b"))
    return best.select("high_id", F.col("b.low_id").alias("low_id"), F.col("b.distance").alias("distance"))


def nearest_dates(df: DataFrame, score: str, keys: list[str], date: str = "date", id_: str = "id", high: float = 0.75, low: float = 0.25) -> DataFrame:
    """As matched_pairs() for the distance in days alone: the low rows next before and after in a sorted window, no pairs."""
    highs, lows = _sides(df, score, high, low)
    first = lows.groupBy(*keys, date).agg(F.min(id_).alias("_l")).select(*keys, F.col(date).alias("_when"), F.lit(None).cast(df.schema[id_].dataType).alias("high_id"), F.struct(F.col(date).alias("d"), F.col("_l").alias("l")).alias("at"))
    ask = highs.select(*keys, F.col(date).alias("_when"), F.col(id_).alias("high_id"), F.lit(None).cast(first.schema["at"].dataType).alias("at"))
    w = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_high = F.col("high_id").isNotNull().cast("int")
    both = first.unionByName(ask).withColumn("_high", is_high)
    both = both.withColumn("before", F.last("at", ignorenulls=True).over(w.orderBy("_when", "_high"))).withColumn("after", F.last("at", ignorenulls=True).over(w.orderBy(F.desc("_when"), "_high")))
    gap = lambda s: F.when(F.col(s).isNotNull(), F.struct(F.abs(F.datediff(F.col(f"{s}.d"), "_when")).alias("distance"), F.col(f"{s}.l").alias("low_id")))
    found = both.filter("_high = 1").select("high_id", F.array_min(F.array_compact(F.array(gap("before"), gap("after")))).alias("b"))
    return found.filter("b is not null").select("high_id", F.col("b.low_id").alias("low_id"), F.col("b.distance").alias("distance"))


def candidate_sets(rows: DataFrame, threshold: float) -> DataFrame:
    """ticker, x, y (x < y): pairs of different token sets of a ticker, among them all whose Jaccard similarity is at least threshold.

    rows: ticker, same (a set's hash), tokens (distinct); sets may be repeated, empty ones meet nothing. Two such sets
    differ in at most k tokens, k by their sizes, so of k + 1 parts that a token's hash deals them into one holds the same
    tokens of both: candidates share a whole part, which unlike sets hardly do. Sizes are cut into bands; a pair lies in one
    band or in two neighbours, and k is that of the smaller's band.
    """

    def part_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows (ticker, same, hashes: ascending, distinct, at least one), a row for each part of each of a set's two schemes."""
        width = math.log(1 / threshold) + 1e-9  # sizes within the threshold are in one band of this width or in neighbours
        for b in batches:
            if not len(b):
                continue
            n, hashes = b.column(2).value_lengths().to_numpy(), b.column(2).flatten().to_numpy()
            band = np.floor(np.log(n) / width).astype(np.int64)
            for scheme in (band, band - 1):  # as the smaller and as the larger set of a pair
                parts = np.floor((1 - threshold) / threshold * np.exp((scheme + 1) * width) + 1e-6).astype(np.int64) + 1
                base, row = np.cumsum(parts) - parts, np.repeat(np.arange(len(n)), parts)
                slot = np.repeat(base, n) + (((hashes >> 32) + (1 << 31)) * np.repeat(parts, n) >> 32)
                first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
                total = np.zeros(len(row), np.int64)
                total[slot[first]] = np.add.reduceat(hashes, first)
                take = pa.array(row)
                arrays = [b.column(0).take(take), b.column(1).take(take), pa.array(n[row].astype(np.int32)), pa.array(scheme[row]), pa.array(np.arange(len(row)) - base[row]), pa.array(total)]
                yield pa.RecordBatch.from_arrays(arrays, names=["ticker", "same", "n", "scheme", "part", "total"])

    hashes = F.array_sort(F.transform("tokens", lambda t: F.xxhash64(t)))
    keyed = rows.filter(F.size("tokens") > 0).select("ticker", "same", F.array_distinct(hashes).alias("hashes"))
    kind = rows.schema["ticker"].dataType.simpleString()
    keyed = keyed.mapInArrow(part_keys, f"ticker {kind}, same long, n int, scheme long, part long, total long")
    keyed = keyed.select("ticker", "same", "n", F.xxhash64("ticker", "scheme", "part", "total").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("same").alias("low"), F.max("same").alias("high")).filter("low < high").select("key")
    members = checkpointed(keyed.join(shared, "key").distinct())
    a, b = members.alias("a"), members.alias("b")
    meet = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.ticker") == F.col("b.ticker")) & (F.col("a.same") < F.col("b.same")) & (F.col("b.n") >= threshold * F.col("a.n") - 1e-9) & (F.col("a.n") >= threshold * F.col("b.n") - 1e-9))
    return meet.select(F.col("a.ticker").alias("ticker"), F.col("a.same").alias("x"), F.col("b.same").alias("y")).distinct()


def _parities(tokens: Column, words: int = 4) -> Column:
    """64 x words bits, each told by whether an odd number of tokens has it: two sets differ in as many tokens as bits, or in more."""
    one = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))
    hashes = F.transform(tokens, lambda t: F.xxhash64(t))
    word = lambda i: F.aggregate(F.filter(hashes, lambda h: F.pmod(h, F.lit(words)) == i), F.lit(0).cast("long"), lambda bits, h: bits.bitwiseXOR(one(F.shiftright(h, 8).bitwiseAND(F.lit(63)))))
    return F.array(*(word(i) for i in range(words)))


def similar_sets(rows: DataFrame, threshold: float) -> DataFrame:
    """Those of candidate_sets() whose Jaccard similarity is at least threshold, counted out from the tokens.

    Tokens are sent out only for pairs whose parities leave it open.
    """
    meet = checkpointed(candidate_sets(rows, threshold))
    asked = meet.select("ticker", F.explode(F.array("x", "y")).alias("same")).distinct()
    sets = rows.join(asked, ["ticker", "same"], "left_semi").groupBy("ticker", "same").agg(F.first("tokens").alias("tokens"))
    sets = checkpointed(sets.select("*", F.size("tokens").alias("n"), _parities(F.col("tokens")).alias("bits")))
    side = lambda s, *held: sets.select("ticker", F.col("same").alias(s), *(F.col(k).alias(f"{k}_{s}") for k in held))
    apart = F.aggregate(F.zip_with("bits_x", "bits_y", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, k: n + k)
    open_ = meet.join(side("x", "n", "bits"), ["ticker", "x"]).join(side("y", "n", "bits"), ["ticker", "y"])
    open_ = checkpointed(open_.filter(apart <= (1 - threshold) / (1 + threshold) * (F.col("n_x") + F.col("n_y")) + 1e-6).select("ticker", "x", "y"))
    common = F.size(F.array_intersect("tokens_x", "tokens_y"))
    both = open_.join(side("x", "tokens"), ["ticker", "x"]).join(side("y", "tokens"), ["ticker", "y"])
    return both.filter(common / (F.size("tokens_x") + F.size("tokens_y") - common) >= threshold).select("ticker", "x", "y")


def near_duplicates(docs: DataFrame, threshold: float = 0.92, days: int = 7) -> DataFrame:
    """doc_id, duplicate for docs (doc_id, ticker, date, text), in order of date and doc_id.

    A document is a duplicate if an earlier kept one of its ticker, at most days back, has a token-set Jaccard of threshold.
    Candidates share a whole part of their tokens (candidate_sets(): exact for Jaccard); then rounds settle the order: a document goes if an earlier
    neighbour is kept and stays if all of them are gone. Of documents with one token set and one date only the first can
    stay (what drops it drops the others too), so copies aren't expanded into pairs; a text of many dates meets those of
    its own span of days and of the one before. A document without tokens is never a duplicate.
    """
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0))
    # as a compressed table of columns: the tokens are as large as the texts, and most steps read only the others
    rows = docs.sparkSession.read.parquet(written(docs.select("doc_id", "ticker", "date", tokens.alias("tokens")).select("*", F.xxhash64(F.array_sort("tokens")).alias("same"), F.coalesce(F.size("tokens"), F.lit(0)).alias("n")), "parquet"))
    close = checkpointed(similar_sets(rows, threshold))
    alike = close.unionByName(close.select("ticker", F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(rows.filter("n > 0").select("ticker", F.col("same").alias("x"), F.col("same").alias("y")).distinct())
    firsts = checkpointed(rows.filter("n > 0").groupBy("ticker", "same", "date").agg(F.min("doc_id").alias("doc_id")))
    one = firsts.select("ticker", "doc_id", "date", F.col("same").alias("x"))
    other = firsts.select("ticker", F.col("doc_id").alias("prior"), F.col("date").alias("prior_date"), F.col("same").alias("y"))
    gap = F.datediff("date", "prior_date")
    earlier = (gap > 0) | ((gap == 0) & (F.col("prior") < F.col("doc_id")))
    width = max(1, days)  # a prior document is in a date's span of days or in the one before
    span = lambda d: F.floor(F.unix_date(F.to_date(d)) / width)
    spans = one.join(alike, ["ticker", "x"]).withColumn("_span", F.explode(F.array(span("date"), span("date") - 1)))
    edges = checkpointed(spans.join(other.withColumn("_span", span("prior_date")), ["ticker", "y", "_span"]).filter(earlier & (gap <= days)).select("doc_id", "prior"))
    rest = rows.join(firsts.select("doc_id"), "doc_id", "left_anti").select("doc_id", (F.col("n") > 0).alias("duplicate"))
    state = firsts.select("doc_id").join(edges.select("doc_id").distinct().withColumn("open", F.lit(True)), "doc_id", "left").select("doc_id", F.when(F.col("open"), F.lit(None)).otherwise(F.lit(False)).cast("boolean").alias("gone"))
    while True:
        of = state.select(F.col("doc_id").alias("prior"), F.col("gone").alias("prior_gone"))
        told = edges.join(of, "prior").groupBy("doc_id").agg(F.bool_or(~F.col("prior_gone")).alias("hit"), F.bool_and(F.coalesce("prior_gone", F.lit(False))).alias("clear"))
        state = checkpointed(state.join(told, "doc_id", "left").select("doc_id", F.when(F.col("gone").isNotNull(), F.col("gone")).when(F.col("hit"), True).when(F.col("clear"), False).alias("gone")))
        if not state.filter("gone is null").limit(1).collect():
            return state.select("doc_id", F.col("gone").alias("duplicate")).unionByName(rest)
