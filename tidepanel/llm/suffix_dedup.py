"""Suffix-array deduplication of long repeats: q-gram buckets, refined by sorting on the buckets of later offsets.

Corpus-wide buckets are those of a 32-gram that a window's own bytes pick (its least), so that two of some 70 offsets are
shuffled and not all. What shares a bucket and a hash of all bytes around it is one class. Buckets with several classes
are refined from their bytes: buckets of 8-grams, sorted again on the bucket of the offset 8 on, 16 on and so forth up to
the span, each round on the last one's buckets. Only a bucket of more classes than one task holds compares its windows
by a hash of 128 bits instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import durable, numbered, pinned, text_of
from tidepanel.llm.repetition import refined

#: Bytes of the first bucket's q-gram; contexts of one bucket refined in a task; bits of a stretch's width.
Q, BUCKET, WIDTH = 32, 4096, 20
#: Bytes of the buckets that a refinement starts from.
START = 8
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def grams(raw: np.ndarray, q: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of the q bytes from each offset on, from hashes of half the length."""
    h, k = (raw.astype(np.uint64) + np.uint64(seed)) * _B, 1
    while 2 * k <= q:
        h = h[:-k] * _A + h[k:]
        h ^= h >> np.uint64(29)
        h *= _B
        k *= 2
    if k < q:
        m = len(raw) - q + 1
        h = h[:m] * _A + h[q - k : q - k + m]
        h ^= h >> np.uint64(31)
        h *= _B
    return h


def stretches(raw: bytes, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start and bucket of each stretch of windows (span bytes) with their leftmost least q-gram in one place.

    A window's bucket is its least q-gram hash, which its bytes alone decide: equal windows share a bucket wherever they
    stand, though only about two of span - q offsets are kept.
    """
    q = min(Q, span)
    if len(raw) < span:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    gram, k, wide = grams(np.frombuffer(raw, np.uint8), q), 1, span - q + 1
    n, least = len(gram) - wide + 1, gram
    while 2 * k <= wide:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    least = np.minimum(least[:n], least[wide - k : wide - k + n])
    # a stretch ends where the least changes or its leftmost place is left behind
    first = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (gram[: n - 1] == least[:-1]))))
    return first, np.append(first[1:], n) - 1, least[first]


def _stretch_rows(docs: DataFrame, span: int) -> DataFrame:
    """bucket, context (hash of all bytes of a stretch), doc_id, row, at (first start and number of starts less one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, buckets, contexts, at = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                raw = text.encode("utf-8", "surrogatepass")
                first, last, bucket = stretches(raw, span)
                of.append(np.full(len(first), i))
                buckets.append(bucket.view(np.int64))
                at.append(first << WIDTH | (last - first))
                contexts.append(np.fromiter((xxhash.xxh64_intdigest(raw[a : b + span]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first)).view(np.int64))
            if of:
                own = pa.array(np.concatenate(of))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets)), pa.array(np.concatenate(contexts)), batch.column(0).take(own), batch.column(1).take(own), pa.array(np.concatenate(at))], names=["bucket", "context", "doc_id", "row", "at"])

    return docs.mapInArrow(run, f"bucket long, context long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, at long")


def _contexts(docs: DataFrame, span: int) -> DataFrame:
    """The bytes of the stretches listed in each row of docs (doc_id, row, text, wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("of", "bucket", "first", "bytes")}
            for i, (text, wanted) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                raw = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    first = w["at"] >> WIDTH
                    for k, v in (("of", i), ("bucket", w["bucket"]), ("first", first), ("bytes", raw[first : first + (w["at"] & (1 << WIDTH) - 1) + span])):
                        out[k].append(v)
            own = pa.array(out["of"], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int64()), batch.column(0).take(own), batch.column(1).take(own), pa.array(out["first"], pa.int64()), pa.array(out["bytes"], pa.binary())], names=["bucket", "doc_id", "row", "first", "bytes"])

    return docs.mapInArrow(run, f"bucket long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, first long, bytes binary")


def _windows(parts: list[bytes], span: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of each part, and each part's number of windows."""
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    hashes = grams(np.frombuffer(b"".join(parts), np.uint8), span, seed)
    inside = np.ones(int(ends[-1]), bool)
    for k in range(1, span):  # the last starts of a part would run into the next
        inside[ends - k] = False
    return hashes[inside[: len(hashes)]], sizes - span + 1


def window_buckets(parts: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each window of each part (equal for equal bytes alone), and each part's number of windows.

    Buckets of the first START bytes are sorted, those of several windows again by the bucket START bytes on, and so on in
    doubled steps; the last step looks ahead as far as the span leaves. A bucket's identifier is its place in the order.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    raw = np.frombuffer(b"".join([*parts, bytes(span + START)]), np.uint8)
    n, h = int(sizes.sum()), min(START, span)
    gram = np.zeros(n + span, np.uint64)
    for k in range(h):
        gram = gram << np.uint64(8) | raw[k : k + n + span]
    order = np.argsort(gram, kind="stable")
    new = np.ones(len(gram), bool)
    new[1:] = gram[order[1:]] != gram[order[:-1]]
    bucket = np.empty(len(gram), np.int64)
    bucket[order] = np.maximum.accumulate(np.where(new, np.arange(len(gram)), 0))
    alone = new & np.append(new[1:], True)
    active = np.sort(order[~alone])
    while h < span and len(active):
        step = min(h, span - h)
        active = active[active + step < len(gram)]
        bucket, active = refined(bucket, active, bucket[active + step])
        h += step
    ends = np.cumsum(sizes)
    inside = np.ones(n, bool)
    for k in range(1, span):  # the last starts of a part would run into the next
        inside[ends - k] = False
    return bucket[:n][inside], sizes - span + 1


def _refine(span: int):
    """A mapInArrow function on contexts sorted by bucket, doc_id, row, first: runs of windows that stand earlier too."""

    def resolve(rows: list[tuple]) -> pa.RecordBatch:
        buckets, sizes = window_buckets([r[3] for r in rows], span)
        again = np.ones(len(buckets), bool)
        again[np.unique(buckets, return_index=True)[1]] = False
        begin = np.cumsum(sizes) - sizes
        part = np.repeat(np.arange(len(rows)), sizes)
        joined = np.zeros(len(again), bool)
        joined[1:] = again[1:] & again[:-1] & (part[1:] == part[:-1])
        start = np.flatnonzero(again & ~joined)
        end = np.flatnonzero(again & ~np.append(joined[1:], False))
        of = part[start]
        first = np.array([r[2] for r in rows], np.int64)[of] - begin[of]
        return pa.RecordBatch.from_arrays([pa.array(np.array([r[1] for r in rows], np.int64)[of]), pa.array(first + start), pa.array(first + end + span)], names=["row", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if len(held) >= BUCKET and r[0] != held[-1][0]:
                    yield resolve(held)
                    held = []
                held.append(r)
        if held:
            yield resolve(held)

    return run


def _window_rows(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = batch.column(3).to_pylist()
                a, sizes = _windows(parts, span)
                b, _ = _windows(parts, span, 77)
                own = np.repeat(np.arange(len(parts)), sizes)
                first = batch.column(2).to_numpy()[own] + np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), pa.array(first)], names=["a", "b", "doc_id", "row", "lo"])

    return run


def repeated_spans(docs: DataFrame, span: int = 100) -> DataFrame:
    """row, lo, hi: byte ranges of docs (doc_id, row, text) whose union is every span-byte string that starts earlier too.

    Earlier: smaller doc_id, then row, then start; null ids come first. Buckets by q-gram are counted; those of one
    offset are left. What shares a bucket and all bytes around it is settled by one hash; only the first of each such
    class, in buckets with several classes, is refined (_refine), in groups of at most BUCKET classes or, in a
    larger bucket, as rows of windows summed before they are dealt. No pairs are made and no bucket is dropped. What is
    joined to the rows of a bucket is a table of its own, so that a hot bucket is a skewed join, which Spark splits.
    """
    if not 0 < span <= 1 << WIDTH:
        raise ValueError(f"span must lie between 1 and {1 << WIDTH}")
    rows = _stretch_rows(docs, span)
    shared = durable(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"))
    rows = durable(rows.join(shared, "bucket"))
    classes = durable(rows.groupBy("bucket", "context").agg(F.min(F.struct("doc_id", "row", "at")).alias("f"), F.count("*").alias("n")))
    range_of = lambda at: (F.shiftright(at, WIDTH).alias("lo"), (F.shiftright(at, WIDTH) + at.bitwiseAND(F.lit((1 << WIDTH) - 1)) + span).alias("hi"))
    later = rows.join(classes.filter("n > 1").select("bucket", "context", "f"), ["bucket", "context"]).filter((F.col("row") != F.col("f.row")) | (F.col("at") != F.col("f.at"))).select("row", *range_of(F.col("at")))
    several = durable(classes.groupBy("bucket").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    open_ = classes.join(several, "bucket").select(F.col("f.row").alias("row"), F.struct("bucket", F.col("f.at").alias("at")).alias("w"), "kinds")
    wanted = lambda which: open_.filter(which).groupBy("row").agg(F.collect_list("w").alias("wanted"))
    contexts = lambda which: _contexts(docs.join(wanted(which), "row").select("doc_id", "row", "text", "wanted"), span)
    few = contexts(F.col("kinds") <= BUCKET).repartition("bucket").sortWithinPartitions("bucket", "doc_id", "row", "first")
    refined = few.select("bucket", "row", "first", "bytes").mapInArrow(_refine(span), "row long, lo long, hi long")
    windows = contexts(F.col("kinds") > BUCKET).select("doc_id", "row", "first", "bytes").mapInArrow(_window_rows(span), f"a long, b long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, lo long")
    twice = durable(windows.groupBy("a", "b").agg(F.min(F.struct("doc_id", "row", "lo")).alias("f"), F.count("*").alias("n")).filter("n > 1"))
    common = windows.join(twice, ["a", "b"]).filter((F.col("row") != F.col("f.row")) | (F.col("lo") != F.col("f.lo"))).select("row", "lo", (F.col("lo") + span).alias("hi"))
    return later.unionByName(refined).unionByName(common)


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """The union of ranges as maximal runs, in order."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def cut_repeats(docs: DataFrame, span: int = 100) -> DataFrame:
    """doc_id, row, n_bytes, n_removed, n_spans, kept (binary) of each row of docs (doc_id, text).

    Removes each byte that a span-byte string covers which also starts earlier, in a document of smaller doc_id or
    earlier in the same one; judged on the input. Null texts count as empty; shorter texts than span stay whole; equal
    rows: the first in scan order keeps its bytes.
    """
    docs = numbered(pinned(docs.select("doc_id", text_of().alias("text"))), "row").select("doc_id", "row", "text")
    spans = repeated_spans(docs, span).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, runs, kept = [], [], [], []
            for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                cuts = merged(spans)
                edges = [0, *(x for c in cuts for x in c), len(raw)]
                size.append(len(raw))
                removed.append(sum(b - a for a, b in cuts))
                runs.append(len(cuts))
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (size, removed, runs)), pa.array(kept, pa.binary())], names=["doc_id", "row", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = docs.join(spans, "row", "left").select("doc_id", "row", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame, span: int = 100) -> DataFrame:
    """docs with text cut as by cut_repeats(), all columns kept; a null text stays null.

    A character of which some bytes go, goes. Of repeated rows the first in scan order keeps its text; an empty table
    gives an empty one.
    """
    docs = pinned(docs)
    at = docs.columns.index("text")
    rows = numbered(docs, "_row")
    spans = repeated_spans(rows.select("doc_id", F.col("_row").alias("row"), text_of().alias("text")), span).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cuts in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if text is not None and cuts:
                    raw = text.encode("utf-8", "surrogatepass")
                    edges = [0, *(x for c in merged(cuts) for x in c), len(raw)]
                    text = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8", "ignore")
                out.append(text)
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    joined = rows.join(spans, rows["_row"] == spans["row"], "left").select(*(rows[c] for c in docs.columns), "_spans")
    return joined.mapInArrow(run, docs.schema)
