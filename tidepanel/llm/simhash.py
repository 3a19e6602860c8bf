"""SimHash near-duplicates: pigeonhole blocks, Hamming verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import durable, numbered, pinned

#: Fingerprints that share a block are compared pair by pair up to this many; beyond, they meet one flipped bit away.
PAIRED = 24


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash, as a signed integer, of a text's word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    parts = [words[i:] for i in range(shingle)] if len(words) >= shingle else [[w] for w in words]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), map(b" ".join, zip(*parts, strict=False))), np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, row, fp of each row of docs (doc_id, text); row tells repeated rows apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp, pa.int64())], names=["doc_id", "row", "fp"])

    return numbered(docs.select("doc_id", "text"), "row").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(prints: DataFrame, distance: int = 2, paired: int = PAIRED) -> DataFrame:
    """a > b: links between different fingerprints (fp, distinct) that differ in at most distance bits.

    The bits are cut into distance + 2 blocks, of which a close pair shares two; each pair of blocks is a join key. In
    a bucket of at most `paired` fingerprints all pairs are verified. In a larger one each fingerprint goes to the spots
    that it reaches by flipping up to half the distance of its other bits: a close pair meets in one of them, a spot holds
    few, and each of its members is linked to the least. No bucket is dropped, and the work is linear in its size. Links
    of large buckets that another member implies are left out; components are the same. A null fingerprint
    links to nothing; near_duplicates() gives each one once; an empty table has no links.
    """
    parts = distance + 2
    cuts = [64 * i // parts for i in range(parts + 1)]
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    masks = [x | y for x, y in combinations(blocks, 2)]
    keyed = prints.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("table", "key"))
    shared = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = durable(keyed.join(shared, ["table", "key"]))
    few = members.filter(F.col("n") <= paired).drop("n")
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["table", "key"]).filter((F.col("a") > F.col("b")) & (_apart(F.col("a"), F.col("b")) <= distance)).select("a", "b")
    many = members.filter(F.col("n") > paired)
    reach = (distance + 1) // 2
    flips = None
    for i, m in enumerate(masks):
        rest = [1 << k for k in range(64) if not m >> k & 1]
        moves = [_signed(sum(c)) for r in range(reach + 1) for c in combinations(rest, r)]
        own = many.filter(F.col("table") == i).select("table", "key", "fp", F.explode(F.transform(F.array(*map(F.lit, moves)), lambda x: F.col("fp").bitwiseXOR(x))).alias("spot"))
        flips = own if flips is None else flips.unionByName(own)
    spots = flips.groupBy("table", "spot").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    star = spots.select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).filter((F.col("a") > F.col("b")) & (_apart(F.col("a"), F.col("b")) <= distance)).select("a", "b")
    if distance % 2:  # odd: two of a spot can be one bit too far apart, so the least doesn't stand for all
        star = spots.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b")).filter((F.col("a") > F.col("b")) & (_apart(F.col("a"), F.col("b")) <= distance))
    return pairs.unionByName(star).distinct()


def roots(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each connected component of edges (a > b), for all nodes but the roots.

    Large and small stars in turn until nothing changes; each step is a minimum for each node and a join, written to
    the shared folder. Minima are tables of their own, so that a hub's edges are a skewed join, which Spark splits.
    """
    edges, mark = durable(edges.select("a", "b")), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = durable(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = durable(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a > b").distinct()
        edges = durable(small)
        seen = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, row, fp, component_id of each row of docs (doc_id, text).

    Words lie between ASCII white space, A-Z lower-cased; fingerprints at most distance bits apart are linked, and
    component_id is the smallest doc_id that links reach. Texts without words have fingerprint 0 and are linked like
    any other. Equal fingerprints count as one in all joins. A null doc_id never is a component_id unless a component
    has no other.
    """
    prints = durable(fingerprints(docs, shingle))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    root = roots(links(first.select("fp"), distance))
    of = first.join(root, first["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(of.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "row", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


#: Min-hashes of a text; they make BANDS keys of ROWS each.
BANDS, ROWS = 32, 8
HASHES = BANDS * ROWS
#: Multipliers and addends of the min-hashes.
_MIX = np.random.default_rng(42).integers(0, 1 << 63, (2, HASHES), dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """The distinct hashes, in order, of a text's word shingles; a text of fewer words has its words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    parts = [words[i:] for i in range(shingle)] if len(words) >= shingle else [[w] for w in words]
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), map(b" ".join, zip(*parts, strict=False))), np.uint64))


def min_hashes(own: np.ndarray) -> np.ndarray:
    """HASHES min-hashes of distinct shingle hashes: two sets agree in each with their Jaccard similarity as probability."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(own), 256):
        mixed = own[i : i + 256, None] * _MIX[0] + _MIX[1]
        np.minimum(least, (mixed >> np.uint64(32)).min(axis=0).astype(np.uint32), out=least)
    return least


def _sketches(batches: Iterator[pa.RecordBatch], shingle: int, bands: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, same, keys, fp = [], [], [], []
        for text in batch.column(1).to_pylist():
            own = shingle_hashes(text, shingle)
            least = min_hashes(own)
            n.append(len(own))
            same.append(xxhash.xxh128_digest(own.tobytes()))
            keys.append([xxhash.xxh64_intdigest(least[t * ROWS : (t + 1) * ROWS].tobytes(), seed=t) - (1 << 63) for t in range(bands)])
            fp.append(fingerprint(text, shingle))
        arrays = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(fp, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row", "n", "same", "keys", "fp"])


#: Texts, and shingles of them, of a bucket that make a block; a task compares two blocks at once.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two different ones of some sets (distinct hashes) share: products of blocks of their incidence
    matrix, which leaves out what one set alone has."""
    m, flat = len(sets), np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owner, flat = np.repeat(np.arange(m), [len(s) for s in sets])[order], flat[order]
    first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.empty(0, np.int64)
    times = np.diff(np.append(first, len(flat)))
    column = np.repeat(np.cumsum(times > 1) - 1, times)  # those of one set alone have no column
    held = np.repeat(times > 1, times)
    owner, column = owner[held], column[held]
    wide, out = max(1, (1 << 22) // m), np.zeros((m, m))
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        lo, hi = np.searchsorted(column, (c, c + wide))
        part = np.zeros((m, wide), np.float32)
        part[owner[lo:hi], column[lo:hi] - c] = 1
        out += part @ part.T
    return out


def _linked_in_cells(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Of rows (key, x, y, own, id, part, shingles), sorted by key, x and y, links a > b that join the parts of a cell.

    All pairs of a cell (across its two blocks, if it has two) are counted out; a similar one is a link unless its parts
    are joined already, so a cell gives fewer links than it has texts.
    """
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for (_, x, y), held in groupby(rows, key=lambda r: r[:3]):
        own, ids, part, raw = zip(*(r[3:] for r in held), strict=True)
        own, ids, part = np.array(own), np.array(ids, np.int64), np.unique(part, return_inverse=True)[1].tolist()
        sets = [np.frombuffer(s, np.uint64) for s in raw]
        n = np.array([len(s) for s in sets])
        common = common_counts(sets)
        similar = np.triu(common >= similarity * (n[:, None] + n[None, :] - common) - 1e-9, 1)
        if x != y:
            similar &= own[:, None] != own[None, :]
        label, links = list(range(max(part) + 1)), []
        for i, j in zip(*(v.tolist() for v in np.nonzero(similar)), strict=True):
            p, q = part[i], part[j]
            while label[p] != p:
                p = label[p] = label[label[p]]
            while label[q] != q:
                q = label[q] = label[label[q]]
            if p != q:
                label[max(p, q)] = min(p, q)
                links.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def links_in_buckets(members: DataFrame, shingles: DataFrame, similarity: float, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """a > b: links between members (key, texts, size, id, part) of a bucket whose shingles (id, shingles) are similar enough.

    size: the shingles of the bucket's texts together. All pairs are counted out where the bucket's rows are, and only
    links that join two parts leave the task. A bucket of more texts or shingles than a block is dealt into blocks, and
    each two of them are a task's work, so no group is unbounded and no pair is left out. A member without a row of
    shingles meets nobody; an empty table has no links.
    """
    deals = F.ceil(F.greatest(F.col("texts") / block, F.col("size") / block_shingles))
    dealt = members.withColumn("deals", deals).withColumn("own", F.pmod(F.xxhash64("id"), "deals"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)))
    cells = cells.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "part").join(shingles, "id")
    sorted_ = cells.select("key", "x", "y", "own", "id", "part", "shingles").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return sorted_.mapInArrow(partial(_linked_in_cells, similarity=similarity), "a long, b long")


def _shingles(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_hashes(t, shingle).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "shingles"])


def _similar(batches: Iterator[pa.RecordBatch], shingle: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, a_text, b_text) the a, b whose shingle sets have that Jaccard similarity or more."""
    of, other = None, np.empty(0, np.uint64)
    for batch in batches:
        keep = []
        for b, one, two in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            if b != of:
                of, other = b, shingle_hashes(two, shingle)
            own = shingle_hashes(one, shingle)
            common = len(np.intersect1d(own, other, assume_unique=True))
            keep.append(common >= similarity * (len(own) + len(other) - common) - 1e-9)
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def similar_pairs(texts: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those pairs (a, b) of texts (id, text) whose shingle sets have the Jaccard similarity asked for, by the sets themselves."""
    side = lambda s: texts.select(F.col("id").alias(s), F.col("text").alias(f"{s}_text"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_text", "b_text")
    return both.mapInArrow(partial(_similar, shingle=shingle, similarity=similarity), "a long, b long")


def fingerprint_pairs(prints: DataFrame, distance: int = 2) -> DataFrame:
    """a > b: candidates among texts (id, fp) by SimHash: each with the first of its fingerprint, and the firsts of fingerprints that links() joins."""
    first = durable(prints.groupBy("fp").agg(F.min("id").alias("least")))
    same = prints.join(first, "fp").filter("id > least").select(F.col("id").alias("a"), F.col("least").alias("b"))
    of = lambda s: first.select(F.col("fp").alias(s), F.col("least").alias(f"{s}_id"))
    near = links(first.select("fp"), distance).join(of("a"), "a").join(of("b"), "b")
    return same.unionByName(near.select(F.greatest("a_id", "b_id").alias("a"), F.least("a_id", "b_id").alias("b")))


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, distance: int = 2, bands: int = BANDS) -> DataFrame:
    """doc_id, row, component of each row of docs: near copies by word shingles, component the least row among them.

    Two texts are linked if the Jaccard similarity of their shingle sets, counted out from the texts, is at least the one
    asked for. SimHash comes first: fingerprints at most distance bits apart, found by blocks and compared bit by bit
    (links()), give pairs, which the texts confirm, and components. Texts at that similarity can be further apart (some ten
    bits at 0.8, where blocks would be too short to tell texts apart); they are found among what SimHash left in several
    components: candidates share a bucket, a key of ROWS min-hashes: a pair at 0.8 shares one of BANDS with a probability
    of 0.997, a more similar one more surely. There each text meets the bucket's first that it shares most buckets with;
    then all pairs of all buckets whose texts are not in one component yet are counted out where the bucket is, whatever
    its size (links_in_buckets), and give as many links as join them. Equal shingle sets count as one. Null and empty
    texts and those without words are each other's copies; repeated rows and ids are told apart; an empty table gives an
    empty one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = numbered(docs.select("doc_id", "text"), "row")
    found = durable(rows.mapInArrow(partial(_sketches, shingle=shingle, bands=bands), f"doc_id {kind}, row long, n long, same binary, keys array<long>, fp long"))
    least = found.groupBy("same").agg(F.min("row").alias("id"))
    distinct = found.join(least.select(F.col("id").alias("row")), "row", "left_semi").filter("n > 0")
    keyed = durable(distinct.select(F.col("row").alias("id"), "n", F.explode("keys").alias("key")))
    shared = durable(keyed.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("size")).filter("size > 1").drop("size"))
    members = durable(keyed.join(shared, "key"))
    by_bits = durable(fingerprint_pairs(distinct.select(F.col("row").alias("id"), "fp"), distance))
    ids = members.select("id").unionByName(by_bits.select(F.explode(F.array("a", "b")).alias("id"))).distinct()
    texts = durable(rows.select(F.col("row").alias("id"), "text").join(ids, "id", "left_semi"))

    edges = durable(similar_pairs(texts, by_bits, shingle, similarity))
    root = durable(roots(edges))
    part = lambda k: root.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root"))
    apart = F.coalesce("id_root", "id") != F.coalesce("first_root", "first")
    often = members.filter("id > first").groupBy("id", "first").agg(F.count("*").alias("times")).join(part("id"), "id", "left").join(part("first"), "first", "left").filter(apart)
    tried = durable(often.groupBy(F.col("id").alias("a")).agg(F.max_by("first", F.struct("times", -F.col("first"))).alias("b")))
    edges = durable(edges.unionByName(similar_pairs(texts, tried, shingle, similarity)))
    root = roots(edges)
    placed = durable(members.join(root, members["id"] == root["node"], "left").select("key", "id", "n", F.coalesce("root", "id").alias("part")))
    mixed = durable(placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("texts"), F.sum("n").alias("size")).filter("low < high").select("key", "texts", "size"))
    open_ = durable(placed.join(mixed, "key"))
    shingles = durable(texts.join(open_.select("id").distinct(), "id", "left_semi").mapInArrow(partial(_shingles, shingle=shingle), "id long, shingles binary"))
    more = durable(links_in_buckets(open_, shingles, similarity))
    root = roots(edges.unionByName(more))
    of = durable(least.join(root, least["id"] == root["node"], "left").select("same", F.coalesce("root", "id").alias("component")))
    return found.select("doc_id", "row", "same").join(of, "same").select("doc_id", "row", "component")


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without near copies (similar_documents()): of each component the row of least doc_id, then of least scan place; all columns stay.

    A null doc_id counts as least. Of all rows without words one stays. An empty table gives an empty one.
    """
    docs = pinned(docs)
    groups = similar_documents(docs, shingle, similarity)
    keep = groups.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("k")).select(F.col("k.row").alias("_row"))
    return numbered(docs).join(keep, "_row", "left_semi").drop("_row")
