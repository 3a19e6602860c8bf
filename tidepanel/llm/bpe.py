"""Byte-level BPE: higher-order functions fold ranked merges over the bytes of distinct words; decoding joins pieces."""

from __future__ import annotations

import base64
import json
import mmap
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tidepanel.llm.common import durable, session, text_of
from tidepanel.llm.pieces import gathered, parted, spread

#: Pre-tokens of at most SHORT bytes whose ids are in a file that an executor's workers map, some 45 bytes each; no worker
#: holds it in memory of its own. The rest are folded beside their document, but for those over LONG bytes, where a fold's work would be the square of them.
KNOWN, SHORT, LONG = 1_000_000, 64, 512
#: Words that a worker keeps for good, and until as many are gathered: a bound on its memory, not on its input.
WARM, RECENT = 120_000, 60_000
#: Bytes of texts whose words are looked up together: a worker's arrays are several times as large.
TOGETHER = 1_000_000
#: Multipliers that pick the two places of a key in the literal rank map.
PLACES = (0x9E3779B1, 0x85EBCA77)
#: Fixed pattern of pre-tokens; Java's \s is all Unicode white space under (?U).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PATTERN = f"(?U){PRE_TOKEN}"
#: Ids from here on are marks of pre-tokens yet to be filled in.
_MARK = 1 << 31
PARTS = regex.compile(PRE_TOKEN)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _literal(value, kind: str) -> Column:
    """A constant that the optimizer folds into one literal."""
    return F.from_json(F.lit(json.dumps(value)), kind)


class Ranks:
    """The rank file as literals. A piece's id is its rank, so two neighbours make the map's key by their ids.

    of: ranks of all pairs of pieces that make a piece, a hash table in one array: the key, which is the left id * 2^bits
    + the right one + 1, and the rank in one long, at one of two places that the key gives (slot), 0 where there is none; one:
    ids of single bytes; two: ranks of two bytes by their values, so that a pre-token's first look costs no lookup. Ids and
    places of a piece are packed into one long: at most 2^places bytes are a pre-token.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.bits = max(ranks.values()).bit_length()
        if self.bits > 20:
            raise ValueError("ids of more than 20 bits")
        self.none = 1 << self.bits
        self.places = 62 - 2 * self.bits
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[(left << self.bits | right) + 1] = rank
        self.size = 1 << max(4, (2 * len(pairs)).bit_length())
        table = [0] * self.size
        for entry in (key << self.bits | rank for key, rank in pairs.items()):
            way = 0
            for _ in range(500):  # who comes takes the place, and who stood there goes to the other of its two
                at = self.slot(entry >> self.bits, way)
                table[at], entry = entry, table[at]
                if not entry:
                    break
                way = int(self.slot(entry >> self.bits, 0) == at)
            else:
                raise ValueError("no places for all pairs")
        self.of = _literal(table, "array<bigint>")
        self.one = _literal([ranks.get(bytes([a]), -1) for a in range(256)], "array<int>")
        self.two = _literal([ranks.get(bytes([a, b]), self.none) for a in range(256) for b in range(256)], "array<int>")

    def slot(self, key, way: int):
        """A place of a key, a number or a column of up to 40 bits: the middle of a product."""
        if isinstance(key, Column):
            mixed = F.shiftrightunsigned(key, 20).bitwiseXOR(key).bitwiseAND(F.lit((1 << 30) - 1)) * PLACES[way]
            return F.shiftright(mixed, 20).bitwiseAND(F.lit(self.size - 1)).cast("int")
        return (((key >> 20 ^ key) & (1 << 30) - 1) * PLACES[way] >> 20) & (self.size - 1)


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def folded(words: Column, ranks: Ranks) -> Column:
    """Ids of each of words, an array of pre-tokens: in each, as often as it has bytes, the adjacent pair of least rank
    (the leftmost) becomes one piece.

    The fold's state is an array of pieces, a long for each: the rank of it and the next as one piece, its place and its
    id, from high bits to low. The least long so is the pair to merge next, and a merge removes the next and changes two in place.
    """
    bits, above = ranks.bits, ranks.bits + ranks.places
    own, low = (1 << bits) - 1, (1 << above) - 1

    def one(word: Column, of: Column, byte: Column, two: Column) -> Column:
        def look(key: Column) -> Column:
            at = [F.get(of, ranks.slot(key, way)) for way in (0, 1)]
            hits = (F.when(F.shiftright(x, bits) == key, x.bitwiseAND(F.lit(own))) for x in at)
            return F.coalesce(*hits, F.lit(ranks.none).cast("long"))

        def rank(left: Column, right: Column) -> Column:
            return F.shiftleft(F.when(right.isNotNull(), _let(F.shiftleft(left, bits) + right + 1, look)).otherwise(F.lit(ranks.none).cast("long")), above)

        def joined(acc: Column, m: Column, at: Column) -> Column:
            new, after = F.shiftright(m, above), F.get(acc, at + 1)
            piece = rank(new, after.bitwiseAND(F.lit(own))) + m.bitwiseAND(F.lit(low - own)) + new
            before = lambda left: rank(left.bitwiseAND(F.lit(own)), new) + left.bitwiseAND(F.lit(low))
            # no two pieces are equal, as each holds its place
            return F.transform(F.array_remove(acc, F.get(acc, at)), lambda x, i: F.when(i + 1 == at, piece).when(i + 2 == at, before(x)).otherwise(x))

        def merge(acc: Column, _: Column) -> Column:
            return _let(F.array_min(acc), lambda m: F.when(m >= ranks.none << above, acc).otherwise(_let(F.array_position(acc, m).cast("int"), lambda at: joined(acc, m, at))))

        def all_merges(signs: Column) -> Column:
            values = F.transform(F.split(signs, ""), F.ascii)
            start = _let(values, lambda p: F.transform(p, lambda v, i: F.shiftleft(F.coalesce(F.get(two, v * 256 + F.get(p, i + 1)), F.lit(ranks.none)).cast("long"), above) + F.shiftleft(i.cast("long"), bits) + F.get(byte, v)))
            return F.aggregate(F.sequence(F.lit(2), F.greatest(F.length(signs), F.lit(2))), start, merge, lambda acc: F.transform(acc, lambda x: x.bitwiseAND(F.lit(own)).cast("int")))

        return _let(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), all_merges)

    # each table is named once: its literal stands once in the plan
    return _let(ranks.of, lambda of: _let(ranks.one, lambda byte: _let(ranks.two, lambda two: F.transform(words, lambda w: one(w, of, byte, two)))))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, uses: each pre-token of all texts of docs (text); null and empty texts have none, repeated rows count each."""
    return docs.select(F.explode(F.regexp_extract_all(text_of(), F.lit(PATTERN), 0)).alias("word")).groupBy("word").agg(F.count("*").alias("uses"))


def _fitting(counts: DataFrame, known: int) -> int:
    """The least number of uses that at most `known` words reach; counts above 100,000 are told apart no further."""
    reach = counts.groupBy(F.least("uses", F.lit(100_000)).alias("uses")).count().orderBy(F.desc("uses")).collect()
    least, total = 100_001, 0
    for r in reach:
        if (total := total + r["count"]) > known:
            break
        least = r["uses"]
    return least


def merged(raw: bytes, ranks: dict[bytes, int]) -> bytes:
    """Ids of one long pre-token: the same merges by a heap of pairs, n log n of its bytes."""
    n = len(raw)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, at, end = heappop(heap)
        mid = after[at]
        if mid is None or mid == n or after[mid] != end:  # one of the two has become another piece since
            continue
        after[at], after[mid] = end, None
        if end < n:
            before[end] = at
            if (r := ranks.get(raw[at : after[end]])) is not None:
                heappush(heap, (r, at, after[end]))
        if at and (r := ranks.get(raw[before[at] : end])) is not None:
            heappush(heap, (r, before[at], end))
    at, ids = 0, []
    while at < n:
        ids.append(ranks[raw[at : after[at]]])
        at = after[at]
    return np.array(ids, "<u4").tobytes()


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (word, ids) one row for each batch: hashes, words and their sizes, ids and their numbers, each end to end."""
    for batch in batches:
        if batch.num_rows:
            words = [w.encode() for w in batch.column(0).to_pylist()]
            ids = batch.column(1).to_pylist()
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).tobytes()
            flat = np.array([x for i in ids for x in i], "<u4")
            sizes = (np.array([*map(len, x)], np.uint8).tobytes() for x in (words, ids))  # SHORT bytes at most
            row = (hashes, b"".join(words), *sizes, (flat.astype("<u2") if (small := not len(flat) or flat.max() < 1 << 16) else flat).tobytes())
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in row), pa.array([2 if small else 4])], names=["hashes", "words", "word_sizes", "id_sizes", "ids", "width"])


def laid_out(parts: list[tuple]) -> Iterator[np.ndarray]:
    """The table that rows of _compact make together, as arrays to be written end to end: the number of words and of their
    bytes, hashes in order, where each word's ids and bytes begin and their sizes in a byte, all ids, all bytes."""
    join = lambda k: b"".join(p[k] for p in parts)
    hashes, words = np.frombuffer(join(0), np.uint64), np.frombuffer(join(1), np.uint8)
    order = np.argsort(hashes).astype(np.uint32)
    yield np.array([len(hashes), len(words)], np.uint64)
    yield hashes[order]
    sizes = [np.frombuffer(join(k), np.uint8) for k in (2, 3)]
    yield from ((np.cumsum(x, dtype=np.uint32) - x)[order] for x in sizes)
    yield np.concatenate([np.frombuffer(p[4], f"<u{p[5]}").astype("<u4") for p in parts] or [np.empty(0, "<u4")])
    yield from (x[order] for x in sizes)
    yield words


class Known:
    """Ids of texts' words (parted), found in a table of pre-tokens; those that it lacks are marked and listed.

    The table is rows of _compact, or the name of a file (laid_out) that Spark has brought to each executor: its workers
    map one file and share its pages, and none unpacks it. What has been found is kept for a while.
    """

    def __init__(self, table: list[tuple] | str, ranks: dict[bytes, int]):
        self.table, self.ranks = table, ranks

    def __setstate__(self, state: dict) -> None:
        table, self.ranks = state["table"], state["ranks"]
        if isinstance(table, str):
            with open(SparkFiles.get(table), "rb") as f:
                self.raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        else:
            self.raw = b"".join(x.tobytes() for x in laid_out(table))
        n, size = np.frombuffer(self.raw, np.uint64, 2).tolist()
        self.words, self.ids = len(self.raw) - size, 16 * (n + 1)  # where they begin
        self.hashes = np.frombuffer(self.raw, np.uint64, n, 16)
        begins = np.frombuffer(self.raw, np.uint32, 2 * n, 8 * n + 16).reshape(2, n)
        sizes = np.frombuffer(self.raw, np.uint8, 2 * n, self.words - 2 * n).reshape(2, n)
        self.spans = [*zip(begins, sizes, strict=True)]  # where each begins, and its size in a byte
        self.kept, self.recent = {}, []

    def look(self, parts: list[str]) -> dict[str, bytes]:
        """Those of parts that the table holds, and long ones, with their ids."""
        raw = [p.encode() for p in parts]
        out = {p: merged(x, self.ranks) for p, x in zip(parts, raw, strict=True) if len(x) > LONG}
        if len(self.hashes):
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == hashes)
            table, own, ids = self.raw, self.words, self.ids
            for k, w, wn, i, n in zip(hit.tolist(), *(x[at[hit]].tolist() for s in self.spans for x in s), strict=True):
                if table[own + w : own + w + wn] == raw[k]:
                    out[parts[k]] = table[ids + 4 * i : ids + 4 * (i + n)]
        return out

    def texts(self, texts: pa.Array) -> list[tuple[bytes, list[str]]]:
        """Of each text the ids in order, with a mark and a number for each pre-token that is missing, and those by number."""
        if len(self.recent) > RECENT:
            for w in self.recent:
                del self.kept[w]
            self.recent.clear()
        ends, words = parted(texts)
        keys = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # str made in C, not by a scalar each
        own, rare = list(map(self.kept.get, keys)), {}
        parts = {k: _parts(keys[k]) for k, ids in enumerate(own) if ids is None}
        found = self.look(list({p for ps in parts.values() for p in ps}))
        for k, ps in parts.items():
            if all(p in found for p in ps):
                own[k] = self.kept[keys[k]] = found[ps[0]] if len(ps) == 1 else b"".join(map(found.__getitem__, ps))
                if len(self.kept) > WARM:
                    self.recent.append(keys[k])
            else:
                own[k] = b"".join([found[p] if p in found else (_MARK + rare.setdefault(p, len(rare))).to_bytes(4, "little") for p in ps])
        ids, ends = spread(own, words, ends)
        # the batch's numbers of missing pre-tokens become each text's own
        at, starts = np.flatnonzero(ids >= _MARK), np.append(0, ends)
        pairs, place = np.unique(np.searchsorted(ends, at, "right") << 32 | (ids[at] & (_MARK - 1)), return_inverse=True)
        first = np.searchsorted(pairs, np.arange(len(starts)) << 32)
        ids[at] = (place - first[pairs[place] >> 32] + _MARK).astype("<u4")
        names = list(rare)
        missing = [names[k] for k in (pairs & (_MARK - 1)).tolist()]
        raw, bounds = ids.tobytes(), (4 * starts.astype(np.int64)).tolist()
        return [(raw[s:e], missing[i:j]) for s, e, i, j in zip(bounds, bounds[1:], first.tolist(), first[1:].tolist(), strict=False)]


def _parts(word: str) -> list[str]:
    """The pre-tokens of one of a text's words."""
    if word.isascii() and word[0] == " ":  # mostly letters after a blank, or those and a sign
        if word[1:].isalpha():
            return [word]
        if word[-1] in ",.;:!?" and word[1:-1].isalpha():
            return [word[:-1], word[-1]]
    return PARTS.findall(word)


def _inserted(marked: pa.Array, rare: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of rows (marked) one after another, with those of rare, a list of lists for each row, in place of their marks, and where each row begins and the last ends."""
    bounds = np.frombuffer(marked.buffers()[1], np.int32)[marked.offset : marked.offset + len(marked) + 1] >> 2 if len(marked) else np.zeros(1, np.int32)
    ids = np.frombuffer(marked.buffers()[2] or b"", "<u4")[bounds[0] : bounds[-1]] if len(marked) else np.empty(0, "<u4")
    bounds = bounds - bounds[0]
    at = np.flatnonzero(ids >= _MARK)
    if not len(at):
        return ids, bounds
    first, lists = rare.offsets.to_numpy(), rare.values
    begins, more = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
    which = first[np.searchsorted(bounds, at, "right") - 1] + (ids[at] & (_MARK - 1))
    source, n = np.arange(len(ids)), np.ones(len(ids), np.int64)
    source[at], n[at] = len(ids) + begins[which], begins[which + 1] - begins[which]
    after = np.append(0, np.cumsum(n))
    return np.concatenate([ids, more])[np.repeat(source - after[:-1], n) + np.arange(after[-1])], after[bounds].astype(np.int32)


def filled(marked: bytes, rare: list) -> np.ndarray:
    """marked with the ids of rare in place of their marks."""
    return _inserted(pa.array([marked], pa.binary()), pa.array([[np.asarray(r, np.int32) for r in rare]], pa.list_(pa.list_(pa.int32()))))[0]


def _pieces(ranks: dict[bytes, int]) -> pa.Array:
    """The piece of each id; null where there is none."""
    by_id = {rank: token for token, rank in ranks.items()}
    return pa.array([by_id.get(k) for k in range(max(by_id, default=-1) + 1)], pa.binary())


def _joined(ids: np.ndarray, bounds: np.ndarray, pieces: pa.Array, absent: pa.Buffer | None = None) -> pa.Array:
    """The bytes that each row's ids stand for, its pieces as they lie one after another; bounds: where each row begins and the last ends."""
    wrong = np.flatnonzero((ids < 0) | (ids >= len(pieces)))
    got = pieces.take(pa.array(ids)) if not len(wrong) else None
    if got is None or got.null_count:
        raise ValueError(f"no piece has the id {ids[wrong[0]] if got is None else ids[got.is_null().to_numpy(zero_copy_only=False)][0]}")
    ends = np.frombuffer(got.buffers()[1], np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [absent, pa.py_buffer(ends[bounds]), got.buffers()[2] or pa.py_buffer(b"")])


def _sent(parts: DataFrame) -> str:
    """The name of the file, with the table that rows of _compact make, which each executor gets once."""
    path = f"{os.path.realpath(tempfile.mkdtemp(prefix='spark-'))}/words-{uuid.uuid4().hex}"
    with open(path, "wb") as f:
        for x in laid_out([tuple(p) for p in parts.toLocalIterator()]):
            x.tofile(f)
    parts.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def encode(docs: DataFrame, ranks: dict[bytes, int], known: int = KNOWN, decoded: bool = False) -> DataFrame:
    """doc_id, ids (array) and ids_le (the same, little-endian 32-bit) of each row of docs (doc_id, text); with decoded
    also the bytes that those ids stand for, joined in the tasks that fill them in.

    The pre-tokens of the corpus are counted; the most frequent (`known` at most, of SHORT bytes at most) are folded once
    each and sent to all executors as one file of bounded size, which workers map. A document's other pre-tokens, each once, are folded in its
    own row and put in their places. No text is shuffled. A pre-token of n bytes takes n merges over at most n pieces;
    one of over LONG bytes is merged by a heap instead. Null texts count as empty: no ids. Equal rows give equal rows; an
    empty table gives an empty one.
    """
    session(docs.sparkSession)
    tables = Ranks(ranks)
    counts = durable(word_counts(docs).filter(F.octet_length("word") <= SHORT))
    often = counts.filter(F.col("uses") >= F.greatest(F.lit(_fitting(counts, known)), F.lit(2))).repartition("word")
    folds = often.select("word", F.element_at(folded(F.array("word"), tables), 1).alias("ids"))
    parts = durable(folds.mapInArrow(_compact, "hashes binary, words binary, word_sizes binary, id_sizes binary, ids binary, width long"))
    held = docs.sparkSession.sparkContext.broadcast(Known(_sent(parts), ranks))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, TOGETHER):
            got = held.value.texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.list_(pa.string()))], names=["doc_id", "marked", "rare"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(ranks) if decoded else None
        for batch in batches:
            out, bounds = _inserted(batch.column(1), batch.column(2))
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(out.view(np.int32)))
            raw = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(4 * bounds), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, raw, *([_joined(out.view(np.int32), bounds, pieces)] if decoded else [])], names=["doc_id", "ids", "ids_le", *["decoded"] * decoded])

    kind = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select("doc_id", text_of().alias("text")).mapInArrow(mark, f"doc_id {kind}, marked binary, rare array<string>")
    return marked.select("doc_id", "marked", F.when(F.size("rare") > 0, folded(F.col("rare"), tables)).otherwise(F.expr("cast(array() as array<array<int>>)")).alias("rare")).mapInArrow(fill, f"doc_id {kind}, ids array<int>, ids_le binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """encoded (with ids, an array) and the bytes that the ids stand for: their pieces joined, as column decoded.

    No ids are no bytes; a null stays null; equal rows give equal rows; an empty table gives an empty one. An id that no
    piece has is an error.
    """
    session(encoded.sparkSession)
    rows = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(ranks)
        for batch in batches:
            rows = batch.column("ids")
            n = rows.value_lengths().fill_null(0).to_numpy()  # flatten() leaves a null row's ids out
            flat = rows.flatten().cast(pa.int64()).fill_null(-1).to_numpy()
            known = pa.array(rows.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)).cast(pa.bool_())
            yield batch.append_column("decoded", _joined(flat, np.append(0, np.cumsum(n)), pieces, known.buffers()[1] if rows.null_count else None))

    return rows.mapInArrow(run, StructType([*rows.schema, StructField("decoded", BinaryType())]))
