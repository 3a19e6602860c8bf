"""Importance resampling towards a target: hashed runs of words, gains of buckets, and a seeded draw without replacement.

Words meet a dictionary in an Aho-Corasick automaton, each bounded by its delimiters. A match gives the word's payload, its
CRC-32 and length; payloads of neighbours compose to the CRC of a run of words, without making its string.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.checksums import joined
from tidepanel.llm.common import durable, in_order, session, text_of

#: Words of a process's dictionary, and the length of the longest in it; the payloads of others are made where they stand.
WORDS, LONGEST = 200_000, 64
#: Delimiters become spaces, A-Z small letters; bytes beyond ASCII belong to words.
_LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


class Words:
    """Payloads of the words of texts. The automaton is built again whenever its dictionary has doubled."""

    def __init__(self, limit: int = WORDS):
        self.limit, self.number, self.crcs, self.sizes, self.points = limit, {}, [], [], []
        self.built, self.automaton = 0, None

    def _build(self) -> None:
        import ahocorasick

        self.automaton, self.built = ahocorasick.Automaton(ahocorasick.STORE_INTS), len(self.number)
        for word, k in self.number.items():
            self.automaton.add_word(f" {word} ", k)
        self.automaton.make_automaton()
        self.crc, self.size, self.length = np.array(self.crcs, np.uint32), np.array(self.sizes, np.int64), np.array(self.points, np.int64)

    def _met(self, word: str) -> tuple[int, int]:
        """The payload of a word that the automaton doesn't hold; the dictionary takes it, if there is room."""
        k = self.number.get(word)
        if k is not None:
            return self.crcs[k], self.sizes[k]
        raw = word.encode()
        crc = zlib.crc32(raw)
        if len(self.number) < self.limit and len(word) <= LONGEST:
            self.number[word] = len(self.crcs)
            self.crcs.append(crc)
            self.sizes.append(len(raw))
            self.points.append(len(word))
        return crc, len(raw)

    def scan(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """CRCs and lengths in bytes of the words of a text, in order."""
        text = f" {text.encode().translate(_LETTERS).decode()} "
        if len(self.number) >= min(self.limit, max(1024, 2 * self.built)) > self.built:
            self._build()
        found = list(self.automaton.iter(text)) if self.automaton else []
        k = np.fromiter((v for _, v in found), np.int64, len(found))
        crc, size, length = (self.crc[k], self.size[k], self.length[k]) if self.automaton else (k.astype(np.uint32), k, k)
        if int(length.sum()) == len(text) - text.count(" "):
            return crc, size
        ends = np.fromiter((e for e, _ in found), np.int64, len(found))
        left, right = np.concatenate([[0], ends]), np.concatenate([ends - length - 1, [len(text) - 1]])
        at, more = [], []
        for i in np.flatnonzero(right > left).tolist():  # what lies between matches
            for word in text[left[i] : right[i]].split(" "):
                if word:
                    at.append(i)
                    more.append(self._met(word))
        new = np.array(more, np.int64).reshape(-1, 2)
        return np.insert(crc, at, new[:, 0].astype(np.uint32)), np.insert(size, at, new[:, 1])


def runs(crc: np.ndarray, size: np.ndarray, longest: int) -> np.ndarray:
    """CRCs of all runs of 1 to longest consecutive words, joined by one space, from the words' CRCs and lengths."""
    out = [crc]
    if longest > 1:
        spaced = joined(np.full(len(crc), zlib.crc32(b" "), np.uint32), crc, size)
    for n in range(2, min(longest, len(crc)) + 1):
        out.append(joined(out[-1][:-1], spaced[n - 1 :], size[n - 1 :] + 1))
    return np.concatenate(out)


_WORDS: dict[int, Words] = {}


def bucketed(docs: DataFrame, buckets: int = 10_000, longest: int = 1, words: int = WORDS) -> DataFrame:
    """The rows of docs (doc_id, text) with n_words, n_features and buckets: the bucket of each feature, little-endian.

    A feature is a run of 1 to longest words; its bucket is its CRC-32 modulo buckets. What a process has learnt of words
    serves its next tasks. A null text has no words.
    """
    session(docs.sparkSession)
    width = "<u2" if buckets <= 1 << 16 else "<u4"
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WORDS.setdefault(words, Words(words))
        for batch in batches:
            n, out = [], []
            for text in batch.column(1).to_pylist():
                crc, size = known.scan(text)
                n.append(len(crc))
                out.append((runs(crc, size, longest) % buckets).astype(width))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(list(map(len, out)), pa.int64()), pa.array([x.tobytes() for x in out], pa.binary())], names=["doc_id", "n_words", "n_features", "buckets"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, buckets binary")


def bucket_counts(features: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Features in each bucket; counted in each task, so that it sends a row for each bucket at most."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                counts += np.bincount(np.frombuffer(raw, width), minlength=buckets)
        here = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), pa.array(counts[here])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # buckets rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets."""
    b, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the sum of the gains of a row's features."""
    width = "<u2" if len(gain) <= 1 << 16 else "<u4"
    kind = features.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(gain[np.frombuffer(raw, width)].sum()) for raw in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return features.select("doc_id", "n_words", "n_features", "buckets").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))), u a hash of seed and id between 0 and 1; a null id counts as an empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / float(1 << 32))))


def resampled(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, seed: int = 2024, least: int = 20, percent: int = 10, words: int = WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs (doc_id, text) for the texts of target (text).

    Of the rows with least words, percent of a hundred (rounded down) with the highest scores are drawn and ranked from 1,
    ties to the lesser doc_id (null first); the rank of others is null. Texts are read once: their buckets are written, then
    counted and scored. Only the buckets' sums come to the driver. Null and empty texts weigh 0. Repeated rows are drawn
    each, next to each other; an empty table gives an empty one.
    """
    features = durable(bucketed(docs, buckets, longest, words))
    wanted = bucket_counts(bucketed(target.select(F.lit(0).alias("doc_id"), "text"), buckets, longest, words), buckets)
    rows = weighted(features, gains(bucket_counts(features, buckets), wanted))
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("_fit", F.col("n_words") >= least)
    placed = in_order(rows, [F.desc("_fit"), F.desc("score"), F.asc_nulls_first("doc_id")])
    n = placed.filter("_fit").count() * percent // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("_fit") & (F.col("_place") < n), F.col("_place") + 1).alias("rank"))
