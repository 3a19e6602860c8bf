"""Importance resampling against plain counting."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tidepanel.llm import importance
from tidepanel.llm.common import durable

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, longest=1):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, buckets, longest, seed=2024, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (collections.Counter(bucket(f) for x in texts for f in features(x, longest)[1]) for texts in ([d[1] for d in docs], target))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    rows = []
    for doc_id, text in docs:
        words, own = features(text, longest)
        weight = sum(gain[bucket(f)] for f in own)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    drawn = collections.Counter()
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        drawn[(*r[:4], k + 1)] += 1
    rest = collections.Counter((*r[:4], None) for r in [*fit[len(fit) * percent // 100 :], *(r for r in rows if r[4] < least)])
    return drawn + rest


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(13)
    words = [*(f"W{rng.choice('abcÄé')}{rng.randrange(400)}" for _ in range(300)), "x" * 90, "同同同", "ß", "1st", "\x85", "K"]
    texts = [None, "", "...", " ", "one", "A\x00b\x7fc", *(rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=rng.randrange(80))) for _ in range(300))]
    rows = [(i if i != 9 else None, t) for i, t in enumerate(texts)]
    return rows + [rows[20]] * 30 + [(5, "again " * 25)], [" ".join(rng.choices(words[:40], k=50)) for _ in range(5)] + [None]


@pytest.mark.parametrize("buckets,longest,words", [(10_000, 1, 200_000), (70_000, 3, 1500), (97, 2, 0)])
def test_resampled(spark, docs, buckets, longest, words):
    rows, target = docs
    table = durable(spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, score int, _place string").repartition(3))
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    out = importance.resampled(table, wanted, buckets, longest, words=words)
    assert collections.Counter(map(tuple, out.collect())) == brute(rows, target, buckets, longest)
    assert importance.resampled(table.filter("false"), wanted, buckets, longest).count() == 0


def test_scan_as_the_dictionary_grows(docs):
    """Payloads are the words' own before, between and after the automaton's builds, and beyond its room."""
    rng = random.Random(4)
    for limit in (0, 10, 1100, 5000):
        known = importance.Words(limit)
        for _ in range(400):
            text = "".join(rng.choice([" ", " ", "-", "", "\n"]) + rng.choice(["é", "w", "同", "X" * 70]) + str(rng.randrange(4000)) for _ in range(rng.randrange(40)))
            crc, size = known.scan(text)
            words = [w.encode() for w in features(text)[0]]
            assert crc.tolist() == list(map(zlib.crc32, words)) and size.tolist() == list(map(len, words))
        assert len(known.number) <= limit and (limit < 1000 or known.built > 0)


def test_runs():
    words = ["a", "bé", "ccc", "d"]
    crc, size = np.array([zlib.crc32(w.encode()) for w in words], np.uint32), np.array([len(w.encode()) for w in words])
    for n in (1, 2, 3, 9):
        assert sorted(importance.runs(crc, size, n).tolist()) == sorted(zlib.crc32(f.encode()) for f in features(" ".join(words), n)[1])
    assert importance.runs(crc[:0], size[:0], 3).tolist() == []
