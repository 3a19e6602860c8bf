"""Quality rules on repetition: suffix array with bucket pointers, and maximal repeats from longest-common-prefix intervals."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidepanel.llm.common import ASCII_SPACE, session

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
#: Words of a repeat at least; largest covered share of a text's words; largest share of one repeat.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 5, 0.4, 0.3


def pointers(ids: np.ndarray) -> np.ndarray:
    """Each position's bucket pointer after sorting by one id: the start of its bucket."""
    sizes = np.bincount(ids)
    return (np.cumsum(sizes) - sizes)[ids]


def refined(rank: np.ndarray, active: np.ndarray, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket pointers after sorting each active bucket by the pointers in follow, and the positions that still share one."""
    key = rank[active] * np.int64(len(rank) + 1) + follow
    order = np.argsort(key)
    at, key = active[order], key[order]
    old, place = rank[at], np.arange(len(at))
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    bucket = np.ones(len(at), bool)
    bucket[1:] = old[1:] != old[:-1]
    out = rank.copy()
    out[at] = old + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(bucket, place, 0))
    alone = new.copy()
    alone[:-1] &= new[1:]
    return out, np.sort(at[~alone])


def intervals(lcp: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The intervals of neighbouring suffixes that share more than those around them: depth (words shared), first suffix, whether
    the string is a maximal repeat, and of each suffix the deepest interval that is one (-1: none).

    lcp: words that neighbours share, 0 for too few; before: the word before each suffix. A string that can't be made longer
    to the right is an interval; it is maximal if its suffixes have different words before them.
    """
    depth: list[int] = []
    first: list[int] = []
    low: list[int] = []
    high: list[int] = []
    parent: list[int] = []
    of, stack, done = [], [], []

    def opened(d: int, at: int, lo: int, hi: int) -> int:
        for held, x in zip((depth, first, low, high, parent), (d, at, lo, hi, -1), strict=True):
            held.append(x)
        stack.append(len(depth) - 1)
        return stack[-1]

    for i, (d, b) in enumerate(zip([*lcp.tolist(), 0], before.tolist(), strict=True)):
        top = stack[-1] if stack else -1
        if d > (depth[top] if stack else 0):
            of.append(opened(d, i, b, b))
            continue
        of.append(top)
        if stack:
            low[top], high[top] = min(low[top], b), max(high[top], b)
        while stack and depth[stack[-1]] > d:
            k = stack.pop()
            done.append(k)
            if stack and depth[stack[-1]] >= d:
                up = parent[k] = stack[-1]
                low[up], high[up] = min(low[up], low[k]), max(high[up], high[k])
            elif d:
                parent[k] = opened(d, first[k], low[k], high[k])
    maximal = np.array(low) != np.array(high)
    nearest = [-1] * len(depth)
    for k in reversed(done):  # those around an interval end after it
        nearest[k] = k if maximal[k] else nearest[parent[k]] if parent[k] >= 0 else -1
    return np.array(depth, np.int64), np.array(first, np.int64), maximal.astype(bool), np.array([nearest[k] if k >= 0 else -1 for k in of], np.int64)


def repeats(docs: list[np.ndarray], min_repeat: int = MIN_REPEAT) -> list[tuple[int, int, int, int, list[tuple[int, int]]]]:
    """Of each document (word ids): words in 3-word windows found twice, words that repeats cover, longest repeat, maximal
    repeats, covered spans.

    One suffix array holds all documents of the batch; ids of different documents differ and a unique id ends each, so
    no match crosses documents. Buckets of one position are left alone from the round on in which they become so.
    """
    sizes = np.array([len(d) + 1 for d in docs], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    n = int(ends[-1]) if len(docs) else 0
    ids = np.empty(n, np.int64)
    for d, s, e in zip(docs, starts, ends, strict=True):
        ids[s : e - 1] = d + s  # at most e - s - 1 different ids
        ids[e - 1] = e - 1
    level = [pointers(ids)]
    active = np.flatnonzero(np.bincount(ids, minlength=n)[ids] > 1)
    threes, found, h = np.zeros(n + 1, np.int64), np.empty(0, np.int64), 1
    while len(active):
        rank, active = refined(level[-1], active, level[-1][active + h])
        level.append(rank)
        h *= 2
        if h == 2 and len(active):
            same = refined(rank, active, level[0][active + 2])[1]
            np.add.at(threes, same, 1)
            np.add.at(threes, same + 3, -1)
        if h <= min_repeat:
            found = active
    sa = found[np.argsort(level[-1][found])]
    a, b = sa[:-1], sa[1:]
    lcp = np.zeros(len(a), np.int64)
    for k in range(len(level) - 1, -1, -1):
        x, y = np.minimum(a + lcp, n - 1), np.minimum(b + lcp, n - 1)
        lcp += np.where(level[k][x] == level[k][y], 1 << k, 0)
    # what a suffix begins with belongs to its deepest maximal repeat, or to one that begins before it and covers it
    widest, found_in = np.zeros(len(sa), np.int64), np.empty(0, np.int64)
    if len(sa):
        depth, at, maximal, deepest = intervals(np.where(lcp >= min_repeat, lcp, 0), np.where(sa > 0, ids[sa - 1], -1))
        widest[deepest >= 0] = depth[deepest[deepest >= 0]]
        found_in = np.searchsorted(ends, sa[at[maximal]], side="right")
    number = np.bincount(found_in, minlength=len(docs))
    keep = widest >= min_repeat
    sa, widest = sa[keep], widest[keep]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, sa, 1)
    np.add.at(cover, sa + widest, -1)
    covered = np.cumsum(cover)[:n] > 0
    longest = np.zeros(len(docs), np.int64)
    np.maximum.at(longest, np.searchsorted(ends, sa, side="right"), widest)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for doc, s, e in zip(np.searchsorted(ends, edges[::2], side="right").tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        spans[doc].append((s - int(starts[doc]), e - int(starts[doc])))
    three = np.concatenate(([0], np.cumsum(np.cumsum(threes)[:n] > 0)))
    total = np.concatenate(([0], np.cumsum(covered)))
    return [(int(three[e] - three[s]), int(total[e] - total[s]), int(longest[i]), int(number[i]), spans.get(i, [])) for i, (s, e) in enumerate(zip(starts, ends, strict=True))]


def profile(texts: list[str | None], min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> dict[str, list]:
    """The columns of quality() for some texts."""
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines")}
    docs = []
    for text in texts:
        text = text or ""
        words = WORD.findall(text)
        ids: defaultdict[str, int] = defaultdict(count().__next__)
        docs.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
        out["n_words"].append(len(words))
        out["word_chars"].append(sum(map(len, words)))
        out["n_symbols"].append(sum(map(text.count, SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
    three, covered, longest, number, spans = (list(x) for x in zip(*repeats(docs, min_repeat), strict=True)) if docs else ([], [], [], [], [])
    failed = [n < 50 or 100 * r > 50 * n for n, r in zip(out["n_words"], three, strict=True)]
    kept = [not f and c <= max_covered * n and m <= max_longest * n for f, c, m, n in zip(failed, covered, longest, out["n_words"], strict=True)]
    return out | {"n_repeat_words": three, "base_failed": failed, "kept": kept, "covered_words": covered, "longest_repeat": longest, "n_maximal_repeats": number, "repeat_spans": [[{"start": s, "end": e} for s, e in x] for x in spans]}


_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_words long, longest_repeat long, n_maximal_repeats long, repeat_spans array<struct<start: long, end: long>>"
_ARROW = pa.schema([(k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("covered_words", pa.int64()), ("longest_repeat", pa.int64()), ("n_maximal_repeats", pa.int64()), ("repeat_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def quality(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """Repetition profile and verdict of each row of docs (doc_id, text; other columns are not read).

    base_failed: under 50 words, or more than half of the words in 3-word windows that the text has twice or more.
    kept: not base_failed, and the union of all maximal repeats of min_repeat words or more covers at most max_covered of the
    words, and the longest is at most max_longest of them. Null and empty texts have no words and fail; equal rows give
    equal rows; an empty table gives an empty one. Rows don't meet, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = profile(batch.column(1).to_pylist(), min_repeat, max_covered, max_longest)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[f.name], f.type) for f in _ARROW)], names=["doc_id", *_ARROW.names])

    session(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_COLUMNS}")


def keep_good(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns: null and empty texts go, equal rows share a verdict."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(profile(batch.column(at).to_pylist(), min_repeat, max_covered, max_longest)["kept"], pa.bool_()))

    session(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
