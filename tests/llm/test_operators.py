"""The corpus operators against brute force on small inputs, edge cases included."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import pickle
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidepanel.llm import bpe, licenses, packing, personal_data, pieces, queries, repetition, simhash, suffix_dedup, token_counts, topk, url_rules

SPACES = r"[^\x20\x09-\x0D]+"
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
EDGES = ["", " ", "\n \t", "a", "a a a a a a a a", "x" * 3000, "ab" * 700, "no end", "\x00\x1c\x85", "é́ü 　ß ı İ. Σ", "don't we'll 'tis", "<|endoftext|> <|startoftext|>x", "12 345.67.89.1", "\U0001f600 \U0001f600\U0001f600", "同同同同 同同"]


def prose(rng: random.Random, n: int, vocabulary: int = 80) -> str:
    return " ".join(f"{rng.choice('abcdefghij')}{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts() -> list[str | None]:
    rng = random.Random(1)
    own = [prose(rng, rng.randint(3, 200)) for _ in range(40)]
    passage = prose(rng, 40)
    near = [t.replace("a1 ", "zz ", 1) for t in own[:6]]
    return [None, *EDGES, *own, *own[:4], *near, *(passage + t for t in own[6:12]), (passage + " ") * 3]


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Documents with a null id, repeated ids and rows, and columns whose names clash with inner ones."""
    rows = [(i if i != 3 else None, t, "x", i) for i, t in enumerate(texts)] + [(9, texts[20], "x", 0), (9, texts[20], "x", 0)]
    path = simhash.durable(spark.createDataFrame(rows, "doc_id long, text string, row string, fp long"))
    return path


def empty(docs):
    return docs.filter("false")


def by_id(df) -> dict:
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


def each(docs, df):
    """Pairs of an input text and its result, ids that repeat left out."""
    found, seen = by_id(df), by_id(docs)
    assert {k: len(v) for k, v in found.items()} == {k: len(v) for k, v in seen.items()}
    return [(v[0]["text"], found[k][0]) for k, v in seen.items() if len(v) == 1]


def test_repetition(docs):
    for text, r in each(docs, repetition.quality(docs)):
        w = re.findall(SPACES, text or "")

        def windows(k, w=w):
            count = collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
            mark = [0] * len(w)
            for i in range(len(w) - k + 1):
                if count[tuple(w[i : i + k])] > 1:
                    mark[i : i + k] = [1] * k
            return sum(mark), max(count.values(), default=0) > 1

        longest = max((k for k in range(5, len(w)) if windows(k)[1]), default=0)
        maximal = 0
        for k in range(5, longest + 1):
            places = collections.defaultdict(list)
            for i in range(len(w) - k + 1):
                places[tuple(w[i : i + k])].append(i)
            maximal += sum(len({w[i - 1] if i else None for i in v}) > 1 and len({w[i + k] if i + k < len(w) else None for i in v}) > 1 for v in places.values())
        assert r.n_maximal_repeats == maximal
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.covered_words, r.longest_repeat) == (len(w), sum(map(len, w)), windows(3)[0], windows(5)[0], longest)
        assert r.base_failed == (len(w) < 50 or 100 * windows(3)[0] > 50 * len(w))
        assert sum(s["end"] - s["start"] for s in r.repeat_spans) == r.covered_words
        assert not (r.base_failed and r.kept)
    assert repetition.quality(empty(docs)).count() == 0


def test_keep_good_keeps_columns(docs):
    kept = repetition.keep_good(docs)
    assert kept.schema == docs.schema and 0 < kept.count() < docs.count()


@pytest.mark.parametrize("known", [0, 30, 10**6])
def test_bpe_round_trip(docs, known):
    ranks = bpe.read_ranks(BYTE_BPE)
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.encode(docs, ranks, known)
    for text, r in each(docs, bpe.decode(out, ranks)):
        want = encoder.encode_ordinary(text or "")
        assert r.ids == want and r.ids_le == np.array(want, "<u4").tobytes() and bytes(r.decoded) == (text or "").encode()
    assert bpe.encode(empty(docs), ranks, known).count() == 0


def test_bpe_decodes_where_it_encodes(spark, docs):
    """No literal of all pieces and no higher-order function over each id: the tasks that fill ids in join their pieces."""
    ranks = bpe.read_ranks(BYTE_BPE)
    plan = queries.op2_byte_bpe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "unhex" not in plan
    known = lambda df: sorted(map(str, df.select("doc_id", "ids", "ids_le", "decoded").collect()))
    assert known(bpe.encode(docs, ranks, 30, decoded=True)) == known(bpe.decode(bpe.encode(docs, ranks, 30), ranks))
    rows = spark.createDataFrame([([1, 2],), (None,), ([],), ([2, None],), ([len(ranks) + 9],), ([-1],)], "ids array<int>")
    piece = {v: k for k, v in ranks.items()}
    assert [r.decoded and bytes(r.decoded) for r in bpe.decode(rows.limit(3), ranks).collect()] == [piece[1] + piece[2], None, b""]
    for k in (3, 4, 5):
        with pytest.raises(Exception, match="no piece has the id"):
            bpe.decode(rows.limit(k + 1).offset(k), ranks).collect()


@pytest.mark.parametrize("gap", [" ", "  ", "\u2028", "\xa0", "\u3000\n", "\x85 ", "\u1680", "\x1c", "'"])
def test_bpe_parts_words_at_white_space_and_signs(gap):
    """Missing pre-tokens get marks and numbers of their own in each text; wide white space is white space."""
    ranks, rng = bpe.read_ranks(BYTE_BPE), random.Random(4)
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = ["".join(rng.choices(["alpha", "É", gap, gap, " ", "'s", "!?", ".", "12", "|", "<", "同", "\n"], k=rng.randint(0, 25))) for _ in range(400)]
    words = sorted({p for t in own for p in bpe.PARTS.findall(t)})[::2]
    batch = pa.RecordBatch.from_arrays([pa.array(words), pa.array([encoder.encode_ordinary(w) for w in words], pa.list_(pa.int32()))], names=["word", "ids"])
    table = [tuple(c[0].as_py() for c in r.columns) for r in bpe._compact(iter([batch]))]
    known = pickle.loads(pickle.dumps(bpe.Known(table, ranks)))
    # of a table that all of an executor's workers may hold: 18 bytes a word besides the words and their ids
    assert known.hashes.nbytes + sum(x.nbytes for s in known.spans for x in s) <= 18 * len(words) and bpe.KNOWN <= 10**6
    for _ in range(2):
        for text, (marked, rare) in zip(own, known.texts(pa.array(["x", *own]).slice(1)), strict=True):
            assert len(set(rare)) == len(rare) and not set(rare) & set(words)
            assert bpe.filled(marked, [encoder.encode_ordinary(r) for r in rare]).tolist() == encoder.encode_ordinary(text)


def test_bpe_workers_map_their_table(spark):
    """A worker gets the name of a file and maps it: its own memory doesn't grow with the table."""
    ranks, rng = bpe.read_ranks(BYTE_BPE), random.Random(5)
    words = sorted({"".join(rng.choices("abcdeß同", k=rng.randint(1, 12))) for _ in range(150_000)})
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    batch = pa.RecordBatch.from_arrays([pa.array(words), pa.array([encoder.encode_ordinary(w) for w in words], pa.list_(pa.int32()))], names=["word", "ids"])
    parts = [tuple(c[0].as_py() for c in r.columns) for r in bpe._compact(iter([batch.slice(0, 9), batch.slice(9)]))]
    name = bpe._sent(spark.createDataFrame(parts, "hashes binary, words binary, word_sizes binary, id_sizes binary, ids binary, width long"))

    def held() -> int:
        return sum(int(line.split()[1]) for line in open("/proc/self/smaps_rollup") if line.startswith("Pss_Anon"))

    sent = pickle.dumps(bpe.Known(name, {}))
    before = held()
    known = pickle.loads(sent)
    assert len(sent) < 1_000 and held() - before < 1_000  # KB; the table has some 7 MB
    assert known.look(words[::7]) == {w: np.array(encoder.encode_ordinary(w), "<u4").tobytes() for w in words[::7]}
    assert known.look(["xyz", ""]) == {} and bpe.TOGETHER <= 10**6
    assert pickle.loads(pickle.dumps(bpe.Known(bpe._sent(spark.createDataFrame([], "a binary, b binary, c binary, d binary, e binary, f long")), {}))).look(["a"]) == {}


def test_bpe_fills_in_whole_batches():
    """Marks and pieces of all rows of a batch, and of a slice of one, with no Python object for an id."""
    rng, mark = random.Random(6), 1 << 31
    rare = [[rng.choices(range(99), k=rng.randint(1, 4)) for _ in range(rng.choice([0, 0, 1, 3]))] for _ in range(60)]
    ids = [rng.sample([*rng.choices(range(99), k=rng.choice([0, 1, 5])), *(mark + k for k in range(len(r))), *(mark + k for k in range(len(r)))], k=rng.choice([0, len(r)])) for r in rare]
    marked = pa.array([np.array(x, "<u4").tobytes() for x in ids], pa.binary())
    lists = pa.array(rare, pa.list_(pa.list_(pa.int32())))
    want = [[y for x in own for y in (r[x - mark] if x >= mark else [x])] for own, r in zip(ids, rare, strict=True)]
    pieces = bpe._pieces({bytes([k]) * (k % 3 + 1): k for k in range(99)})
    for part in (slice(0, 60), slice(7, 31), slice(9, 9)):
        out, bounds = bpe._inserted(marked[part], lists[part])
        assert [out[s:e].tolist() for s, e in zip(bounds, bounds[1:], strict=False)] == want[part]
        assert bpe._joined(out.view(np.int32), bounds, pieces).to_pylist() == [b"".join(bytes([k]) * (k % 3 + 1) for k in w) for w in want[part]]
    with pytest.raises(ValueError, match="no piece has the id 7"):
        bpe._joined(np.array([1, 7]), np.array([0, 2]), bpe._pieces({b"a": 1, b"b": 9}))


def test_bpe_of_very_long_pretokens(spark):
    """100,000 letters without a gap, and pre-tokens about the length from which a heap merges them."""
    ranks, rng = bpe.read_ranks(BYTE_BPE), random.Random(8)
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = ["".join(rng.choice("abcdeéß同") for _ in range(n)) for n in (1, 2, 63, 64, 65, 200, 300, 500, 511, 512, 513, 2000, 100_000)]
    docs = simhash.durable(spark.createDataFrame([(i, f"{t} {t}") for i, t in enumerate(own)], "doc_id long, text string"))
    assert {r.doc_id: r.ids for r in bpe.encode(docs, ranks).collect()} == {i: encoder.encode_ordinary(f"{t} {t}") for i, t in enumerate(own)}


def test_licenses(spark):
    mit = licenses.TEMPLATES[0].text
    words = mit.split()
    rows = [(0, f"x\n{mit.upper()} and more"), (1, " ".join(words[: int(len(words) * 0.5)])), (2, "Under the MIT-License; Apache  License.\nCC BY"), (3, None), (4, "mit licenses gnu general\npublic license"), (5, ""), (6, " ".join(sorted(set(words))[: math.ceil(0.8 * len(set(words)))])), (6, "cc byte")]
    docs = simhash.durable(spark.createDataFrame(rows, "doc_id long, text string"))
    got = by_id(licenses.scan(docs))
    assert "text:mit" in got[0][0].labels and got[0][0].score == 1.0 and got[0][0].n_base == 0
    assert got[1][0].labels == "" and got[1][0].score == 0.0
    assert (got[2][0].n_base, got[2][0].first_word, got[2][0].last_word, got[2][0].base_labels) == (3, 2, 6, "apache,cc-by,mit")
    assert got[3][0].n_words == 0 and got[5][0].first_word is None
    assert got[4][0].base_labels == "gpl"
    assert {r.labels for r in got[6]} == {"text:mit", ""}
    assert licenses.scan(empty(docs)).count() == 0


def test_licenses_of_one_label_in_several_texts(spark):
    """Two texts a label, wrapped over lines, long documents, and columns whose names clash."""
    texts = ("alpha beta gamma delta epsilon", "one two three four five six seven eight nine ten", "alpha one zeta eta theta")
    templates = (licenses.Template("l", texts[0]), licenses.Template("l", texts[1]), licenses.Template("m", texts[2]))
    rng = random.Random(9)
    filler = " ".join(rng.choice(["alpha", "two", "x", "y", "\n"]) for _ in range(30_000))
    own = [*texts, texts[1].replace(" ", "\n"), filler, f"{filler} ONE, two three\nfour five six seven eight {filler}", "beta gamma delta alpha", "ten nine", None]
    docs = simhash.durable(spark.createDataFrame([(i, t, "a", 1, 2) for i, t in enumerate(own)], "doc_id long, text string, label string, block int, row int"))
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs, templates).collect()}

    def want(text):
        words = re.findall("[0-9a-z]+", (text or "").lower())
        best = {}
        for t in templates:
            tokens, step = set(t.text.split()), len(t.text.split())
            blocks = [re.findall("[0-9a-z]+", x.lower()) for x in (text or "").split("\n")] + [words[k * step : (k + 2) * step] for k in range(-(-len(words) // step))]
            share = max((len(tokens & set(b)) / len(tokens) for b in blocks), default=0)
            if share >= 0.8:
                best[t.label] = max(share, best.get(t.label, 0))
        return ",".join(sorted(best)), max(best.values(), default=0.0)

    assert got == {i: want(t) for i, t in enumerate(own)} and [got[i][0] for i in range(4)] == ["l", "l", "m", "l"] and got[5][0] == "l"


def reference_cut(rows: list[tuple[int, bytes]], span: int) -> dict[int, tuple[int, int, bytes]]:
    seen, out = set(), {}
    for i, raw in rows:
        cover = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - span + 1):
            if raw[p : p + span] in seen:
                cover[p] += 1
                cover[p + span] -= 1
            seen.add(raw[p : p + span])
        mask = np.cumsum(cover)[:-1] > 0
        out[i] = (int(mask.sum()), int(np.diff(np.concatenate(([0], mask.astype(int)))).clip(0).sum()), bytes(np.frombuffer(raw, np.uint8)[~mask]))
    return out


@pytest.mark.parametrize("bucket", [4096, 1])
def test_suffix_dedup(spark, texts, bucket, monkeypatch):
    """bucket 1 sends every bucket with several contexts through the rows that large ones take."""
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = simhash.durable(spark.createDataFrame(rows, "doc_id long, text string"))
    want = reference_cut([(i, (t or "").encode()) for i, t in rows], 100)
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.cut_repeats(docs).collect()}
    assert got == want and sum(v[0] for v in want.values()) > 5000
    assert suffix_dedup.cut_repeats(empty(docs)).count() == 0
    cut = {r.doc_id: r.text for r in suffix_dedup.without_repeats(docs).collect()}
    assert cut[0] is None and all(cut[i] == want[i][2].decode("utf-8", "ignore") for i in cut if i)


@pytest.mark.parametrize("span", [1, 5, 8, 20, 33, 160, 300])
def test_suffix_dedup_of_other_spans(spark, span):
    rng = random.Random(span)
    source = bytes(rng.choice(b"abcd ") for _ in range(3000)).decode()
    own = ["".join(source[k : k + span + 20] for k in (rng.randrange(2500) for _ in range(3))) for _ in range(30)] + ["q" * 700, "q" * 650, ""]
    docs = simhash.durable(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string"))
    want = reference_cut([(i, t.encode()) for i, t in enumerate(own)], span)
    assert {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.cut_repeats(docs, span).collect()} == want
    with pytest.raises(ValueError):
        suffix_dedup.cut_repeats(docs, 0)


def test_window_buckets_are_equal_for_equal_bytes_alone():
    rng = random.Random(2)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(12, 40))) for _ in range(60)]
    buckets, sizes = suffix_dedup.window_buckets(parts, 12)
    windows = [p[i : i + 12] for p in parts for i in range(len(p) - 11)]
    assert sizes.tolist() == [len(p) - 11 for p in parts] and len(buckets) == len(windows)
    assert len({*zip(buckets.tolist(), windows, strict=True)}) == len(set(windows)) == len(set(buckets.tolist()))


def test_suffix_dedup_of_repeated_rows(docs):
    """Rows in order of id (null first) and scan place keep what stands first, by content."""
    rows = sorted(enumerate(r.asDict() for r in docs.collect()), key=lambda r: (r[1]["doc_id"] is not None, r[1]["doc_id"] or 0, r[0]))
    want = reference_cut([(k, (r["text"] or "").encode()) for k, (_, r) in enumerate(rows)], 100)
    expected = collections.Counter((r["doc_id"], *want[k]) for k, (_, r) in enumerate(rows))
    assert collections.Counter((r.doc_id, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.cut_repeats(docs).collect()) == expected
    assert suffix_dedup.without_repeats(docs).schema == docs.schema


def test_wrapped_licence_notices_are_found(spark):
    """Each notice on lines of five words, with comment signs, after and before other words."""
    rows = []
    for i, t in enumerate(licenses.TEMPLATES):
        w = t.text.split()
        wrapped = "\n".join("# " + " ".join(w[k : k + 5]) for k in range(0, len(w), 5))
        rows.append((i, f"{'other words here ' * (11 + 7 * i)}\n{wrapped}\n{'and more ' * 30}"))
    docs = simhash.durable(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(docs).collect()}
    assert all(t.label in got[i] for i, t in enumerate(licenses.TEMPLATES))


def test_url_rules(spark):
    rows = [(1, "https://www.example.com/en/1?utm_source=feed"), (2, "http://a.EXAMPLE.com/en/x"), (3, "http://b.com"), (4, "http://b.com/x"), (5, None), (6, "no scheme"), (7, "ftp://x.net/es/"), (8, "http://x.org/a?page=2&ref=x"), (9, "http://x.org/a?PAGE=2"), (10, "http://h.org/sessionid"), (11, "http://h.org/?session_id=4"), (12, "http://notexample.com/en/"), (1, "http://x.net/fr/q#z"), (13, "http://host?x=/en/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit("?"))
    got = collections.defaultdict(list)
    for r in url_rules.judge(pages).collect():
        got[r.page_id].append((r.host, r.path, r.rule, r.verdict))
    assert sorted(got[1]) == [("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("x.net", "/fr/q", "net/fr/", "block")]
    assert got[2] == [("a.example.com", "/en/x", "example.com/en/", "block")]
    assert got[3] == [("b.com", "", None, "allow")] and got[4] == [("b.com", "/x", "com/", "allow")]
    assert got[5] == [("", "", None, "allow")] and got[6] == [("", "", None, "allow")]
    assert got[7][0][2:] == ("net/es/", "block") and got[8][0][2:] == (None, "block") and got[9][0][3] == "allow"
    assert got[10][0][3] == "allow" and got[11][0][3] == "block" and got[12][0][2] == "com/" and got[13] == [("host", "", None, "allow")]
    assert url_rules.judge(pages.filter("false")).count() == 0
    hot = spark.range(500).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "http://casino.org/").when(F.col("id") % 3 == 1, F.lit(None)).otherwise("http://a.org/").alias("url"))
    assert {(r.verdict, r.n) for r in url_rules.judge(hot).groupBy("verdict").agg(F.count("*").alias("n")).collect()} == {("block", 167), ("allow", 333)}
    with pytest.raises(ValueError):
        url_rules.Pattern("x")


def written(rng: random.Random, tree) -> str:
    """A text that a parsed regular expression matches."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "ANY":
            out += rng.choice("abz/&")
        elif name == "BRANCH":
            out += written(rng, rng.choice(arg[1]))
        elif name == "SUBPATTERN":
            out += written(rng, arg[3])
        elif name == "MAX_REPEAT":
            out += "".join(written(rng, arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
        elif name == "IN":
            sign = str(arg[0][0]) == "NEGATE"
            held = {chr(c) for kind, x in arg if str(kind) != "NEGATE" for c in (range(x[0], x[1] + 1) if str(kind) == "RANGE" else [x])}
            out += rng.choice([c for c in "abcxyz019-_./?&#=" if (c in held) != sign])
        else:
            assert name == "AT"
    return out


def test_url_index_fetches_what_all_patterns_match(spark):
    """Urls written from each pattern: as many patterns by the index as by running all."""
    rng = random.Random(6)
    own = [written(rng, re._parser.parse(p.regex)) for p in url_rules.PATTERNS for _ in range(40)]
    urls = ["http://onlinecasino.net/", "http://xxx.org/", "http://h.org/ONLINE-casino?x", *(f"http://h.org{x}" for x in own), *(f"http://h.org/q{x.upper()}" for x in own)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.n_patterns for r in url_rules.judge(pages).collect()}
    want = {i: sum(re.search(p.regex, u.lower()) is not None for p in url_rules.PATTERNS) for i, u in enumerate(urls)}
    assert got == want and want[0] == 1 and want[1] == 2
    assert {r.page_id: r.verdict for r in url_rules.judge(pages).filter("page_id < 2").collect()} == {0: "block", 1: "block"}


def test_url_tokens_are_read_off_the_expression():
    """Declared by nobody: whole tokens of each way to match; an expression that can match without one is refused."""
    tokens = lambda regex: set(url_rules.Pattern(regex).tokens)
    assert tokens(r"[?&]session[-_]?id=[a-z0-9]+") == {("id", "session"), ("sessionid",)}
    assert tokens(r"(^|[^a-z0-9])(foo|bar)x?([^a-z0-9]|$)") == {("foo",), ("foox",), ("bar",), ("barx",)}
    assert tokens(r"/a[0-9]/b+/c/") == {("c",)}
    for regex in ("foo|bar", "/foo", "foo/", "/foo.*/", "/(foo)?/", "/[ab]/", r"/fo\w/", "/(foo/|bar)"):
        with pytest.raises(ValueError, match="whole token"):
            url_rules.Pattern(regex)


def test_random_url_rules_fetch_all_their_matches(spark):
    rng = random.Random(12)
    part = lambda: rng.choice(["foo", "bar", "a1", "[ab]", "(foo|x)", "b?", "[-_]?", "[^a-z]", ".", "/", "-", "[0-9]+", "(/|$)", "s*", "(-|_)+"])
    rules, texts = [], []
    while len(rules) < 150:
        regex = rng.choice(["/", "(^|[^a-z0-9])", ""]) + "".join(part() for _ in range(rng.randrange(1, 5))) + rng.choice(["/", "([^a-z0-9]|$)", ""])
        try:
            rules.append(url_rules.Pattern(regex))
        except ValueError:
            continue
        texts += [rng.choice(["", "http://h/", "q"]) + written(rng, re._parser.parse(regex)) + rng.choice(["", "/", "z"]) for _ in range(4)]
    got = {r.url: r.n_patterns for r in url_rules.blocked_urls(spark.createDataFrame([(t,) for t in texts], "url string"), tuple(rules)).collect()}
    want = {t: n for t in texts if (n := sum(re.search(p.regex, t.lower()) is not None for p in rules))}
    assert got == want and len(want) > 150


@pytest.mark.parametrize("blocks", [(1024, 16384), (3, 20)])
def test_top_k(spark, blocks):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(150, 20)) * 0.2
    v[50:60] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(150, None), (151, [1.0, None] + [0.0] * 18), (152, [float("nan")] * 20), (153, [float("inf")] + [0.0] * 19), (200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ints = np.floor(256 * v.astype(np.float32).astype(float)).astype(np.int64)
    want = []
    for q in range(0, 150, 10):
        s = [(-int(ints[q] @ ints[i]), i) for i in range(150) if i != q]
        want += [(q, k + 1, i, -m) for k, (m, i) in enumerate(sorted(s)[:5])]
    out = topk.top_k(topk.quantised(df), F.col("vec_id") % 10 == 0, 5, *blocks)
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert topk.top_k(topk.quantised(df.filter("vec_id in (0, 1, 2)")), F.col("vec_id") == 0).count() == 2
    assert topk.top_k(topk.quantised(df.filter("false")), F.col("vec_id") == 0).count() == 0


def test_top_k_of_repeated_rows_and_large_numbers(spark):
    """Repeated rows are each other's candidates, clashing columns don't matter, and sums beyond a double are exact."""
    rows = [(10, [1.0, 2.0], 1), (10, [1.0, 2.0], 2), (10, [3.0, 1.0], 3), (4, [1.0, 0.0], 4), (None, [9.0, 9.0], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row long")
    got = sorted(map(tuple, topk.top_k(topk.quantised(df, 1), F.col("vec_id") == 10, 2).collect()))
    assert got == sorted([(10, 1, 10, 5), (10, 2, 10, 5), (10, 1, 10, 5), (10, 2, 10, 5), (10, 1, 10, 5), (10, 2, 10, 5)])
    big = 2**31
    own = [(0, [big, 1]), (1, [big, 1]), (2, [big, 2]), (3, [-big, 7]), (4, [4 * big, 0])]
    df = spark.createDataFrame(own, "vec_id long, ints array<long>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, 4).orderBy("rank").collect()]
    assert got == [(0, 1, 4, 2**63 - 1), (0, 2, 2, big * big + 2), (0, 3, 1, big * big + 1), (0, 4, 3, 7 - big * big)]


def test_rows_keep_their_numbers(spark):
    """A file of several parts is cut alike whatever the parallelism of the next job."""
    from tidepanel.llm import common

    path = f"{common.shared_dir(spark)}/many"
    spark.range(60_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.option("parquet.block.size", 1 << 18).parquet(path)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")  # small files are cut too
    try:
        rows = common.numbered(spark.read.parquet(path))
        fixed = spark.conf.get("spark.sql.files.minPartitionNum")
        assert int(fixed) == spark.sparkContext.defaultParallelism and rows.rdd.getNumPartitions() > 1
        first = {r.doc_id: r._row for r in rows.select("doc_id", "_row").collect()}
        assert {r.doc_id: r._row for r in common.numbered(spark.read.parquet(path)).select("doc_id", "_row").collect()} == first and len(set(first.values())) == 60_000
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)


def test_package_imports_from_its_zip():
    import subprocess
    import sys

    from tidepanel.llm.common import packed_up

    code = "import tidepanel.llm.suffix_dedup as m; print(m.__file__)"
    out = subprocess.run([sys.executable, "-c", code], env=dict(os.environ, PYTHONPATH=packed_up()), cwd="/", capture_output=True, text=True, check=True)
    assert "tidepanel.zip" in out.stdout


def test_encoder_is_the_library(texts):
    rng = random.Random(3)
    alphabet = "aEé' .,0<|>́ 　ΣİßK\x1c\x85\n"
    own = [t or "" for t in texts] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    encoder = pieces.Encoder(WORD_BPE)
    assert encoder.texts(own) == [np.array(x.ids, "<u4").tobytes() for x in encoder.model.encode_batch(own, add_special_tokens=False)]


@pytest.mark.parametrize("alphabet", [["<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "x", " ", "<|startoftext|>"], ["\u0338", "<", "=", ">", "é", "\u2028", "\u3000", "\xa0", " ", "A", "'S", "7", ",", "\x1d", "한", "가\u11a8", "ﬁ", "İ"]])
def test_words_told_apart_once(monkeypatch, alphabet):
    """Special tokens, signs that compose, wide white space: each distinct word is looked up once, with the library's ids."""
    rng = random.Random(11)
    own = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(2000)]
    encoder, looked = pieces.Encoder(WORD_BPE), []
    monkeypatch.setattr(encoder, "words", lambda words, f=encoder.words: looked.extend(words) or f(words))
    want = [np.array(x.ids, "<u4").tobytes() for x in encoder.model.encode_batch(own, add_special_tokens=False)]
    assert encoder.texts(own) == want and encoder.texts(pa.array([None, *own]).slice(1)) == want
    looked.clear()
    assert len(set(encoder.texts(["alpha beta. Alpha, beta\n"] * 500))) == 1
    assert set(looked) == {"alpha", "beta", ".", ",", ""} and len(looked) <= 6


def test_packing(docs):
    library = Tokenizer.from_file(WORD_BPE)
    out = packing.packed_documents(docs, WORD_BPE, 64)
    rows = out.collect()
    want = collections.Counter()
    total = 0
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        want.update((r.doc_id, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    at = collections.defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 64
    assert len(at) <= math.ceil(total / 64) * 1.05 + 1
    assert packing.packed_documents(empty(docs), WORD_BPE).count() == 0


def test_plan_holds_any_histogram():
    rng = np.random.default_rng(5)
    for capacity in (1, 2, 7, 64):
        for _ in range(20):
            histogram = np.where(rng.random(capacity + 1) < 0.5, rng.integers(0, 30, capacity + 1), 0)
            histogram[0] = 0
            held = np.zeros(capacity + 1, int)
            for shape, n in packing.plan(histogram, capacity):
                assert sum(shape) <= capacity and n > 0
                for v in shape:
                    held[v] += n
            assert (held == histogram).all()


@pytest.mark.parametrize("paired", [24, 1])
def test_simhash(spark, texts, paired, monkeypatch):
    """paired 1 sends every bucket through flipped bits."""
    monkeypatch.setattr(simhash.links, "__defaults__", (2, paired))
    rng = random.Random(7)
    own = [t for t in texts]
    base = prose(rng, 300)
    own += [base + f" q{i}" for i in range(30)]
    docs = simhash.durable(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string"))
    prints = []
    for t in own:
        w = re.findall(SPACES, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    component = list(range(len(own)))
    for i in range(len(own)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and component[i] != component[j]:
                a, b = sorted((component[i], component[j]))
                component = [a if c == b else c for c in component]
    got = {r.doc_id: (r.h, r.component_id) for r in simhash.near_duplicates(docs).withColumn("h", simhash.hexadecimal(F.col("fp"))).collect()}
    assert got == {i: (f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, component, strict=True))}
    assert simhash.near_duplicates(empty(docs)).count() == 0


@pytest.mark.parametrize("distance", [1, 2, 3, 4])
def test_links_of_close_fingerprints(spark, distance):
    rng = random.Random(distance)
    own = {rng.getrandbits(63) for _ in range(20)}
    for _ in range(200):
        p = rng.choice(sorted(own))
        own.add(p ^ sum(1 << b for b in rng.sample(range(63), rng.randint(1, 4))))
    prints = spark.createDataFrame([(p,) for p in own], "fp long")
    for paired in (1, 1000):
        root = {r.node: r.root for r in simhash.roots(simhash.links(prints, distance, paired)).collect()}
        label = {p: p for p in own}
        for a in sorted(own):
            for b in sorted(own):
                if b < a and (a ^ b).bit_count() <= distance and label[a] != label[b]:
                    x, y = sorted((label[a], label[b]))
                    label = {k: x if v == y else v for k, v in label.items()}
        assert {p: root.get(p, p) for p in own} == label


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(9)
    own = [prose(rng, 200, 5000) for _ in range(30)]
    copies = []
    for t in own[:10]:
        w = t.split(" ")
        for i in (50, 120):
            w[i] = "changed"
        copies += [t, " ".join(w)]
    rows = [(i, t, "x") for i, t in enumerate(own + copies)]
    docs = simhash.durable(spark.createDataFrame(rows, "doc_id long, text string, component string"))
    kept = simhash.one_of_each(docs)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == list(range(30))
    assert simhash.one_of_each(empty(docs)).count() == 0


def family(rng: random.Random, n: int, changed: int, words: int = 300) -> list[list[str]]:
    """Texts of one source with that many of its words replaced, each with a copy of its own, and pairs about the cut."""
    source = [f"s{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(n):
        own = source.copy()
        for k in rng.sample(range(words), changed):
            own[k] = f"o{i}x{k}"
        other = own.copy()
        for k in rng.sample(range(words), rng.randint(2, 14)):
            other[k] = f"c{i}x{k}"
        out += [own, other]
    return out


def components_at(sets: list[set], similarity: float) -> tuple[dict[int, int], set[tuple[int, int]]]:
    label, pairs = {i: i for i in range(len(sets))}, set()
    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= similarity * (len(sets[i]) + len(sets[j]) - common) - 1e-9:
                pairs.add((j, i))
                x, y = sorted((label[i], label[j]))
                label = {k: x if v == y else v for k, v in label.items()}
    return label, pairs


def test_near_copies_of_a_hot_source_are_found(spark):
    """All links of brute force, in families whose strangers fill the buckets."""
    rng = random.Random(4)
    texts = family(rng, 150, 14) + family(rng, 100, 28)
    rng.shuffle(texts)
    docs = simhash.durable(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    pairs = components_at([{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts], 0.8)[1]
    got = {r.doc_id: r.component for r in simhash.similar_documents(docs).collect()}
    assert len(pairs) > 90
    assert sum(got[i] == got[j] for i, j in pairs) >= 0.99 * len(pairs)


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_links_in_buckets_of_any_block(spark, block):
    """Blocks join the parts that brute force over the buckets joins, by fewer links than there are rows."""
    rng = random.Random(block)
    sets, rows = {}, []
    for i in range(60):
        source = range(1000 * (i % 4), 1000 * (i % 4) + 100)
        sets[i] = np.unique(np.array([s if rng.random() > 0.01 * (i % 14) else rng.getrandbits(60) for s in source], np.uint64))
        rows += [(key, 60, 6000, i, i // 2) for key in (i % 3, 7)]
    members = spark.createDataFrame(rows, "key long, texts long, size long, id long, part long")
    shingles = spark.createDataFrame([(i, s.tobytes()) for i, s in sets.items()], "id long, shingles binary")
    links = [tuple(r) for r in simhash.links_in_buckets(members, shingles, 0.8, block).collect()]
    similar = [(a, b) for a in range(60) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) - 1e-9]
    assert set(links) <= set(similar) and len(similar) > 100 and (block < 60 or len(links) < len(rows))

    def joined(pairs):
        label = {i: i // 2 for i in range(60)}
        for a, b in pairs:
            x, y = sorted((label[a], label[b]))
            label = {k: x if v == y else v for k, v in label.items()}
        return label

    assert joined(links) == joined(similar)


def test_common_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (0, 1, 5, 50, 200, 400)] + [np.arange(10**7, 10**7 + 50, dtype=np.uint64)]
    got = simhash.common_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)
    assert simhash.common_counts([np.empty(0, np.uint64)] * 2).tolist() == [[0, 0], [0, 0]]


def test_near_copies_are_linked_at_the_similarity_alone(spark):
    """Pairs just above 0.8 are joined and pairs from 0.65 to just below aren't, as brute force over the shingle sets says."""
    texts = []
    for i in range(150):
        own = [f"p{i}w{k}" for k in range(304)]
        other = own.copy()
        for k in range(2, 2 + 7 * (5 + i % 8), 7):
            other[k] = f"q{i}w{k}"
        texts += [own, other]
    docs = simhash.durable(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    pairs = components_at([{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts], 0.8)[1]
    got = {r.doc_id: r.component for r in simhash.similar_documents(docs).collect()}
    joined = {(i, i + 1) for i in range(0, len(texts), 2) if got[i] == got[i + 1]}
    assert 30 < len(pairs) < 120
    assert joined <= pairs and len(joined) >= 0.98 * len(pairs)


def test_token_counts(docs):
    library = Tokenizer.from_file(WORD_BPE)
    for hot in (1, 10**6):  # all words rare; all words broadcast
        for text, r in each(docs, token_counts.token_counts(docs, WORD_BPE, 50, hot)):
            n = len(library.encode(text or "", add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text or "").encode()), n, n > 50)
    assert token_counts.token_counts(empty(docs), WORD_BPE).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text: str) -> list[str]:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data(spark):
    rng = random.Random(11)
    parts = ["a.b@c.d", "_d@e.f", "x@y", "@", "1.2.3.4", "256.1.1.1", ".5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+12", "Mr. John Smith", "123-45-6789", "\U0001f600", " ", " ", "word", "9" * 20, "-", "(555) 010-9999 call", "phone: (415) 555-2671", "joe [at] mail [dot] com"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(300)] + [(300, None), (301, "1" * 60_000 + "a." * 20_000 + "@x"), (302, "a@b.c" * 2000)]
    docs = simhash.durable(spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)))
    got = {r.doc_id: r for r in personal_data.digest(personal_data.find_spans(docs)).collect()}
    for i, text in rows:
        want = base_spans(text or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in got[i].spans.split(",") if s and s.split(":")[0] in PATTERNS] == want
        assert got[i].n_email == sum(s.startswith("email") for s in want)
    assert personal_data.find_spans(docs.filter("false")).count() == 0
    clean = {r.doc_id: r.text for r in personal_data.redacted(docs).collect()}
    assert clean[300] is None
    assert all(sum(clean[i].count(f"<{k}>") for k in ("EMAIL", "IP", "CARD", "PHONE")) > 0 for i, t in rows if base_spans(t or ""))
    one = spark.createDataFrame([(1, "to a.b@c.d or 1.2.3.4.")], "doc_id long, text string")
    assert personal_data.redacted(one).first().text == "to <EMAIL> or <IP>."


def test_masked_addresses_in_capitals_are_candidates(spark):
    docs = spark.createDataFrame([(1, "JOE [AT] MAIL [DOT] COM"), (2, "joe [at] mail [dot] com")], "doc_id long, text string")
    got = {r.doc_id: r.n for r in personal_data.with_candidates(docs, "text", "spans").select("doc_id", F.size("spans").alias("n")).collect()}
    assert got == {1: 1, 2: 1}


def test_nothing_of_a_planted_value_is_left(spark):
    """Values of 16 to 5,000 characters, names and addresses of any length: the redacted text is what stood round them."""
    rng = random.Random(14)
    rows, want = [], []
    for n in (16, 17, 100, 128, 129, 210, 1000, 5000):
        value = "".join(rng.choice("abcdefghij0123456789ABCDEF") for _ in range(n - 2)) + "a7"
        rows.append(f"my config: api_key = {value} and more")
        want.append("my config: <SECRET> and more")
    for n in (3, 40, 400):
        rows.append(f"dear Dr. M{'a' * n} S{'o' * n}, hello")
        want.append("dear <PERSON>, hello")
        rows.append(f"mail: {'jo' * n} [at] {'site' * n} [dot] com today")
        want.append("mail: <MASKED_EMAIL> today")
    docs = simhash.durable(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    got = {r.doc_id: r.text for r in personal_data.redacted(docs).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_secrets_are_found_and_redacted(spark):
    rng = random.Random(21)
    own = [(i, f'word token = "{rng.getrandbits(160):040x}" more') for i in range(40)] + [(40, "a token of thanks"), (41, "password: short"), (42, None), (43, "API_KEY='abcdefgh12345678ABCDEF'")]
    docs = spark.createDataFrame(own, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal_data.digest(personal_data.find_spans(docs)).collect()}
    assert all(got[i] == "secret:5:55" for i in range(40)) and got[43] == "secret:0:32" and not got[40] and not got[41] and not got[42]
    clean = {r.doc_id: r.text for r in personal_data.redacted(docs).collect()}
    assert clean[0] == "word <SECRET> more" and clean[40] == "a token of thanks" and clean[43] == "<SECRET>"


def test_reliabilities_tell_good_labelers_from_bad():
    rng = random.Random(13)
    counts = collections.Counter()
    for _ in range(4000):
        true = rng.random() < 0.6
        votes = tuple((1 if true else -1) * (1 if rng.random() < p else -1) for p in (0.95, 0.9, 0.85, 0.6))
        counts[0, votes] += 1
    right, post = personal_data.reliabilities([(k, v, n) for (k, v), n in counts.items()])
    assert right[0] > right[3] and abs(right[0] - 0.95) < 0.05 and post[0, (1, 1, 1, 1)] > 0.9 > 0.1 > post[0, (-1, -1, -1, -1)]
    rows = [(personal_data.features(0, v, (1, 0, 0)), post[k, v], float(n)) for (k, v), n in counts.items()]
    w = personal_data.logistic(rows)
    wrong = sum(n for f, y, n in rows if (sum(a * b for a, b in zip(w, f, strict=True)) >= 0) != (y >= 0.5))
    assert wrong / 4000 < 0.1
