"""The corpus pipeline and the contract's queries on the smallest tables."""

from __future__ import annotations

import math

import pytest

import corpus_pipeline
from tidepanel.llm import queries
from tidepanel.llm.common import durable


def test_stages_keep_columns_and_pack_all(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, sf))
        sizes.append(docs.count())
        if name != "packed":
            assert docs.columns == columns
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] == sizes[4] <= sizes[5]
    packed = docs.toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert packed.sequence_id.nunique() <= math.ceil(packed.length.sum() / 2048) * 1.05 + 1


def test_stages_by_brute_force(spark, sf):
    """Each stage on what the one before kept: windows counted out, all pairs of shingle sets, a set of all strings, the library's ids."""
    import collections
    import re

    import public_tokenizers
    from test_operators import SPACES, base_spans, components_at, reference_cut
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = durable(docs.unionByName(docs.limit(3).selectExpr("cast(null as long) as doc_id", "text", "lang", "source", "n_chars")).unionByName(docs.limit(2)).unionByName(docs.limit(1).selectExpr("cast(-1 as long) as doc_id", "cast(null as string) as text", "lang", "source", "n_chars")))
    of = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    stages = dict(corpus_pipeline.STAGES)

    def verdict(text):
        w = re.findall(SPACES, text or "")

        def again(k):
            count, mark = collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)), [0] * len(w)
            for i in range(len(w) - k + 1):
                if count[tuple(w[i : i + k])] > 1:
                    mark[i : i + k] = [1] * k
            return sum(mark), max(count.values(), default=0) > 1

        if len(w) < 50 or 100 * again(3)[0] > 50 * len(w) or again(5)[0] > 0.4 * len(w):
            return False
        longest = int(0.3 * len(w)) + 1
        return longest < 5 or not again(longest)[1]

    good = durable(stages["quality"](spark, docs, sf))
    assert of(good) == collections.Counter(k for k in of(docs).elements() if verdict(k[1]))

    one = durable(stages["near_copies"](spark, good, sf))
    rows = [(r.doc_id, r.text) for r in good.collect()]
    words = [re.findall(SPACES, "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) for _, t in rows]
    label = components_at([{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words], 0.8)[0]
    groups = collections.defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[label[i]].append((doc_id is not None, doc_id or 0, i, text))
    assert of(one) == collections.Counter((g[1] if g[0] else None, g[3]) for g in map(min, groups.values()))

    cut = durable(stages["long_repeats"](spark, one, sf))
    kept = sorted(((r.doc_id is not None, r.doc_id or 0), i, r.doc_id, r.text) for i, r in enumerate(one.collect()))
    want = reference_cut([(i, t.encode()) for _, i, _, t in kept], 100)
    assert of(cut) == collections.Counter((d, want[i][2].decode("utf-8", "ignore")) for _, i, d, _ in kept)

    clean = durable(stages["private"](spark, cut, sf))
    before, after = of(cut), of(clean)
    assert {t for _, t in before if not base_spans(t)} - {t for _, t in after} == set() or all("<" in t for _, t in after - before)
    assert sum(len([s for s in base_spans(t) if s.startswith("email")]) for _, t in after) == 0 < sum(t.count("<EMAIL>") for _, t in after)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = collections.Counter(len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in after.elements())
    packed = stages["packed"](spark, clean, sf).collect()
    total = collections.defaultdict(int)
    assert sum(r.length for r in packed) == sum(n * k for n, k in lengths.items()) and {r.doc_id for r in packed} == {d for d, _ in after}
    for r in packed:
        total[r.sequence_id] += r.length
    assert max(total.values()) <= 2048


def test_near_copies_by_fingerprints_alone(spark):
    """Without min-hashes SimHash has to find them: of texts with one word changed all that are two bits apart at most, and no unlike text."""
    import random

    from tidepanel.llm import simhash

    draw = random.Random(5)
    texts = []
    for _ in range(40):
        words = [f"w{draw.randrange(5000)}" for _ in range(400)]
        texts += [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(["First", *words[1:]]), " ".join(words).upper()]
    docs = durable(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: r.component for r in simhash.similar_documents(docs, bands=0).collect()}
    fps, sets = [simhash.fingerprint(t, 5) for t in texts], [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    near = [(i, j) for j in range(len(texts)) for i in range(j) if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 2 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(near) > 60 and all(got[i] == got[j] for i, j in near)
    assert all(i // 4 == j // 4 for i in got for j in got if got[i] == got[j])


def test_stages_of_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, sf))
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, duck, sf, name):
    from conftest import lines

    ours, theirs = queries.queries()[name](spark, sf).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and lines(ours) == lines(theirs)
