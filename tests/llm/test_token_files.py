"""Token files: round trips of planes and documents, against the tokenizers library."""

from __future__ import annotations

import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidepanel.llm import token_files
from tidepanel.llm.checksums import joined
from tidepanel.llm.common import durable, shared_dir

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def test_joined_crcs():
    rng = random.Random(3)
    pairs = [(rng.randbytes(rng.randrange(9)), rng.randbytes(n)) for n in (0, 1, 2, 3, 255, 256, 70_000, *(rng.randrange(500) for _ in range(50)))]
    crcs = [np.array([zlib.crc32(x) for x in part], np.uint32) for part in zip(*pairs, strict=True)]
    assert joined(*crcs, np.array([len(b) for _, b in pairs])).tolist() == [zlib.crc32(a + b) for a, b in pairs]


@pytest.mark.parametrize("unit", ["byte", "bit"])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes(unit, n):
    rng = np.random.default_rng(n)
    for width in (1, 2, 3, 4):
        ids = rng.integers(0, 256**width, n, dtype=np.uint64).astype("<u4")
        planes = token_files.to_planes(ids, width, unit)
        assert len(planes) == width * (8 if unit == "bit" else 1) and all(len(p) == (-(-n // 8) if unit == "bit" else n) for p in planes)
        assert (token_files.from_planes(planes, n, unit) == ids).all()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "é́ü 　ß", "<|endoftext|>x", "word " * 3000, *(" ".join(rng.choices("alpha beta. gamma, Déjà 12".split(), k=rng.randrange(60))) for _ in range(80))]
    rows = [(i if i != 8 else None, t, 1, "x") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return durable(spark.createDataFrame(rows + [(9, "again", 1, "x")] * 2, "doc_id long, text string, shard int, start string").repartition(3))


@pytest.mark.parametrize("chunk,unit", [(64, "byte"), (1000, "bit"), (65_536, "byte")])
def test_documents(spark, docs, chunk, unit):
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    token_files.write(docs, path, WORD_BPE, chunk=chunk, unit=unit)
    model = Tokenizer.from_file(WORD_BPE)
    got = sorted(token_files.documents(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    ids = {(r.doc_id, r.text): [*model.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda k: -1 if k is None else k)
    at, stream = 0, []
    for r in got:
        own = np.frombuffer(r.ids_le, "<u4").tolist()
        assert own in [v for (k, _), v in ids.items() if k == r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(r.ids_le))
        at += len(own)
        stream += own
    assert at == sum(len(ids[r.doc_id, r.text]) for r in docs.collect())
    plain = token_files.documents(spark, path)
    assert sorted(map(tuple, plain.collect()), key=lambda r: r[1]) == [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got]
    index = spark.read.parquet(f"{path}/index").collect()
    assert sum(r.n_ids for r in index) == at and sum(r.n_docs for r in index) == len(got) and max(r.n_ids for r in index) <= chunk
    for first, last in ((0, 1), (3, 3), (50, 900), (at - 5, at + 9)):
        assert [r.id for r in token_files.ids_between(spark, path, first, last).sort("place").collect()] == stream[first:last]


def test_empty_table_and_damage(spark, docs):
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    token_files.write(docs.filter("false"), path, WORD_BPE)
    assert token_files.documents(spark, path).count() == 0
    row = {"shard": 0, "chunk": 0, "n_ids": 2, "unit": "byte", "crc32": 1, "planes": [__import__("zstandard").compress(b"ab")]}
    with pytest.raises(ValueError, match="damaged"):
        token_files._decoded(row)
