"""Token counts of whole texts: each distinct pre-token is tokenised once, then joined to the documents' frequencies."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import durable, numbered, text_of
from tidepanel.llm.pieces import runs_of

#: A pre-token is joined by broadcast if it is at least 1 / HOT of all and, with its length, 1 / HOT_BYTES of all bytes: at
#: most so many rows and so many bytes can be that, whatever the corpus.
HOT, HOT_BYTES = 1_000_000, 32_000_000


def counter(tokenizer: str):
    """A mapInArrow function: pieces of each row's first column (a string), under the name n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(tokenizer)
        model.no_truncation()
        model.no_padding()
        for batch in batches:
            n = [len(x) for x in model.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n"])

    return run


def _word_uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each pre-token of a batch of texts with its uses there."""
    for batch in batches:
        uses: Counter = Counter()
        for text in batch.column(0).to_pylist():
            uses.update(runs_of(text))
        yield pa.RecordBatch.from_arrays([pa.array(uses.keys(), pa.string()), pa.array(uses.values(), pa.int64())], names=["word", "uses"])


def _frequencies(known):
    """A mapInArrow function on rows (_row, doc_id, text, n_bytes): of each text one row with the pieces of its frequent
    pre-tokens (known, a broadcast dictionary), and one for each other pre-token with its times there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = known.value
        for batch in batches:
            of, words, times = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                own = Counter(runs_of(text))
                rare = [w for w in own if w not in pieces]
                for w in rare:
                    times.append(own.pop(w))
                times.append(sum(map(mul, own.values(), map(pieces.__getitem__, own))))
                words += [*rare, None]
                of += [i] * (len(rare) + 1)
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(3).take(at), pa.array(words, pa.string()), pa.array(times, pa.int64())], names=["_row", "doc_id", "n_bytes", "word", "times"])

    return run


def word_counts(docs: DataFrame) -> DataFrame:
    """word, uses: each distinct pre-token of docs (text); null and empty texts have none, repeated rows count each."""
    return docs.select("text").mapInArrow(_word_uses, "word string, uses long").groupBy("word").agg(F.sum("uses").alias("uses"))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, hot: int = HOT, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of each row of docs (doc_id, text).

    For tokenizers files whose normaliser and pre-tokeniser keep nothing across white space. Each distinct pre-token is
    counted once. The frequent ones meet the documents' frequencies where these are counted, by a broadcast dictionary, and
    are summed before any shuffle; the rest are joined as one row for each document and pre-token, none of which is
    frequent enough to fill a task. Null texts count as empty: 0 bytes, 0 tokens. Repeated rows and null ids keep rows of their own; an empty table
    gives an empty one.
    """
    rows = numbered(docs.select("doc_id", text_of().alias("text"))).select("_row", "doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    pieces = durable(word_counts(rows).mapInArrow(counter(tokenizer), "word string, uses long, n long"))
    size = F.octet_length("word").cast("long")
    total, bytes_ = pieces.agg(F.sum("uses"), F.sum(F.col("uses") * size)).first()
    is_hot = (F.col("uses") * hot >= F.lit(total or 0)) & (F.col("uses") * hot_bytes >= F.lit(bytes_ or 0))
    often = pieces.filter(is_hot).select("word", "n").toArrow()  # hot rows and hot_bytes bytes at most
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(often["word"].to_pylist(), often["n"].to_pylist(), strict=True)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = durable(rows.mapInArrow(_frequencies(known), f"_row long, doc_id {kind}, n_bytes long, word string, times long"))
    sums = held.filter("word is null").select("_row", F.struct("doc_id", "n_bytes").alias("doc"), F.col("times").alias("n"))
    rare = held.filter("word is not null").select("word", "_row", "times").join(pieces.filter(~is_hot).select("word", "n"), "word")
    both = sums.unionByName(rare.groupBy("_row").agg(F.sum(F.col("n") * F.col("times")).alias("n")), allowMissingColumns=True)
    out = both.groupBy("_row").agg(F.max("doc").alias("doc"), F.sum("n").alias("n_tokens"))
    return out.select("doc.doc_id", "doc.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
