"""Exact top-k inner-product search: columnar branch and bound over blocks of queries and candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import numbered

#: Queries and candidates of one task, and dimensions between two cuts. Candidates are sent once for each block of queries.
QUERY_BLOCK, ROW_BLOCK, DIM_BLOCK = 4096, 16384, 16


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and ints: floor(scale * component); vectors null or with null or non-finite components are left out."""
    # null and NaN compare as not below infinity
    finite = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return vectors.filter(finite).select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("ints"))


_COLUMNS = "query_id long, query_row long, vec_id long, row long, score long"
_LONG = 2**63 - 1


def _found(query: tuple[int, int], ids: np.ndarray, places: np.ndarray, score: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"query_id": query[0], "query_row": query[1], "vec_id": ids, "row": places, "score": score})


def _best_exact(queries: np.ndarray, own: list[tuple[int, int]], rows: np.ndarray, ids: np.ndarray, places: np.ndarray, k: int) -> list[pd.DataFrame]:
    """best() by whole numbers of any size, for products that a double can't hold; scores beyond a long are its ends."""
    out, wide = [], rows.astype(object)
    for query, vector in zip(own, queries, strict=True):
        score = np.array([max(-_LONG - 1, min(_LONG, int(s))) for s in wide @ vector.astype(object)], np.int64)
        at = np.flatnonzero(places != query[1])
        top = at[np.lexsort((places[at], ids[at], ~score[at]))[:k]]
        out.append(_found(query, ids[top], places[top], score[top]))
    return out


def best(queries: np.ndarray, own: list[tuple[int, int]], rows: np.ndarray, row_ids: np.ndarray, places: np.ndarray, k: int) -> list[pd.DataFrame]:
    """The k best rows of each query (own: id and place), ties to the smaller id, then place; a query's own row is left out.

    Rows lie dimension by dimension. After each block of dimensions a row survives if its partial product plus the most
    that the remaining dimensions can add (Cauchy-Schwarz on the remaining mass) reaches the k-th best certain score.
    """
    dims = queries.shape[1]
    longest = lambda x: np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)).max(initial=0.0)
    if longest(queries) * longest(rows) >= 2.0**52:
        return _best_exact(queries, own, rows, row_ids, places, k)
    columns = np.ascontiguousarray(rows.T.astype(np.float64))  # exact: sums stay below 2**53
    cuts = [*range(0, dims, DIM_BLOCK), dims]
    rest = lambda x: np.stack([np.sqrt((x[:, c:].astype(np.float64) ** 2).sum(axis=1)) for c in cuts])
    row_rest, query_rest = rest(rows), rest(queries)
    out = []
    for q in range(len(queries)):
        alive = np.flatnonzero(places != own[q][1])
        score = np.zeros(len(alive))
        for b, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            part = columns[lo:hi] if len(alive) == columns.shape[1] else columns[lo:hi, alive]
            score = score + queries[q, lo:hi].astype(np.float64) @ part
            if hi < dims and len(alive) > k:
                slack = query_rest[b + 1, q] * row_rest[b + 1, alive] * (1 + 1e-9) + 1
                floor = np.partition(score - slack, len(alive) - k)[len(alive) - k]
                keep = score + slack >= floor
                alive, score = alive[keep], score[keep]
        top = np.lexsort((places[alive], row_ids[alive], -score))[:k]
        out.append(_found(own[q], row_ids[alive[top]], places[alive[top]], score[top].astype(np.int64)))
    return out


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors (vec_id, ints) of largest inner product with each query row.

    All rows are candidates but the query's own; ties go to the smaller vec_id. Queries are the rows where is_query
    holds. Both sides are dealt into blocks by a hash of the id, as many as their counts ask for; each pair of blocks is
    one group of bounded size that keeps k rows for each query, and a last ranking joins the blocks' winners. Vectors are
    compared with those of the same length only. Repeated rows and ids are rows of their own, as candidates and as queries;
    null ids take no part. Scores beyond a long's range count as its ends. An empty table gives an empty one.
    """
    rows = numbered(vectors.select("vec_id", "ints"), "row").filter("vec_id is not null").withColumn("dims", F.size("ints"))
    n = rows.agg(F.count("*"), F.count_if(is_query)).first()
    row_blocks, query_blocks = max(1, -(-n[0] // row_block)), max(1, -(-n[1] // query_block))
    block = lambda m: F.pmod(F.xxhash64("row", F.lit(m)), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    candidates = rows.select("dims", block(row_blocks).cast("int").alias("rb"), every(query_blocks).alias("qb"), F.lit(False).alias("asks"), "vec_id", "row", "ints")
    queries = rows.filter(is_query).select("dims", every(row_blocks).alias("rb"), block(query_blocks).cast("int").alias("qb"), F.lit(True).alias("asks"), "vec_id", "row", "ints")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        q, r = pdf[pdf.asks], pdf[~pdf.asks]
        none = [_found((0, 0), *(np.empty(0, np.int64),) * 3)]
        own = list(zip(q.vec_id.tolist(), q.row.tolist(), strict=True))
        found = best(np.stack(q.ints.to_numpy()), own, np.stack(r.ints.to_numpy()), r.vec_id.to_numpy(), r.row.to_numpy(), k) if len(q) and len(r) else []
        return pd.concat(found or none, ignore_index=True)

    found = candidates.unionByName(queries).groupBy("dims", "rb", "qb").applyInPandas(search, _COLUMNS)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
