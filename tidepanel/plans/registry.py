"""Queries with their SQL oracles; doubles are rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: Logical tables in DuckDB's SQL, for WITH.
VIEWS = {
    "bars": "SELECT event_type AS ticker, date_trunc('hour', ts) AS date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, sum(value) AS volume FROM events GROUP BY 1, 2",
    "bars_xs": "SELECT CAST(user_id % 25 AS VARCHAR) AS ticker, date_trunc('day', ts) + to_hours(CAST(floor(hour(ts) / 6) * 6 AS BIGINT)) AS date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, sum(value) AS volume FROM events GROUP BY 1, 2",
    "bars_long": "SELECT p_brand AS ticker, date_trunc('week', l_shipdate) AS date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(l_quantity) AS volume FROM (SELECT *, l_extendedprice / l_quantity AS price, {'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_partkey, 'e': l_suppkey, 'f': l_extendedprice / l_quantity} AS k FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1, 2",
    "valid": "SELECT * FROM bars WHERE open > 0 AND high > 0 AND low > 0 AND close > 0",
    "split_bars": "SELECT *, CASE WHEN date <= TIMESTAMP '2024-01-15' THEN 'train' WHEN date <= TIMESTAMP '2024-01-22' THEN 'val' ELSE 'test' END AS split FROM valid",
    "docs": "SELECT doc_id, source AS ticker, DATE '2024-01-01' + CAST(doc_id % 14 AS INTEGER) AS date, text, lang, n_chars, CASE WHEN doc_id % 14 < 8 THEN 'train' WHEN doc_id % 14 < 11 THEN 'val' ELSE 'test' END AS split FROM documents",
    "vectors": "SELECT vec_id AS item_id, label AS grp, layer, list_transform(embedding[(layer - 1) * 16 + 1 : layer * 16], lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings, (SELECT unnest(range(1, 5)) AS layer)",
}
NEEDS = {"valid": ("bars",), "split_bars": ("bars", "valid")}


def sql(body: str, *views: str, digits: int = 8, doubles: tuple[str, ...] = ()) -> str:
    """body with the views it names before it, its doubles rounded."""
    names: list[str] = []
    for v in views:
        names += [x for x in (*NEEDS.get(v, ()), v) if x not in names]
    head = "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " " if names else ""
    cut = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles)
    return f"{head}SELECT *{f' REPLACE ({cut})' if cut else ''} FROM ({body})"


def query(name: str, oracle: str | None = None, *views: str, doubles: tuple[str, ...] | str = (), digits: int = 8):
    """Registers a function of (spark, sf_dir) under name, with the body of its oracle."""
    columns = tuple(doubles.split()) if isinstance(doubles, str) else doubles

    def register(f: Callable) -> Callable:
        def rounded(spark, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns}) if columns else df

        QUERIES[name] = rounded
        if oracle is not None:
            ORACLES[name] = sql(oracle, *views, digits=digits, doubles=columns)
        return f

    return register
