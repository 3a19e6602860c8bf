"""Fits in DuckDB's SQL, for oracles: sums of products, elimination and powers of a matrix, as lists of rows."""

from __future__ import annotations


def fit_sql(rows: str, k: int, alpha: float = 0.0) -> str:
    """Tables, to stand in a WITH RECURSIVE, of which the last, fit (w), is the ridge of y on the k numbers of x in rows (x, y)."""
    return (
        f"r AS MATERIALIZED (SELECT row_number() OVER () AS id, x, y FROM ({rows})), "
        f"c AS MATERIALIZED (SELECT id, i, x - avg(x) OVER (PARTITION BY i) AS x, y - avg(y) OVER (PARTITION BY i) AS y FROM (SELECT id, y, unnest(x) AS x, unnest(range(1, {k + 1})) AS i FROM r)), "
        "g AS (SELECT a.i AS i, b.i AS j, sum(a.x * b.x) AS v FROM c a JOIN c b ON a.id = b.id GROUP BY 1, 2), "
        "h AS (SELECT i, sum(x * y) AS v FROM c GROUP BY i), "
        f"m AS (SELECT list(cells ORDER BY i) AS m FROM (SELECT g.i AS i, list_append(list(g.v + CASE WHEN g.i = g.j THEN {alpha} ELSE 0 END ORDER BY g.j), max(h.v)) AS cells FROM g JOIN h ON g.i = h.i GROUP BY g.i)), "
        f"e AS (SELECT 1 AS step, m FROM m UNION ALL SELECT step + 1, list_transform(range(1, {k + 1}), lambda i: CASE WHEN i = step THEN list_transform(m[step], lambda z: z / m[step][step]) ELSE list_transform(range(1, {k + 2}), lambda j: m[i][j] - m[i][step] * m[step][j] / m[step][step]) END) FROM e WHERE step <= {k}), "
        f"fit AS (SELECT list_transform(m, lambda z: z[{k + 1}]) AS w FROM e WHERE step = {k + 1})"
    )


def first_sql(rows: str, k: int, squares: int = 14) -> str:
    """Tables, to stand in a WITH RECURSIVE, of which the last, fit (w), is the first right singular vector of rows (x), signed
    by their mean: a matrix squared again and again leaves its first direction."""
    return (
        f"r AS MATERIALIZED (SELECT row_number() OVER () AS id, x FROM ({rows})), "
        f"c AS MATERIALIZED (SELECT id, unnest(x) AS x, unnest(range(1, {k + 1})) AS i FROM r), "
        "g AS (SELECT a.i AS i, b.i AS j, sum(a.x * b.x) AS v FROM c a JOIN c b ON a.id = b.id GROUP BY 1, 2), "
        "m AS (SELECT list(cells ORDER BY i) AS m FROM (SELECT i, list(v ORDER BY j) AS cells FROM g GROUP BY i)), "
        f"p AS (SELECT 1 AS step, m FROM m UNION ALL SELECT step + 1, list_transform(s, lambda a: list_transform(a, lambda z: z / list_sum(list_transform(range(1, {k + 1}), lambda i: s[i][i])))) FROM (SELECT step, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b))) AS s FROM p WHERE step <= {squares})), "
        "mu AS (SELECT list(v ORDER BY i) AS mu FROM (SELECT i, avg(x) AS v FROM c GROUP BY i)), "
        f"fit AS (SELECT list_transform(m, lambda a: list_dot_product(a, mu)) AS w FROM p, mu WHERE step = {squares + 1})"
    )
