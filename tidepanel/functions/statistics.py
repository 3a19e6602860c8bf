"""Statistics as aggregates or windows: missing instead of an error for constants and empty groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.scalar import EPS_FORECAST, col
from tidepanel.operators.ranking import with_average_ranks
from tidepanel.sources.sinks import checkpointed


def pearson(x, y) -> Column:
    """Correlation as an aggregate; null for a constant (corr() would raise)."""
    x, y = col(x), col(y)
    both = lambda v: F.when(x.isNotNull() & y.isNotNull(), v)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(both(x)) * F.stddev_pop(both(y)))


def spearman(df: DataFrame, x: str, y: str, *keys: str, least: int = 3) -> DataFrame:
    """keys, n, rho of rows where both are known; rho is null under `least` rows or for a constant.

    Ranks are counted by ranges of (keys, value), so that no key is one task's. The rows' keys and values are written once.
    """
    rows = checkpointed(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")))
    ranked = with_average_ranks(rows, ["_x", "_y"], *keys)
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.count("*") >= least, pearson("_x_rank", "_y_rank")).alias("rho"))


#: Places of the rule by which Student's t is integrated, and where its tail is cut.
NODES, FAR = 1000, 12.0


def student_p(t, degrees) -> Column:
    """Two-sided p of Student's t: its tail over its whole, with t = sqrt(degrees) * tan(u / sqrt(degrees)), by Simpson's rule."""
    t, degrees = col(t), col(degrees).cast("double")
    root = F.sqrt(degrees)
    end = F.least(root * (math.pi / 2), F.lit(FAR))

    def mass(low: Column) -> Column:
        step = (end - low) / NODES
        weight = lambda i: F.when((i == 0) | (i == NODES), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        height = lambda i: F.exp((degrees - 1) * F.ln(F.greatest(F.cos((low + i * step) / root), F.lit(1e-300))))
        return step / 3 * F.aggregate(F.sequence(F.lit(0), F.lit(NODES)), F.lit(0.0), lambda acc, i: acc + weight(i) * height(i))

    return mass(F.least(F.atan(F.abs(t) / root) * root, end)) / mass(F.lit(0.0))


def spearman_p(rho, n) -> Column:
    """Two-sided p of a rank correlation of n rows, by the t approximation; 0 for a perfect one."""
    rho, n = col(rho), col(n)
    left = 1 - rho * rho
    return F.when(n < 3, None).when(left <= 1e-15, 0.0).otherwise(student_p(rho * F.sqrt((n - 2) / F.greatest(left, F.lit(1e-15))), n - 2))


def qlike(actual, predicted) -> Column:
    r = F.greatest(col(actual), F.lit(EPS_FORECAST)) / F.greatest(col(predicted), F.lit(EPS_FORECAST))
    return r - F.ln(r) - 1


def rank_decile(rank: Column, n: Column) -> Column:
    """Decile 1 to 10 of a rank from 1 among n by equal cuts of (1, n)."""
    return F.when(n == 1, 1).otherwise(F.greatest(F.lit(1), F.floor((10 * (rank - 1) + n - 2) / (n - 1)))).cast("long")


def draw(seed: int, *parts, size: Column) -> Column:
    """A repeatable draw from 0 to size - 1, the same in any engine: the first 32 bits of an MD5."""
    text = F.concat_ws("-", F.lit(str(seed)), *(col(p).cast("string") for p in parts))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), size)
