"""The sweep of axes over layers, labels, versions and methods, from sums that all candidates share; and the choice among them.

items: item_id, domain, ticker, date, split and a column for each label. vectors: item_id, layer, vec. A version is one
domain or both; both weigh alike. What comes to the driver are matrices of the vectors' width, and a row for each candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.statistics import spearman
from tidepanel.operators.audits import or_all, top_one
from tidepanel.operators.gram import matrix_of, products, summed
from tidepanel.operators.matching import nearest_dates
from tidepanel.operators.ranking import quantiles
from tidepanel.sources.sinks import checkpointed

METHODS = ("contrast", "logistic", "ridge", "within_ridge", "pc1")
JOINT = "joint"


@dataclass(frozen=True)
class Axis:
    layer: int
    label: str
    version: str
    method: str
    alpha: float | None
    weights: np.ndarray


def _unit(w: np.ndarray) -> np.ndarray:
    return w / max(float(np.linalg.norm(w)), 1e-8)


def sided(train: DataFrame, labels: list[str]) -> DataFrame:
    """train with high and low (arrays of 0 and 1 by label): at or beyond its domain's outer quartiles."""
    stacked = train.select("domain", F.explode(F.array(*(F.struct(F.lit(x).alias("label"), F.col(x).cast("double").alias("value")) for x in labels))).alias("s")).select("domain", "s.*")
    cuts = quantiles(stacked, "value", [0.25, 0.75], "domain", "label").groupBy("domain").pivot("label", labels).agg(F.first("q"))
    both = train.join(cuts.select("domain", *(F.col(f"`{x}`").alias(f"_q{j}") for j, x in enumerate(labels))), "domain")
    side = lambda f: F.array(*(f(F.col(x).cast("double"), F.col(f"_q{j}")).cast("double") for j, x in enumerate(labels)))
    return both.select(*train.columns, side(lambda y, q: y >= q[1]).alias("high"), side(lambda y, q: y <= q[0]).alias("low"))


def matched(train: DataFrame, labels: list[str], domains: tuple[str, ...]) -> DataFrame:
    """domain, label, high_id, low_id: each high item with the low one of its domain and ticker that is nearest in days."""
    each = []
    for d, x in product(domains, labels):
        rows = train.filter(F.col("domain") == d).select(F.col("item_id").alias("id"), "ticker", "date", x)
        each.append(nearest_dates(rows, x, ["ticker"]).select(F.lit(d).alias("domain"), F.lit(x).alias("label"), "high_id", "low_id"))
    return reduce(DataFrame.unionByName, each)


def _first(p: np.ndarray, rounds: int = 300) -> np.ndarray:
    """The first eigenvector of a sum of outer products, by iteration on a few directions."""
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(len(p), min(8, len(p)))))[0]
    for _ in range(rounds):
        new = np.linalg.qr(p @ q)[0]
        done = abs(abs(float(new[:, 0] @ q[:, 0])) - 1) < 1e-15
        q = new
        if done:
            break
    small = q.T @ p @ q
    return q @ np.linalg.eigh(small)[1][:, -1]


def _logistic(table: DataFrame, bounds: dict, weights: dict, k: int, labels: list[str], versions: list[str], penalty: float, rounds: int, tolerance: float) -> dict:
    """(layer, version, label): direction that parts high from low rows, of all candidates at once.

    Each round is one pass that sums every candidate's gradient; a step is preconditioned by a bound of the curvature, a
    quarter of the weighted products, which need no pass; steps carry momentum, begun anew when they turn back.
    table: layer, domain, high, low, vec. weights: by version, domain and label. The passes read matrices that are packed
    once, without the rows that are neither high nor low in any label, whose gradients are zero.
    """
    cands = list(product(versions, range(len(labels))))
    layers = sorted({layer for layer, _ in bounds})
    at = {layer: np.zeros((len(cands), k + 1)) for layer in layers}
    ahead, speed = {x: v.copy() for x, v in at.items()}, 1.0
    inverse = {key: np.linalg.inv(b) for key, b in bounds.items()}
    mass = {(v, j): sum(weights[v, d, j][1] for d in weights["domains"]) for v, j in cands}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            layer, domain = np.array(b.column(0).to_pylist()), np.array(b.column(1).to_pylist())
            high, low, x = matrix_of(b.column(2)), matrix_of(b.column(3)), matrix_of(b.column(4))
            x, used = np.concatenate([x, np.ones((len(x), 1))], axis=1), np.maximum(high, low).any(axis=1)
            for key in {*zip(layer[used].tolist(), domain[used].tolist(), strict=True)}:
                rows = used & (layer == key[0]) & (domain == key[1])
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.string()), *(pa.array([m[rows].tobytes()], pa.binary()) for m in (high, low, x))], names=["layer", "domain", "high", "low", "x"])

    packed = checkpointed(table.select("layer", "domain", "high", "low", "vec").mapInArrow(pack, "layer long, domain string, high binary, low binary, x binary"))

    def gradients(points: dict) -> dict:
        held = table.sparkSession.sparkContext.broadcast(points)
        own = {d: np.array([[weights[v, d, j][0]] for v, j in cands]) for d in weights["domains"]}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            pick = [j for _, j in cands]
            for b in batches:
                for key, domain, *raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    high, low = (np.frombuffer(m).reshape(-1, len(labels))[:, pick] for m in raw[:2])
                    x = np.frombuffer(raw[2]).reshape(-1, k + 1)
                    z = x @ held.value[key].T
                    total[key] = total.get(key, 0.0) + ((1 / (1 + np.exp(-np.clip(z, -500, 500))) - high) * np.maximum(high, low)).T @ x * own[domain]
            for key, t in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([t.tobytes()], pa.binary())], names=["layer", "g"])

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    total[key] = total.get(key, 0.0) + np.frombuffer(raw)
            for key, t in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([t.tobytes()], pa.binary())], names=["layer", "g"])

        sums = packed.mapInArrow(run, "layer long, g binary").repartition("layer").mapInArrow(merged, "layer long, g binary")
        return {r["layer"]: np.frombuffer(bytes(r["g"])).reshape(len(cands), -1) for r in sums.collect()}  # a row for each layer

    free = np.append(np.full(k, penalty), 0.0)
    for _ in range(rounds):
        grads, moved, back = gradients(ahead), 0.0, 0.0
        new = {}
        for layer in layers:
            new[layer] = at[layer].copy()
            for c, (v, j) in enumerate(cands):
                g = grads[layer][c] / mass[v, j] + free * ahead[layer][c]
                new[layer][c] = ahead[layer][c] - inverse[layer, (v, j)] @ g
                back += float((ahead[layer][c] - new[layer][c]) @ (new[layer][c] - at[layer][c]))
            moved = max(moved, float(np.abs(new[layer] - at[layer]).max() / max(1e-12, np.abs(new[layer]).max())))
        speed, old = (1.0, 1.0) if back > 0 else ((1 + (1 + 4 * speed * speed) ** 0.5) / 2, speed)
        ahead = {x: new[x] + (old - 1) / speed * (new[x] - at[x]) for x in layers}
        at = new
        if moved < tolerance:
            break
    return {(layer, v, labels[j]): at[layer][c][:k] for layer in layers for c, (v, j) in enumerate(cands)}


def fitted(items: DataFrame, vectors: DataFrame, labels: list[str], domains: tuple[str, str], alphas: list[float], penalty: float = 1e-4, rounds: int = 200, tolerance: float = 1e-6) -> list[Axis]:
    """The axes of all layers, labels, versions and methods (ridges for each alpha), fitted on training items that have all labels.

    One pass of products by layer and domain serves contrasts, ridges and the bound of the logistic steps; one of ticker
    sums the ridges within tickers; one of pair differences the first components.
    """
    train = checkpointed(items.filter("split = 'train'").dropna(subset=labels))
    table = checkpointed(sided(train, labels).join(vectors, "item_id"))
    y = F.array(*(F.col(x).cast("double") for x in labels))
    one = F.array(F.lit(1.0))
    both = products(table, F.concat("vec", y, one, "high", "low"), "layer", "domain")
    by_ticker = summed(table, F.concat("vec", y, one), "layer", "domain", "ticker")
    levels = products(by_ticker.withColumn("_v", F.transform("total", lambda x: x / F.sqrt("n"))), F.col("_v"), "layer", "domain")
    pairs = checkpointed(matched(train, labels, domains))
    side = lambda p: vectors.select(F.col("item_id").alias(f"{p}_id"), "layer", F.col("vec").alias(f"_{p}"))
    deltas = pairs.join(side("high"), "high_id").join(side("low"), ["low_id", "layer"])
    apart = products(deltas, F.concat(F.zip_with("_high", "_low", lambda a, b: a - b), one), "layer", "domain", "label")
    n_labels, out, bounds, weights = len(labels), [], {}, {"domains": domains}
    versions = {**{d: (d,) for d in domains}, JOINT: domains}
    layers = sorted({layer for layer, _ in both})
    k = len(next(iter(both.values()))) - 3 * n_labels - 1 if both else 0
    at_one = k + n_labels
    for layer in layers:
        for (version, own), (j, label) in product(versions.items(), enumerate(labels)):
            mats = {d: both[layer, d] for d in own if (layer, d) in both}
            n = {d: m[at_one, at_one] for d, m in mats.items()}
            share = {d: 0.5 / n[d] * sum(n.values()) if len(mats) > 1 else 1.0 for d in mats}
            high, low = at_one + 1 + j, at_one + 1 + n_labels + j
            out.append(Axis(layer, label, version, "contrast", None, np.mean([m[:k, high] / m[at_one, high] - m[:k, low] / m[at_one, low] for m in mats.values()], axis=0)))
            s = sum(share[d] * m[: at_one + 1, : at_one + 1] for d, m in mats.items())
            s = s - np.outer(s[-1], s[-1]) / s[-1, -1]
            inside = sum(share[d] * (m[: at_one + 1, : at_one + 1] - levels[layer, d]) for d, m in mats.items())
            for alpha in alphas:
                out.append(Axis(layer, label, version, "ridge", alpha, np.linalg.solve(s[:k, :k] + alpha * np.eye(k), s[:k, k + j])))
                out.append(Axis(layer, label, version, "within_ridge", alpha, np.linalg.solve(inside[:k, :k] + alpha * np.eye(k), inside[:k, k + j])))
            deltas_ = [apart[layer, d, label] for d in own if (layer, d, label) in apart]
            if deltas_ and sum(m[-1, -1] for m in deltas_) >= 2:
                p = sum(deltas_)
                w = _first(p[:k, :k])
                out.append(Axis(layer, label, version, "pc1", None, w if w @ p[:k, -1] >= 0 else -w))
            chosen = {d: m[at_one, high] + m[at_one, low] - m[high, low] for d, m in mats.items()}
            for d in domains:
                w = (0.5 / chosen[d] * sum(chosen.values()) if len(mats) > 1 else 1.0) if d in mats else 0.0
                weights[version, d, j] = (w, w * chosen.get(d, 0.0))
            spots = [*range(k), at_one]
            curve = sum(weights[version, d, j][0] * m[np.ix_(spots, spots)] for d, m in mats.items()) / sum(weights[version, d, j][1] for d in mats)
            bounds[layer, (version, j)] = curve / 4 + np.diag(np.append(np.full(k, penalty), 1e-12))
    if bounds:
        found = _logistic(table, bounds, weights, k, labels, list(versions), penalty, rounds, tolerance)
        out += [Axis(layer, label, version, "logistic", None, w) for (layer, version, label), w in found.items()]
    return [replace(a, weights=_unit(a.weights)) for a in out]


def measured(items: DataFrame, vectors: DataFrame, axes: list[Axis], labels: list[str], splits: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """candidate (its place in axes), split, domain, n, rho, within_rho of each axis's scores with its label.

    within_rho is the rank correlation after each ticker's mean is taken off both. All candidates of a layer are scored in
    one product, and ranked together by ranges.
    """
    layers: dict[int, list[int]] = {}
    for c, a in enumerate(axes):
        layers.setdefault(a.layer, []).append(c)
    held = items.sparkSession.sparkContext.broadcast({x: np.stack([axes[c].weights for c in own]) for x, own in layers.items()})  # the axes
    rows = items.filter(F.col("split").isin(*splits)).select("item_id", "domain", "ticker", "split", F.array(*(F.col(x).cast("double") for x in labels)).alias("y")).join(vectors, "item_id")
    kind = items.schema["ticker"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                layer, x = np.array(b.column(4).to_pylist()), matrix_of(b.column(5))
                scores: list = [None] * len(b)
                for key in set(layer.tolist()) & held.value.keys():
                    at = np.flatnonzero(layer == key)
                    for i, s in zip(at.tolist(), (x[at] @ held.value[key].T).tolist(), strict=True):
                        scores[i] = s
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(scores, pa.list_(pa.float64()))], names=[*b.schema.names[:5], "scores"])

    scored = rows.filter(F.col("vec").isNotNull()).select("domain", "ticker", "split", "y", F.col("layer").cast("long").alias("layer"), "vec").mapInArrow(run, f"domain string, ticker {kind}, split string, y array<double>, layer long, scores array<double>")
    table = items.sparkSession.createDataFrame([(x, i, c, labels.index(axes[c].label)) for x, own in layers.items() for i, c in enumerate(own)], "layer long, place int, candidate int, label int")
    each = scored.select("domain", "ticker", "split", "y", "layer", F.posexplode("scores").alias("place", "s")).join(table, ["layer", "place"])
    each = checkpointed(each.select("candidate", "split", "domain", "ticker", "s", F.get("y", F.col("label")).alias("y")).filter("y is not null"))
    keys = ["candidate", "split", "domain"]
    means = each.groupBy(*keys, "ticker").agg(F.avg("s").alias("_s"), F.avg("y").alias("_y"))
    inner = each.join(means, [*keys, "ticker"]).select(*keys, F.round(F.col("s") - F.col("_s"), 10).alias("s"), F.round(F.col("y") - F.col("_y"), 10).alias("y"))
    return spearman(each, "s", "y", *keys).join(spearman(inner, "s", "y", *keys).select(*keys, F.col("rho").alias("within_rho")), keys)


def sweep(items: DataFrame, vectors: DataFrame, labels: list[str], domains: tuple[str, str], alphas: list[float], **fit) -> tuple[list[Axis], DataFrame]:
    """The axes, each turned so that its training scores rise with the label on average over its version's domains, and
    candidate, layer, label, version, method, alpha, split, domain, n, rho, within_rho."""
    axes = fitted(items, vectors, labels, domains, alphas, **fit)
    rows = checkpointed(measured(items, vectors, axes, labels))
    info = items.sparkSession.createDataFrame([(c, int(a.layer), a.label, a.version, a.method, a.alpha) for c, a in enumerate(axes)], "candidate int, layer long, label string, version string, method string, alpha double")
    own = (F.col("version") == JOINT) | (F.col("version") == F.col("domain"))
    out = rows.join(info, "candidate")
    falls = out.filter((F.col("split") == "train") & own).groupBy("candidate").agg((F.coalesce(F.avg("rho"), F.lit(0.0)) < 0).alias("_falls"))
    turned = {r["candidate"] for r in falls.filter("_falls").collect()}  # a row for each candidate
    signed = lambda k: F.when(F.col("_falls"), -F.col(k)).otherwise(F.col(k)).alias(k)
    out = out.join(falls, "candidate", "left").select("candidate", "layer", "label", "version", "method", "alpha", "split", "domain", "n", signed("rho"), signed("within_rho"))
    return [replace(a, weights=-a.weights) if c in turned else a for c, a in enumerate(axes)], out


def selected(metrics: DataFrame, domains: tuple[str, str], least: tuple[float, float] = (0.05, 0.075)) -> DataFrame:
    """The best candidate of each version on validation rows: by the rho of its domain, or for both domains by their mean,
    among those that rise in both if any does; ties by the mean within-ticker rho, then layer, label, method and alpha.

    gate: both domains' rho are at least the first number, and their mean the second.
    """
    of = lambda k, d: F.max(F.when(F.col("domain") == d, F.col(k))).alias(f"{k}_{d}")
    keys = ["version", "candidate", "layer", "label", "method", "alpha"]
    val = metrics.filter("split = 'val'").groupBy(*keys).agg(*(of(k, d) for k in ("rho", "within_rho") for d in domains))
    known = lambda k: [F.col(f"{k}_{d}") for d in domains]
    mean = lambda cells: F.aggregate(F.array_compact(F.array(*cells)), F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(F.array_compact(F.array(*cells))), F.lit(0))
    val = val.withColumn("macro", mean(known("rho"))).withColumn("macro_within", mean(known("within_rho")))
    score: Column = F.col("macro")
    for d in domains:
        score = F.when(F.col("version") == d, F.col(f"rho_{d}")).otherwise(score)
    both = reduce(lambda a, b: a & b, (F.coalesce(c > 0, F.lit(False)) for c in known("rho")))
    eligible = or_all(val.withColumn("score", score), (F.col("version") != JOINT) | both, "version")
    best = top_one(eligible, ["version"], F.desc_nulls_last("score"), F.desc_nulls_last("macro_within"), "layer", "label", "method", "alpha")
    return best.withColumn("gate", reduce(lambda a, b: a & b, (F.coalesce(c >= least[0], F.lit(False)) for c in known("rho"))) & F.coalesce(F.col("macro") >= least[1], F.lit(False)))


def cosines(best: DataFrame, axes: list[Axis], versions: tuple[str, ...]) -> DataFrame:
    """best with cosine_{version}: the cosine of its axis with each version's."""
    chosen = {r["version"]: axes[r["candidate"]].weights for r in best.select("version", "candidate").collect()}  # one a version
    rows = [(a, *(float(w @ chosen[b]) if b in chosen else None for b in versions)) for a, w in chosen.items()]
    return best.join(best.sparkSession.createDataFrame(rows, "version string, " + ", ".join(f"cosine_{b} double" for b in versions)), "version")
