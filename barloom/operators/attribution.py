"""What each feature adds to each prediction of a boosted model: Shapley values along the paths of its trees.

A model's trees are read from where it was saved, a row a node. The value of a set of features is what a tree gives when the
other features follow the training rows through its splits; a leaf's part of every feature's Shapley value depends only on the
few features on the leaf's own path, so no sets are listed. Rows are worked on batch by batch where they lie.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Leaf(NamedTuple):
    """``value``: weight of the tree times prediction. For each feature on the path: the open lower and closed upper bound of its values, and
    the share of training rows that follows the path's splits on it."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]


def leaves(spark: SparkSession, path: str) -> list[list[Leaf]]:
    """The leaves of each tree of a pipeline saved at ``path``: as many as the model has, whatever the rows."""
    nodes = spark.read.parquet(f"{path}/stages/*/data").select("treeID", "nodeData.*").collect()
    weights = {r[0]: r[2] for r in spark.read.parquet(f"{path}/stages/*/treesMetadata").collect()}
    trees: dict[int, dict] = {}
    for n in nodes:
        trees.setdefault(n.treeID, {})[n.id] = n
    return [_leaves_of(trees[t], weights[t]) for t in sorted(trees)]


def _leaves_of(nodes: dict, weight: float) -> list[Leaf]:
    out: list[Leaf] = []

    def walk(i: int, met: dict[int, tuple[float, float, float]]) -> None:
        node = nodes[i]
        if node.leftChild < 0:
            names = tuple(met)
            out.append(Leaf(weight * node.prediction, names, *(tuple(met[f][k] for f in names) for k in range(3))))
            return
        if node.split.numCategories != -1:
            raise ValueError("splits of numbers only")
        f, cut = node.split.featureIndex, node.split.leftCategoriesOrThreshold[0]
        low, high, share = met.get(f, (-math.inf, math.inf, 1.0))
        for child, bounds in ((node.leftChild, (low, min(high, cut))), (node.rightChild, (max(low, cut), high))):
            walk(child, met | {f: (*bounds, share * nodes[child].rawCount / node.rawCount)})

    walk(0, {})
    return out


def base_value(trees: list[list[Leaf]]) -> float:
    """The mean margin, with no feature known."""
    return sum(leaf.value * math.prod(leaf.share) for tree in trees for leaf in tree)


@functools.lru_cache(maxsize=1 << 16)
def _patterns(leaf: Leaf, n_features: int) -> np.ndarray:
    """The leaf's part of every feature's value, a row for each set of the path's features that are inside their bounds."""
    d = len(leaf.features)
    inside = ((np.arange(1 << d) >> np.arange(d)[:, None]) & 1).astype(float)
    weights = [math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)]
    out = np.zeros((1 << d, n_features))
    for i, f in enumerate(leaf.features):
        # by size of the known set among the path's other features: how much of the leaf is left
        sizes = [np.ones(1 << d)]
        for j in range(d):
            if j != i:
                without = [s * leaf.share[j] for s in sizes] + [0.0]
                having = [0.0] + [s * inside[j] for s in sizes]
                sizes = [a + b for a, b in zip(without, having, strict=True)]
        out[:, f] = leaf.value * (inside[i] - leaf.share[i]) * sum(w * s for w, s in zip(weights, sizes, strict=True))
    return out


def shapley(trees: list[list[Leaf]], x: np.ndarray) -> np.ndarray:
    """Values of each row and feature (``x``: rows by features); with the base value they add up to the margin."""
    out = np.zeros(x.shape)
    for tree in trees:
        for leaf in tree:
            if leaf.features:
                met = np.zeros(len(x), np.int64)
                for k, (f, lo, hi) in enumerate(zip(leaf.features, leaf.low, leaf.high, strict=True)):
                    met |= ((x[:, f] > lo) & (x[:, f] <= hi)).astype(np.int64) << k
                out += _patterns(leaf, x.shape[1])[met]
    return out


def margins(trees: list[list[Leaf]], x: np.ndarray) -> np.ndarray:
    """The sum of the trees of each row; a rise is likely where it is above 0."""
    out = np.zeros(len(x))
    for tree in trees:
        for leaf in tree:
            inside = np.ones(len(x), bool)
            for f, lo, hi in zip(leaf.features, leaf.low, leaf.high, strict=True):
                inside &= (x[:, f] > lo) & (x[:, f] <= hi)
            out[inside] += leaf.value
    return out


def staged(rows: DataFrame, path: str, features: list[str], rounds: list[int], *keep: str) -> DataFrame:
    """(``keep``, rounds, probability): what the first trees of the model at ``path`` give, for each number of them in ``rounds``."""
    trees = leaves(rows.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(len(keep) + i).to_numpy(zero_copy_only=False) for i in range(len(features))])
            total, at = np.zeros(len(x)), 0
            for n in sorted(rounds):
                total, at = total + margins(trees[at:n], x), n
                made = [pa.array(np.full(len(x), n, np.int32)), pa.array(1 / (1 + np.exp(-2 * total)))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], [*keep, "rounds", "probability"])

    asked = rows.dropna(subset=features).select(*keep, *[F.col(f"`{f}`").cast("double").alias(f) for f in features])
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields[: len(keep)]]
    return asked.mapInArrow(run, ", ".join([*kept, "rounds int", "probability double"]))


def staged_counts(rows: DataFrame, paths: list[str], features: list[str], rounds: list[int], actual: str) -> DataFrame:
    """(model, rounds, tp, fp, fn, tn): hits and misses of what the first trees of each model in ``paths`` give, as in ``staged``, for each
    number of them in ``rounds``; the rows are read once for all models. ``model``: its place in ``paths``."""
    models, stages = [leaves(rows.sparkSession, p) for p in paths], sorted(set(rounds))
    names = ["tp", "fp", "fn", "tn"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((len(models), len(stages), 4), np.int64)
        for batch in batches:
            up, *x = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            up, x = up == 1, np.column_stack(x)
            for m, trees in enumerate(models):
                total, at = np.zeros(len(x)), 0
                for s, n in enumerate(stages):
                    total, at = total + margins(trees[at:n], x), n
                    said = 1 / (1 + np.exp(-2 * total)) >= 0.5
                    found[m, s] += [(said & up).sum(), (said & ~up).sum(), (~said & up).sum(), (~said & ~up).sum()]
        of = [(m, n) for m in range(len(models)) for n in stages]
        keys = [pa.array([m for m, _ in of], pa.int32()), pa.array([n for _, n in of], pa.int32())]
        yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, found.reshape(-1, 4).T.copy())], ["model", "rounds", *names])

    asked = rows.dropna(subset=[actual, *features]).select(F.col(actual).cast("int").alias("_actual"), *[F.col(f"`{f}`").cast("double").alias(f) for f in features])
    parts = asked.mapInArrow(run, ", ".join(["model int, rounds int", *(f"{n} long" for n in names)]))
    return parts.where("tp + fp + fn + tn > 0").groupBy("model", "rounds").agg(*[F.sum(n).alias(n) for n in names])


def attributions(rows: DataFrame, path: str, features: list[str], *keep: str) -> DataFrame:
    """(``keep``, base, margin, a column ``by_<feature>`` for each feature) of the rows that have all ``features``, in the order in which
    the model at ``path`` was trained on them."""
    trees = leaves(rows.sparkSession, path)
    base, names = base_value(trees), [f"by_{f}" for f in features]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(len(keep) + i).to_numpy(zero_copy_only=False) for i in range(len(features))])
            found = [np.full(len(x), base), margins(trees, x), *shapley(trees, x).T]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *map(pa.array, found)], [*keep, "base", "margin", *names])

    asked = rows.dropna(subset=features).select(*keep, *[F.col(f"`{f}`").cast("double").alias(f) for f in features])
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields[: len(keep)]]
    return asked.mapInArrow(run, ", ".join([*kept, *(f"`{n}` double" for n in ["base", "margin", *names])]))


def top_features(attributed: DataFrame, k: int = 10) -> DataFrame:
    """(place, feature, mean_size, mean): the ``k`` features whose values are largest in size over all rows; ties by name."""
    names = [c for c in attributed.columns if c.startswith("by_")]
    sums = attributed.agg(*[F.struct(F.avg(F.abs(f"`{c}`")).alias("mean_size"), F.avg(f"`{c}`").alias("mean")).alias(c) for c in names])
    long = sums.unpivot([], names, "feature", "v").select(F.expr("substring(feature, 4)").alias("feature"), "v.*")  # a row a feature
    place = F.row_number().over(Window.orderBy(F.desc("mean_size"), "feature"))
    return long.withColumn("place", place).where(F.col("place") <= k).select("place", "feature", "mean_size", "mean")


def reasons(attributed: DataFrame, k: int = 3, *keep: str) -> DataFrame:
    """(``keep``, place, feature, value): the ``k`` features that moved each prediction most."""
    names = [c for c in attributed.columns if c.startswith("by_")]
    each = F.array(*[F.struct((-F.abs(f"`{c}`")).alias("size"), F.lit(c[3:]).alias("feature"), F.col(f"`{c}`").alias("value")) for c in names])
    rows = attributed.select(*keep, F.posexplode(F.slice(F.array_sort(each), 1, k)).alias("_i", "_x"))
    return rows.select(*keep, (F.col("_i") + 1).alias("place"), "_x.feature", "_x.value")
