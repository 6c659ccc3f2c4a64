"""Connected components by alternating stars, as joins and aggregates.

Each round hangs every node's neighbours on the smallest of them, first the larger neighbours, then the smaller ones,
until each component is a star around its smallest node. Edges live in the shared folder between rounds; nothing is
collected but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def _smallest(pairs: DataFrame) -> DataFrame:
    """The smallest of each node and its neighbours. Written out, so that the join on it can split a hub's rows."""
    mins = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return store.materialize(mins, "cc-min")


def _large_star(edges: DataFrame) -> DataFrame:
    pairs = edges.union(edges.select("v", "u"))
    hung = pairs.where("v > u").join(_smallest(pairs), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    mins = _smallest(down)
    hung = down.join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return hung.union(mins.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node of an edge to another node, and the smallest node of its component.

    Null ends, loops and repeated edges are ignored.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    current, before = store.materialize(pairs, "cc-edges"), None
    while True:
        mark = current.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        current = store.materialize(_small_star(store.materialize(_large_star(current), "cc-large")), "cc-small")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
