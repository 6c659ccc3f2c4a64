"""A Merkle manifest of a dataset: one root for all rows, and for each row the siblings that prove it.

A row's leaf digest covers all its fields. Leaves of a group (``source``) stand in order of their id. ``FAN`` neighbours
make a node, level by level, up to the group's subroot; subroots in order of their groups make the root in the same way.

The tree is cut into aligned blocks of ``FAN ** BLOCK_LEVELS`` leaves. A block is walked by one postorder recursion that
returns the digest of the subtree and, while it unwinds, appends the siblings of each subtree to the leaves in it. Block
roots are the leaves of another such traversal, spread over the cluster again, until each group has one node; subroots go
the same way. No task holds more than a block, and the driver holds nothing that grows with the rows.

Null values are digested as ``-`` and differ from empty texts; a null group comes first, as do null ids in a group; rows
that repeat an id stand in order of their digests, and fully equal rows are leaves of their own; a very long text is
digested where it is read and never moved; columns beyond the fields are ignored, whatever their names; an empty table has no row and
no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ordering, store

FAN = 3
BLOCK_LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_DIGEST = 32  # bytes
_PATH = "array<struct<left:string,right:string>>"
_PATH_ARROW = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 (hex) of all values, each with its length in bytes before it."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x.left, acc, x.right), 256))


def height(n: int, fan: int = FAN) -> int:
    """Levels above ``n`` leaves."""
    levels, reach = 0, 1
    while reach < n:
        levels, reach = levels + 1, reach * fan
    return levels


def visit(digests: list[str], level: int, lo: int, hi: int, fan: int, paths: list[list[tuple[str, str]]] | None) -> str:
    """Digest of the subtree of ``level`` over leaves ``lo`` to ``hi``; ``paths`` of these leaves grow by their siblings."""
    if level == 0:
        return digests[lo]
    step = fan ** (level - 1)
    starts = range(lo, hi, step)
    found = [visit(digests, level - 1, a, min(a + step, hi), fan, paths) for a in starts]
    if paths is not None:
        for k, a in enumerate(starts):
            beside = "".join(found[:k]), "".join(found[k + 1 :])
            for path in paths[a : min(a + step, hi)]:
                path.append(beside)
    return hashlib.sha256("".join(found).encode()).hexdigest()


def _block_height(size: int, fan: int, levels: int) -> int:
    """Levels of a block of a tree of ``size`` leaves: a tree that fits into one block ends where one node remains."""
    return min(height(size, fan), levels)


def _hexes(raw: bytes) -> list[str]:
    return [raw[a : a + _DIGEST].hex() for a in range(0, len(raw), _DIGEST)]


def _numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` with their group's number ``g`` (ascending in group order), ``size`` and their place ``idx`` in it."""
    order = [F.asc_nulls_first("grp"), F.asc_nulls_first("key"), F.asc("leaf"), F.asc("received")]
    placed = ordering.sorted_parts(leaves, order, "leaves")
    runs = placed.groupBy("grp", "part").agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    runs = runs.join(ordering.part_starts(placed), "part")
    group = Window.partitionBy("grp")  # as many rows as parts that the group spans
    spans = runs.select(
        F.col("grp").alias("_grp"), F.col("part").alias("_part"), "start",
        F.min(F.col("start") + F.col("first")).over(group).alias("g"), F.sum("n").over(group).alias("size"),
    )
    same = (F.col("part") == F.col("_part")) & F.col("grp").eqNullSafe(F.col("_grp"))
    return placed.join(spans, same).select("g", "size", (F.col("start") + F.col("pos") - F.col("g")).alias("idx"), "key", "leaf", "received")


def _blocks(rows: DataFrame, fan: int, levels: int) -> DataFrame:
    """One row a block of leaves: their keys and digests in order, and the block's root."""
    length = fan**levels

    def block(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        first = group.iloc[0]
        leaves = [bytes(x) for x in group["leaf"]]
        top = visit([x.hex() for x in leaves], _block_height(int(first["size"]), fan, levels), 0, len(leaves), fan, None)
        keys = [None if pd.isna(k) else int(k) for k in group["key"]]
        row = first["g"], first["block"], first["size"], keys, b"".join(leaves), b"".join(map(bytes, group["received"])), top
        return pd.DataFrame([row], columns=["g", "block", "size", "keys", "leaves", "received", "digest"])

    dealt = rows.withColumn("block", F.floor(F.col("idx") / length)).groupBy("g", "block")
    made = dealt.applyInPandas(block, "g long, block long, size long, keys array<long>, leaves binary, received binary, digest string")
    return store.materialize(made, "merkle-blocks")


def _climb(nodes: DataFrame, fan: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """From nodes (g, idx, size, digest) to their groups' roots: (g, idx, path, top) of the nodes and (g, digest)."""
    length, spark = fan**levels, nodes.sparkSession

    def traverse(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        digests, size = group["digest"].tolist(), int(group["size"].iloc[0])
        paths: list[list[tuple[str, str]]] = [[] for _ in digests]
        top = visit(digests, _block_height(size, fan, levels), 0, len(digests), fan, paths)
        named = [[{"left": a, "right": b} for a, b in p] for p in paths]
        return pd.DataFrame({"g": group["g"], "idx": group["idx"], "up": group["idx"] // length, "size": -(-size // length), "path": named, "digest": top})

    climbs = []
    while not nodes.where("size > 1").isEmpty():
        dealt = nodes.withColumn("up", F.floor(F.col("idx") / length)).groupBy("g", "up")
        climb = store.materialize(
            dealt.applyInPandas(traverse, f"g long, idx long, up long, size long, path {_PATH}, digest string"), "merkle-climb"
        )
        climbs.append(climb.select("g", "idx", "up", "path"))
        nodes = climb.where(F.col("idx") % length == 0).select("g", F.col("up").alias("idx"), "size", "digest")
    tops = nodes.select("g", "digest")
    above = nodes.select("g", "idx", F.array().cast(_PATH).alias("path"), F.col("digest").alias("top"))
    for climb in reversed(climbs):
        higher = above.select("g", F.col("idx").alias("up"), F.col("path").alias("_path"), "top")
        above = climb.join(higher, ["g", "up"]).select("g", "idx", F.concat("path", "_path").alias("path"), "top")
    return (store.materialize(above, "merkle-paths") if climbs else above), tops


def build(
    docs: DataFrame, *, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS,
    received: dict[str, Column] | None = None, fan: int = FAN, block_levels: int = BLOCK_LEVELS,
) -> tuple[DataFrame, DataFrame]:
    """The manifest, two tables in the shared folder. Blocks: (g, block, size, keys, leaves, received, digest), a row for up
    to ``fan ** block_levels`` rows of ``docs``. Paths: (g, block, path, subroot, root), from each block to the root.

    ``received`` states columns as a reader got them; the digests of such rows are kept beside the leaves.
    """
    changed = [(received or {}).get(f, F.col(f)) for f in fields]
    digests = docs.select(
        F.col(group).cast("string").alias("grp"), F.col(key).cast("long").alias("key"),
        F.unhex(leaf_digest([F.col(f) for f in fields])).alias("leaf"), F.unhex(leaf_digest(changed)).alias("received"),
    )
    blocks = _blocks(_numbered(store.materialize(digests, "digests")), fan, block_levels)
    blocks_of = F.ceil(F.col("size") / fan**block_levels)
    in_group, subroots = _climb(blocks.select("g", F.col("block").alias("idx"), blocks_of.alias("size"), "digest"), fan, block_levels)
    ordered = ordering.sorted_parts(store.materialize(subroots, "subroots"), [F.asc("g")], "groups")
    places = ordered.join(ordering.part_starts(ordered), "part").select(
        F.col("g").alias("group"), F.lit(0).cast("long").alias("g"), (F.col("start") + F.col("pos")).alias("idx"),
        F.lit(ordered.count()).cast("long").alias("size"), "digest",
    )
    places = store.materialize(places, "groups")
    to_root, _ = _climb(places.drop("group"), fan, block_levels)
    groups = places.select("idx", F.col("group").alias("g")).join(to_root.drop("g"), "idx")
    paths = in_group.join(groups.select("g", F.col("path").alias("_path"), F.col("top").alias("root")), "g")
    paths = paths.select("g", F.col("idx").alias("block"), F.concat("path", "_path").alias("path"), F.col("top").alias("subroot"), "root")
    return blocks, store.materialize(paths, "merkle-manifest")


def proofs(blocks: DataFrame, paths: DataFrame, *, fan: int = FAN, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """(key, leaf, received, path, subroot, root) of each row of the dataset; ``path`` has the siblings of each level, those
    left and those right of the row's own node."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                leaves, n = _hexes(row["leaves"]), len(row["keys"])
                inside: list[list[tuple[str, str]]] = [[] for _ in leaves]
                visit(leaves, _block_height(row["size"], fan, block_levels), 0, n, fan, inside)
                above = [(x["left"], x["right"]) for x in row["path"]]
                ends = np.cumsum([0] + [len(p) + len(above) for p in inside])
                left, right = zip(*(x for p in inside for x in (*p, *above)), strict=True) if ends[-1] else ((), ())
                sides = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
                columns = [
                    pa.array(row["keys"], pa.int64()), pa.array(leaves), pa.array(_hexes(row["received"])),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), sides).cast(_PATH_ARROW),
                    pa.array([row["subroot"]] * n), pa.array([row["root"]] * n),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "leaf", "received", "path", "subroot", "root"])

    whole = blocks.join(paths, ["g", "block"]).select("size", "keys", "leaves", "received", "path", "subroot", "root")
    return whole.mapInArrow(expand, f"key long, leaf string, received string, path {_PATH}, subroot string, root string")
