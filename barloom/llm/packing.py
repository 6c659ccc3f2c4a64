"""Best-fit packing of documents into sequences, with certified bin counts.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt to groups of bounded size; each group is packed
by best-fit decreasing, and dual feasible functions give a bound that no packing of the group can beat. Groups above
their bound give up the pieces of their unfilled sequences, which are dealt anew among those groups and packed again,
for as long as a round saves more than ``least_gain`` of them. ``certificate`` tells how far the result is from the bound.

Null and empty texts are one piece with the end id; repeated rows are documents of their own; very long texts become as many
pieces as they need; pieces of equal length are packed in order of id; other columns of the input are ignored, whatever
their names; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, tokens

CAPACITY = 2048
END_ID = 0
GROUP_PIECES = 10_000
#: Words whose ids a worker remembers; workers that pack may serve other stages later.
MEMO_WORDS = 800_000
#: A further round must save this share of the sequences that it packs again.
LEAST_GAIN = 0.0005

_PIECE = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = _PIECE + ", grp long, bin long, offset long, filled long, n_bins long, bound long"


def pieces(docs: DataFrame, vocabulary: str, *, kind: str = "word", capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces with their ids (``ids``: the encoder's ``dtype``) and checksum."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary, kind, memo_words=MEMO_WORDS)
        encode, width = encoder.encode, encoder.dtype.itemsize
        end = END_ID.to_bytes(width, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                found = encode([t or "" for t in part.column(1).to_pylist()])
                for doc_id, raw in zip(part.column(0).to_pylist(), found, strict=True):
                    raw += end
                    wide = np.frombuffer(raw, encoder.dtype).astype("<u4")
                    for n, a in enumerate(range(0, len(wide), capacity)):
                        ids = wide[a : a + capacity]
                        rows.append((doc_id, n, a, len(ids), zlib.crc32(ids), raw[width * a : width * (a + capacity)]))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"
    )


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length: longest first, each into the fullest bin that holds it."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms, n = 0, 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        bins[i], offsets[i] = b, capacity - room
        if room > size:
            open_bins[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY, counts: np.ndarray | None = None) -> int:
    """Bins that any packing needs: the largest bound of two families of dual feasible functions.

    One drops lengths below a threshold and rounds those above its complement up to a whole bin; the other rounds
    ``(k + 1) x`` down, unless it is whole.
    """
    if not len(lengths):
        return 0
    hist = np.bincount(lengths, counts, capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    n, total = np.cumsum(hist), np.cumsum(hist * x)
    low = np.arange(1, capacity // 2 + 1)
    middle = total[capacity - low] - total[low - 1]
    best = int((-(-(middle + (n[-1] - n[capacity - low]) * capacity) // capacity)).max())
    best = max(best, int(-(-total[-1] // capacity)))
    for k in range(1, 33):
        whole, rest = np.divmod((k + 1) * x, capacity)
        value = np.where(rest == 0, k * x, whole * capacity)  # of k * capacity
        best = max(best, int(-(-int((hist * value).sum()) // (k * capacity))))
    return best


def _pack_groups(rows: DataFrame, capacity: int) -> DataFrame:
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece", "ids_crc32", "length"], kind="stable").reset_index(drop=True)
        lengths = group["length"].to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, lengths).astype(np.int64)
        return group.assign(
            bin=bins, offset=offsets, filled=fill[bins], n_bins=len(fill), bound=lower_bound(lengths, capacity)
        )[[c.split()[0] for c in _PLACED.split(", ")]]

    return rows.groupBy("grp").applyInPandas(pack, _PLACED)


def _dealt(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """``rows`` in ``n`` random groups; ``row`` parts those that are equal in all else."""
    group = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", "row", F.lit(seed)), F.lit(n))
    return rows.select(*[c.split()[0] for c in _PIECE.split(", ")], (group + F.lit(seed << 32)).alias("grp"))


def _numbered(found: DataFrame) -> DataFrame:
    return found.withColumn("row", F.monotonically_increasing_id())


def pack_pieces(
    found: DataFrame,
    *,
    capacity: int = CAPACITY,
    group_pieces: int = GROUP_PIECES,
    rounds: int | None = None,
    least_gain: float = LEAST_GAIN,
) -> DataFrame:
    """The pieces with their ``sequence_id`` and ``offset``; ``rounds`` bounds the rounds after the first."""
    placed, seed, settled = _packed(found, capacity, group_pieces), 0, []
    while rounds is None or seed < rounds:
        seed += 1
        loose = (F.col("n_bins") > F.col("bound")) & (F.col("filled") < capacity)
        old = placed.where(loose).agg(F.count("*"), F.countDistinct("grp", "bin")).first()
        if old[1] < 2:
            break
        dealt = _dealt(placed.where(loose), -(-old[0] // group_pieces), seed)
        again = store.materialize(_pack_groups(dealt, capacity), "repacked")
        saved = old[1] - again.agg(F.countDistinct("grp", "bin")).first()[0]
        if saved <= 0:
            break
        settled.append(placed.where(~loose))
        placed = again
        if saved < least_gain * old[1]:
            break
    for more in settled:
        placed = placed.union(more)
    return placed.select(
        "row", "doc_id", "piece", "start", "length", "ids_crc32",
        (F.shiftleft("grp", 24) + F.col("bin")).alias("sequence_id"), "offset",
    )


def _packed(found: DataFrame, capacity: int, group_pieces: int) -> DataFrame:
    found = found if "row" in found.columns else _numbered(found)
    dealt = _dealt(found, -(-found.count() // group_pieces) or 1, 0)
    return store.materialize(_pack_groups(dealt, capacity), "packed")


def bound_of(found: DataFrame, capacity: int = CAPACITY) -> int:
    """Sequences that any packing of all pieces needs, from the counts of their lengths."""
    rows = found.groupBy("length").count().collect()  # at most ``capacity`` rows
    return lower_bound(np.array([r[0] for r in rows], np.int64), capacity, np.array([r[1] for r in rows], np.int64))


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """Sequences used and those that any packing of the same pieces needs."""
    return packed.select("sequence_id").distinct().count(), bound_of(packed, capacity)


def pack_documents(docs: DataFrame, vocabulary: str, *, capacity: int = CAPACITY) -> DataFrame:
    """Where each piece of each document stands."""
    found = store.materialize(_numbered(pieces(docs, vocabulary, capacity=capacity).drop("ids")), "pieces")
    return pack_pieces(found, capacity=capacity).drop("row")


def sequences(docs: DataFrame, vocabulary: str, *, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens and ids (the encoder's ``dtype``)."""
    found = store.materialize(_numbered(pieces(docs, vocabulary, capacity=capacity)), "pieces")
    placed = pack_pieces(found.drop("ids"), capacity=capacity).select("row", "sequence_id", "offset")
    joined = placed.join(found.select("row", "length", "ids"), "row")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x.ids)
    return joined.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"),
        F.aggregate(ordered, F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"),
    )
