"""Importance resampling: draw documents whose hashed features look like those of a target.

Each text becomes a row of a sparse matrix of counts by bucket. The matrix is written once, as blocks in compressed sparse
row form: ``indptr``, ``indices`` and ``counts``. Column sums of the corpus and of the target give a gain for each bucket;
the product of the matrix with the gains is each document's weight; weight and a Gumbel number from the document's id are
its score, and the highest scores are drawn, which is sampling without replacement by weight.

Null and empty texts have no feature and weigh 0; rows that repeat a ``doc_id`` are documents of their own, equal in
score and next to each other in rank; a null ``doc_id`` draws its number from the text ``null`` and comes after others of
its score; a very long text is one row of one block; other columns of the input are ignored, whatever their names; an
empty corpus gives no row, an empty target is uniform.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordering, store

BUCKETS = 10_000
#: Words of a block at most, unless one text has more; documents of a block at most.
BLOCK_WORDS = 1 << 18
BLOCK_ROWS = 4096
MEMO_FEATURES = 500_000

_BLOCK = "doc_ids array<bigint>, n_words array<bigint>, indptr binary, indices binary, counts binary"
#: Bytes: A-Z to a-z; other ASCII but digits and letters to a space; the bytes of other characters stay.
_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)


class _Buckets(dict):
    """Feature to bucket, remembered."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        found = self[feature] = zlib.crc32(feature) % self.n
        return found


def features(words: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` words, joined by a space."""
    out = list(words)
    for n in range(2, longest + 1):
        out += map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False))
    return out


def block_of(rows: list[list[int]], buckets: int) -> tuple[bytes, bytes, bytes]:
    """``indptr`` (8 bytes an entry), ``indices`` and ``counts`` (4 bytes) of rows of buckets."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    flat = np.fromiter((b for r in rows for b in r), np.int64, int(sizes.sum()))
    cells, counts = np.unique(np.repeat(np.arange(len(rows)), sizes) * buckets + flat, return_counts=True)
    indptr = np.searchsorted(cells, np.arange(len(rows) + 1) * buckets)
    return indptr.astype("<i8").tobytes(), (cells % buckets).astype("<u4").tobytes(), counts.astype("<u4").tobytes()


def count_matrix(texts: DataFrame, *, key: str = "doc_id", buckets: int = BUCKETS, longest: int = 1) -> DataFrame:
    """The matrix of ``texts`` (``key``, text), written to the shared folder: one row a block of documents."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Buckets(buckets)
        keys, sizes, rows, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            columns = [[keys], [sizes], *([x] for x in block_of(rows, buckets))]
            kinds = [pa.list_(pa.int64())] * 2 + [pa.binary()] * 3
            names = [c.split()[0] for c in _BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or b"").translate(_LOWER).split()
                if len(memo) > MEMO_FEATURES:
                    memo.clear()
                keys.append(doc_id)
                sizes.append(len(words))
                rows.append([memo[f] for f in (features(words, longest) if longest > 1 else words)])
                held += len(rows[-1])
                if held >= BLOCK_WORDS or len(keys) >= BLOCK_ROWS:
                    yield block()
                    keys, sizes, rows, held = [], [], [], 0
        if keys:
            yield block()

    rows = texts.select(F.col(key).cast("long"), F.col("text").cast("binary"))
    return store.materialize(rows.mapInArrow(build, _BLOCK), "counts")


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Total of each bucket. A task adds its blocks to one vector; the driver gets ``buckets`` numbers, whatever the rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for indices, counts in zip(batch.column(0), batch.column(1), strict=True):
                at, n = np.frombuffer(indices.as_py(), "<u4"), np.frombuffer(counts.as_py(), "<u4")
                total += np.bincount(at, n, buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    parts = matrix.select("indices", "counts").mapInArrow(add, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of target share to corpus share, both with one added to each bucket, rounded down."""
    n = len(corpus)
    over = (target + 1.0) * float(corpus.sum() + n)
    under = (corpus + 1.0) * float(target.sum() + n)
    return np.floor(1000 * np.log(over / under)).astype(np.int64)


def products(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): row sums, and the product of the matrix with ``gain``."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, n_words, indptr, indices, counts = (c[row] for c in batch.columns)
                ends = np.frombuffer(indptr.as_py(), "<i8")
                n = np.frombuffer(counts.as_py(), "<u4").astype(np.int64)
                sums = [np.concatenate(([0], np.cumsum(x))) for x in (n, n * gain[np.frombuffer(indices.as_py(), "<u4")])]
                columns = [doc_ids.values, n_words.values, *(pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(multiply, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel number from the first 32 bits of a hash of the id, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, *, target_key: str = "item_id", buckets: int = BUCKETS, longest: int = 1,
    seed: int = 2024, least_words: int = 20, percent: int = 10,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of all documents; ``rank`` of the drawn ones, from 1, null for the rest.

    Scores are ordered in range partitions, so neither one task nor the driver sees them all.
    """
    matrix = count_matrix(docs, buckets=buckets, longest=longest)
    wanted = count_matrix(target, key=target_key, buckets=buckets, longest=longest)
    gain = gains(column_sums(matrix, buckets), column_sums(wanted, buckets))
    weighed = products(matrix, gain).select(
        "doc_id",
        "n_features",
        "weight",
        (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"),
        (F.col("n_words") >= least_words).alias("eligible"),
    )
    order = [F.desc("eligible"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features")]
    placed = ordering.sorted_parts(store.materialize(weighed, "weights"), order, "scores")
    n = placed.where("eligible").count()
    place = F.col("start") + F.col("pos") + 1
    rank = F.when(F.col("eligible") & (place <= percent * n // 100), place)
    joined = placed.join(ordering.part_starts(placed), "part")
    return joined.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
