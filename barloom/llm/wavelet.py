"""Token-id shards as wavelet matrices: one bit-plane per id bit, with rank and select.

A shard file holds whole documents in ascending ``doc_id`` order. Each plane comes with a rank directory, the ones before
every ``STEP`` bits, so ``access``, ``rank``, ``count``, ``select`` and ``occurrences`` look at the directory and at
single steps of packed planes; ids are unpacked by ``decode`` only.

Null texts count as empty (one end id); rows that repeat a ``doc_id`` stay, ordered by text; null ids come first; very
long texts stay in one shard, which then exceeds ``shard_tokens``; other columns of the input are ignored, whatever their
names; an empty table gives no shard and no row.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store, tokens

MAGIC = b"WMSHARD2"
END_ID = 0
SHARD_TOKENS = 1 << 20
#: Bits between two entries of a rank directory.
STEP = 512
_STEP_BYTES = STEP // 8
_HEAD = struct.Struct("<8sI")
#: Of each byte: the place of its k-th one, high bit first.
_PLACE = np.zeros((256, 8), np.int64)
for _byte in range(256):
    _where = [n for n in range(8) if _byte >> (7 - n) & 1]
    _PLACE[_byte, : len(_where)] = _where


def build(ids: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """Packed planes, high bit first, and how many zeros each has; zeros go before ones, in order."""
    planes, zeros = [], []
    for level in range(bits - 1, -1, -1):
        ones = (ids & ids.dtype.type(1 << level)) != 0
        planes.append(np.packbits(ones))
        at = np.flatnonzero(~ones)
        zeros.append(len(at))
        after = np.empty_like(ids)
        np.take(ids, at, out=after[: len(at)], mode="clip")
        np.take(ids, np.flatnonzero(ones), out=after[len(at) :], mode="clip")
        ids = after
    return planes, zeros


def rank_directory(plane: np.ndarray) -> np.ndarray:
    """Ones before each step of a packed plane, and all of them last."""
    steps = -(-len(plane) // _STEP_BYTES)
    padded = np.zeros(steps * _STEP_BYTES, np.uint8)
    padded[: len(plane)] = plane
    per_step = np.bitwise_count(padded.view("<u8")).reshape(steps, STEP // 64).sum(1, dtype=np.int64)
    return np.concatenate(([0], np.cumsum(per_step))).astype("<u4")


class Shard:
    """A shard read from its file's bytes; planes are decompressed, not unpacked, when first asked for."""

    def __init__(self, raw: bytes):
        magic, size = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        head = json.loads(raw[_HEAD.size : _HEAD.size + size])
        self.n, self.bits, self.zeros = head["n"], head["bits"], head["zeros"]
        blobs, at = [], _HEAD.size + size
        for length in head["blobs"]:
            blobs.append(raw[at : at + length])
            at += length
        self._unpack = zstandard.ZstdDecompressor().decompress
        self.doc_ids = np.frombuffer(self._unpack(blobs[0]), "<i8")
        self.has_id = np.frombuffer(self._unpack(blobs[1]), "u1").astype(bool)
        self.offsets = np.frombuffer(self._unpack(blobs[2]), "<i8")
        self._blobs, self._planes, self._ranks = blobs[3:], {}, {}

    def plane(self, level: int) -> np.ndarray:
        """The packed bits of a plane, filled up with zeros to whole steps."""
        if level not in self._planes:
            raw = np.frombuffer(self._unpack(self._blobs[2 * level]), "u1")
            padded = np.zeros(-(-len(raw) // _STEP_BYTES) * _STEP_BYTES, np.uint8)
            padded[: len(raw)] = raw
            self._planes[level] = padded
            self._ranks[level] = np.frombuffer(self._unpack(self._blobs[2 * level + 1]), "<u4").astype(np.int64)
        return self._planes[level]

    def decode(self) -> np.ndarray:
        """All ids in order: undo the partitions from the lowest plane up."""
        kind = "<u2" if self.bits <= 16 else "<u4"
        ids = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            ones = np.unpackbits(np.frombuffer(self._unpack(self._blobs[2 * level]), "u1"), count=self.n).view(bool)
            z = self.zeros[level]
            before = np.empty(self.n, kind)
            before[np.flatnonzero(~ones)] = ids[:z]
            before[np.flatnonzero(ones)] = ids[z:] | np.array(1 << (self.bits - 1 - level), kind)
            ids = before
        return ids

    def _rank1(self, level: int, i: int) -> int:
        """Ones before bit ``i``: the directory's entry and at most one step of bits."""
        plane, step = self.plane(level), i // STEP
        ones = int(self._ranks[level][step])
        if i % STEP:
            part = plane[step * _STEP_BYTES : i // 8]
            ones += int(np.bitwise_count(part).sum(dtype=np.int64))
            if i % 8:
                ones += (int(plane[i // 8]) >> (8 - i % 8)).bit_count()
        return ones

    def _places(self, level: int, k: np.ndarray, one: bool) -> np.ndarray:
        """Where the ``k``-th ones (or zeros) of a plane stand."""
        plane, ranks = self.plane(level), self._ranks[level]
        before = ranks if one else np.arange(len(ranks)) * STEP - ranks
        step = np.searchsorted(before, k, side="right") - 1
        part = plane.reshape(-1, _STEP_BYTES)[step]
        if not one:
            part = ~part
        rest = k - before[step]
        sums = np.cumsum(np.bitwise_count(part), axis=1, dtype=np.int64)
        byte = (sums <= rest[:, None]).sum(1)
        row = np.arange(len(k))
        rest = rest - np.where(byte > 0, sums[row, byte - 1], 0)
        return step * STEP + byte * 8 + _PLACE[part[row, byte], rest]

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            one = int(self.plane(level)[i // 8]) >> (7 - i % 8) & 1
            r = self._rank1(level, i)
            value = value << 1 | one
            i = self.zeros[level] + r if one else i - r
        return value

    def _follow(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if token >> (self.bits - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
            if lo == hi:
                break
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self._follow(token, lo, self.n if hi is None else hi)
        return b - a

    def rank(self, token: int, i: int) -> int:
        return self.count(token, 0, i)

    def _select(self, token: int, at: np.ndarray) -> np.ndarray:
        for level in range(self.bits - 1, -1, -1):
            one = bool(token >> (self.bits - 1 - level) & 1)
            at = self._places(level, at - self.zeros[level] if one else at, one)
        return at

    def select(self, token: int, k: int) -> int:
        """Position of the ``k``-th occurrence, from 0; -1 if there are fewer."""
        lo, hi = self._follow(token, 0, self.n)
        return int(self._select(token, np.array([lo + k]))[0]) if 0 <= k < hi - lo else -1

    def occurrences(self, token: int) -> Iterator[np.ndarray]:
        """All positions of a token, ascending, some thousands at a time."""
        lo, hi = self._follow(token, 0, self.n)
        for a in range(lo, hi, 8192):
            yield self._select(token, np.arange(a, min(hi, a + 8192)))


def shard_bytes(doc_ids: list[int | None], ids: list[bytes], size: int = 1 << 16) -> tuple[bytes, int]:
    """One file's bytes and its number of ids; ``ids``: each document's, two little-endian bytes an id, four where the
    vocabulary's ``size`` is larger."""
    bits = max(1, (size - 1).bit_length())
    flat = np.frombuffer(b"".join(ids), "<u2" if bits <= 16 else "<u4")
    planes, zeros = build(flat, bits)
    pack = zstandard.ZstdCompressor(level=1).compress
    blobs = [
        pack(np.array([d or 0 for d in doc_ids], "<i8").tobytes()),
        pack(np.array([d is not None for d in doc_ids], "u1").tobytes()),
        pack(np.cumsum([0, *(len(x) // flat.itemsize for x in ids)], dtype="<i8").tobytes()),
    ]
    for plane in planes:
        blobs += [pack(plane.tobytes()), pack(rank_directory(plane).tobytes())]
    head = json.dumps({"n": len(flat), "bits": bits, "zeros": zeros, "blobs": list(map(len, blobs))}).encode()
    return b"".join((_HEAD.pack(MAGIC, len(head)), head, *blobs)), len(flat)


_MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long"


def write_shards(
    docs: DataFrame, folder: str, vocabulary: str, *, kind: str = "byte", shard_tokens: int = SHARD_TOKENS
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write shard files under ``folder``; one row per file.

    Rows are dealt by ranges of ``doc_id``, so shards follow one another by (part, seq). A shard closes with the document
    that reaches ``shard_tokens``.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary, kind)
        encode, width = encoder.encode, encoder.dtype.itemsize
        end = END_ID.to_bytes(width, "little")
        part, seq, doc_ids, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/part-{part:06d}-{seq:06d}.wm"
            raw, n = shard_bytes(doc_ids, ids, encoder.size)
            store.put_file(path, raw)
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "seq": pa.array([seq], pa.int32()),
                    "path": [path],
                    "n_docs": [len(doc_ids)],
                    "n_tokens": [n],
                }
            )

        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 500):
                slice_ids = batch.column(0).slice(at, 500).to_pylist()
                slice_texts = [t or "" for t in texts.slice(at, 500).to_pylist()]
                for doc_id, found in zip(slice_ids, encode(slice_texts), strict=True):
                    doc_ids.append(doc_id)
                    ids.append(found + end)
                    size += len(found) // width + 1
                    if size >= shard_tokens:
                        yield close()
                        seq, doc_ids, ids, size = seq + 1, [], [], 0
        if doc_ids:
            yield close()

    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id")
    files = ranged.sortWithinPartitions("doc_id", "text").mapInArrow(write, _MANIFEST)
    return store.materialize(files, "wm-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """Add ``start``, the ids in all shards before. The driver sees one number per range, never one per document."""
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    bases, total = [], 0
    for row in parts:
        bases.append((row["part"], total))
        total += row["n"]
    base = manifest.sparkSession.createDataFrame(bases, "part int, base long")
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    started = manifest.join(base, "part").withColumn(
        "start", F.col("base") + F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    )
    return started.drop("base").repartition(max(1, len(parts)), "path")


def _documents(shard: Shard, row: dict, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(shard.doc_ids, pa.int64(), mask=~shard.has_id),
            "start": pa.array(shard.offsets[:-1] + row["start"], pa.int64()),
            "n_tokens": pa.array(np.diff(shard.offsets), pa.int64()),
            **columns,
            "shard": pa.array([row["path"].rpartition("/")[2]] * len(shard.doc_ids), pa.string()),
        }
    )


def read_shards(started: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """Each document of the shard files: its place, length and checksum, and the shard that holds it; ``ids`` too, if
    asked for."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(store.get_file(row["path"]))
                wide = shard.decode().astype("<u4")
                cuts = shard.offsets.tolist()
                sums = [zlib.crc32(wide[a:b]) for a, b in zip(cuts, cuts[1:])]
                columns = {"ids_crc32": pa.array(sums, pa.int64())}
                if with_ids:
                    columns["ids"] = pa.LargeListArray.from_arrays(shard.offsets, wide.astype(np.int64)).cast(pa.list_(pa.int64()))
                yield _documents(shard, row, columns)

    ids = "ids array<long>, " if with_ids else ""
    return started.select("path", "start").mapInArrow(
        read, f"doc_id long, start long, n_tokens long, ids_crc32 long, {ids}shard string"
    )


def count_token(started: DataFrame, token: int) -> DataFrame:
    """(doc_id, start, n_tokens, n, shard): how often each document that holds the token does; counted in the planes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(store.get_file(row["path"]))
                if not shard.count(token):
                    continue
                ranks = np.array([shard.rank(token, int(i)) for i in shard.offsets])
                found = _documents(shard, row, {"n": pa.array(np.diff(ranks), pa.int64())})
                yield found.filter(pa.array(np.diff(ranks) > 0))

    return started.select("path", "start").mapInArrow(
        read, "doc_id long, start long, n_tokens long, n long, shard string"
    )


def find_token(started: DataFrame, token: int) -> DataFrame:
    """(doc_id, start, position, shard): every place of a token, counted from its document's first id."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(store.get_file(row["path"]))
                for at in shard.occurrences(token):
                    doc = np.searchsorted(shard.offsets, at, side="right") - 1
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(shard.doc_ids[doc], pa.int64(), mask=~shard.has_id[doc]),
                            "start": pa.array(shard.offsets[doc] + row["start"], pa.int64()),
                            "position": pa.array(at - shard.offsets[doc], pa.int64()),
                            "shard": pa.array([row["path"].rpartition("/")[2]] * len(at), pa.string()),
                        }
                    )

    return started.select("path", "start").mapInArrow(read, "doc_id long, start long, position long, shard string")


def wavelet_tokens(docs: DataFrame, vocabulary: str, *, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write ``docs`` as wavelet-matrix shards in the shared folder and read every document back from them."""
    folder = store.new_folder(docs.sparkSession, "wm-shards")
    manifest = write_shards(docs, folder, vocabulary, shard_tokens=shard_tokens)
    return read_shards(with_starts(manifest))
