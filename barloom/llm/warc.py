"""WARC archives compressed record by record with a Zstandard dictionary of their own.

Each file starts with a skippable frame that embeds the dictionary, built from the file's first records; then one frame
per record follows. Equal payloads are stored once: the record with the smallest ``page_id`` is a ``response``, the
others are ``revisit`` records that refer to it.

Null html counts as empty; a null ``page_id`` sorts after all others; rows that repeat the smallest ``page_id`` are all
responses; very long payloads are records as others; other columns of the input are ignored, whatever their names; an
empty table gives no file.
"""

from __future__ import annotations

import base64
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
TRAIN_BYTES = 4 << 20
TRAIN_RECORDS = 1000
FILE_BYTES = 256 << 20
#: Payloads handed on at once when an archive is read.
READ_BYTES = 8 << 20
LEVEL = 3
SALTS = 16
_DATE = "2000-01-01T00:00:00Z"
_NONE = "-"


def mark_revisits(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Add ``digest`` (hex SHA-1) and ``refers_to``, the smallest page_id of an equal payload if that is another row.

    Only digests that occur twice or more are joined; a salt deals the copies of a hot one to several tasks. Payloads
    under ``least_bytes`` never refer.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long"), "url", html.alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload"))
    keys = pages.where(F.length("payload") >= least_bytes).groupBy("digest")
    firsts = keys.agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first_id")), F.col("first_id"))
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(firsts, ["digest", "salt"], "left").withColumn("refers_to", refers).drop("first_id", "salt")


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """Header lines and block; a revisit keeps the HTTP header, which states the payload's length, and no payload."""
    base32 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = _NONE if page_id is None else str(page_id)
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{name}:{base32}')}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base32}",
        f"X-Page-ID: {name}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[2:2] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{base32}')}>",
            f"X-Refers-To-Page: {refers_to}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes]) -> bytes:
    """A dictionary of the records; the ends of the records themselves where they are too few or too alike to train on."""
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, records)) // 16))
    if len(records) >= 8:
        try:
            return zstandard.train_dictionary(size, records).as_bytes()
        except zstandard.ZstdError:
            pass
    share = max(256, DICTIONARY_BYTES // len(records))
    return b"".join(r[:share] for r in records)[-DICTIONARY_BYTES:]


def write_archives(marked: DataFrame, folder: str, *, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the rows of ``mark_revisits`` as ``.warc.zst`` files; one row (path, n_records, n_bytes) a file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        records = (
            _record(*row)
            for batch in batches
            for at in range(0, batch.num_rows, 200)
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True)
        )
        held: list[bytes] = []
        seq = 0
        while True:
            size = sum(map(len, held))
            for record in records:
                held.append(record)
                size += len(record)
                if len(held) >= TRAIN_RECORDS or size >= TRAIN_BYTES:
                    break
            if not held:
                return
            dictionary = train(held)
            pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)).compress
            frames = [struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary, *map(pack, held)]
            n, size, held = len(held), sum(map(len, frames)), []
            for record in records:
                if size >= file_bytes:
                    held = [record]
                    break
                frames.append(pack(record))
                n, size = n + 1, size + len(frames[-1])
            path = f"{folder}/part-{part:06d}-{seq:04d}.warc.zst"
            yield pa.RecordBatch.from_pydict(
                {"path": [path], "n_records": [n], "n_bytes": [store.put_file(path, *frames)]}
            )
            seq += 1

    columns = marked.select("page_id", "url", "payload", "digest", "refers_to")
    return store.materialize(columns.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-manifest")


def records(raw: bytes) -> Iterator[bytes]:
    """The records of one file, each from its own frame."""
    magic, size = struct.unpack_from("<II", raw)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    view, at = memoryview(raw), 8 + size
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8:at]))
    while at < len(raw):
        frame, parts = opener.decompressobj(), []
        while not frame.eof:
            fed = view[at : at + 65536]
            if not fed:
                raise ValueError("cut record")
            parts.append(frame.decompress(fed))
            at += len(fed) - len(frame.unused_data)
        yield b"".join(parts)


def parse(record: bytes) -> dict:
    """Header fields and payload of a record; a response's payload is checked against its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["payload_bytes"] = int(http.rpartition(b"Content-Length: ")[2])
    if fields["WARC-Type"] == "response":
        import hashlib

        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if fields["WARC-Payload-Digest"] != f"sha1:{digest}" or len(payload) != fields["payload_bytes"]:
            raise ValueError("payload and digest differ")
    fields["payload"] = payload
    return fields


def read_archives(manifest: DataFrame, n_files: int) -> DataFrame:
    """Every record of the files in ``manifest``; ``payload`` is null for revisits, which do not hold it."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x in (None, _NONE) else int(x)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())

        def made(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names
            )

        for batch in batches:
            for path in batch.column(0).to_pylist():
                found, size = [], 0
                for f in map(parse, records(store.get_file(path))):
                    revisit = f["WARC-Type"] == "revisit"
                    found.append(
                        (
                            number(f["X-Page-ID"]),
                            f["WARC-Target-URI"],
                            f["payload_bytes"],
                            f["WARC-Payload-Digest"].removeprefix("sha1:"),
                            f["WARC-Type"],
                            number(f.get("X-Refers-To-Page")),
                            None if revisit else f["payload"],
                        )
                    )
                    size += len(f["payload"])
                    if size >= READ_BYTES:
                        yield made(found)
                        found, size = [], 0
                if found:
                    yield made(found)

    return manifest.select("path").repartition(max(1, n_files), "path").mapInArrow(
        read,
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long,"
        " payload binary",
    )


def archive(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Write every page as a WARC record in the shared folder and read all archives back."""
    folder = store.new_folder(pages.sparkSession, "warc")
    manifest = write_archives(mark_revisits(pages, least_bytes=least_bytes), folder)
    return read_archives(manifest, manifest.count())
