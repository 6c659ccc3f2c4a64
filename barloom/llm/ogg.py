"""Ogg media columns: texts' bytes as 8-bit samples in an Ogg container, and back.

``mux`` writes two logical streams: a skeleton that states the sample rate, and the samples. ``demux`` verifies every
page's checksum, sorts pages by serial number, joins packets from lacing values, also over page ends, and takes times
from granule positions.

Null texts count as empty; an empty text is one block of zeros. Equal texts give equal files: serial numbers come from
the payload. Repeated rows are stored one by one and null ids stay; very long texts span pages; other columns of the input
are ignored, whatever their names; an empty table gives no row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

BLOCK = 64
RATE = 8000
PACKET = 4096
PAGE_SEGMENTS = 255
CONTINUED, FIRST, LAST = 1, 2, 4

_PAGE = struct.Struct("<4sBBqIIIB")
_SKELETON = b"fishead\0"
_SAMPLES = b"PCM8    "
_FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    pass


def page_crc(page: bytes) -> int:
    """Ogg's checksum (polynomial 0x04c11db7, not reflected) by way of zlib's reflected one."""
    reflected = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_FLIP), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def lace(packets: list[bytes]) -> tuple[bytes, bytes]:
    lacing = b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in packets)
    return lacing, b"".join(packets)


def mux(payload: bytes, rate: int = RATE) -> bytes:
    """One Ogg file: skeleton and sample streams; pages of up to 255 segments, packets cut where a page is full."""
    serial = zlib.crc32(payload) & 0x7FFFFFFE
    head = _SAMPLES + struct.pack("<IBB", rate, 1, 8)
    fishead = _SKELETON + struct.pack("<HHqqqq", 3, 0, 0, 1, 0, 1)
    fisbone = b"fisbone\0" + struct.pack("<IIIqq", 20, serial, 1, rate, 1)
    pages = [
        _page(FIRST, 0, serial + 1, 0, *lace([fishead])),
        _page(FIRST, 0, serial, 0, *lace([head])),
        _page(0, 0, serial + 1, 1, *lace([fisbone])),
        _page(LAST, 0, serial + 1, 2, b"\0", b""),
    ]
    lacing, _ = lace([payload[a : a + PACKET] for a in range(0, len(payload), PACKET)])
    at, continued = 0, 0
    for number, first in enumerate(range(0, len(lacing), PAGE_SEGMENTS), 1):
        part = lacing[first : first + PAGE_SEGMENTS]
        size = sum(part)
        ends = part.rstrip(b"\xff")  # samples up to the last packet that ends here
        granule = at + sum(ends) if ends else -1
        last = LAST if first + PAGE_SEGMENTS >= len(lacing) else 0
        pages.append(_page(continued | last, granule, serial, number, part, payload[at : at + size]))
        at += size
        continued = CONTINUED if part[-1] == 255 else 0
    return b"".join(pages)


@dataclass
class LogicalStream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: granule position of the page on which each packet ends
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    closed: bool = False
    _partial: list[bytes] = field(default_factory=list)


def demux(raw: bytes) -> dict[int, LogicalStream]:
    """Logical streams by serial number; raises ``OggError`` on a bad checksum, a lost page or a cut packet."""
    streams: dict[int, LogicalStream] = {}
    at = 0
    while at < len(raw):
        if len(raw) - at < _PAGE.size:
            raise OggError("cut page header")
        magic, version, flags, granule, serial, number, crc, segments = _PAGE.unpack_from(raw, at)
        body = at + _PAGE.size + segments
        lacing = raw[at + _PAGE.size : body]
        end = body + sum(lacing)
        if magic != b"OggS" or version != 0 or end > len(raw):
            raise OggError("not a page")
        if page_crc(raw[at : at + 22] + b"\0\0\0\0" + raw[at + 26 : end]) != crc:
            raise OggError(f"checksum of page {number} of stream {serial}")
        stream = streams.setdefault(serial, LogicalStream(serial))
        if number != stream.pages or bool(flags & FIRST) != (number == 0) or stream.closed:
            raise OggError(f"lost or repeated page in stream {serial}")
        if bool(flags & CONTINUED) != bool(stream._partial):
            raise OggError(f"cut packet in stream {serial}")
        size = 0
        for value in lacing:
            size += value
            if value < 255:
                stream.packets.append(b"".join((*stream._partial, raw[body : body + size])))
                stream.granules.append(granule)
                stream._partial = []
                body, size = body + size, 0
        if size:
            stream._partial.append(raw[body : body + size])
        stream.pages += 1
        stream.closed = bool(flags & LAST)
        at = end
    for stream in streams.values():
        if stream._partial or not stream.closed:
            raise OggError(f"stream {stream.serial} has no end")
    return streams


@dataclass(frozen=True)
class Samples:
    body: bytes
    rate: int
    #: second at which each packet ends; those of a page end with its granule position and count back from it
    times: list[float]


def samples(raw: bytes) -> Samples:
    """The one sample stream in a file."""
    found = [s for s in demux(raw).values() if s.packets and s.packets[0].startswith(_SAMPLES)]
    if len(found) != 1:
        raise OggError("one sample stream expected")
    rate, channels, bits = struct.unpack_from("<IBB", found[0].packets[0], len(_SAMPLES))
    if (channels, bits) != (1, 8):
        raise OggError("8-bit mono expected")
    packets, granules = found[0].packets[1:], found[0].granules[1:]
    times, at = [0.0] * len(packets), 0
    for n in range(len(packets) - 1, -1, -1):
        last_of_page = n + 1 == len(packets) or granules[n] != granules[n + 1]
        at = granules[n] if last_of_page else at - len(packets[n + 1])
        times[n] = at / rate
    body = b"".join(packets)
    if not granules or granules[-1] != len(body) or at != len(packets[0]):
        raise OggError("granule position and samples differ")
    return Samples(body, rate, times)


def feature(body: bytes, seconds: float) -> str:
    """Duration, mean, root mean square around the middle, zero crossings and distinct values, from integers."""
    x = np.frombuffer(body, np.uint8).astype(np.int32) - 128
    side = x >= 0
    return (
        f"dur={seconds:.4f};mean={int(x.sum()) / len(x):.4f};rms={(int((x * x).sum(dtype=np.int64)) / len(x)) ** 0.5:.4f};"
        f"zc={int((side[1:] != side[:-1]).sum())};levels={int((np.bincount(x + 128, minlength=256) > 0).sum())}"
    )


def encode_media(docs: DataFrame, *, block: int = BLOCK, rate: int = RATE) -> DataFrame:
    """doc_id, n_bytes and the Ogg file of each text's bytes, padded with zeros to a positive multiple of ``block``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raws = [(t or "").encode() for t in part.column(1).to_pylist()]
                media = [mux(r.ljust(max(block, -(-len(r) // block) * block), b"\0"), rate) for r in raws]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, raws), pa.int64()), pa.array(media, pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """``media`` (doc_id, n_bytes, media) with the samples of every verified file (``payload``), its rate, the second at
    which each packet ends and the features."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [samples(raw) for raw in part.column(2).to_pylist()]
                columns = [
                    pa.array([x.body for x in found], pa.binary()),
                    pa.array([x.rate for x in found], pa.int32()),
                    pa.array([x.times for x in found], pa.list_(pa.float64())),
                    pa.array([feature(x.body, x.times[-1]) for x in found], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *columns], ["doc_id", "n_bytes", "media", "payload", "rate", "packet_ends", "feature"]
                )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        decode,
        "doc_id long, n_bytes long, media binary, payload binary, rate int, packet_ends array<double>, feature string",
    )


def media_column(docs: DataFrame) -> DataFrame:
    """Store every text as Ogg in the shared folder, then read the stored files back."""
    return decode_media(store.materialize(encode_media(docs), "ogg-media"))
