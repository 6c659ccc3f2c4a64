"""Operators that write files: token shards, Ogg media, WARC archives."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from barloom.llm import ogg, store, tokens, warc, wavelet
from barloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, start long, part int"
ODD = [
    "", "\x7f", " \x7f a", "a\n b", "a  b", "  a  b \n", "x\x1cy z", "can't  won't\n\n\nx", "　a b c d",
    "é é ΣΣ b", "<|endoftext|> a", "a <|endoftext|> b", "x<|startoftext|>y", "< |endoftext| >", "a\u0085 b", "ab​ cd", "\n", "A1b2. ABC,  x²y", "I'm a<b>|c", "İstanbul ﬁ É",
]


def odd_docs(spark):
    rows = [(i * 3 - 5, t, "en", "s", 1, 7, 8) for i, t in enumerate(ODD)]
    rows += [(4, None, None, None, None, None, None), (4, "b a", "en", "s", 3, 1, 1), (4, "b a", "en", "s", 3, 1, 1)]
    rows += [(None, "nobody", "en", "s", 1, 1, 1), (9999, "Long words here. " * 40_000, "en", "s", 1, 1, 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def expected_tokens(docs, vocabulary):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    rows = sorted(
        ((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""),
    )
    at, out = 0, []
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("as_text", [False, True])
@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_words_give_the_ids_of_whole_texts(name, kind, as_text):
    import random

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = as_text
    e = tokens.WordEncoder(public_tokenizers.path(name), kind, as_text)
    rng = random.Random(4)
    parts = [*"abcXYZéΣİ²１٣'’-_.,;:!?#$%&*|<>09 \n\t　​́ﬁß", "  ", "<|endoftext|>", "'s", " the", " don't", "and"]
    texts = ODD + ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(3000)]
    for text, found in zip(texts, e.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(found, e.dtype).tolist() == want, text


def test_shards_of_odd_documents(spark):
    docs, path = odd_docs(spark), public_tokenizers.path("byte_bpe_50k.json")
    got = wavelet.wavelet_tokens(docs, path, shard_tokens=50)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    rows = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect()), key=key)
    assert rows == sorted(expected_tokens(docs, path), key=key)


def test_shards_of_no_documents(spark):
    docs = spark.createDataFrame([], DOCS)
    assert wavelet.wavelet_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).collect() == []


@pytest.mark.parametrize("n,size", [(3000, 50257), (1 << 16, 50257), (700, 300), (5000, 1 << 17), (512, 2)])
def test_shard_answers(n, size):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n).astype(np.uint64) % size).astype("<u2" if size <= 1 << 16 else "<u4")
    cut = n // 3
    shard = wavelet.Shard(wavelet.shard_bytes([3, None], [ids[:cut].tobytes(), ids[cut:].tobytes()], size)[0])
    assert (shard.decode() == ids).all()
    for i in (0, 17, cut, n // 2 + 1, n - 1):
        assert shard.access(i) == ids[i]
    for token in {0, 1, 2, int(ids[50]), int(ids[-1]), size - 1}:
        where = np.flatnonzero(ids == token).tolist()
        assert shard.count(token) == len(where)
        for a, b in ((0, n), (0, n // 2), (100, 500), (cut, cut)):
            assert shard.count(token, a, b) == sum(a <= x < b for x in where)
            assert shard.rank(token, b) == sum(x < b for x in where)
        assert [x for part in shard.occurrences(token) for x in part.tolist()] == where
        assert shard.select(token, len(where)) == -1
        assert [shard.select(token, k) for k in range(min(5, len(where)))] == where[:5]


def test_tokens_are_counted_and_found_in_all_shards(spark):
    docs, path = odd_docs(spark), public_tokenizers.path("byte_bpe_50k.json")
    manifest = wavelet.write_shards(docs, store.new_folder(spark, "t"), path, shard_tokens=500)
    started = wavelet.with_starts(manifest)
    ids = {r.start: (r.doc_id, r.ids) for r in wavelet.read_shards(started, with_ids=True).collect()}
    for token in (0, 257, 50256, 60000):
        places = {(d, a, i) for a, (d, x) in ids.items() for i, v in enumerate(x) if v == token}
        assert {(r.doc_id, r.start, r.position) for r in wavelet.find_token(started, token).collect()} == places
        counted = {(r.doc_id, r.start): r.n for r in wavelet.count_token(started, token).collect()}
        assert counted == {(d, a): x.count(token) for a, (d, x) in ids.items() if token in x}


def test_op1_on_documents(spark):
    got = QUERIES["op1_wavelet_tokens"](spark, SF)
    rows = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got.collect())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows == expected_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


def crc_by_bits(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg_checksum():
    for data in (b"", b"OggS", bytes(range(256)) * 3):
        assert ogg.page_crc(data) == crc_by_bits(data)


@pytest.mark.parametrize("size", [64, 4096, 65024, 65280, 69632, 200_000])
def test_ogg_round_trip(size):
    payload = np.random.default_rng(size).integers(0, 256, size, np.uint8).tobytes()
    raw = ogg.mux(payload)
    read = ogg.samples(raw)
    assert (read.body, read.rate) == (payload, ogg.RATE)
    ends = [*range(ogg.PACKET, size, ogg.PACKET), size]
    assert read.times == [x / ogg.RATE for x in ends]
    assert len(ogg.demux(raw)) == 2
    for at in (30, len(raw) // 2, len(raw) - 1):
        with pytest.raises(ogg.OggError):
            ogg.samples(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :])
    with pytest.raises(ogg.OggError):
        ogg.samples(raw[: len(raw) // 2])


def feature_of(payload):
    x = np.frombuffer(payload, np.uint8).astype(float) - 128
    crossings = int(np.sum((x[1:] >= 0) != (x[:-1] >= 0)))
    return (
        f"dur={len(x) / 8000:.4f};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};zc={crossings};"
        f"levels={len(set(x.tolist()))}"
    )


def test_op5_on_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op5_ogg_media"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    media = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) == (
            len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), feature_of(payload),
        )
        assert media.setdefault(payload, (r.media_bytes, r.media_sha256)) == (r.media_bytes, r.media_sha256)


def test_media_of_odd_documents(spark):
    docs = odd_docs(spark)
    texts = docs.select("doc_id", "text").collect()
    got = ogg.media_column(docs.selectExpr("*", "1 media", "2 payload")).collect()
    want = []
    for doc_id, text in texts:
        raw = (text or "").encode()
        want.append((str(doc_id), len(raw), raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))))
    assert sorted((str(r.doc_id), r.n_bytes, bytes(r.payload)) for r in got) == sorted(want)
    assert all(r.packet_ends[-1] == len(r.payload) / r.rate for r in got)
    assert ogg.media_column(docs.limit(0)).collect() == []


def expected_pages(rows):
    first = {}
    for page_id, html in rows:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    out = []
    for page_id, html in rows:
        raw = (html or "").encode()
        refers = first.get(html or "")
        refers = None if refers == page_id else refers
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((page_id, len(raw), digest, "revisit" if refers is not None else "response", refers))
    return out


def test_archives_of_odd_pages(spark):
    rows = [(7, "a", "same"), (3, "b\nc", "same"), (9, None, "same"), (1, "x", None), (2, "y", ""), (5, "z", "é" * 99)]
    rows += [(3, "b", "same"), (None, "n", "same"), (11, "big", "<p>word</p>" * 30_000)]
    rows += [(100 + i, f"u{i}", f"<html><body>page {i % 40} of many</body></html>") for i in range(300)]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    found = warc.archive(pages.selectExpr("*", "1 payload", "2 refers_to")).collect()
    texts = {r[0]: r[2] for r in rows if r[0] != 3}
    for r in found:
        assert r.payload is None if r.record_type == "revisit" else r.page_id == 3 or bytes(r.payload) == (texts[r.page_id] or "").encode()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(expected_pages([(r[0], r[2]) for r in rows]), key=key)
    assert warc.archive(pages.limit(0)).collect() == []


def test_archive_files_are_split_and_hold_their_dictionary(spark):
    pages = spark.range(3000).selectExpr(
        "id page_id", "concat('http://a/', id) url", "concat('<html>', repeat(uuid(), 5), id, '</html>') html"
    )
    marked = store.materialize(warc.mark_revisits(pages), "t")
    folder = store.new_folder(spark, "t")
    manifest = warc.write_archives(marked.coalesce(1), folder, file_bytes=100_000).collect()
    assert len(manifest) > 1 and sum(r.n_records for r in manifest) == 3000
    raw = store.get_file(manifest[0].path)
    assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_MAGIC
    assert len(list(warc.records(raw))) == manifest[0].n_records


@pytest.mark.parametrize("held", [[b"one short record"], [b"WARC/1.1 same"] * 50, [bytes([i]) * 400 for i in range(5)]])
def test_few_or_equal_records_have_a_dictionary(held):
    import zstandard

    dictionary = warc.train(held)
    assert dictionary
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).compress
    raw = warc.DICTIONARY_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary
    assert list(warc.records(raw + b"".join(map(pack, held)))) == held


def test_op10_on_pages(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op10_warc_archive"](spark, SF).collect())) == sorted(expected_pages(rows))
