"""Conversations as token sequences with a loss mask, put together from tokens.

A turn is ``<|im_start|>role<|im_sep|>text<|im_end|>``. Role and text are encoded apart, as ordinary text whatever they
hold; the three marks are ids beyond the vocabulary, spliced between. The mask is the prefix sum of +1 where the text of a
trained role starts and -1 where it ends. A mark, or the start of any ``<|...|>``, inside a role or a text gets a backslash
after its ``<`` (one more where some stand there), so the output as text is unambiguous too and unescaping restores it.

Turns are encoded where they are read and dealt by ranges of (conversation, turn), so that a long conversation spreads over
tasks; each task writes chunks of whole turns. A conversation is its chunks in order.

Null texts and roles count as empty; a null ``conv_id`` is a conversation of its own that comes first, null turns come
first in theirs; rows that repeat a turn stay, in order of role and text; a very long text is one turn of one chunk; other
columns of the input are ignored, whatever their names; an empty table gives no chunk and no conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, tokens

MARKS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
TRAINED = ("assistant",)
#: Tokens of a chunk at most, unless one turn has more.
CHUNK_TOKENS = 1 << 16
MEMO_WORDS = 300_000

_TURN = "conv_id long, turn long, role string, text string, ids binary, n_tokens long, loss_from long"
_CHUNK = "conv_id long, part int, seq long, edge boolean, n_turns long, ids binary, mask binary"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """``text`` without any ``<|``: a backslash more in each ``<|``, ``<\\|`` and so on."""
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def marks_of(vocabulary: str) -> tuple[int, int, int]:
    """The ids of the three marks: the first that the vocabulary does not use."""
    size = tokens.encoder(vocabulary, "byte", True, MEMO_WORDS).size
    return size, size + 1, size + 2


def encode_turns(turns: DataFrame, vocabulary: str, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """Each turn with its ids (4 bytes each), how many, and where the text starts if it is trained on, else -1."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary, "byte", True, MEMO_WORDS)
        start, sep, end = (np.array([x], "<u4").tobytes() for x in marks_of(vocabulary))
        wide = lambda raw: np.frombuffer(raw, encoder.dtype).astype("<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                roles, texts = (part.column(k).to_pylist() for k in (2, 3))
                heads = map(wide, encoder.encode(map(escape, roles)))
                bodies = map(wide, encoder.encode(map(escape, texts)))
                ids, sizes, froms = [], [], []
                for role, head, body in zip(roles, heads, bodies, strict=True):
                    ids.append(start + head + sep + body + end)
                    sizes.append(len(ids[-1]) // 4)
                    froms.append(2 + len(head) // 4 if role in trained else -1)
                made = [pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(froms, pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [c.split()[0] for c in _TURN.split(", ")])

    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"))
    return rows.mapInArrow(encode, _TURN)


def loss_mask(sizes: list[int], froms: list[int]) -> np.ndarray:
    """A byte a token of turns in order: 1 from where a trained text starts up to its end mark."""
    ends = np.cumsum(sizes)
    steps = np.zeros(int(ends[-1]) + 1, np.int8)
    for end, size, start in zip(ends.tolist(), sizes, froms, strict=True):
        if start >= 0:
            steps[end - size + start] += 1
            steps[end - 1] -= 1
    return np.cumsum(steps[:-1], dtype=np.int8).astype(np.uint8)


def assemble(turns: DataFrame, vocabulary: str, *, trained: tuple[str, ...] = TRAINED, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """The formatted conversations, written to the shared folder as chunks (conv_id, part, seq, edge, n_turns, ids, mask): ids
    take 4 bytes a token, the mask one. Chunks of a conversation follow each other by (part, seq); one that is not on an
    ``edge`` is a conversation's only one."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, opening, again, key, held = 0, True, False, None, []

        def chunk(edge: bool) -> pa.RecordBatch:
            ids, sizes, froms, parts = zip(*held, strict=True)
            row = [key], [parts[0]], [seq], [edge], [len(held)], [b"".join(ids)], [loss_mask(sizes, froms).tobytes()]
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], [c.split()[0] for c in _CHUNK.split(", ")])

        size = 0
        for batch in batches:
            for conv_id, *turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and conv_id != key:
                    yield chunk(opening or again)
                    seq, opening, again, held, size = seq + 1, False, False, [], 0
                elif held and size + turn[1] > chunk_tokens:
                    yield chunk(True)
                    seq, again, held, size = seq + 1, True, [], 0
                key = conv_id
                held.append(turn)
                size += turn[1]
        if held:
            yield chunk(True)

    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    encoded = store.materialize(encode_turns(turns, vocabulary, trained), "turns")
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = encoded.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = dealt.select("conv_id", "ids", "n_tokens", "loss_from", F.spark_partition_id().alias("part"))
    return store.materialize(rows.mapInArrow(chunks, _CHUNK), "chat")


def byte_table(vocabulary: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    encoder = tokens.encoder(vocabulary, "byte", True, MEMO_WORDS)
    of_char = {chr(c): b for b, c in tokens._BYTE_CHARS.items()}
    out = [b""] * encoder.size
    for token, i in encoder.tokenizer.get_vocab(with_added_tokens=False).items():
        out[i] = bytes(map(of_char.__getitem__, token)) if all(c in of_char for c in token) else token.encode()
    return out


def turns_of(ids: np.ndarray, mask: np.ndarray, table: list[bytes], marks: tuple[int, int, int]) -> list[tuple[str, str, str]]:
    """(role, text, text under the mask), as in the input, of each turn of a chunk."""
    start, sep, end = (np.flatnonzero(ids == m).tolist() for m in marks)
    out = []
    for a, b, c in zip(start, sep, end, strict=True):
        text = lambda at: unescape(b"".join(map(table.__getitem__, at.tolist())).decode())
        inside = mask[b + 1 : c].astype(bool)
        if mask[a : b + 1].any() or mask[c]:
            raise ValueError("a mark is trained on")
        out.append((text(ids[a + 1 : b]), text(ids[b + 1 : c]), text(ids[b + 1 : c][inside])))
    return out


def read_turns(chunks: DataFrame, vocabulary: str) -> DataFrame:
    """(conv_id, part, seq, n, role, text, trained) of each turn in the chunks; ``n`` is its place in its chunk."""
    schema = "conv_id long, part int, seq long, edge boolean, n long, role string, text string, trained string"
    # as large as the vocabulary; workers that only read need no tokenizer
    sent = chunks.sparkSession.sparkContext.broadcast((byte_table(vocabulary), marks_of(vocabulary)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, marks = sent.value
        for batch in batches:
            for conv_id, part, seq, edge, ids, mask in zip(*batch.columns, strict=True):
                found = turns_of(np.frombuffer(ids.as_py(), "<u4"), np.frombuffer(mask.as_py(), "u1"), table, marks)
                head = [pa.array([x.as_py()] * len(found), k) for x, k in ((conv_id, pa.int64()), (part, pa.int32()), (seq, pa.int64()), (edge, pa.bool_()))]
                columns = [*head, pa.array(range(len(found)), pa.int64()), *(pa.array(c, pa.string()) for c in zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return chunks.select("conv_id", "part", "seq", "edge", "ids", "mask").mapInArrow(read, schema)


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(turns: DataFrame) -> DataFrame:
    """One row a conversation of ``read_turns``: turns, digest of role and text lines, code points and digest of what is trained
    on, code points of the output as text. Conversations inside one chunk are digested where they lie; turns of the others
    are sorted and digested as a stream, since a digest has an order, so that none is ever held whole."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = sum(map(len, MARKS))
        done: list[tuple] = []
        key, state = None, None

        def close() -> tuple:
            n, lines, chars, trained, length = state
            return key, n, lines.hexdigest(), chars, trained.hexdigest(), length

        def out() -> pa.RecordBatch:
            kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], [c.split()[0] for c in _DIGESTS.split(", ")])

        for batch in batches:
            for conv_id, role, text, trained in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv_id != key:
                    if state is not None:
                        done.append(close())
                    key, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(trained)
                state[3].update(trained.encode())
                state[4] += marked + len(escape(role)) + len(escape(text))
            if done:
                yield out()
                done = []
        if state is not None:
            done.append(close())
            yield out()

    columns = ["conv_id", "role", "text", "trained"]
    whole = turns.where("not edge").select(*columns).mapInArrow(digest, _DIGESTS)
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = turns.where("edge").repartition(n, "conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "part", "seq", "n")
    return whole.union(spread.select(*columns).mapInArrow(digest, _DIGESTS))


def format_conversations(turns: DataFrame, vocabulary: str, *, trained: tuple[str, ...] = TRAINED, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """The turns as read back from the written chunks; see ``read_turns``."""
    return read_turns(assemble(turns, vocabulary, trained=trained, chunk_tokens=chunk_tokens), vocabulary)
