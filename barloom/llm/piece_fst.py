"""SentencePiece encoding and decoding by a weighted finite-state transducer.

``compile_model`` reads a model file and compiles three machines: the normaliser (the file's character map, extra spaces,
the space mark, the mark before a text), a trie with an arc for each piece, and for each character without a piece the
arcs of its bytes. A segment of text is composed with the trie lazily: from each place that a path reaches, the trie is
walked forward and ends where no piece goes on. The shortest path in the tropical semiring gives the ids.

In a unigram model arcs weigh the pieces' costs. A BPE model merges by priority, which no weight on pieces can say: there
a state also remembers its last piece, and an arc whose piece merging would not leave beside it weighs infinity. One path
of finite weight is left then to each place, the one that merging gives, so a place once reached needs no other arc.

Text is cut where no piece holds the characters on both sides, so segments are independent; their ids are remembered in
a bounded memory. Null and empty texts have no ids; repeated rows are encoded one by one; very long texts are encoded
whole, segment by segment; other columns of the input are ignored, whatever their names; an empty table gives no row.
Of arcs into a place at equal cost, the longest stays. Costs are summed in eight bytes from a segment's start; the library
sums four-byte ones over a whole text, so unigram costs that differ by less than its rounding may fall the other way.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MARK = "▁"
MEMO_WORDS = 450_000
#: Rows handed on at once.
SLICE = 250
TAIL = ".,;:!?#$%&*|<>"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Code points, which follow the pieces where codes name either.
_POINTS = 0x110000
_INFINITE = float("inf")
#: Fixed value: what an unknown character costs beyond the dearest piece of a unigram model.
UNKNOWN_PENALTY = 10.0


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield tag >> 3, raw[at : at + size]
            at += size
        else:
            size = varint()
            yield tag >> 3, raw[at : at + size]
            at += size


class _Memo(dict):
    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, key):
        found = self[key] = self.learn(key)
        return found


def character_map(blob: bytes) -> dict[str, str]:
    """The replacements of a model's compiled character map: a double-array trie of UTF-8 keys, whose values are places
    in a list of zero-ended strings."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units, strings = np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :]
    named, labels = units & np.uint32(0x800000FF), np.arange(256)
    units = units.tolist()

    def children(at: int) -> int:
        return at ^ ((units[at] >> 10) << ((units[at] & 512) >> 6))

    found, open_ = {}, [(children(0), b"")]
    while open_:
        base, key = open_.pop()
        near = base ^ labels
        near = np.where(near < len(units), near, 0)
        for label in np.flatnonzero((named[near] == labels) & (near > 0)).tolist():
            at = base ^ label
            if units[at] & 256:  # a key ends here
                start = units[children(at)] & 0x7FFFFFFF
                found[(key + bytes([label])).decode()] = strings[start : strings.index(0, start)].decode()
            open_.append((children(at), key + bytes([label])))
    return found


class Normaliser:
    """A model's normaliser: character map, extra spaces, the mark before a text and for spaces."""

    def __init__(self, spec: dict, user: list[str]):
        self.rules = character_map(spec.get(2, b""))
        self.longest = max(map(len, self.rules), default=0)
        self.prefix, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.mark = MARK if self.escape else " "
        self.user = re.compile("(" + "|".join(map(re.escape, sorted(user, key=len, reverse=True))) + ")") if user else None
        firsts = "".join(sorted({k[0] for k in self.rules}))
        self.first = re.compile("[" + re.escape(firsts) + "]") if firsts else None
        self.plain = not (self.rules or self.squeeze or user) and self.escape

    def _mapped(self, text: str) -> str:
        out, at = [], 0
        for hit in self.first.finditer(text) if self.first else ():
            i = hit.start()
            if i < at:
                continue
            for size in range(min(self.longest, len(text) - i), 0, -1):
                if (to := self.rules.get(text[i : i + size])) is not None:
                    out += (text[at:i], to)
                    at = i + size
                    break
        return "".join(out) + text[at:]

    def __call__(self, text: str) -> str:
        if self.user:  # user-defined symbols stay as they are
            text = "".join(x if n % 2 else self._mapped(x) for n, x in enumerate(self.user.split(text)))
        else:
            text = self._mapped(text)
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        text = (" " if self.prefix else "") + text
        text = text.replace(" ", self.mark)
        return text.rstrip(self.mark) if self.squeeze else text


class Model:
    """What a model file says; ``decode`` needs no more."""

    def __init__(self, raw: bytes):
        self.pieces, self.kind, spec = [], UNIGRAM, {}
        for number, value in _fields(raw):
            if number == 1:
                p = dict(_fields(value))
                score = struct.unpack("<f", p[2])[0] if 2 in p else 0.0
                self.pieces.append((p[1].decode(), score, p.get(3, NORMAL)))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
        self.normalise = Normaliser(spec, [p for p, _, k in self.pieces if k == USER])
        self.mark, self.prefix = self.normalise.mark, self.normalise.prefix
        self.table = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN
            else p.replace(self.mark, " ").encode()
            for p, _, k in self.pieces
        ]

    def decode(self, ids: np.ndarray) -> str:
        found = list(map(self.table.__getitem__, ids.tolist()))
        if self.normalise.squeeze:  # spaces before the text go; those around an unknown piece are its own
            for n, piece in enumerate(ids):
                found[n] = found[n] if self.pieces[piece][2] == UNKNOWN else found[n].lstrip(b" ")
                if found[n]:
                    break
            return b"".join(found).decode("utf-8", "replace")
        text = b"".join(found).decode("utf-8", "replace")
        return text.removeprefix(" ") if self.prefix else text


class Transducer(Model):
    def __init__(self, raw: bytes):
        super().__init__(raw)
        pieces, kind = self.pieces, self.kind
        if kind not in (UNIGRAM, BPE) or kind == BPE and any(k == UNUSED for _, _, k in pieces):
            raise ValueError("a unigram model, or a BPE model without unused pieces, is needed")
        #: ids take two bytes where the model has no more pieces than these can tell apart, else four
        self.letter = "H" if len(pieces) <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.letter == "H" else "<u4")
        #: codes of characters without a piece start here
        self.bare = max(1 << 16, len(pieces))
        self.codes = self.bare + _POINTS
        self.bpe = kind == BPE
        user = [p for p, _, k in pieces if k == USER]
        self.names = [p for p, _, _ in pieces]
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER)}
        self.scores = {p: s for p, s, k in pieces if k == NORMAL}
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), 0)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.longest = max(map(len, self.ids), default=1)
        self.inside = {p[n : n + 2] for p in self.ids for n in range(len(p) - 1)}
        self.word_starts = not any(b[1] == self.mark and b[0] != self.mark for b in self.inside)
        self.derived = _Memo(lambda code: self._derive(self._name(code)))
        self.pairs = _Memo(self._may_follow)
        costs = [-s for s in self.scores.values()] or [0.0]
        self.bare_cost = 1.0 if self.bpe else max(costs) + UNKNOWN_PENALTY
        self.costs = [1.0 if self.bpe else -s for _, s, _ in pieces]
        if not self.bpe:  # always the cheapest way over these characters
            for p in user:
                self.costs[self.ids[p]] = len(p.encode()) * min(costs) + 0.1
        #: a node is (children by character, id of the piece that ends here or -1)
        self.trie: tuple[dict, int] = ({}, -1)
        self._compile()
        self.segments = _Memo(self._shortest)
        self.words = _Memo(self._word)
        self.runs = _Memo(self._cut)

    def _compile(self) -> None:
        """The trie of the pieces that arcs may have: in a BPE model those that merging makes of their own characters."""
        for piece, number in self.ids.items():
            if piece and (not self.bpe or piece in self.scores and self.derived[number] is not None):
                node = self.trie
                for ch in piece[:-1]:
                    node = node[0].setdefault(ch, ({}, -1))
                node[0][piece[-1]] = (node[0].get(piece[-1], ({}, -1))[0], number)

    # pieces that may stand beside each other ---------------------------------------------------------------------

    def _name(self, code: int) -> str:
        return self.names[code] if code < self.bare else chr(code - self.bare)

    def _merges(self, text: str) -> tuple[list[str], list[tuple[float, str, str]]]:
        """The symbols that merging leaves, and after each merge its score and the first and last symbol then."""
        symbols, steps = list(text), []
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                score = self.scores.get(symbols[i] + symbols[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return symbols, steps
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            steps.append((best, symbols[0], symbols[-1]))

    def _derive(self, piece: str) -> list[tuple[float, str, str]] | None:
        """How merging makes the piece; None if it makes something else of these characters."""
        symbols, steps = self._merges(piece)
        return steps if len(symbols) == 1 else None

    def _may_follow(self, pair: int) -> bool:
        """Whether merging both pieces' characters never joins the two: at each moment the best merge goes first, the
        leftmost of equals."""
        a, b = divmod(pair, self.codes)
        left, right = self.derived[a], self.derived[b]
        i = j = 0
        last, first = self._name(a)[-1], self._name(b)[0]
        while True:
            across = self.scores.get(last + first)
            a = left[i][0] if i < len(left) else None
            b = right[j][0] if j < len(right) else None
            if across is not None and (a is None or across > a) and (b is None or across >= b):
                return False
            if a is None and b is None:
                return True
            if b is None or a is not None and a >= b:
                last = left[i][2]
                i += 1
            else:
                first = right[j][1]
                j += 1

    # composition and shortest path -------------------------------------------------------------------------------

    def _shortest(self, text: str) -> bytes:
        """Ids of the shortest path through the composition of a segment with the trie, place after place."""
        root, costs, pairs, bpe, longest = self.trie[0], self.costs, self.pairs, self.bpe, self.longest
        bare, codes = self.bare, self.codes
        n = len(text)
        cost, last, since = [0.0] + [_INFINITE] * n, [-1] * (n + 1), [0] * (n + 1)
        for at, base in enumerate(cost):
            if base == _INFINITE or at == n:
                continue
            state = last[at] * codes
            children, end, alone = root, at, True
            for ch in text[at : at + longest]:
                if ch not in children:
                    break
                children, piece = children[ch]
                end += 1
                if piece < 0:
                    continue
                alone = alone and end > at + 1
                if bpe and (last[end] >= 0 or at and not pairs[state + piece]):
                    continue
                if base + costs[piece] < cost[end]:
                    cost[end], last[end], since[end] = base + costs[piece], piece, at
            if alone:  # a character that is no piece
                piece, end = bare + ord(text[at]), at + 1
                if bpe and (last[end] >= 0 or at and not pairs[state + piece]):
                    continue
                if base + self.bare_cost < cost[end]:
                    cost[end], last[end], since[end] = base + self.bare_cost, piece, at
        path, end = [], n
        while end:
            path.append(last[end])
            end = since[end]
        path.reverse()
        if max(path) >= bare:
            path = [i for code in path for i in self._ids_of(code)]
        return struct.pack(f"<{len(path)}{self.letter}", *path)

    def _ids_of(self, code: int) -> list[int]:
        if code < self.bare:
            return [code]
        return [self.byte_ids[b] for b in self._name(code).encode()] if self.byte_ids else [self.unknown]

    def _cut(self, text: str) -> bytes:
        """Ids of a text whose ends are cuts, segment by segment; parts of a cut text are remembered."""
        held = list(map(self.inside.__contains__, map(add, text, text[1:])))
        if all(held):
            return self._shortest(text)
        out, a = [], 0
        for at, together in enumerate(held, 1):
            if not together:
                out.append(self.segments[text[a:at]])
                a = at
        out.append(self.segments[text[a:]])
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        """Ids of a space mark and a word; punctuation after a word leaves that word's own ids, where there is a cut."""
        core = word.rstrip(TAIL)
        if core and len(core) < len(word) and word[len(core) - 1 : len(core) + 1] not in self.inside:
            return self.words[core] + self.runs[word[len(core) :]]
        return self._cut(self.mark + word)

    def _spans(self, text: str) -> bytes:
        """Ids of normalised text, word by word where pieces never cross the start of one."""
        if not self.word_starts:
            return self._cut(text) if text else b""
        mark = re.escape(self.mark)
        return b"".join(map(self.runs.__getitem__, re.findall(f"{mark}+[^{mark}]*|^[^{mark}]+", text)))

    def encode(self, text: str) -> bytes:
        """Ids in ``dtype``."""
        if not text:
            return b""
        if len(self.words) + len(self.segments) + len(self.runs) > MEMO_WORDS:
            for memo in (self.words, self.segments, self.runs):
                memo.clear()
        if len(self.pairs) > 2 * MEMO_WORDS:
            self.pairs.clear()
        plain = self.normalise.plain and self.byte_ids and self.prefix and self.word_starts
        if plain and "  " not in text and MARK not in text and " " not in (text[0], text[-1]):
            return b"".join(map(self.words.__getitem__, text.split(" ")))
        text = self.normalise(text)
        if self.bpe and self.normalise.user:  # symbols never merge with what stands beside them
            parts = enumerate(self.normalise.user.split(text))
            found = b"".join(struct.pack(f"<{self.letter}", self.ids[x]) if n % 2 else self._spans(x) for n, x in parts)
        else:
            found = self._spans(text)
        if self.byte_ids:
            return found
        ids = np.frombuffer(found, self.dtype)  # neighbouring unknown characters are one id
        again = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return ids[np.concatenate(([True], ~again))].tobytes() if again.any() else found


_compiled: dict[tuple[str, type], Model] = {}


def compile_model(path: str, kind: type[Model] = Transducer) -> Model:
    """The worker's transducer of a model file, or what ``kind`` makes of it."""
    if (path, kind) not in _compiled:
        with open(path, "rb") as src:
            _compiled[path, kind] = kind(src.read())
    return _compiled[path, kind]


def encode_column(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, text (null as empty) and its ids (four little-endian bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compile_model(model)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [np.frombuffer(machine.encode(t), machine.dtype).astype("<u4").tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.string()), pa.array(ids, pa.binary())], ["doc_id", "text", "ids"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text string, ids binary")


def decode_column(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text that the ids give, in place of ``ids``."""
    others = [f for f in encoded.schema.fields if f.name not in ("ids", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compile_model(model, Model)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                *kept, ids = batch.slice(at, SLICE).columns
                texts = [machine.decode(np.frombuffer(raw, "<u4")) for raw in ids.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(texts, pa.string())], [*(f.name for f in others), "decoded"]
                )

    schema = StructType([*others, StructField("decoded", StringType())])
    return encoded.select(*(f.name for f in others), "ids").mapInArrow(run, schema)
