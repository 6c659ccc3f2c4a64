"""Whole texts to token ids with the ``tokenizers`` library, remembering the ids of each word.

A word is a piece of text between two places at which the tokenizer splits in any context, so the ids of a text are
those of its words one after another. The memory is per worker process and bounded. Ids are those of the library's own
call ``encode(text, add_special_tokens=False)``: the string of an added token in a text gives that token's id, and such
texts go through the library whole. ``special_as_text`` treats those strings as ordinary text instead.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable

import numpy as np

MEMO_WORDS = 1_200_000

#: A byte-level pre-token never holds white space after something else; the class on the left is wider than any
#: tokenizer's white space, the one on the right narrower.
_CUT = re.compile(r"(?<=\S)(?=[ \t-\r])")
#: A text without these has only single spaces and line feeds between its words.
_ODD_SPACE = ["  ", "\n\n", " \n", "\n ", *map(chr, [9, 11, 12, 13, *range(28, 32)])]
_ODD_SPACE_WIDE = [*map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
#: Punctuation after letters: a pre-token of its own in byte-level patterns.
_TAIL = ".,;:!?#$%&*|<>"


def _byte_chars() -> dict[int, int]:
    """Byte to the printable character that stands for it in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(printable))
    return {b: b for b in printable} | {b: 256 + n for n, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()
_SPACE_CHAR = chr(_BYTE_CHARS[32])


class _Memo(dict):
    def __init__(self, learn: Callable):
        super().__init__()
        self.learn = learn

    def __missing__(self, word):
        found = self[word] = self.learn(word)
        return found


class WordEncoder:
    """``kind``: ``byte`` for byte-level vocabularies that keep white space, ``word`` for those that drop it.

    ``dtype`` is the little-endian integer in which ids are given: two bytes, or four where the vocabulary needs them.
    """

    def __init__(self, path: str, kind: str, special_as_text: bool = False, memo_words: int = MEMO_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if kind not in ("byte", "word"):
            raise ValueError(kind)
        self.memo_words = memo_words
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added if not (special_as_text and t.special)]
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._plain = sys.byteorder == "little" and array(self._code).itemsize == self.dtype.itemsize
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # words are remembered here
        self.encode_one = self._byte if kind == "byte" else self._word
        self.letters = _Memo(self._learn_letters)
        self.tails = _Memo(self._full)
        self.whole = _Memo(self._learn_byte if kind == "byte" else self._learn_word)
        self.spaced = _Memo(self._learn_spaced)

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text, in ``dtype``."""
        out = []
        for text in texts:
            if len(self.whole) + len(self.spaced) + len(self.letters) > self.memo_words:
                for memo in (self.whole, self.spaced, self.letters):
                    memo.clear()
            if len(self.tails) > 10_000:
                self.tails.clear()
            out.append(self._full(text) if any(x in text for x in self.added) else self.encode_one(text))
        return out

    def _byte(self, text: str) -> bytes:
        if any(x in text for x in _ODD_SPACE) or not text.isascii() and any(x in text for x in _ODD_SPACE_WIDE):
            return b"".join(map(self.whole.__getitem__, _CUT.split(text)))
        parts = []
        for n, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            parts.append(self.whole["\n" + first if n else first])
            parts += map(self.spaced.__getitem__, rest)
        return b"".join(parts)

    def _word(self, text: str) -> bytes:
        return b"".join(map(self.whole.__getitem__, text.encode().split()))

    def _pack(self, ids: Iterable[int]) -> bytes:
        return array(self._code, ids).tobytes() if self._plain else np.array(ids, self.dtype).tobytes()

    def _full(self, text: str) -> bytes:
        return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids) if text else b""

    def _learn_letters(self, chars: str) -> bytes:
        """One pre-token, its bytes as characters, goes straight to the model."""
        return self._pack([t.id for t in self.model.tokenize(chars)])

    def _chars(self, word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS)

    def _learn_spaced(self, word: str) -> bytes:
        core = word.rstrip(_TAIL)
        if not core.isalpha():
            return self._full(" " + word)
        found = self.letters[_SPACE_CHAR + self._chars(core)]
        return found + self.tails[word[len(core) :]] if len(core) < len(word) else found

    def _learn_byte(self, word: str) -> bytes:
        if word[:1] == " ":
            return self._learn_spaced(word[1:])
        first = word[:1] if word[:1] == "\n" else ""
        core = word[len(first) :].rstrip(_TAIL)
        if not core.isalpha():
            return self._full(word)
        return self.tails[first] + self.letters[self._chars(core)] + self.tails[word[len(first) + len(core) :]]

    def _learn_word(self, raw: bytes) -> bytes:
        word = raw.decode()
        core = word.rstrip(_TAIL)
        if not core.isalpha():
            return self._full(word)
        letters = core.lower() if core.isascii() else self.tokenizer.normalizer.normalize_str(core)
        if not letters.isalpha():
            return self._full(word)
        found = self.letters[self._chars(letters)]
        return found + self.tails[word[len(core) :]] if len(core) < len(word) else found


_encoders: dict[tuple, WordEncoder] = {}


def encoder(path: str, kind: str, special_as_text: bool = False, memo_words: int = MEMO_WORDS) -> WordEncoder:
    """The worker's encoder of a vocabulary file."""
    key = path, kind, special_as_text, memo_words
    if key not in _encoders:
        _encoders[key] = WordEncoder(*key)
    return _encoders[key]
