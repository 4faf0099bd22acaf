"""Token ids of whole texts by a public BPE vocabulary, with a bounded cache of white-space chunks.

The vocabulary's pre-tokeniser never joins characters across white space, so a text's ids are the
ids of its chunks in order. Chunks of plain letters go to the BPE model directly; anything unusual
(control separators, special-token strings, combining or rare characters) goes through the full
tokenizer, so the ids always equal those of ``Tokenizer.encode``.
"""

from __future__ import annotations

import unicodedata
from array import array

import numpy as np
import regex
from tokenizers import Tokenizer

from assayer.llm._work import CACHES

_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_ODD = regex.compile(r"[\x1c-\x1f]")
_PLAIN = regex.compile(r"[!-įı-ɏ]+")
_coders: dict[str, "WordCoder"] = CACHES.setdefault("coder", {})


def _byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, others follow at 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Cache(dict):
    def __init__(self, make):
        self.make = make

    def __missing__(self, chunk: str) -> bytes:
        ids = self.make(chunk)
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids


class WordCoder:
    """Encodes texts as 16- or 32-bit little-endian ids (``dtype``)."""

    MAX_CACHED = 1_000_000

    def __init__(self, path: str):
        self.full = Tokenizer.from_file(path)
        self.model = self.full.model
        self.dtype = np.dtype("<u2" if self.full.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.letters = _byte_letters()
        self.chunks, self.words = _Cache(self._chunk), _Cache(self._word)

    @classmethod
    def load(cls, path: str) -> "WordCoder":
        if path not in _coders:
            _coders[path] = cls(path)
        return _coders[path]

    def _pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _word(self, word: str) -> bytes:
        mapped = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return self._pack([t.id for t in self.model.tokenize(mapped)])

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():
            if chunk.isascii() or _PLAIN.fullmatch(chunk):  # one word of composed letters
                low = chunk.lower()
                return self._word(low) if low == chunk else self.chunks[low]
        elif chunk[-1] in ".,;:!?" and chunk[:-1].isalpha() and (chunk.isascii() or _PLAIN.fullmatch(chunk)):
            return self.chunks[chunk[:-1]] + self.words[chunk[-1]]
        if not _PLAIN.fullmatch(chunk) or "<|" in chunk or "­" in chunk or "\x7f" in chunk:
            return self._pack(self.full.encode(chunk, add_special_tokens=False).ids)
        low = unicodedata.normalize("NFC", chunk).lower()
        return b"".join(map(self.words.__getitem__, _PIECES.findall(low)))

    def encode(self, text: str) -> bytes:
        if _ODD.search(text):
            return self._pack(self.full.encode(text, add_special_tokens=False).ids)
        for cache in (self.chunks, self.words):
            if len(cache) > self.MAX_CACHED:
                cache.clear()
        return b"".join(map(self.chunks.__getitem__, text.split()))
