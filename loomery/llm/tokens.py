"""Whole-text token ids of the public word-end BPE, by chunk.

The tokenizer drops white space and never merges across it, so the ids of a text
are the ids of its white-space chunks in order. Chunks repeat, hence a bounded
memory of chunk ids makes most of the work a lookup. Texts with characters outside
the plain Latin range go through the tokenizer whole, so that its own
normalisation decides.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

_MEMORY = 400_000


def _latin(kinds: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] in kinds)


_LETTERS, _NUMBERS = _latin("L"), _latin("N")
#: Outside this set NFC, lower case or white space could differ between libraries.
_UNUSUAL = re.compile(r"[^\x00-\x1b\x20-\u012f\u0131-\u017e\u2010-\u2027\u2030-\u205e\u20ac]")
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    plain = {b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b <= 0xFF and b != 0xAD)}
    table, spare = {}, 0x100
    for b in range(256):
        table[b] = chr(b) if b in plain else chr(spare)
        spare += b not in plain
    return table


class WordBpe(dict):
    """Maps a lower-case chunk to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= _MEMORY:
            self.clear()
        ids = []
        for piece in _PIECES.findall(chunk):
            if not piece.isascii():
                piece = "".join(self.letters[b] for b in piece.encode())
            ids += [t.id for t in self.model.tokenize(piece)]
        out = b"".join(i.to_bytes(4, "little") for i in ids)
        if len(chunk) < 64:
            self[chunk] = out
        return out

    def ids(self, text: str) -> bytes:
        if _UNUSUAL.search(text):
            return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.__getitem__, text.lower().split()))


@cache
def word_bpe(path: str) -> WordBpe:
    """One tokenizer for each worker process."""
    return WordBpe(path)
