"""Token ids of whole texts, by the tokenizers library, with the ids of frequent words remembered.

Both supported kinds of vocabulary cut a text into pieces before merging, so the ids of a text are those of its pieces
in order. Pieces repeat; they are merged once by the library's model and then looked up. That needs the cutting rule,
which is stated here for printable ASCII and Latin-1 only: any text with another character, or with white space that the
quick cut does not cover, is encoded whole by the library.
"""

from __future__ import annotations

import json
import os.path
import re
import zlib
from array import array

import numpy as np
from tokenizers import Tokenizer

# How the two vocabularies cut a text, for the characters of _OTHER's complement.
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_BYTE_PIECE = rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+"
_WORD_PIECE = rf"'(?:[stmd]|re|ve|ll)|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+"
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-\xff]")
_GAPS = ("  ", " \n", "\n ", "\n\n", "\t", "\r")

ID = np.dtype("<u4")
CACHE_ENTRIES = 500_000


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder(dict):
    """Ids of a text as little-endian unsigned 32-bit integers, as by the library without tokens around it.

    The string of an added token in a text is that token; texts that hold one are encoded whole. As a dictionary it
    remembers the ids of words and pieces; all are forgotten when there are ``entries`` of them.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.entries = entries
        self.whole = Tokenizer.from_file(path)
        # In any case, as a vocabulary may look for them in lower-cased text.
        added = [t["content"] for t in settings.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        # What all of them start with before any letter: looked for first, as that takes next to no time.
        self.mark = re.match(r"[^\w]*", os.path.commonprefix(added))[0]
        self.letters = _byte_letters()
        self.merge = self.whole.model.tokenize
        lower = "Lowercase" in json.dumps(settings.get("normalizer"))
        byte_level = (settings.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        self.kind = "byte" if byte_level and not settings.get("normalizer") else "word" if lower else "other"
        self.pieces = re.compile(_BYTE_PIECE if self.kind == "byte" else _WORD_PIECE).findall

    def __missing__(self, word: str) -> bytes:
        pieces = self.pieces(word)
        if pieces == [word]:
            mapped = word.encode().decode("latin-1").translate(self.letters)
            ids = array("I", [token.id for token in self.merge(mapped)]).tobytes()
        else:
            ids = b"".join(map(self.__getitem__, pieces))
        if len(self) >= self.entries:
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if self.kind == "other" or _OTHER.search(text) or (self.mark in text and self.added.search(text)):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, ID).tobytes()
        if self.kind == "word":
            # No piece holds white space, so words can be encoded one by one.
            words = text.lower().split()
        elif any(gap in text for gap in _GAPS):
            words = self.pieces(text)
        else:
            # White space is single here: a space opens the next piece, a line end is a piece of its own.
            words = text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        return b"".join(map(self.__getitem__, words))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def crc32(ids: bytes | np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids if isinstance(ids, bytes) else ids.astype(ID, copy=False).tobytes())
