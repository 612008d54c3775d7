"""A wavelet matrix over token ids: bit planes with rank support, packed into one compressed block of bytes.

Ids are first replaced by their rank among the ids that occur, so there are only as many planes as those need. Plane 0
holds the highest bit of every id in text order; each further plane is ordered by the bit before it, zeros first, order
kept within. Counting ones up to a position then leads from plane to plane.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_HEAD = struct.Struct("<4sQIB")
_MAGIC = b"WVM1"
_WORD = 64


class WaveletMatrix:
    """access, count and occurrences without decoding; ``decode`` gives all ids back."""

    def __init__(self, alphabet: np.ndarray, planes: np.ndarray, zeros: np.ndarray, size: int) -> None:
        self.alphabet, self.planes, self.zeros, self.size = alphabet, planes, zeros, size
        self._ranks: np.ndarray | None = None

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        ids = np.ascontiguousarray(ids, np.uint32)
        present = np.zeros(int(ids.max()) + 1 if ids.size else 0, bool)
        present[ids] = True
        alphabet = np.flatnonzero(present).astype(np.uint32)
        code = np.zeros(present.size, np.uint32)
        code[alphabet] = np.arange(alphabet.size)
        width = np.uint16 if alphabet.size <= 1 << 16 else np.uint32
        symbols = code[ids].astype(width)
        depth = max(int(alphabet.size) - 1, 0).bit_length()
        n_bytes = -(-ids.size // _WORD) * (_WORD // 8)
        planes, zeros = np.zeros((depth, n_bytes), np.uint8), np.zeros(depth, np.uint64)
        for level in range(depth):
            ones = (symbols & width(1 << (depth - 1 - level))) != 0
            packed = np.packbits(ones, bitorder="little")
            planes[level, : packed.size] = packed
            low = symbols[~ones]
            zeros[level] = low.size
            symbols = np.concatenate([low, symbols[ones]])
        return cls(alphabet, planes, zeros, ids.size)

    def decode(self) -> np.ndarray:
        """All ids in order, by undoing the stable partitions from the last plane up."""
        depth = len(self.zeros)
        width = np.uint16 if depth <= 16 else np.uint32
        symbols = np.zeros(self.size, width)
        for level in range(depth - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.size, bitorder="little").view(bool)
            zero = int(self.zeros[level])
            above = np.empty(self.size, width)
            above[~ones] = symbols[:zero]
            above[ones] = symbols[zero:] | width(1 << (depth - 1 - level))
            symbols = above
        return self.alphabet[symbols] if self.size else np.empty(0, np.uint32)

    @property
    def ranks(self) -> np.ndarray:
        """Ones before each 64-bit word of a plane."""
        if self._ranks is None:
            ones = np.bitwise_count(self.planes.view("<u8")).astype(np.int64)
            self._ranks = np.concatenate([np.zeros((len(ones), 1), np.int64), ones.cumsum(axis=1)], axis=1)
        return self._ranks

    def _rank1(self, level: int, at: int) -> int:
        word, bit = divmod(at, _WORD)
        ones = int(self.ranks[level, word])
        if bit:
            ones += (int(self.planes[level].view("<u8")[word]) & ((1 << bit) - 1)).bit_count()
        return ones

    def _select(self, level: int, bit: int, n: int) -> int:
        """Position of the n-th (from 0) zero or one of a plane."""
        lo, hi = 0, self.size
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._rank1(level, mid + 1)
            if (ones if bit else mid + 1 - ones) <= n:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.size:
            raise IndexError(at)
        symbol = 0
        for level in range(len(self.zeros)):
            ones = self._rank1(level, at)
            bit = self._rank1(level, at + 1) - ones
            symbol = symbol << 1 | bit
            at = int(self.zeros[level]) + ones if bit else at - ones
        return int(self.alphabet[symbol])

    def _range(self, token: int, start: int, end: int) -> tuple[int, int, int]:
        symbol = int(np.searchsorted(self.alphabet, token))
        if symbol >= len(self.alphabet) or self.alphabet[symbol] != token:
            return 0, 0, symbol
        depth = len(self.zeros)
        for level in range(depth):
            a, b = self._rank1(level, start), self._rank1(level, end)
            if symbol >> (depth - 1 - level) & 1:
                start, end = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                start, end = start - a, end - b
        return start, end, symbol

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often an id occurs in [start, end)."""
        lo, hi, _ = self._range(token, start, self.size if end is None else end)
        return hi - lo

    def occurrence(self, token: int, n: int) -> int:
        """Position of the n-th occurrence (from 0) of an id, -1 if there are fewer."""
        lo, hi, symbol = self._range(token, 0, self.size)
        if n >= hi - lo:
            return -1
        at, depth = lo + n, len(self.zeros)
        for level in range(depth - 1, -1, -1):
            if symbol >> (depth - 1 - level) & 1:
                at = self._select(level, 1, at - int(self.zeros[level]))
            else:
                at = self._select(level, 0, at)
        return at

    def to_bytes(self) -> bytes:
        """Header, then alphabet, zeros per plane and planes, compressed; ranks are counted again when needed."""
        body = self.alphabet.astype("<u4").tobytes() + self.zeros.astype("<u8").tobytes() + self.planes.tobytes()
        head = _HEAD.pack(_MAGIC, self.size, len(self.alphabet), len(self.zeros))
        return head + zstandard.ZstdCompressor(level=1).compress(body)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, size, n_symbols, depth = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix")
        body = zstandard.ZstdDecompressor().decompress(data[_HEAD.size :])
        alphabet = np.frombuffer(body, "<u4", n_symbols)
        zeros = np.frombuffer(body, "<u8", depth, 4 * n_symbols)
        n_bytes = -(-size // _WORD) * (_WORD // 8)
        planes = np.frombuffer(body, np.uint8, depth * n_bytes, 4 * n_symbols + 8 * depth).reshape(depth, n_bytes)
        return cls(alphabet, planes, zeros, size)
