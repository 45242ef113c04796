"""Vectorised byte kernels that the text operators share.

Texts arrive as Arrow string arrays.  ``pieces`` walks over them in slices of bounded size, so the memory of a
Python worker depends on the longest single text and never on the batch.  ``Words`` cuts one slice into words and
gives the hash of any byte range in constant time, from prefix sums of ``T[b] * P**i`` modulo 2**64: P is odd, so
it has an inverse and a range starting anywhere can be moved to the origin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 19
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


#: A fixed random odd 64-bit code for each byte.
BYTE_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)


class _Powers:
    """Powers of P and of its inverse, grown to the longest slice seen."""

    up = np.ones(1, U64)
    down = np.ones(1, U64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = -(-n // (1 << 16)) << 16
            with np.errstate(over="ignore"):
                up, down = np.full(size, _P, U64), np.full(size, _P_INV, U64)
                up[0] = down[0] = 1
                cls.up, cls.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return cls.up, cls.down


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser over 64-bit words."""
    with np.errstate(over="ignore"):
        h = h ^ U64((salt * 0xD6E8FEB86659FD93) & (2**64 - 1)) if salt else h.copy()
        h ^= h >> U64(32)
        h *= U64(0xD6E8FEB86659FD93)
        h ^= h >> U64(29)
        h *= U64(0xA0761D6478BD642F)
        h ^= h >> U64(32)
    return h


def lut(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry mask that is true in the inclusive byte ranges."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes of words that any white space ends: everything but space and 09-0D.
SPACED = ~lut((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words made of digits, lower-case letters and everything beyond ASCII.
ALNUM = lut((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Letters only: lower case and everything beyond ASCII.
LETTERS = lut((0x61, 0x7A), (0x80, 0xFF))
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (n + 1) and validity of a string column, without copying the bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    valid = ~np.asarray(col.is_null())
    _, off, data = col.buffers()
    n = len(col)
    offsets = np.frombuffer(off, np.int64, n + 1 + col.offset)[col.offset :] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if n and not valid.all():  # a null's range may hold anything
        lengths = np.where(valid, np.diff(offsets), 0)
        if (lengths != np.diff(offsets)).any():
            raw = np.concatenate([raw[a : a + k] for a, k in zip(offsets, lengths, strict=False)] or [raw[:0]])
            offsets = np.concatenate([[0], np.cumsum(lengths)])
    return raw, offsets, valid


def pieces(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (first row, last row + 1, bytes, local offsets) of at most ``limit`` bytes, or of one row."""
    raw, offsets, _ = buffers(col)
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


class RangeHash:
    """64-bit hashes of byte ranges of one slice, from prefix sums; ``salt`` 0 or 1 gives independent ones."""

    def __init__(self, data: np.ndarray, salt: int = 0):
        n = len(data)
        up, self.down = _Powers.get(n + 1)
        codes = mix(BYTE_CODES, 700 + salt) | U64(1) if salt else BYTE_CODES
        self.sums = np.zeros(n + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(codes[data] * up[:n], dtype=U64, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start], salt)


class Words:
    """The words of one slice: ``start``, ``end`` (bytes), ``row`` (local), ``first`` (n + 1 word offsets)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray, fold: bool = True):
        self.data = LOWER[data] if fold else data
        n = len(data)
        inside = np.zeros(n + 1, bool)
        inside[:n] = letters[self.data]
        begin = inside[:n].copy()
        begin[1:] &= ~inside[: n - 1]
        cut = offsets[1:-1]
        cut = cut[cut < n]
        begin[cut] = inside[cut]
        ends = inside[:n] & ~inside[1:]
        ends[cut[cut > 0] - 1] = inside[cut[cut > 0] - 1]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.n = n

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hash(self, start: np.ndarray | None = None, end: np.ndarray | None = None, salt: int = 0) -> np.ndarray:
        """64-bit hashes of byte ranges, of the words unless told otherwise."""
        if not hasattr(self, "_ranges"):
            self._ranges = RangeHash(self.data)
        return self._ranges(self.start if start is None else start, self.end if end is None else end, salt)


def hash_words(texts: list[str], letters: np.ndarray) -> list[np.ndarray]:
    """Word hashes of a few texts, as ``Words.hash`` gives them."""
    out: list[np.ndarray] = []
    for _, _, data, offsets in pieces(pa.array(texts, pa.large_string())):
        w = Words(data, offsets, letters)
        out += np.split(w.hash(), w.first[1:-1])
    return out


def segments(values: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    return np.split(values, first[1:-1]) if len(first) > 1 else []
