"""Vectorised text primitives that the corpus operators share.

Tokens are the maximal runs of ASCII letters, digits and non-ASCII bytes of the lower-cased text; every
other byte separates. A token is represented by a 64-bit hash, computed for whole Arrow buffers at once:
with ``P`` the prefix sums of ``T[byte] * B**i`` (mod 2**64), the hash of bytes ``[s, e)`` is
``(P[e] - P[s]) * B**-s``, which doesn't depend on where the token stands. The same construction over
token hashes gives the hash of any window of tokens in constant time. Nothing here truncates a text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_MASK = (1 << 64) - 1
_BASE, _WINDOW_BASE = 0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4B & ~7 | 3
_rng = np.random.default_rng(20_240_117)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_WORD = np.zeros(256, bool)
_WORD[0x80:] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _WORD[_lo:_hi] = True
#: Bytes of text handled at once; a longer text is handled alone, whole.
CHUNK_BYTES = 1 << 18


class _Powers:
    """Powers of an odd base and of its inverse mod 2**64, extended as longer texts come."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, _U), np.ones(1, _U)

    def to(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(self.base, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(self.inverse, m, 1 << 64))])


_BYTES, _TOKENS = _Powers(_BASE & _MASK), _Powers(_WINDOW_BASE & _MASK)


def trim() -> None:
    """Gives memory that is free back to the system: workers live on between tasks, and several would each keep their most."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run: Callable) -> Callable:
    """``run`` over a partition's batches, and ``trim`` at its end."""

    def whole(batches):
        yield from run(batches)
        trim()

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    n = len(texts)
    if not n:
        return
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def flat(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, one after the other, and the offsets of the rows; null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if lower:
        texts = pc.utf8_lower(texts)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def tokens_of_bytes(raw: np.ndarray, at: np.ndarray, with_ends: bool = False):
    """(hash of each token, first token of each row, byte where each token starts, and with_ends where it ends)."""
    n = len(raw)
    if not n:
        empty = np.zeros(0, np.int64)
        return (np.zeros(0, _U), np.zeros(len(at), np.int64), empty) + ((empty,) if with_ends else ())
    word = _WORD[raw]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~word[:-1]
    starts = np.flatnonzero(word & (before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~word[1:]
    ends = np.flatnonzero(word & (after | cut[1:])) + 1
    _BYTES.to(n + 1)
    sums = np.empty(n + 1, _U)
    sums[0] = 0
    np.cumsum(_BYTE[raw] * _BYTES.up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _BYTES.down[starts])
    first = np.searchsorted(starts, at)
    return (hashes, first, starts) + ((ends,) if with_ends else ())


def tokens(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row from, row to, token hashes, first token of each row and the end) for successive ranges of rows."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    for lo, hi in chunks(texts, limit):
        raw, at = flat(texts.slice(lo, hi - lo))
        hashes, first, _ = tokens_of_bytes(raw, at)
        yield lo, hi, hashes, first


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each token."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


class Windows:
    """Hashes of any window of tokens of one sequence."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        _TOKENS.to(n + 1)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(hashes * _TOKENS.up[:n], out=self.sums[1:])

    def at(self, start: np.ndarray, length) -> np.ndarray:
        """Hash of tokens [start, start + length); the caller keeps them inside one text."""
        return mix((self.sums[start + length] - self.sums[start]) * _TOKENS.down[start])


def row_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Positions at which a window of ``width`` tokens fits inside its row."""
    last = np.repeat(first[1:], np.diff(first))
    pos = np.arange(first[-1])
    return pos[pos + width <= last]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
