"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

All work here is per byte or per word in vectorised form; texts never become Python strings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ``[^\x20\x09-\x0D]+``
NOT_SPACE = ~_IS_SPACE
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BYTE = np.random.default_rng(20240601).integers(0, 2**64, 256, dtype=U)
_BASE = 0x9E3779B97F4A7C15 | 3
_powers = [np.ones(1, U), np.ones(1, U)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            x = np.full(size, base, U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of texts ``first`` to ``first + len(self) - 1`` of the column."""

    first: int
    data: np.ndarray  # bytes
    starts: np.ndarray  # of words, in data
    ends: np.ndarray
    at: np.ndarray  # at[i]:at[i+1] are the words of text i
    hashes: np.ndarray | None

    def __len__(self) -> int:
        return len(self.at) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def doc(self) -> np.ndarray:
        """For each word, the index of its text here."""
        return np.repeat(np.arange(len(self)), self.counts())


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and len + 1 offsets; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def words_of(raw: np.ndarray, offs: np.ndarray, kind: np.ndarray, lower: bool, first: int = 0, hashed: bool = True) -> Words:
    data = _LOWER[raw] if lower else raw
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = kind[data]
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:n]
    edge = offs[:-1]
    begin = inside.copy()
    begin[1:] &= ~before[1:]
    begin[edge] = inside[edge] & (np.diff(offs) > 0)
    starts = np.flatnonzero(begin[:n])
    stop = before.copy()
    stop[:n] &= ~inside[:n]
    cut = offs[1:][np.diff(offs) > 0]
    stop[cut] = before[cut]
    ends = np.flatnonzero(stop)
    at = np.searchsorted(starts, offs)
    h = None
    if hashed:
        h = span_hashes(data, starts, ends)
    return Words(first, data, starts, ends, at, h)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _pow(len(data))
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def blocks(col: pa.Array | pa.ChunkedArray, kind: np.ndarray, lower: bool, size: int = 1 << 18, hashed: bool = True) -> Iterator[Words]:
    """All texts of a column, some texts at a time, so that memory stays near ``size`` bytes or one text."""
    raw, offs = column_bytes(col)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield words_of(raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i], kind, lower, i, hashed)
        i = j


def hash_of(word: str) -> np.uint64:
    return words_of(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]), np.ones(256, bool), False).hashes[0]


_STEP = U(0xD6E8FEB86659FD93)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words (also across texts: the caller drops those)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += h[j : j + n]
    return mix(out)


def whole(counts: np.ndarray, k: int) -> np.ndarray:
    """Start positions, over all words, of the k-grams that lie within one text."""
    at = np.concatenate([[0], np.cumsum(counts)])
    left = at[1:].repeat(counts) - np.arange(at[-1])
    return np.flatnonzero(left >= k)


def set_fingerprint(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes, as two signed 64-bit values."""
    a = int(mix(h).sum(dtype=U)) if len(h) else 0
    b = int(mix(h ^ U(0xA5A5A5A55A5A5A5A)).sum(dtype=U)) if len(h) else 0
    return a - (a >> 63 << 64), b - (b >> 63 << 64)
