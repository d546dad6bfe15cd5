"""Word and shingle arithmetic on whole Arrow text columns with numpy.

Texts are handled as UTF-8 bytes.  A chunk of texts is one byte array plus
offsets; words are found with byte-class tables and hashed with a polynomial
over 64-bit integers, so that no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words between white space (space, \t to \r).
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of lower-cased words: digits, letters a to z and all beyond ASCII.
PLAIN = np.zeros(256, dtype=bool)
PLAIN[48:58] = PLAIN[97:123] = PLAIN[128:] = True


@dataclass
class Chunk:
    """``first`` row of the batch, ``data`` bytes, ``ends`` of the n texts (n + 1 offsets from 0)."""

    first: int
    data: np.ndarray
    ends: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.ends) - 1


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a text column into chunks of about ``most`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(at, at[row] + most, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield Chunk(row, raw[at[row] : at[stop]], at[row : stop + 1] - at[row])
        row = stop


@dataclass
class Words:
    """Words of a chunk: ``start``/``stop`` bytes, ``key`` hash, and ``ends``, the n + 1 word offsets of texts."""

    start: np.ndarray
    stop: np.ndarray
    key: np.ndarray
    ends: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends) - 1), np.diff(self.ends))


def words(data: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> Words:
    """Find maximal runs of bytes of ``kind`` inside each text and hash them."""
    n = len(data)
    inside = np.empty(n + 1, dtype=bool)
    inside[:n] = kind[data]
    inside[n] = False
    begin = inside[:n].copy()
    begin[1:] &= ~inside[: n - 1]
    cut = ends[(ends < n)]
    begin[cut] |= inside[cut]
    close = inside[:n] & ~inside[1:]
    cut = ends[(ends > 0) & (ends <= n)] - 1
    close[cut] |= inside[cut]
    start, stop = np.flatnonzero(begin), np.flatnonzero(close) + 1
    key = _hashed(data, start, stop)
    return Words(start, stop, key, np.searchsorted(start, ends))


def _hashed(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    n = len(data)
    power = np.empty(n + 1, dtype=np.uint64)
    power[0] = 1
    power[1:] = _BASE
    power = np.multiply.accumulate(power)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_LETTER[data] * power[:n], out=total[1:])
    back = np.full(n + 1, _INVERSE, dtype=np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    return mix((total[stop] - total[start]) * back[start] + (stop - start).astype(np.uint64))


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words, and their n + 1 offsets.

    A text with fewer words, but not none, is one shorter shingle.
    """
    count = np.diff(found.ends)
    whole = np.maximum(count - size + 1, (count > 0).astype(count.dtype))
    ends = np.concatenate([[0], np.cumsum(whole)]).astype(np.int64)
    owner = np.repeat(np.arange(len(count)), whole)
    first = found.ends[:-1][owner] + (np.arange(ends[-1]) - ends[:-1][owner])
    length = np.minimum(count[owner], size)
    key = np.zeros(len(first), dtype=np.uint64)
    for k in range(size):
        there = k < length
        word = found.key[np.minimum(first + k, max(len(found.key) - 1, 0))] if len(found.key) else key
        key = np.where(there, key * _BASE + word, key)
    return mix(key + length.astype(np.uint64)), ends
