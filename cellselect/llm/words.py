"""Words and window hashes of whole Arrow text columns, as numpy arrays.

A word is a maximal run of characters other than space and U+0009..U+000D. UTF-8 never uses those
bytes inside a character, so words are cut on bytes. All hashes are 64-bit polynomial sums over
prefix sums (a window costs the same at any length), finished with a mixer; they depend on the words
alone, so a retried task or another partitioning gives the same values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"

_BYTE_KEYS = np.random.Generator(np.random.PCG64(20240917)).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C1B
_WORD_BASE = 0xD1B54A32D192ED0B
#: Bytes of text handled at once: keeps the working arrays in tens of MB whatever the batch holds.
BLOCK_BYTES = 1 << 19


def _powers(base: int, n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; grown by doubling and kept per worker."""
    have = cache.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        have = cache[base] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    up, down = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], dtype=np.uint64, out=sums[1:])
    length = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * down[starts] + length * np.uint64(0xA24BAED4963EE407))


def byte_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range."""
    return _range_hash(_BYTE_KEYS[data], starts, ends, _BASE)


@dataclass
class Words:
    """Words of consecutive texts: ``first[d]:first[d+1]`` are text d's, ``hash`` their hashes,
    ``start``/``end`` their byte ranges in ``data``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text index, word position) of every n-word window inside one text, in order."""
        per = np.maximum(self.counts - n + 1, 0)
        doc = np.repeat(np.arange(len(per)), per)
        before = np.cumsum(per) - per
        pos = np.arange(len(doc)) - before[doc]
        at = self.first[:-1][doc] + pos
        return _range_hash(self.hash, at, at + n, _WORD_BASE), doc, pos

    def whole(self) -> np.ndarray:
        """Hash of each text's whole word sequence."""
        return _range_hash(self.hash, self.first[:-1], self.first[1:], _WORD_BASE)


def blocks(texts: pa.Array | pa.ChunkedArray, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after, bytes, byte offsets) of runs of rows of about ``block_bytes`` together;
    a longer text stands alone. Nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks)
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + block_bytes, "right")) - 1
        stop = min(n, max(row + 1, stop))
        yield row, stop, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


def split(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    """Cut one block (see ``blocks``) into words."""
    if lower:
        data = _LOWER[data]
    black = np.zeros(len(data) + 2, bool)
    black[1:-1] = ~_WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a text's first byte starts anew even when no space stands before it
    start = np.flatnonzero(black[1:] & (edge | ~black[:-1]))
    end = np.flatnonzero(black[:-1] & (edge | ~black[1:]))
    first = np.searchsorted(start, offsets)
    return Words(data, start, end, first, byte_hash(data, start, end))


def words_of(texts: pa.Array, lower: bool = False, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after, Words) over a whole column."""
    for row, stop, data, offsets in blocks(texts, block_bytes):
        yield row, stop, split(data, offsets, lower)
