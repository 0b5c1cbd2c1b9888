"""Word spans and hashes of Arrow text columns, computed with numpy over UTF-8 bytes.

Words are maximal runs of bytes other than space and 0x09-0x0D; A-Z are lower-cased first. Both are ASCII rules, so they
can be applied to UTF-8 bytes. A null text is an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        _POWERS[0] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 256), _BASE, np.uint64)]), dtype=np.uint64)
    return _POWERS[0]


@dataclass
class Block:
    """Some consecutive documents. ``first``: row of the first in its batch."""

    first: int
    data: np.ndarray  # lower-cased bytes of all documents
    ends: np.ndarray  # of documents, in ``data``
    starts: np.ndarray  # of words
    stops: np.ndarray  # of words
    words_to: np.ndarray  # number of words up to the end of each document

    @property
    def n_docs(self) -> int:
        return len(self.ends)

    @property
    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(self.n_docs), np.diff(self.words_to, prepend=0))

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word: a random byte table under a polynomial, then a finaliser."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lens = self.stops - self.starts
        inside = np.ones(len(self.data), np.int32)
        # position within the word, restarted at each start
        inside[self.starts[0]] = 0
        inside[self.starts[1:]] = self.starts[:-1] - self.starts[1:] + 1
        inside[: self.starts[0]] = 0
        pos = np.cumsum(inside, dtype=np.int32)
        values = _BYTE[self.data]
        np.minimum(pos, int(lens.max()), out=pos)  # only trailing space, whose value is 0, lies beyond
        values *= _powers(int(lens.max()) + 1)[pos]
        return mix(np.add.reduceat(values, self.starts) + lens.astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.stops[i]].tobytes()


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ends of rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    at = np.frombuffer(at, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at[1:] - at[0]


def blocks(column: pa.Array, most: int = 1 << 19, lower: bool = True) -> Iterator[Block]:
    """Blocks of whole documents with about ``most`` bytes each (one document at least); lower: A-Z to a-z."""
    raw, ends = _raw(column)
    row = 0
    while row < len(ends):
        begin = int(ends[row - 1]) if row else 0
        last = max(row + 1, int(np.searchsorted(ends, begin + most, side="right")))
        own = ends[row:last] - begin
        # a space after each document keeps words apart
        data = raw[begin : int(ends[last - 1])]
        data = np.insert(_LOWER[data] if lower else data, own, 0x20)
        own = own + np.arange(1, len(own) + 1)
        edge = np.diff(np.concatenate([[True], _SPACE[data]]).astype(np.int8))
        starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        yield Block(row, data, own, starts, stops, np.searchsorted(starts, own))
        row = last


_SHINGLE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(block: Block, width: int = 5) -> Iterator[np.ndarray]:
    """For each document the sorted distinct 64-bit hashes of its ``width``-word shingles.

    With fewer words the whole sequence is the only shingle; without words the set is empty.
    """
    words = block.hashes()
    n = len(words)
    rolled = np.zeros(max(0, n - width + 1), np.uint64)
    for k in range(width):
        rolled += words[k : n - width + 1 + k] * _SHINGLE[k] if len(rolled) else rolled
    rolled = mix(rolled)
    begin = 0
    for end in block.words_to.tolist():
        have = end - begin
        if have >= width:
            yield np.unique(rolled[begin : end - width + 1])
        elif have:
            whole = (words[begin:end] * _SHINGLE[:have]).sum(dtype=np.uint64, keepdims=True) + _SHINGLE[8 + have]
            yield mix(whole)
        else:
            yield np.zeros(0, np.uint64)
        begin = end
