"""Vectorised hashing of words and substrings of Arrow text batches, without a Python object per word.

A rolling polynomial (modulo 2^64, odd base, a random value per byte) gives the hash of any substring from two prefix sums; a mixing step then
spreads the bits. Everything here works on one slice of a batch, whose bytes are bounded, except where a single text is longer than the bound.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

SLICE_BYTES = 1 << 20
_RANDOM = np.random.default_rng(20240229)
_BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER_VALUES = _BYTE_VALUES.copy()
_LOWER_VALUES[65:91] = _BYTE_VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, after which a worker that serves further tasks gives its free memory back."""

    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            gc.collect()
            # Where the C library has no such call, freed memory stays with the process.
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return inner


class _Powers:
    """Powers of a base modulo 2^64, extended on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.values = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            step = np.uint64(pow(self.base, len(self.values), 1 << 64))
            self.values = np.concatenate([self.values, self.values * step])
        return self.values[:n]


_FORWARD, _BACKWARD = _Powers(_BASE), _Powers(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``SLICE_BYTES`` bytes, at least one row each."""
    offsets = _offsets(texts)
    start, n = 0, len(texts)
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, side="right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def as_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One plain string array; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    return column.fill_null("")


def _offsets(texts: pa.Array) -> np.ndarray:
    buffer = texts.buffers()[1]
    return np.frombuffer(buffer, np.int64, len(texts) + 1, 8 * texts.offset) if buffer is not None and len(texts) else np.zeros(len(texts) + 1, np.int64)


def raw(texts: pa.Array, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of rows ``start`` to ``end`` and where each row begins in them (one more entry than rows)."""
    offsets = _offsets(texts)[start : end + 1]
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8, offsets[-1] - offsets[0], offsets[0]), offsets - offsets[0]


class Rolling:
    """Hashes of the byte ranges of one slice, or of ranges of other symbols with given ``values``."""

    def __init__(self, data: np.ndarray, lower: bool = False, values: np.ndarray | None = None) -> None:
        if values is None:
            values = (_LOWER_VALUES if lower else _BYTE_VALUES)[data]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values * _FORWARD.upto(len(data)), out=self.sums[1:])
        self.back = _BACKWARD.upto(len(data) + 1)

    def ranges(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of ``data[begin:end]``; equal bytes have equal hashes wherever they lie."""
        return mix((self.sums[end] - self.sums[begin]) * self.back[begin])


def word_bounds(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word (a run without space, tab, LF, VT, FF or CR), and the index of the first word of each row (one more entry than rows)."""
    inner = ~_SPACE[data]
    starts = inner.copy()
    starts[1:] &= ~inner[:-1]
    ends = inner.copy()
    ends[:-1] &= ~inner[1:]
    edges = rows[(rows > 0) & (rows < len(data))]  # a row's first byte begins a word even where the row before ends in one
    starts[edges] |= inner[edges]
    ends[edges - 1] |= inner[edges - 1]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return begin, end, np.searchsorted(begin, rows)


def words(texts: pa.Array, start: int, end: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, A-Z lower-cased if asked, and the index of each row's first word."""
    data, rows = raw(texts, start, end)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(end - start + 1, np.int64)
    begin, stop, first = word_bounds(data, rows)
    return Rolling(data, lower).ranges(begin, stop), first


cloudpickle.register_pickle_by_value(sys.modules[__name__])
