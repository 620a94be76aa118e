"""Vectorised helpers over Arrow text columns: byte views, word hashes, rolling hashes.

Everything here works on bounded chunks of a batch (about ``CHUNK`` bytes, one
row at least), so that the memory of a Python worker does not follow the number
of rows in an Arrow batch.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * CHUNK)
        steps = np.full(size, base, dtype=U64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * CHUNK:
            _POWERS[base] = have
    return have[:n]


class Rolling:
    """Hashes of any substring of ``data`` from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum((data.astype(U64) + U64(1)) * _powers(_BASE, n), out=self.sums[1:])
        self.inverse = _powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * self.inverse[start] + (stop - start).astype(U64))

    def grams(self, k: int) -> np.ndarray:
        """The hash of each window of ``k`` bytes."""
        n = len(self.sums) - k
        return mix64((self.sums[k:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, dtype=U64)


def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets (n + 1); a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, at least one row each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


#: Bytes of words that white space parts: all but space and 0x09-0x0D.
SOLID = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
#: Bytes of words of letters: ASCII letters and all parts of longer characters.
LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SOLID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and row of each maximal run of bytes of a ``kind``; runs end with their row."""
    n = len(data)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    solid = kind[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = np.flatnonzero(solid & (edge[:n] | ~np.concatenate(([False], solid[:-1]))))
    stop = np.flatnonzero(solid & (edge[1:] | ~np.concatenate((solid[1:], [False])))) + 1
    return start, stop, np.searchsorted(offsets, start, side="right") - 1


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """The position of the leftmost smallest value in each window of ``w``; values are compared by their upper 32 bits."""
    n = len(values)
    if n < w:
        return np.zeros(0, dtype=np.int64)
    packed = (values & U64(0xFFFFFFFF00000000)) | np.arange(n, dtype=U64)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(U64).max, dtype=U64)
    padded[:n] = packed
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - w + 1], ahead[w - 1 : n])
    return (least & U64(0xFFFFFFFF)).astype(np.int64)


def release() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task that gives its memory back at its end; workers live on, and what they keep adds to the next task's."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task
