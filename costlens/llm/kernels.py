"""Vectorised text kernels that run inside Spark tasks, on one Arrow batch.

Word hashes come from prefix sums of a polynomial over the batch's bytes, so
no word becomes a Python string. Batches are walked in runs of whole texts of
about ``RUN_BYTES``; one longer text is a run of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_POWERS: list[np.ndarray] = []

#: The separators of a word: space and the characters 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def returning(batches):
    """Hand on a task's batches and, at its end, give memory that is free inside
    the Python worker back to the machine: a worker outlives its tasks, and what
    it keeps adds to the executor's size in stages that need none of it."""
    import ctypes
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):       # another C library
            pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes (wraps on overflow)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def byte_table(fold_ascii: bool = True) -> np.ndarray:
    """A random odd-free value per byte; A-Z equal a-z when folded."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
    if fold_ascii:
        table[65:91] = table[97:123]
    return table


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, RUN_BYTES + 1)
        out = []
        for p in (_P, _PINV):
            x = np.full(size, p, dtype=np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        _POWERS[:] = out
    return _POWERS[0][:n], _POWERS[1][:n]


def string_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, off


def runs(off: np.ndarray, limit: int = RUN_BYTES):
    """(first, last) text numbers of consecutive texts of about ``limit`` bytes."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def word_bounds(data: np.ndarray, off: np.ndarray, sep: np.ndarray):
    """Starts and ends of the words of a run; no word crosses two texts."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z
    gap = sep[data]
    edge = np.zeros(n + 1, bool)
    edge[off[:-1][off[:-1] < n]] = True
    edge[0] = edge[n] = True
    before = edge[:n].copy()
    before[1:] |= gap[:-1]
    after = edge[1:].copy()
    after[:-1] |= gap[1:]
    word = ~gap
    return np.flatnonzero(word & before), np.flatnonzero(word & after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    n = len(data)
    up, down = powers(n + 1)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * up[:n], out=c[1:])
    h = (c[ends] - c[starts]) * down[starts]
    return mix(h ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_of(col, sep: np.ndarray, table: np.ndarray):
    """For each run of texts: (first text, data, offsets within data, word
    starts, word ends, word hashes, index of each text's first word)."""
    raw, off = string_buffers(col)
    for i, j in runs(off):
        data, o = raw[off[i]:off[j]], off[i:j + 1] - off[i]
        s, e = word_bounds(data, o, sep)
        yield i, data, o, s, e, span_hashes(data, s, e, table), np.searchsorted(s, o)


def chain(*parts: np.ndarray) -> np.ndarray:
    """A hash of a sequence of hashes, order included."""
    h = np.full(len(parts[0]), len(parts), np.uint64) * np.uint64(_P)
    for x in parts:
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + x)
    return h
