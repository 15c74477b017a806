"""Vectorised byte-level text kernels shared by the Arrow operators.

A word is a maximal run of bytes other than space and 0x09-0x0D. Every kernel
works on the UTF-8 buffer of a whole Arrow batch, so cost per byte is a few
NumPy passes and nothing is done per word in Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """Words of a batch: byte ranges, 64-bit hashes and the words per text."""

    __slots__ = ("data", "starts", "ends", "hashes", "counts", "offsets")

    def __init__(self, data, starts, ends, hashes, counts):
        self.data, self.starts, self.ends, self.hashes, self.counts = data, starts, ends, hashes, counts
        self.offsets = np.concatenate(([0], np.cumsum(counts)))


def split_words(data: np.ndarray, offsets: np.ndarray, *, lower: bool = True, hashed: bool = True) -> Words:
    """Find and hash the words of every text in a buffer.

    Hashes are polynomial over per-byte random values modulo 2**64, taken from
    prefix sums, then finalised with the length. Buffers are cut into segments
    at white space or text ends, which no word crosses, so the working set
    stays bounded; one word longer than a segment gets a segment of its own.
    """
    if lower:
        data = _LOWER[data]
    n = len(data)
    space = _WS[data]
    begin = ~space
    stop = begin.copy()
    if n:
        begin[1:] &= space[:-1]
        stop[:-1] &= space[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begin[inner] = ~space[inner]
        stop[inner - 1] = ~space[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    hashes = np.zeros(0, np.uint64)
    if hashed:
        hashes = np.empty(len(starts), np.uint64)
        k = 0
        while k < len(starts):
            lo = starts[k]
            m = max(k + 1, int(np.searchsorted(ends, lo + _SEGMENT, side="right")))
            hi = ends[m - 1]
            power, inverse = _power_tables(max(_SEGMENT, int(hi - lo)) + 1)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_BYTE[data[lo:hi]] * power[: hi - lo], out=sums[1:])
            a, b = starts[k:m] - lo, ends[k:m] - lo
            hashes[k:m] = mix64((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
            k = m
    return Words(data, starts, ends, hashes, counts)


def windows(hashes: np.ndarray, size: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Rabin-Karp fingerprints of every run of ``size`` hashes (wrapping 64-bit)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    b = np.uint64(base)
    for j in range(1, size):
        out *= b
        out += hashes[j : j + n]
    return mix64(out)


def window_owner(counts: np.ndarray, size: int) -> np.ndarray:
    """For each run of ``size`` words of a batch, whether one text holds it whole."""
    total = int(counts.sum())
    n = max(0, total - size + 1)
    if n == 0:
        return np.zeros(0, bool)
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner[:n] == owner[size - 1 : size - 1 + n]


def batches(stream, limit: int = 2 << 20):
    """Cut Arrow batches so that each holds about ``limit`` bytes at most, or one
    row. Working arrays are several times a batch; they stay small, and a worker
    gives its memory back before and after a task's rows."""
    release()
    for batch in stream:
        n = batch.num_rows
        if batch.nbytes <= limit or n <= 1:
            if n:
                yield batch
            continue
        parts = min(n, int(batch.nbytes // limit) + 1)
        step = max(1, n // parts)
        for k in range(0, n, step):
            yield batch.slice(k, step)
        del batch
    release()


def release() -> None:
    """Give memory that earlier batches have freed back to the system: worker
    processes live on, and executors count all of them."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


try:
    import ctypes

    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # not the GNU C library
    _trim = None
