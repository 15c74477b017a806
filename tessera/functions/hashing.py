"""64-bit FNV-1a with Murmur's finalizer, over NumPy columns of byte strings."""

from __future__ import annotations

import numpy as np

_BASIS, _PRIME = 0xCBF29CE484222325, 0x100000001B3
_M = (1 << 64) - 1


def finalize(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hash_bytes(data: bytes, seed: int = 0) -> int:
    """Hash of one byte string."""
    h = _BASIS ^ seed
    for b in data:
        h = ((h ^ b) * _PRIME) & _M
    return int(finalize(np.array([h], np.uint64))[0])


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of many byte ranges of one buffer: all ranges advance together, a
    byte at a time, longest first, so the loop runs as often as the longest is long."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    h = np.full(len(starts), np.uint64(_BASIS ^ seed))
    at, left = starts[order], size[order]
    live = len(order)
    for k in range(int(size.max(initial=0))):
        live = int(np.searchsorted(-left[:live], -k, side="left"))
        h[:live] = (h[:live] ^ data[at[:live] + k]) * np.uint64(_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return finalize(out)


def reduce_range(h: np.ndarray, n: int) -> np.ndarray:
    """The high half of h * n (n below 2**32): a uniform index in [0, n)."""
    hi, lo, n = h >> np.uint64(32), h & np.uint64(0xFFFFFFFF), np.uint64(n)
    return ((hi * n + ((lo * n) >> np.uint64(32))) >> np.uint64(32)).astype(np.int64)


def rotate(h: np.ndarray, bits: int) -> np.ndarray:
    return (h << np.uint64(bits)) | (h >> np.uint64(64 - bits))
