"""xoshiro256++ seeded by SplitMix64, for data that must be reproducible bit by bit."""

from __future__ import annotations

import math

import numpy as np

_M = (1 << 64) - 1


class Xoshiro256pp:
    def __init__(self, seed: int):
        words, z = [], seed & _M
        for _ in range(4):
            z = (z + 0x9E3779B97F4A7C15) & _M
            x = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & _M
            x = ((x ^ x >> 27) * 0x94D049BB133111EB) & _M
            words.append(x ^ x >> 31)
        self.words = words

    def u64(self) -> int:
        a, b, c, d = self.words
        top = (a + d) & _M
        out = ((top << 23 | top >> 41) + a) & _M
        c ^= a
        d ^= b
        self.words = [a ^ d, b ^ c, (c ^ b << 17) & _M, (d << 45 | d >> 19) & _M]
        return out

    def uniform(self) -> float:
        """In [0, 1), 53 bits."""
        return (self.u64() >> 11) * 2.0**-53

    def uniform32(self) -> np.float32:
        """In [0, 1), 24 bits."""
        return np.float32((self.u64() >> 40) * 2.0**-24)

    def below(self, n: int) -> int:
        """Uniform in [0, n), without bias."""
        if n <= 0:
            raise ValueError("nothing is below 0")
        least = (1 << 64) % n
        while True:
            m = self.u64() * n
            if m & _M >= least:
                return m >> 64

    def gaussian(self) -> np.float32:
        """Box-Muller."""
        r = math.sqrt(-2.0 * math.log(1.0 - self.uniform()))
        return np.float32(r * math.cos(math.tau * self.uniform()))

    def uniforms(self, n: int, low: float = -1.0, high: float = 1.0) -> np.ndarray:
        return np.array([low + np.float32(high - low) * self.uniform32() for _ in range(n)], np.float32)

    def gaussians(self, n: int) -> np.ndarray:
        return np.array([self.gaussian() for _ in range(n)], np.float32)
