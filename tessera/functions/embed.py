"""Embedders: the one function that users supply, and a hashing one built in."""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..metric import Metric
from .hashing import finalize, hash_bytes, hash_ranges, reduce_range, rotate
from .vector import stored_form

# Words that the hashing embedder leaves out.
STOPWORDS = frozenset(
    x.encode() for x in ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "into", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")
)
#: The same as numbers, a byte after the other: none is longer than four.
_STOPS = np.array(sorted(int.from_bytes(x, "big") for x in STOPWORDS), np.int64)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Embedder(ABC):
    """Turns texts into vectors of one length. Instances are sent to executors."""

    @property
    @abstractmethod
    def name(self) -> str: ...

    @property
    @abstractmethod
    def dim(self) -> int: ...

    @property
    @abstractmethod
    def fingerprint(self) -> int:
        """64 bits that name the model; a store accepts one model only."""

    @abstractmethod
    def embed_batch(self, texts: list[str]) -> np.ndarray:
        """A float32 matrix with a row per text."""


class HashEmbedder(Embedder):
    """Signed feature hashing of words and word pairs with square-root damping."""

    def __init__(self, dim: int = 384, seed: int = 0x5EED0F4A5):
        if dim < 8:
            raise ConfigError(f"{dim} buckets are too few; 8 is the least")
        self._dim, self.seed = dim, seed

    @property
    def name(self) -> str:
        return FINGERPRINT_NAME.decode()

    @property
    def dim(self) -> int:
        return self._dim

    @property
    def fingerprint(self) -> int:
        raw = self._dim.to_bytes(8, "little") + self.seed.to_bytes(8, "little")
        return hash_bytes(raw, hash_bytes(FINGERPRINT_NAME))

    def _bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return reduce_range(h, self._dim), np.where(h & np.uint64(1) == 0, 1.0, -1.0)

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        raw = [t.encode() for t in texts]
        n, dim = len(raw), self._dim
        out = np.zeros(n * dim)
        ends_of = np.cumsum([0, *map(len, raw)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        word = _WORD[data]
        begin, stop = word.copy(), word.copy()
        if len(data):
            begin[1:] &= ~word[:-1]
            stop[:-1] &= ~word[1:]
            inner = ends_of[1:-1]
            inner = inner[(inner > 0) & (inner < len(data))]
            begin[inner] = word[inner]
            stop[inner - 1] = word[inner - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        low = _LOWER[data]
        size = ends - starts
        keep = ~((size == 1) & (data[starts] < 128)) if len(starts) else np.zeros(0, bool)
        short = np.flatnonzero(keep & (size <= 4))
        code = np.zeros(len(short), np.int64)
        for j in range(4):
            here = size[short] > j
            code[here] = (code[here] << 8) | low[starts[short[here]] + j]
        keep[short] = ~np.isin(code, _STOPS)
        starts, ends = starts[keep], ends[keep]
        owner = np.searchsorted(ends_of, starts, side="right") - 1
        h = hash_ranges(low, starts, ends, self.seed)
        place, sign = self._bucket(h)
        out += np.bincount(owner * dim + place, weights=sign, minlength=n * dim)
        two = np.flatnonzero(owner[1:] == owner[:-1])
        place, sign = self._bucket(finalize(rotate(h[two], 17) ^ h[two + 1]))
        out += np.bincount(owner[two] * dim + place, weights=0.5 * sign, minlength=n * dim)
        m = out.reshape(n, dim)
        m = np.sign(m) * np.sqrt(np.abs(m))
        for k in np.flatnonzero(~m.any(axis=1)):
            place, sign = self._bucket(np.array([hash_bytes(raw[k], self.seed)], np.uint64))
            m[k, place[0]] = sign[0]
        return (m / np.sqrt((m * m).sum(axis=1, keepdims=True))).astype(np.float32)


#: What the built-in embedder's fingerprint is seeded with.
FINGERPRINT_NAME = b"hash-embedder-v1"


def embed_column(df: DataFrame, embedder: Embedder, text: str | list[str], vector: str = "vector", *, rows: int = 64, metric: str | Metric | None = None) -> DataFrame:
    """``df`` with the vectors of a text column, or of several one after the other,
    made in Arrow batches of ``rows``. With ``metric`` they are given as a store of
    that metric holds them, and a vector that it could not hold is an error."""
    at = [df.columns.index(t) for t in ([text] if isinstance(text, str) else text)]
    dim, unit = embedder.dim, metric is not None and Metric.parse(metric).normalizes

    def run(stream):
        for batch in stream:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                texts = ["".join(x or "" for x in row) for row in zip(*[part.column(c).to_pylist() for c in at])]
                m = np.ascontiguousarray(embedder.embed_batch(texts), np.float32)
                if m.shape != (part.num_rows, dim):
                    raise ValueError(f"embedder {embedder.name} gave {m.shape}, not {(part.num_rows, dim)}")
                if metric is not None:
                    m, said = stored_form(m.astype(np.float64), unit)
                    bad = np.flatnonzero(~np.equal(said, None))
                    if len(bad):
                        raise ValueError(f"embedder {embedder.name} gave a vector that cannot be stored: {said[bad[0]]}")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, dim, dtype=np.int32)), pa.array(m.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, vector])

    schema = df.withColumn(vector, F.array().cast("array<float>")).schema
    return df.mapInArrow(run, schema)
