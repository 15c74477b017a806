"""Clustered Gaussian vectors for benchmarks, generated on the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def clustered(spark: SparkSession, n: int, dim: int, *, centers: int = 64, sigma: float = 0.4, seed: int = 42) -> DataFrame:
    """id, vector: row i stands around centre i mod ``centers``. A row depends on
    the seed and its id alone, so any partitioning gives the same data."""
    middle = np.random.default_rng(seed ^ 0xABCD).standard_normal((centers, dim)).astype(np.float32)

    def run(stream):
        for batch in stream:
            ids = np.asarray(batch.column(0))
            noise = np.stack([np.random.default_rng((seed, int(i))).standard_normal(dim) for i in ids]) if len(ids) else np.zeros((0, dim))
            m = (middle[ids % centers] + sigma * noise).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, dim, dtype=np.int32)), pa.array(m.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "vector"])

    return spark.range(n).mapInArrow(run, "id long, vector array<float>")
