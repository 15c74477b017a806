"""The interface of indexes, and the two that are built in.

Whatever has these members can stand where an index is asked for; hits have the
columns query_id, rank, segment_id, ordinal, row, id, score.
"""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

from ..metric import Metric
from ..operators import hnsw, knn


@runtime_checkable
class VectorIndex(Protocol):
    @property
    def dim(self) -> int: ...

    @property
    def metric(self) -> Metric: ...

    def __len__(self) -> int: ...

    def search(self, queries, k: int) -> DataFrame:
        """The k best rows of a list of (id, vector) or a frame (query_id, query)."""


class _Rows:
    def __init__(self, rows: DataFrame, metric: str | Metric, dim: int):
        self.rows, self._metric, self._dim, self._size = rows, Metric.parse(metric), dim, None

    @property
    def dim(self) -> int:
        return self._dim

    @property
    def metric(self) -> Metric:
        return self._metric

    def __len__(self) -> int:
        if self._size is None:
            self._size = self.rows.count()
        return self._size

    def is_empty(self) -> bool:
        return self.rows.isEmpty()


class ExactIndex(_Rows):
    """Every row is scored."""

    def search(self, queries, k: int) -> DataFrame:
        return knn.in_blocks(queries, lambda block: knn.search(self.rows, block, k=k, metric=self.metric, dim=self.dim))


class GraphIndex(_Rows):
    """Small-world graphs, one for each segment of the rows."""

    def __init__(self, rows: DataFrame, metric: str | Metric, dim: int, *, graphs: DataFrame | None = None, params: hnsw.HnswParams = hnsw.HnswParams(), ef: int = 64):
        super().__init__(rows, metric, dim)
        self.graphs, self.params, self.ef = graphs, params, ef

    def search(self, queries, k: int) -> DataFrame:
        if self.graphs is None:
            self.graphs = hnsw.stored_graphs(self.rows, self.metric, self.params)
        return hnsw.search_graphs(self.rows, self.graphs, queries, k=k, ef=self.ef, metric=self.metric, dim=self.dim)
