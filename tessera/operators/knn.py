"""Exact nearest neighbours over vector rows.

Rows are (segment_id, ordinal, row, id, vector); a hit is ranked by score, then
ordinal, then row, never by the external id. Two forms give the same hits: an
expression form that defines the semantics, and a form that multiplies Arrow
batches with a broadcast block of queries and keeps a bounded list per query in
each task. Queries are taken in blocks of bounded size.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, NotFinite, ZeroNorm
from ..functions import vector as V
from ..metric import Metric
from ..plans.scratch import scratch

#: Queries multiplied with a batch at once, and queries in one broadcast.
BLOCK, BROADCAST = 256, 4096
#: Hits that a task holds for its queries before it cuts them, and hands on what is left if that is still too much.
HELD = 1_000_000
HITS = "query_id long, segment_id long, ordinal int, row long, id long, score double"


def prepare_query(values, dim: int, metric: Metric, key=None) -> np.ndarray:
    """A query as a float64 vector, validated; unit length for cosine."""
    q = np.asarray(values, np.float64)
    if q.shape != (dim,):
        raise DimensionMismatch(dim, q.size)
    bad = np.flatnonzero(~np.isfinite(q))
    if len(bad):
        raise NotFinite(key, int(bad[0]))
    if metric.normalizes:
        n = float(q @ q)
        if not V.TINY < n <= float(np.finfo(np.float32).max):
            raise ZeroNorm(key)
        q = q / np.sqrt(n)
    return q


def scores_of(queries: np.ndarray, rows: np.ndarray, metric: Metric) -> np.ndarray:
    """Queries x rows; rows are already of unit length for cosine."""
    if metric is Metric.L2:
        # |q|^2 - 2 q.x + |x|^2 loses digits near zero, so differences are taken directly.
        return np.stack([-((rows - q) ** 2).sum(axis=1) for q in queries])
    return queries @ rows.T


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, column) of the k best finite-or-infinite scores of each row, ties to lower columns."""
    s = np.where(np.isnan(scores), -np.inf, scores)
    real = ~np.isnan(scores)
    if s.shape[1] > k > 0:
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
        above, ties = s > least, (s == least) & real
        chosen = (above & real) | (ties & (np.cumsum(ties, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    else:
        chosen = real & (k > 0)
    return np.nonzero(chosen)


def _scan(queries: list[np.ndarray], names: list[int], k: int, metric: Metric, dim: int):
    block = np.stack(queries)
    labels = np.array(names, np.int64)

    def given(out):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["query_id", "segment_id", "ordinal", "row", "id", "score"])

    def cut(held):
        q, seg, ordinal, row, ident, score = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((row, ordinal, -score, q))
        first = np.r_[True, np.diff(q[order]) != 0]
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        order = order[place < k]
        return tuple(x[order] for x in (q, seg, ordinal, row, ident, score))

    # Beyond it no list of k hits for each query is kept: what a batch of rows gives is handed on.
    most = HELD // len(block)

    def run(stream):
        held, size = [], 0
        for batch in stream:
            column = batch.column(4)
            whole = np.asarray(column.value_lengths().fill_null(-1)) == dim
            if not whole.all():
                raise ValueError(f"a stored vector has not {dim} components")
            rows = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
            seg, ordinal, row, ident = (np.asarray(batch.column(c)) for c in range(4))
            order = np.lexsort((row, ordinal))
            rows, seg, ordinal, row, ident = rows[order], seg[order], ordinal[order], row[order], ident[order]
            step = max(1, min(BLOCK, HELD // max(1, len(rows))))
            for lo in range(0, len(block), step):
                s = scores_of(block[lo : lo + step], rows, metric)
                q, c = best(s, k)
                hits = (labels[lo + q], seg[c], ordinal[c], row[c], ident[c], s[q, c])
                if k > most:
                    yield given(hits)
                    continue
                held.append(hits)
                size += len(q)
            if size > 4 * k * len(block) + HELD:
                held = [cut(held)]
                size = len(held[0][0])
        if held:
            yield given(cut(held))

    return run


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of every query with their rank from 1; NaN never ranks."""
    return _with_ranks(hits, k, False)


def _with_ranks(hits: DataFrame, k: int, every: bool) -> DataFrame:
    """Without the condition on ranks if ``every`` hit is within k: where nobody asks
    for ranks, Spark then leaves out the sort."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "ordinal", "row")
    placed = hits.where(~F.isnan("score")).withColumn("rank", F.row_number().over(w))
    return placed if every else placed.where(F.col("rank") <= k)


def search(rows: DataFrame, queries: list[tuple[int, object]], *, k: int, metric: str | Metric, dim: int, every: bool = False) -> DataFrame:
    """Hits of ``queries`` (id, vector) in ``rows``, by matrix products; ``every`` says
    that there are no more than k rows."""
    metric = Metric.parse(metric)
    ready = [(i, prepare_query(q, dim, metric, i)) for i, q in queries]  # checked even if k is 0
    spark = rows.sparkSession
    if not ready or k <= 0:
        return spark.createDataFrame([], HITS + ", rank int")
    source = rows.select("segment_id", "ordinal", "row", "id", "vector")
    out = None
    # Fewer queries at once where k is larger, so that a task can hold their lists.
    step = min(BROADCAST, HELD // k) if k <= HELD // BLOCK else BROADCAST
    for lo in range(0, len(ready), step):
        part = ready[lo : lo + step]
        found = source.mapInArrow(_scan([q for _, q in part], [i for i, _ in part], k, metric, dim), HITS)
        out = found if out is None else out.unionByName(found)
    return _with_ranks(out, k, every)


def in_blocks(queries, run) -> DataFrame:
    """Hits of ``run`` over a list of queries, or over a frame (query_id, query) of
    any size: the driver holds one block of BROADCAST queries at a time, and the
    hits of every block but a single one are written before the next is read."""
    if not isinstance(queries, DataFrame):
        return run(list(queries))
    spark = queries.sparkSession
    rows = queries.select("query_id", "query").toLocalIterator()
    blocks = itertools.batched(((r["query_id"], r["query"]) for r in rows), BROADCAST)
    first = run(list(next(blocks, ())))
    second = next(blocks, None)
    if second is None:
        return first
    folder = scratch(spark, "knn")
    first.write.parquet(f"{folder}/block=0")
    for n, block in enumerate(itertools.chain((second,), blocks), 1):
        run(list(block)).write.parquet(f"{folder}/block={n}")
    return spark.read.schema(first.schema).parquet(folder)


def search_frame(rows: DataFrame, queries: DataFrame, *, k: int, metric: str | Metric, dim: int) -> DataFrame:
    """As ``search``, for a frame of queries (query_id, query)."""
    return in_blocks(queries, lambda block: search(rows, block, k=k, metric=metric, dim=dim))


#: Distance within which ``search_close`` is certain, width of its cells, and axes.
CLOSE, WIDTH, AXES = 5e-3, 4e-2, 8
#: Squared lengths of stored unit vectors stay below this in single precision.
UNIT = 1 + 2e-6


def _projected(m: np.ndarray, dim: int) -> np.ndarray:
    """Places of vectors on fixed orthonormal axes: no two of them are further apart
    there than the vectors are."""
    axes = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, min(AXES, dim))))[0]
    return m @ axes


def _keys(cells: np.ndarray) -> np.ndarray:
    """A number for each row of integers; rows that share it by chance only cost."""
    out = np.zeros(len(cells), np.uint64)
    for c in cells.T.astype(np.int64).view(np.uint64):
        out = (out ^ c) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _matrix(column, dim: int) -> np.ndarray:
    whole = np.asarray(column.value_lengths().fill_null(-1)) == dim
    if not whole.all():
        raise ValueError(f"a vector has not {dim} components")
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _row_cells(dim: int):
    def run(stream):
        for batch in stream:
            m = _matrix(batch.column(4), dim)
            fits = np.einsum("ij,ij->i", m, m) <= UNIT  # not for NaN either
            cells = np.floor(_projected(np.where(fits[:, None], m, 0.0), dim) / WIDTH)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_keys(cells)), pa.array(fits)], names=[*batch.schema.names, "cell", "fits"])

    return run


def _query_cells(dim: int, metric: Metric):
    def run(stream):
        for batch in stream:
            names = batch.column(0).to_pylist()
            vectors = batch.column(1).to_pylist()
            m = np.array([prepare_query(q, dim, metric, i) for i, q in zip(names, vectors)], np.float64).reshape(-1, dim)
            at = _projected(m, dim)
            low, high = np.floor((at - CLOSE - 1e-9) / WIDTH), np.floor((at + CLOSE + 1e-9) / WIDTH)
            owner, cells = np.arange(len(m)), low
            for axis in range(at.shape[1]):  # both cells where a reach crosses their border
                two = np.flatnonzero(high[owner, axis] != low[owner, axis])
                more = cells[two].copy()
                more[:, axis] = high[owner[two], axis]
                owner, cells = np.r_[owner, owner[two]], np.concatenate([cells, more])
            order = np.argsort(owner, kind="stable")
            ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(m)))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(_keys(cells[order])))
            unit = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, dim, dtype=np.int32)), pa.array(m.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), unit, lists], names=["query_id", "query", "cells"])

    return run


def search_close(rows: DataFrame, queries: DataFrame, *, k: int, dim: int) -> DataFrame:
    """As ``search_frame`` by cosine, for very many queries that have close neighbours
    among the rows: their hits come from a join on cells of a grid, and work grows
    with the rows and queries, not with their product. The k best rows found in
    the cells within CLOSE of a query are its hits if the last of them is so near
    that no row beyond could rank before it; all other queries scan every row."""
    metric, spark = Metric.COSINE, rows.sparkSession
    queries = queries.select("query_id", "query")
    folder = scratch(spark, "close")
    source = rows.select("segment_id", "ordinal", "row", "id", "vector")
    schema = "segment_id long, ordinal int, row long, id long, vector array<float>"
    source.mapInArrow(_row_cells(dim), schema + ", cell long, fits boolean").write.parquet(f"{folder}/rows")
    placed = spark.read.parquet(f"{folder}/rows")
    if k <= 0 or not placed.where("not fits").isEmpty():
        return search_frame(rows, queries, k=k, metric=metric, dim=dim)
    # Of equal vectors only the first k can be among the hits.
    w = Window.partitionBy("cell", "vector").orderBy("ordinal", "row")
    few = placed.drop("fits").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
    asked = queries.mapInArrow(_query_cells(dim, metric), "query_id long, query array<double>, cells array<long>")
    pairs = asked.select("query_id", "query", F.explode("cells").alias("cell")).join(few, "cell")
    hits = ranked(pairs.select("query_id", "segment_id", "ordinal", "row", "id", V.dot("query", "vector").alias("score")), k)
    hits.write.parquet(f"{folder}/hits")
    hits = spark.read.schema(hits.schema).parquet(f"{folder}/hits")
    # A row beyond CLOSE has |q - x|^2 = |q|^2 + |x|^2 - 2 q.x above CLOSE^2.
    sure = hits.where((F.col("rank") == k) & (F.col("score") > (1 + UNIT - CLOSE**2) / 2)).select("query_id")
    rest = queries.join(sure, "query_id", "left_anti")
    if rest.isEmpty():
        return hits
    return hits.join(sure, "query_id", "left_semi").unionByName(search_frame(rows, rest, k=k, metric=metric, dim=dim))


def search_expressions(rows: DataFrame, queries: DataFrame, *, k: int, metric: str | Metric) -> DataFrame:
    """The defining form: every query of ``queries`` (query_id, query) against
    every row, a block of at most BROADCAST queries at a time."""
    metric = Metric.parse(metric)
    schema = queries.select("query_id", "query").schema

    def run(block):
        asked = F.broadcast(rows.sparkSession.createDataFrame(block, schema))
        scored = rows.join(asked).select("query_id", "segment_id", "ordinal", "row", "id", V.score(metric, "query", "vector").alias("score"))
        return ranked(scored.where("score is not null"), k)

    return in_blocks(queries, run)


def above(hits: DataFrame, least: float) -> DataFrame:
    """The hits that score ``least`` or more; ranks stay as they are."""
    return hits.where(F.col("score") >= least)


def stored_rows(df: DataFrame, *, id_col: str, vector_col: str, metric: str | Metric, dim: int, segment_id=0, ordinal=0) -> DataFrame:
    """Vector rows as a segment holds them: validated, of unit length for cosine,
    numbered by id."""
    metric = Metric.parse(metric)
    good = df.where(V.problem(vector_col, dim, metric).isNull())
    vector = V.normalize(vector_col) if metric.normalizes else F.col(vector_col)
    return good.select(F.lit(segment_id).cast("long").alias("segment_id"), F.lit(ordinal).cast("int").alias("ordinal"), F.col(id_col).alias("row"), F.col(id_col).alias("id"), vector.alias("vector"))


def attach(hits: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Late materialisation: further columns of the rows that were hit, fetched by
    (segment_id, row) after ranking; the hits, k per query, are the broadcast side
    while they are few."""
    wanted = rows.select("segment_id", "row", *columns)
    few = hits.limit(100_001).count() <= 100_000
    keys = F.broadcast(hits) if few else hits
    return wanted.join(keys, ["segment_id", "row"])


def recall(found: DataFrame, truth: DataFrame, *, k: int) -> DataFrame:
    """One row: hits in common over queries times k."""
    key = ["query_id", "segment_id", "row"]
    both = found.select(*key).distinct().join(truth.select(*key).distinct(), key).count()
    n = truth.select("query_id").distinct().count()
    return found.sparkSession.createDataFrame([(n, k, both, both / (n * k) if n * k else 0.0)], "queries long, k int, common long, recall double")
