"""Exact top-k inner-product search by tiled matrix products.

Vectors are quantised to floor(256 * x). Queries are taken in tiles of bounded
size; each tile is broadcast and multiplied with every shard of the vectors in
blocks, each block keeps a partial selection, each task merges its blocks, and
the per-query lists of all tasks are merged in a tree.

Defined results
* vectors that are null, empty or hold a null or non-finite component take no
  part, neither as queries nor as candidates; a null vec_id takes no part;
* only vectors of a query's own length are its candidates;
* ties go to the smaller vec_id; rows that share a vec_id with the query are
  never its candidates; rows repeated with one vec_id are candidates of their
  own, and a query given several times is asked once, with its smallest vector;
* a query with fewer candidates than k gets them all; an empty table gives an
  empty result;
* products beyond 2**53 are computed with exact integers and limited to the
  range of a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import workspace

K = 5
EVERY = 50
#: Queries in one broadcast tile (4,096 x 64 components: 2 MB) and rows in a block.
TILE = 4096
BLOCK = 4096
_LONG = (1 << 63) - 1


def _matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (row numbers, quantised float64 matrix) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    lengths = np.asarray(column.value_lengths().fill_null(0))
    values = np.asarray(flat.fill_null(float("nan")).cast(pa.float64()))
    ends = np.cumsum(lengths)
    out = {}
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        m = values[(ends[rows] - n)[:, None] + np.arange(n)]
        good = np.isfinite(m).all(axis=1)
        if good.any():
            with np.errstate(over="ignore"):
                q = np.floor(256.0 * m[good])
            fine = np.isfinite(q).all(axis=1)
            if fine.any():
                out[int(n)] = (rows[good][fine], q[fine])
    return out


def _select(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query the k best of (score desc, id asc): (query number, id, score)."""
    n_q, n = scores.shape
    order = np.argsort(ids, kind="stable")
    ids, scores = ids[order], scores[:, order]
    allowed = ids[None, :] != own[:, None]
    if scores.dtype == object:
        out = []
        for q in range(n_q):
            best = sorted((-s, i) for s, i, a in zip(scores[q], ids.tolist(), allowed[q]) if a)[:k]
            out += [(q, i, max(-_LONG - 1, min(_LONG, -s))) for s, i in best]
        a = np.array(out, dtype=np.int64).reshape(-1, 3)
        return a[:, 0], a[:, 1], a[:, 2]
    scores = np.where(allowed, scores, -np.inf)
    if n > k:
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        above = scores > least
        ties = (scores == least) & allowed
        room = k - above.sum(axis=1, keepdims=True)
        chosen = (above & allowed) | (ties & (np.cumsum(ties, axis=1) <= room))
    else:
        chosen = allowed
    q, c = np.nonzero(chosen)
    return q, ids[c], scores[q, c].astype(np.int64)


def _products(queries: np.ndarray, block: np.ndarray) -> np.ndarray:
    most = np.abs(queries).max(initial=0.0) * np.abs(block).max(initial=0.0) * queries.shape[1]
    if most < 2.0**53:
        return queries @ block.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], dtype=object)
    return whole(queries) @ whole(block).T


_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _top(q, v, s, k):
    """The k best rows of every query among the rows given."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    keep = place < k
    return q[keep], v[keep], s[keep]


def _scan(tile, k):
    """Task: merge the partial selections of all blocks of a shard."""

    def run(stream):
        held = None
        for batch in stream:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                ids = np.asarray(piece.column(0))
                for n, (rows, block) in _matrix(piece.column(1)).items():
                    if n not in tile.value:
                        continue
                    names, queries = tile.value[n]
                    for lo in range(0, len(names), 512):
                        q, v, s = _select(_products(queries[lo : lo + 512], block), ids[rows], names[lo : lo + 512], k)
                        new = (names[lo : lo + 512][q], v, s)
                        held = new if held is None else tuple(np.concatenate(x) for x in zip(held, new))
                if held is not None and len(held[0]) > 4 * k * TILE:
                    held = _top(*held, k)
        if held is not None:
            q, v, s = _top(*held, k)
            for lo in range(0, len(q), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 65536]) for x in (q, v, s)], schema=_OUT)

    return run


def _best(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_topk(vectors: DataFrame, queries: DataFrame | None = None, *, k: int = K, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of ``vectors`` for every
    row of ``queries`` (default: the vectors whose id is divisible by 50)."""
    spark = vectors.sparkSession
    workspace.ship(spark)
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where("vec_id is not null and embedding is not null")
    rows = pick(vectors)
    asked = pick(queries) if queries is not None else rows.where(F.col("vec_id") % EVERY == 0)
    asked = asked.where("size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    asked = workspace.materialise(asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "topk-queries")
    cuts = _tile_bounds(asked, tile)
    parts = []
    for lo, hi in cuts:
        table = asked.where((F.col("vec_id") >= lo) & (F.col("vec_id") <= hi)).toArrow()  # one tile, never more than its bound
        names = np.asarray(table.column("vec_id").combine_chunks())
        blocks = {n: (names[r], m) for n, (r, m) in _matrix(table.column("embedding")).items()}
        shared = spark.sparkContext.broadcast(blocks)
        parts.append(workspace.materialise(_merge(rows.mapInArrow(_scan(shared, k), "query_id long, vec_id long, score long"), k), "topk-tile"))
        shared.unpersist()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _merge(lists: DataFrame, k: int) -> DataFrame:
    """Two levels: lists meet in groups first, and the winners of the groups then meet."""
    grouped = lists.withColumn("branch", F.spark_partition_id() % 16)
    return _best(_best(grouped, ["query_id", "branch"], k).drop("rank"), ["query_id"], k).select("query_id", "rank", "vec_id", "score")


def _tile_bounds(asked: DataFrame, tile: int) -> list[tuple[int, int]]:
    """Id ranges that hold at most ``tile`` queries each (ids are distinct)."""
    n = asked.count()
    if not n:
        return []
    low, high = asked.agg(F.min("vec_id"), F.max("vec_id")).first()
    if n <= tile:
        return [(low, high)]
    done, todo = [], [(low, high, n)]
    while todo:
        lo, hi, m = todo.pop()
        if m <= tile:
            if m:
                done.append((lo, hi))
            continue
        cuts = min(256, 2 * (m // tile + 1))
        width = (hi - lo) // cuts + 1
        inside = asked.where((F.col("vec_id") >= lo) & (F.col("vec_id") <= hi))
        counts = inside.groupBy(F.floor((F.col("vec_id") - F.lit(lo)) / F.lit(width)).alias("cut")).count().collect()
        todo += [(lo + int(r["cut"]) * width, min(hi, lo + (int(r["cut"]) + 1) * width - 1), r["count"]) for r in counts]
    return sorted(done)


ORACLE_SQL = r"""
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from e q join e c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v)),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
