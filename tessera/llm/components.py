"""Connected components of an edge table: in one task where the edges are few,
by alternating star contraction beyond that."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workspace
from .kernels import release

#: Edges (16 bytes each) that one task may contract; more go through rounds of shuffles.
TASK_EDGES = 1 << 20
#: Rows in a batch that the task returns.
BATCH_ROWS = 1 << 16


def connected_components(edges: DataFrame, *, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: longs); a component
    is named by its smallest node.

    Distinct edges are counted. Up to TASK_EDGES are read and contracted by one
    task, whose input is bounded by that limit at any size of the table; more are
    contracted in rounds of shuffles until so few are left or all are stars. A round
    has about ten shuffles, which cost far more than their rows where edges are few.

    Each round links every node's larger neighbours to the smallest node around
    it (large star) and then its smaller neighbours likewise (small star). Both
    steps are partial aggregations and equi-joins. Minima are dealt anew before
    they are joined, so that both sides of a join are plain shuffles and adaptive
    execution can split a hub's edges over several tasks. Rounds end when the edges
    are stars. Null and
    equal ends are ignored; an empty table gives an empty result.
    """
    workspace.ship(edges.sparkSession)
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = workspace.materialise(now, "cc-edges")
    state, left = _state(now), rounds
    while state[0] > TASK_EDGES:
        if not left:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        left -= 1
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = workspace.dealt_apart(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "m", "u")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = workspace.dealt_apart(large.groupBy("u").agg(F.min("v").alias("m")), "m", "u")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = workspace.materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
        new = _state(now)
        if new == state and not _chained(now):
            break
        state = new
    else:
        return workspace.materialise(now.coalesce(1).mapInArrow(_contract, "node long, component long"), "cc-nodes")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v), rising, and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    up = np.arange(len(nodes))
    while len(a):
        # Roots are hooked to the smallest root beside them, then all paths are cut short.
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
        while (up[up] != up).any():
            up = up[up]
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[up]


def _contract(stream):
    release()
    parts = list(stream)
    u, v = (np.concatenate([np.zeros(0, np.int64), *(np.asarray(p.column(k)) for p in parts)]) for k in (0, 1))
    nodes, roots = smallest_reachable(u, v)
    for k in range(0, len(nodes), BATCH_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + BATCH_ROWS]), pa.array(roots[k : k + BATCH_ROWS])], names=["node", "component"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first())


def _chained(edges: DataFrame) -> bool:
    """Whether some node is linked upwards and downwards or to two roots."""
    up = edges.select(F.col("u").alias("v")).distinct()
    return not edges.join(up, "v", "left_semi").isEmpty() or not edges.groupBy("u").count().where("count > 1").isEmpty()
