"""Hierarchical navigable small-world graphs, one per segment.

Building is sequential inside a segment, hence deterministic, and parallel
across segments. Distances are taken to a whole neighbour list at a time. A
distance is minus a score, so nearer is smaller for every metric.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import ConfigError, Corrupt
from ..metric import Metric
from ..plans.scratch import scratch
from .knn import HITS, in_blocks, prepare_query, ranked

TOP_LEVEL = 16
#: Auto mode scans segments of fewer rows than this.
SMALL = 1024
#: Numbers that one step of building or searching works on at once.
STEP = 1 << 21


@dataclass(frozen=True)
class HnswParams:
    m: int = 16
    m0: int = 32
    ef_construction: int = 200
    seed: int = 0x5EEDCAFE

    def __post_init__(self):
        if not 2 <= self.m <= 256 or not self.m <= self.m0 <= 1024 or self.ef_construction < self.m:
            raise ConfigError("need 2 <= m <= 256, m <= m0 <= 1024 and ef_construction >= m")

    @classmethod
    def with_m(cls, m: int, **more) -> HnswParams:
        return cls(m=m, m0=2 * m, **more)


@dataclass
class Graph:
    """Adjacency of every layer, and where searches begin."""

    links: list[list[list[int]]]  # by node, by layer
    entry: int
    top: int
    m: int
    m0: int

    def neighbors(self, node: int, layer: int) -> list[int]:
        return self.links[node][layer] if layer < len(self.links[node]) else []


def assign_levels(n: int, params: HnswParams, segment: int = 0) -> np.ndarray:
    """floor(-ln U / ln m), at most TOP_LEVEL, for all nodes from one stream; every
    segment has a stream of its own, or all would repeat the chance of one."""
    u = 1.0 - np.random.default_rng([params.seed, segment % 2**64] if segment else params.seed).random(n)
    return np.minimum(TOP_LEVEL, np.floor(-np.log(u) / math.log(params.m))).astype(int)


class _Space:
    def __init__(self, rows: np.ndarray, metric: Metric):
        self.rows, self.l2 = np.ascontiguousarray(rows, np.float32), metric is Metric.L2

    def near(self, q: np.ndarray, nodes) -> np.ndarray:
        x = self.rows[nodes]
        if self.l2:
            x = x - q
            return np.einsum("ij,ij->i", x, x)
        return -(x @ q)


def _greedy(space, graph_links, q, at, dist, layer):
    """Move to a strictly nearer neighbour until none is nearer."""
    while True:
        around = [x for x in graph_links(at, layer) if 0 <= x < len(space.rows)]
        if not around:
            return at, dist
        d = space.near(q, around)
        k = int(np.argmin(d))
        if not d[k] < dist:
            return at, dist
        at, dist = around[k], float(d[k])


def _beam(space, graph_links, q, seeds, ef, layer, n):
    """The ef nearest nodes found from ``seeds`` [(distance, node)], sorted."""
    seen = {x for _, x in seeds}
    frontier = list(seeds)
    heapq.heapify(frontier)
    kept = [(-d, -x) for d, x in seeds]
    heapq.heapify(kept)
    while len(kept) > ef:
        heapq.heappop(kept)
    while frontier:
        dist, at = heapq.heappop(frontier)
        if len(kept) >= ef and dist > -kept[0][0]:
            break
        fresh = [x for x in graph_links(at, layer) if x not in seen and 0 <= x < n]
        if not fresh:
            continue
        seen.update(fresh)
        for d, x in zip(space.near(q, fresh).tolist(), fresh):
            if len(kept) < ef:
                heapq.heappush(kept, (-d, -x))
            elif d < -kept[0][0]:
                heapq.heapreplace(kept, (-d, -x))
            else:
                continue
            heapq.heappush(frontier, (d, x))
    return sorted((-d, -x) for d, x in kept)


def _distances(l2: bool, near: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Of every list of vectors (lists, length, dim) to its own base (lists, dim)."""
    if l2:
        x = near - base[:, None, :]
        return np.einsum("ijk,ijk->ij", x, x)
    return -np.matmul(near, base[:, :, None])[:, :, 0]


def _select(space: _Space, nodes: np.ndarray, d: np.ndarray, most: int) -> np.ndarray:
    """Of each list of candidates (sorted, distance inf where there is none) at most
    ``most``, -1 after them: a candidate is kept unless one kept already is strictly
    nearer to it than the base is. All lists take a step at once."""
    vectors, lists = space.rows[nodes], np.arange(len(nodes))
    open_, places = d < np.inf, np.arange(nodes.shape[1])
    kept = np.full((len(nodes), most), -1, np.int32)
    for step in range(most):
        lists = at = lists[open_[lists].any(axis=1)]
        if not len(at):
            break
        pick = open_[at].argmax(axis=1)
        kept[at, step] = nodes[at, pick]
        here = vectors if len(at) == len(vectors) else vectors[at]
        between = _distances(space.l2, here, here[np.arange(len(at)), pick])
        open_[at] &= ~(between < d[at]) & (places > pick[:, None])
    return kept


def _nearest_before(space: _Space, members: np.ndarray, lo: int, hi: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ef nearest of the members before each of members[lo:hi], sorted."""
    own, known = space.rows[members[lo:hi]], space.rows[members[: hi - 1]]
    d = -(own @ known.T)
    if space.l2:
        d = 2 * d + np.einsum("ij,ij->i", known, known)
    d[np.arange(hi - 1) >= np.arange(lo, hi)[:, None]] = np.inf
    few = min(ef, hi - 1)
    best = np.argpartition(d, few - 1, axis=1)[:, :few] if few < hi - 1 else np.broadcast_to(np.arange(hi - 1), d.shape)
    best = np.sort(best, axis=1)
    none = best >= np.arange(lo, hi)[:, None]
    d = np.where(none, np.inf, _distances(space.l2, known[best], own))
    order = np.argsort(d, axis=1, kind="stable")
    return members[np.take_along_axis(best, order, axis=1)], np.take_along_axis(d, order, axis=1)


def _linked(space: _Space, members: np.ndarray, most: int, ef: int) -> list[list[int]]:
    """Neighbours of the members of one layer, inserted in order. What a node chooses
    depends on the nodes before it only, and what happens to its list later on the
    nodes that choose it, so each is done for many nodes at once."""
    n = len(members)
    lists = np.full((n, most + 1), -1, np.int32)
    dim = max(1, space.rows.shape[1])
    lo = 1
    while lo < n:
        step = max(1, min(128, STEP // (min(ef, lo + 128) * dim), STEP // (lo + 128)))
        hi = min(n, lo + step)
        lists[lo:hi, :most] = _select(space, *_nearest_before(space, members, lo, hi, ef), most)
        lo = hi
    place = np.full(len(space.rows), -1, np.int64)
    place[members] = np.arange(n)
    size = (lists >= 0).sum(axis=1)
    by, slot = np.nonzero(lists >= 0)
    chosen = place[lists[by, slot]]
    order = np.lexsort((by, chosen))  # who chose a node, in order of insertion
    chosen, by = chosen[order], by[order]
    turn = np.arange(len(chosen)) - np.searchsorted(chosen, chosen)
    order = np.argsort(turn, kind="stable")
    chosen, by, turn = chosen[order], by[order], turn[order]
    for k in range(int(turn[-1]) + 1 if len(turn) else 0):
        a, b = np.searchsorted(turn, [k, k + 1])
        at = chosen[a:b]
        lists[at, size[at]] = members[by[a:b]]
        size[at] += 1
        full = at[size[at] > most]
        for x in (full[i : i + 512] for i in range(0, len(full), 512)):
            pool = np.sort(lists[x], axis=1)
            d = _distances(space.l2, space.rows[pool], space.rows[members[x]])
            order = np.argsort(d, axis=1, kind="stable")
            lists[x, :most] = _select(space, np.take_along_axis(pool, order, axis=1), np.take_along_axis(d, order, axis=1), most)
            lists[x, most] = -1
            size[x] = (lists[x] >= 0).sum(axis=1)
    return [own[:k] for own, k in zip(lists.tolist(), size.tolist())]


def build_graph(rows: np.ndarray, metric: str | Metric, params: HnswParams = HnswParams(), segment: int = 0) -> Graph:
    """Insert all rows in order. Zero or one row is fine. The ``ef_construction``
    candidates of a node are the nearest ones before it on its layer, found by matrix
    products, which is what a search of the graph so far aims at."""
    n = len(rows)
    space = _Space(rows, Metric.parse(metric))
    levels = assign_levels(n, params, segment)
    links: list[list[list[int]]] = [[] for _ in range(n)]
    for layer in range(int(levels.max()) + 1 if n else 0):
        members = np.flatnonzero(levels >= layer)
        for node, own in zip(members.tolist(), _linked(space, members, params.m0 if layer == 0 else params.m, params.ef_construction)):
            links[node].append(own)
    entry = int(np.argmax(levels)) if n else 0
    return Graph(links, entry, int(levels[entry]) if n else 0, params.m, params.m0)


def _table(graph: Graph, n: int, layer: int, most: int) -> np.ndarray:
    out = np.full((n, most), -1, np.int32)
    for node, layers in enumerate(graph.links):
        if layer < len(layers):
            out[node, : len(layers[layer])] = layers[layer]
    return out


def search_many(graph: Graph, rows: np.ndarray, metric: str | Metric, queries: np.ndarray, k: int, ef: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the hits that ``search_graph`` finds for each query, best
    first: all queries of a block take a step at once."""
    n, found = len(rows), []
    if n and k > 0:
        space, ef = _Space(rows, Metric.parse(metric)), max(ef, min(k, n), 1)
        tables = [_table(graph, n, layer, graph.m0 if layer == 0 else graph.m) for layer in range(graph.top + 1)]
        step = max(1, min(1024, 8 * STEP // n, STEP // (graph.m0 * max(1, rows.shape[1])), STEP // ef))
        for lo in range(0, len(queries), step):
            q, nodes, d = _walk(space, graph, tables, np.asarray(queries[lo : lo + step], np.float32), ef, n)
            nodes, d = nodes[:, :k], d[:, :k]
            real = nodes >= 0
            found.append((lo + np.nonzero(real)[0], nodes[real], -d[real].astype(np.float64)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def _walk(space, graph, tables, q, ef, n):
    every = np.arange(len(q))
    at = np.full(len(q), graph.entry)
    dist = _distances(space.l2, space.rows[at][:, None, :], q)[:, 0]
    for table in tables[:0:-1]:  # to a strictly nearer neighbour until none is nearer
        active = every
        while len(active):
            around = table[at[active]]
            d = np.where(around < 0, np.inf, _distances(space.l2, space.rows[around], q[active]))
            j = d.argmin(axis=1)
            least = d[np.arange(len(j)), j]
            nearer = least < dist[active]
            active, j = active[nearer], j[nearer]
            at[active], dist[active] = around[nearer, j], least[nearer]
    # Of each query the ef nearest nodes so far, sorted, and whether they were left already.
    kept, far, left = np.full((len(q), ef), -1), np.full((len(q), ef), np.inf, np.float32), np.ones((len(q), ef), bool)
    kept[:, 0], far[:, 0], left[:, 0] = at, dist, False
    seen = np.zeros((len(q), n), bool)
    seen[every, at] = True
    active = every
    while len(active := active[~left[active].all(axis=1)]):
        j = (~left[active]).argmax(axis=1)
        left[active, j] = True
        around = tables[0][kept[active, j]]
        fresh = (around >= 0) & ~seen[active[:, None], around]
        owner, slot = np.nonzero(fresh)
        seen[active[owner], around[owner, slot]] = True
        d = np.where(fresh, _distances(space.l2, space.rows[around], q[active]), np.inf).astype(np.float32)
        some = (d < far[active, -1:]).any(axis=1)
        moved, around, d = active[some], around[some], d[some]
        nodes, d = np.concatenate([kept[moved], np.where(d < np.inf, around, -1)], axis=1), np.concatenate([far[moved], d], axis=1)
        gone = np.concatenate([left[moved], nodes[:, ef:] < 0], axis=1)
        order = np.argsort(d, axis=1, kind="stable")[:, :ef]
        kept[moved], far[moved], left[moved] = (np.take_along_axis(x, order, axis=1) for x in (nodes, d, gone))
    order = np.lexsort((kept, far), axis=1)  # of equally near ones the lower first
    return every, np.take_along_axis(kept, order, axis=1), np.take_along_axis(far, order, axis=1)


def search_graph(graph: Graph, rows: np.ndarray, metric: str | Metric, query: np.ndarray, k: int, ef: int = 64) -> list[tuple[int, float]]:
    """(row, score) of the k nearest rows found, best first."""
    n = len(rows)
    if not n or k <= 0:
        return []
    space = _Space(rows, Metric.parse(metric))
    q = np.asarray(query, np.float32)
    at, dist = graph.entry, float(space.near(q, [graph.entry])[0])
    for layer in range(graph.top, 0, -1):
        at, dist = _greedy(space, graph.neighbors, q, at, dist, layer)
    found = _beam(space, graph.neighbors, q, [(dist, at)], max(ef, min(k, n), 1), 0, n)
    return [(x, -d) for d, x in found[:k]]


def validate_graph(graph: Graph, n: int) -> None:
    """Raise Corrupt unless the graph fits a segment of n rows."""
    fine = 2 <= graph.m <= graph.m0 <= 1024 and 0 <= graph.top < 64 and len(graph.links) == n
    if not fine or n and not (0 <= graph.entry < n and len(graph.links[graph.entry]) == graph.top + 1):
        raise Corrupt("the graph does not fit its segment")
    for node, layers in enumerate(graph.links):
        for layer, around in enumerate(layers):
            if len(around) > (graph.m0 if layer == 0 else graph.m) or any(not 0 <= x < n or x == node for x in around):
                raise Corrupt(f"node {node} has impossible neighbours on layer {layer}")


ADJACENCY = "segment_id long, node int, layer int, neighbors array<int>"


def build_graphs(rows: DataFrame, metric: str | Metric, params: HnswParams = HnswParams()) -> DataFrame:
    """Adjacency rows (segment_id, node, layer, neighbors), a graph per segment;
    node -1 carries [entry, top, m, m0]. A segment is one task, so segments
    should hold tens of thousands of rows at most."""
    metric = Metric.parse(metric)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        column = table.column("vector").combine_chunks()
        n = table.num_rows
        seg = table.column("segment_id")[0].as_py()
        g = build_graph(np.asarray(column.flatten(), np.float32).reshape(n, -1), metric, params, seg or 0)
        out = [(-1, 0, [g.entry, g.top, g.m, g.m0])] + [(node, layer, x) for node, layers in enumerate(g.links) for layer, x in enumerate(layers)]
        return pa.Table.from_arrays(
            [pa.array([seg] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.list_(pa.int32()))],
            names=["segment_id", "node", "layer", "neighbors"],
        )

    return rows.select("segment_id", "row", "vector").groupBy("segment_id").applyInArrow(run, ADJACENCY)


def stored_graphs(rows: DataFrame, metric: str | Metric, params: HnswParams = HnswParams()) -> DataFrame:
    """As ``build_graphs``, built and written now: a search reads graphs once for every
    block of queries."""
    folder = scratch(rows.sparkSession, "graphs")
    build_graphs(rows, metric, params).write.parquet(folder)
    return rows.sparkSession.read.schema(ADJACENCY).parquet(folder)


def graph_of(table: pa.Table) -> Graph:
    """A graph from its adjacency rows."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("node", "layer", "neighbors"))), key=lambda x: x[:2])
    if not rows or rows[0][0] != -1 or len(rows[0][2]) != 4:
        raise Corrupt("a graph has no header")
    entry, top, m, m0 = rows[0][2]
    links: list[list[list[int]]] = []
    for node, layer, around in rows[1:]:
        if node == len(links):
            links.append([])
        if node != len(links) - 1 or layer != len(links[node]):
            raise Corrupt("a graph lacks nodes or layers")
        links[node].append(around)
    return Graph(links, entry, top, m, m0)


def search_graphs(rows: DataFrame, graphs: DataFrame, queries, *, k: int, ef: int, metric: str | Metric, dim: int) -> DataFrame:
    """Approximate hits of a list of (id, vector) or a frame (query_id, query):
    every segment's graph is searched in one task."""
    return in_blocks(queries, lambda block: _search_block(rows, graphs, block, k, ef, metric, dim))


def _search_block(rows, graphs, queries, k, ef, metric, dim) -> DataFrame:
    metric = Metric.parse(metric)
    names = np.array([i for i, _ in queries], np.int64)
    asked = np.array([prepare_query(q, dim, metric, i) for i, q in queries], np.float32).reshape(-1, dim)

    def run(vectors: pa.Table, adjacency: pa.Table) -> pa.Table:
        out = []
        if vectors.num_rows and adjacency.num_rows:
            vectors = vectors.sort_by("row")
            n = vectors.num_rows
            m = np.asarray(vectors.column("vector").combine_chunks().flatten(), np.float32).reshape(n, -1)
            g = graph_of(adjacency)
            validate_graph(g, n)
            seg, ordinal = vectors.column("segment_id")[0].as_py(), vectors.column("ordinal")[0].as_py()
            ids, numbers = (np.asarray(vectors.column(c).combine_chunks()) for c in ("id", "row"))
            of, r, score = search_many(g, m, metric, asked, k, ef)
            out = [names[of], np.full(len(of), seg), np.full(len(of), ordinal), numbers[r], ids[r], score]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out or [[]] * 6, types)], names=["query_id", "segment_id", "ordinal", "row", "id", "score"])

    hits = rows.select("segment_id", "ordinal", "row", "id", "vector").groupBy("segment_id").cogroup(graphs.groupBy("segment_id")).applyInArrow(run, HITS)
    return ranked(hits, k)
