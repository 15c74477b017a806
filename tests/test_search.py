import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.errors import ConfigError, Corrupt, DimensionMismatch, NotFinite, ZeroNorm
from tessera.metric import Metric
from tessera.operators import hnsw, knn
from tessera.plans.index import GraphIndex
from tessera.plans.store import Store, StoreConfig
from tessera.sources.synthetic import clustered


def frame(spark, m, segments=1):
    rows = [(i % segments, i % segments, i, i, [float(x) for x in v]) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "segment_id long, ordinal int, row long, id long, vector array<float>")


def truth(m, q, metric, k):
    m, q = m.astype(float), np.asarray(q, float)
    if metric == "l2":
        s = -((m - q) ** 2).sum(1)
    else:
        s = m @ q / (np.linalg.norm(q) if metric == "cosine" else 1)
    return np.lexsort((np.arange(len(m)), -s))[:k].tolist()


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_exact_ranking(spark, metric):
    m = np.random.default_rng(2).standard_normal((700, 37)).astype(np.float32)
    if metric == "cosine":
        m /= np.linalg.norm(m, axis=1, keepdims=True)
    asked = [(i, q) for i, q in enumerate(np.random.default_rng(3).standard_normal((20, 37)))]
    hits = knn.search(frame(spark, m, 3).repartition(4), asked, k=10, metric=metric, dim=37).collect()
    for i, q in asked:
        assert [r["id"] for r in sorted((r for r in hits if r["query_id"] == i), key=lambda r: r["rank"])] == truth(m, q, metric, 10)


def test_ties_nan_and_k(spark):
    rows = frame(spark, np.array([[1, 0], [1, 0], [float("nan"), 0], [float("inf"), 0], [1, 0]]), 1)
    got = knn.search(rows, [(0, [1.0, 0.0])], k=3, metric="dot", dim=2).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == [(3, float("inf")), (0, 1.0), (1, 1.0)]
    assert knn.search(rows, [(0, [1.0, 0.0])], k=10**9, metric="dot", dim=2).count() == 4
    assert knn.search(rows, [(0, [1.0, 0.0])], k=0, metric="dot", dim=2).count() == 0


def test_queries_are_checked_first(spark):
    rows = frame(spark, np.zeros((0, 2)))
    for bad, error in (([1.0], DimensionMismatch), ([1.0, float("nan")], NotFinite), ([0.0, 0.0], ZeroNorm)):
        with pytest.raises(error):
            knn.search(rows, [(0, bad)], k=0, metric="cosine", dim=2)


def test_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "BROADCAST", 3)
    m = np.random.default_rng(4).standard_normal((50, 4)).astype(np.float32)
    asked = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(8)], "query_id long, query array<float>")
    got = knn.search_frame(frame(spark, m), asked, k=2, metric="l2", dim=4).where("rank = 1").collect()
    assert sorted((r["query_id"], r["id"]) for r in got) == [(i, i) for i in range(8)]


def test_graph_search_finds_clustered_neighbours():
    r = np.random.default_rng(4)
    centers = r.standard_normal((40, 48))
    m = (centers[np.arange(3000) % 40] + 0.35 * r.standard_normal((3000, 48))).astype(np.float32)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    g = hnsw.build_graph(m, "cosine", hnsw.HnswParams(ef_construction=100))
    hnsw.validate_graph(g, len(m))
    q = (centers[np.arange(50) % 40] + 0.35 * r.standard_normal((50, 48))).astype(np.float32)
    found = sum(len({x for x, _ in hnsw.search_graph(g, m, "cosine", v, 10, 128)} & set(truth(m, v, "cosine", 10))) for v in q)
    assert found / 500 >= 0.95
    assert sum(hnsw.search_graph(g, m, "cosine", m[i], 1, 64)[0][0] == i for i in range(0, 3000, 10)) > 297


def test_small_graphs_and_parameters():
    for n in (0, 1, 2):
        m = np.eye(max(n, 1), 4, dtype=np.float32)[:n]
        g = hnsw.build_graph(m, "dot")
        hnsw.validate_graph(g, n)
        assert len(hnsw.search_graph(g, m, "dot", np.ones(4), 5)) == n
    levels = hnsw.assign_levels(100_000, hnsw.HnswParams())
    assert abs((levels >= 1).mean() - 1 / 16) < 0.01 and levels.max() <= 16
    for bad in (dict(m=1), dict(m=8, m0=4), dict(ef_construction=3)):
        with pytest.raises(ConfigError):
            hnsw.HnswParams(**bad)
    assert hnsw.HnswParams.with_m(8).m0 == 16
    broken = hnsw.build_graph(np.eye(3, dtype=np.float32), "dot")
    broken.links[0][0].append(7)
    with pytest.raises(Corrupt):
        hnsw.validate_graph(broken, 3)


def test_graphs_by_segment(spark):
    m = np.random.default_rng(6).standard_normal((600, 16)).astype(np.float32)
    rows = frame(spark, m, 2)
    graphs = hnsw.build_graphs(rows, Metric.L2, hnsw.HnswParams(ef_construction=60))
    asked = [(i, m[i]) for i in range(0, 600, 20)]
    found = hnsw.search_graphs(rows, graphs, asked, k=5, ef=64, metric="l2", dim=16)
    exact = knn.search(rows, asked, k=5, metric="l2", dim=16)
    assert knn.recall(found, exact, k=5).first()["recall"] >= 0.95
    assert sorted(map(tuple, graphs.collect()), key=str) == sorted(map(tuple, hnsw.build_graphs(rows.repartition(3), Metric.L2, hnsw.HnswParams(ef_construction=60)).collect()), key=str)


def test_synthetic_rows_do_not_depend_on_partitions(spark):
    a = {r["id"]: r["vector"] for r in clustered(spark, 20, 4, centers=3).collect()}
    assert len(a) == 20 and a == {r["id"]: r["vector"] for r in clustered(spark, 20, 4, centers=3).coalesce(1).collect()}


def test_close_neighbours_need_no_scan(spark, monkeypatch):
    r = np.random.default_rng(5)
    m = r.standard_normal((400, 12))
    m[100:200] = m[:100]  # the same vectors, and close ones
    m[200:300] = m[:100] + 1e-5 * r.standard_normal((100, 12))
    m = (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)
    rows = frame(spark, m, 3)
    asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "query_id long, query array<float>")
    place = lambda hits: {(x["query_id"], x["rank"]): x["id"] for x in hits.collect()}
    for k in (1, 2, 5):  # the last ones have other close rows, but not five
        want = place(knn.search(rows, [(i, v) for i, v in enumerate(m)], k=k, metric="cosine", dim=12))
        assert place(knn.search_close(rows, asked, k=k, dim=12)) == want and len(want) == 400 * k

    def scan(*_, **__):
        raise AssertionError("every row is scanned")

    monkeypatch.setattr(knn, "search_frame", scan)
    assert len(place(knn.search_close(rows, asked, k=1, dim=12))) == 400
    with pytest.raises(AssertionError, match="scanned"):
        knn.search_close(rows, asked, k=2, dim=12)
    with pytest.raises(AssertionError, match="scanned"):  # a row that is no unit vector
        knn.search_close(frame(spark, 2 * m), asked, k=1, dim=12)


def test_a_store_looks_among_close_rows(spark, tmp_path, monkeypatch):
    m = np.random.default_rng(8).standard_normal((60, 8)).astype(np.float32)
    monkeypatch.setattr(knn, "BROADCAST", 20)
    store = Store.open_or_create(spark, f"{tmp_path}/s", StoreConfig(8, "cosine", 1))
    store.publish(frame(spark, m).select("id", "vector"))
    asked = store.snapshot().rows().select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    monkeypatch.setattr(knn, "search", None)  # as a scan would be
    got = store.search(asked, k=1, mode="exact").collect()
    assert sorted((r["query_id"], r["id"]) for r in got) == [(i, i) for i in range(60)]


def test_large_k_is_handed_on_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(knn, "HELD", 500)
    m = np.random.default_rng(9).standard_normal((300, 4)).astype(np.float32)
    asked = [(i, m[i]) for i in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(100, np.int64)), pa.array(np.zeros(100, np.int32)), pa.array(np.arange(100)), pa.array(np.arange(100)), pa.array(m[:100].tolist(), pa.list_(pa.float32()))], names=["segment_id", "ordinal", "row", "id", "vector"])
    pieces = [b.num_rows for b in knn._scan([q for _, q in asked], list(range(20)), 10**9, Metric.DOT, 4)([batch] * 3)]
    assert max(pieces) <= 500 and sum(pieces) == 20 * 300
    for k in (1, 30, 10**9):
        hits = knn.search(frame(spark, m).repartition(3), asked, k=k, metric="dot", dim=4)
        best = {(r["query_id"], r["rank"]): r["id"] for r in hits.collect()}
        assert best == {(i, n + 1): x for i, q in asked for n, x in enumerate(truth(m, q, "dot", k))}
    counts = knn.search(frame(spark, m), asked, k=300, metric="dot", dim=4, every=True).groupBy("query_id").count()
    assert {r["count"] for r in counts.collect()} == {300} and "Window" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_segments_draw_their_own_levels():
    p = hnsw.HnswParams()
    draws = [hnsw.assign_levels(8192, p, s) for s in (0, 1, 2, -1)]
    assert len({d.tobytes() for d in draws}) == 4 and (draws[1] == hnsw.assign_levels(8192, p, 1)).all()
    # Over many segments the share of level 1 and above comes near 1 / m.
    share = np.concatenate([hnsw.assign_levels(8192, p, s) >= 1 for s in range(100)]).mean()
    assert abs(share - 1 / 16) <= 4 * np.sqrt(1 / 16 * 15 / 16 / 819_200)
    m = np.eye(64, dtype=np.float32)
    assert [len(x) for x in hnsw.build_graph(m, "dot", p, 1).links] != [len(x) for x in hnsw.build_graph(m, "dot", p, 2).links]


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_queries_searched_together_find_the_same(monkeypatch, metric):
    m = np.random.default_rng(11).standard_normal((900, 24)).astype(np.float32)
    if metric == "cosine":
        m /= np.linalg.norm(m, axis=1, keepdims=True)
    g = hnsw.build_graph(m, metric, hnsw.HnswParams(ef_construction=60))
    hnsw.validate_graph(g, len(m))
    asked = np.random.default_rng(12).standard_normal((70, 24)).astype(np.float32)
    for step in (hnsw.STEP, 1 << 12):
        monkeypatch.setattr(hnsw, "STEP", step)
        for k, ef in ((1, 1), (10, 64), (40, 10)):
            of, rows, scores = hnsw.search_many(g, m, metric, asked, k, ef)
            for i, q in enumerate(asked):
                alone = hnsw.search_graph(g, m, metric, q, k, ef)
                assert rows[of == i].tolist() == [r for r, _ in alone]
                assert np.allclose(scores[of == i], [s for _, s in alone], atol=1e-4)
        assert hnsw.build_graph(m, metric, hnsw.HnswParams(ef_construction=60)).links[:2] == g.links[:2]
    assert len(hnsw.search_many(hnsw.build_graph(m[:0], metric), m[:0], metric, asked, 3)[0]) == 0


def test_graphs_are_built_once_for_all_blocks(spark, monkeypatch):
    m = np.random.default_rng(13).standard_normal((200, 8)).astype(np.float32)
    monkeypatch.setattr(knn, "BROADCAST", 50)
    asked = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "query_id long, query array<float>")
    index = GraphIndex(frame(spark, m, 2), "l2", 8)
    assert index.search(asked, 1).where("query_id = id").count() >= 198
    plan = index.graphs._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and "parquet" in plan
