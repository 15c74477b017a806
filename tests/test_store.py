import json
import os

import numpy as np
import pytest

from tessera.cli import main
from tessera.errors import ConfigError, Corrupt, Incompatible, IngestError, Locked, StoreError
from tessera.functions.embed import HashEmbedder
from tessera.operators.chunker import ChunkerConfig
from tessera.operators.hnsw import HnswParams
from tessera.plans.ingest import IngestConfig, ingest
from tessera.plans.index import ExactIndex, GraphIndex, VectorIndex
from tessera.plans.progress import Progress
from tessera.plans.store import MANIFEST, OpenOptions, Store, StoreConfig
from tessera.sources.files import discover
from tessera.streaming.ingest import file_stream, start_ingest

CONFIG = StoreConfig(8, "cosine", 0xFEEDF00D)


def vectors(spark, n, start=0, payload=False):
    m = np.random.default_rng(start).standard_normal((n, 8))
    rows = [(start + i, [float(x) for x in v], f"doc-{start + i}" if payload and i % 2 else None) for i, v in enumerate(m)]
    return spark.createDataFrame(rows, "id long, vector array<float>, payload string").repartition(3)


def test_publish_search_compact_and_reopen(spark, tmp_path):
    store = Store.open_or_create(spark, str(tmp_path), CONFIG)
    assert store.generation == 0 and store.search([(0, [1.0] * 8)]).count() == 0
    store.publish(vectors(spark, 40), params=HnswParams())
    store.publish(vectors(spark, 30, 100, payload=True))
    old = store.snapshot()
    asked = [(0, [1.0] * 8), (1, [float(k) for k in range(8)])]
    hits = lambda s: [tuple(r) for r in s.search(asked, k=7, mode="exact").orderBy("query_id", "rank").select("query_id", "rank", "id", "score").collect()]
    before = hits(old)
    payloads = {r["id"]: r["payload"] for r in old.search(asked, k=70, payload=True).collect()}
    assert payloads[101] == "doc-101" and payloads[100] == "" and payloads[3] is None
    assert store.compact(params=None)["rows"] == 70 and store.compact() is None
    assert (store.generation, len(store.snapshot().segments), len(store.snapshot())) == (3, 1, 70)
    assert hits(store.snapshot()) == before == hits(old)  # an old snapshot still reads its own files
    assert store.snapshot().segments[0].name == "seg-0000000003"
    assert len(store.vacuum()) == 3
    again = Store.open(spark, str(tmp_path), verify=True)
    assert hits(again.snapshot()) == before and again.snapshot().info().first()["payload"]


def test_modes_agree(spark, tmp_path):
    store = Store.open_or_create(spark, str(tmp_path), CONFIG)
    store.publish(vectors(spark, 200), params=HnswParams())
    ids = {m: [r["id"] for r in store.search([(0, [1.0] * 8)], k=5, mode=m).orderBy("rank").collect()] for m in ("exact", "approximate", "auto")}
    assert ids["exact"] == ids["approximate"] == ids["auto"]


def test_bad_rows_publish_nothing(spark, tmp_path):
    store = Store.open_or_create(spark, str(tmp_path), CONFIG)
    for bad in ([1.0] * 7, [float("nan")] * 8, [0.0] * 8):
        with pytest.raises(StoreError):
            store.publish(spark.createDataFrame([(1, [1.0] * 8), (2, bad)], "id long, vector array<float>"))
    with pytest.raises(StoreError):
        store.publish(vectors(spark, 0))
    with pytest.raises(Incompatible):
        store.publish(vectors(spark, 3), fingerprint=1)
    assert store.reload().generation == 0 and [n for n in os.listdir(tmp_path) if not n.endswith(".crc")] == [MANIFEST]


def test_configs_locks_and_damage(spark, tmp_path):
    store = Store.open_or_create(spark, str(tmp_path), CONFIG)
    with pytest.raises(Incompatible):
        Store.open_or_create(spark, str(tmp_path), StoreConfig(9, "cosine", CONFIG.fingerprint))
    with store.writer(), pytest.raises(Locked):
        Store.open(spark, str(tmp_path)).publish(vectors(spark, 3))
    store.publish(vectors(spark, 5))
    segment = tmp_path / store.snapshot().segments[0].name
    part = next(p for p in segment.iterdir() if p.name.startswith("part"))
    data = bytearray(part.read_bytes())
    data[len(data) // 2] ^= 1
    part.write_bytes(data)
    (segment / f".{part.name}.crc").unlink()
    with pytest.raises(Corrupt):
        Store.open(spark, str(tmp_path), verify=True)
    manifest = json.loads((tmp_path / MANIFEST).read_text())
    (tmp_path / f".{MANIFEST}.crc").unlink(missing_ok=True)
    (tmp_path / MANIFEST).write_text(json.dumps(manifest | {"body": manifest["body"].replace('"rows": 5', '"rows": 6')}))
    with pytest.raises(Corrupt):
        Store.open(spark, str(tmp_path))
    with pytest.raises(StoreError):
        Store.open(spark, str(tmp_path / "none"))


@pytest.fixture
def corpus(tmp_path):
    root = tmp_path / "corpus"
    files = {
        "docs/graphs.md": "# Small worlds\n\nLayers of near neighbours.\n\n## Parameters\n\nThe beam width trades recall against speed.\n",
        "docs/nested/maps.md": "# Mapping\n\n```rust\nlet map = open_mapped(path);\n```\n",
        "docs/cooking.txt": "Stir flour, butter and sugar into a cake.\n", "docs/copy.txt": "Stir flour, butter and sugar into a cake.\n",
        "src.rs": "fn distance(a: &[f32]) -> f32 { a.iter().sum() }\n", "image.png": "x", "target/ignored.md": "no", ".git/ignored.md": "no", "docs/_kept.md": "an underscore keeps it\n",
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "binary.md").write_bytes(b"\xff\xfe\x00A")
    return root


def test_discovery(corpus):
    (corpus / "a-b.md").write_text("x")
    (corpus / "a").mkdir()
    (corpus / "a/b.md").write_text("y" * 50)
    names = [os.path.relpath(p, corpus) for p, _ in discover([str(corpus)]).files]
    assert names == ["a/b.md", "a-b.md", "binary.md", "docs/_kept.md", "docs/cooking.txt", "docs/copy.txt", "docs/graphs.md", "docs/nested/maps.md", "src.rs"]
    assert discover([str(corpus)], max_file_bytes=30).skipped > 0
    assert discover([str(corpus / "src.rs")]).files == [(str(corpus / "src.rs"), "code")]
    with pytest.raises(IngestError):
        discover([str(corpus / "missing")])


def test_ingest_end_to_end(spark, corpus, tmp_path):
    e = HashEmbedder(256)
    store = Store.open_or_create(spark, str(tmp_path / "store"), StoreConfig(256, "cosine", e.fingerprint))
    report = ingest(spark, store, [str(corpus)], e, IngestConfig(ChunkerConfig(64, 256), batch=2))
    assert (report["files_total"], report["files_skipped"], report["files_done"], report["duplicates"]) == (7, 1, 6, 1)
    assert report["written"] == report["chunks"] - 1 == len(store.snapshot())
    for question, path in (("beam width recall speed", "graphs.md"), ("open mapped path", "maps.md"), ("cake with butter", "cooking.txt"), ("distance iter sum", "src.rs")):
        (hit,) = store.search([(0, e.embed_batch([question])[0])], k=1, payload=True).collect()
        assert path in hit["payload"].split("\n")[0]
        assert path != "graphs.md" or hit["payload"].split("\n")[0].endswith("\tParameters")
    with pytest.raises(Incompatible):
        ingest(spark, store, [str(corpus)], HashEmbedder(128))


def test_streaming_ingest_is_idempotent(spark, corpus, tmp_path):
    e = HashEmbedder(64)
    store = Store.open_or_create(spark, str(tmp_path / "store"), StoreConfig(64, "cosine", e.fingerprint))
    run = lambda mark: start_ingest(file_stream(spark, str(corpus / "docs")), store, e, str(tmp_path / mark), IngestConfig(graph=None)).awaitTermination()
    run("one")
    n = len(store.reload().snapshot())
    run("one")
    assert n > 0 and len(store.reload().snapshot()) == n and store.last_batch("files") == 0
    run("lost")  # the same batch again, as after a lost checkpoint
    assert len(store.reload().snapshot()) == n


def test_command_line(spark, corpus, tmp_path, capsys):
    at = ["--store", str(tmp_path / "cli"), "--master", "local[4]"]
    assert main([*at, "ingest", str(corpus), "--dim", "64", "--no-hnsw"]) == 0
    assert main([*at, "query", "butter", "cake", "-k", "1", "--repeat", "2"]) == 0
    assert "cooking.txt" in capsys.readouterr().out
    assert main([*at, "info"]) == 0 and '"flat"' in capsys.readouterr().out
    assert main([*at, "compact", "--vacuum"]) == 0 and '"compacted": false' in capsys.readouterr().out
    assert main(["--store", str(tmp_path / "no"), "--master", "local[4]", "info"]) == 1
    assert main([*at, "backend"]) == 0
    again = [*at, "--text", "--verify", "--cache"]
    assert main([*again, "ingest", str(corpus), "--dim", "64", "--workers", "2", "--no-sync", "--segment-rows", "3", "--progress"]) == 0
    shown = capsys.readouterr()
    report = {k: v for k, _, v in (x.partition("  ") for x in shown.out.splitlines())}
    assert {"tokens_per_sec", "chunks_per_sec", "mib_per_sec", "micros_per_vector", "peak_rss_bytes", "cpu", "bytes"} <= {k.strip() for k in report}
    seen = [json.loads(x) for x in shown.err.splitlines() if x.startswith('{"phase')]
    assert seen[-1]["phase"] == "done" and seen[-1]["written"] > 0 and {"tasks", "tasks_done", "seconds"} <= seen[0].keys()
    assert main([*again, "info"]) == 0 and "hnsw" in capsys.readouterr().out
    assert main([*at, "bench", "--n", "300", "--dim", "8", "--queries", "3"]) == 0
    made = json.loads(capsys.readouterr().out)
    assert made["kernels"] and all(k["ns"] > 0 and k["gflops"] > 0 for k in made["kernels"]) and made["rss_bytes"] > 0


def test_segments_of_bounded_size_from_one_call(spark, tmp_path):
    store = Store.open_or_create(spark, str(tmp_path), CONFIG)
    rows = vectors(spark, 50, payload=True)
    asked = [(0, [1.0] * 8), (1, [float(k) for k in range(8)])]
    hits = lambda s: [tuple(r) for r in s.search(asked, k=9, mode="exact").orderBy("query_id", "rank").select("query_id", "rank", "id", "score").collect()]
    report = store.publish(rows, params=HnswParams(), segment_rows=16)
    assert (report["segments"], report["rows"], [s.rows for s in store.snapshot().segments]) == (4, 50, [16, 16, 16, 2])
    one = hits(store)
    whole = Store.open_or_create(spark, str(tmp_path / "one"), CONFIG)
    whole.publish(rows)
    assert one == hits(whole) and [r["id"] for r in store.search(asked[:1], k=5, mode="approximate").orderBy("rank").collect()] == [r[2] for r in one[:5]]
    assert store.compact(segment_rows=40)["segments"] == 2 and hits(store) == one
    Store.open(spark, str(tmp_path), OpenOptions(verify=True))
    # Numbered ids with a gap that fills a segment: the numbers of the others stay in order.
    gaps = Store.open_or_create(spark, str(tmp_path / "gaps"), CONFIG)
    gaps.publish(rows.where("id < 16 or id >= 32"), segment_rows=16, numbered=True)
    assert [(s.id, s.rows) for s in gaps.snapshot().segments] == [(1, 16), (3, 16), (4, 2)]
    gaps.publish(vectors(spark, 5, 100))
    assert gaps.snapshot().segments[-1].id == 5 and {r["row"] for r in gaps.snapshot().rows().where("segment_id = 3").collect()} == set(range(16))
    with pytest.raises(ConfigError):
        gaps.publish(rows, segment_rows=0)


def test_a_damaged_graph_or_schema_is_found(spark, tmp_path):
    store = Store.open_or_create(spark, str(tmp_path), CONFIG)
    store.publish(vectors(spark, 30), params=HnswParams())
    graph = tmp_path / (store.snapshot().segments[0].name + ".graph")
    part = next(p for p in graph.iterdir() if p.name.startswith("part"))
    kept = part.read_bytes()
    for at in (5, len(kept) // 3, len(kept) - 20):
        data = bytearray(kept)
        data[at] ^= 4
        part.write_bytes(data)
        (graph / f".{part.name}.crc").unlink(missing_ok=True)
        with pytest.raises(Corrupt):
            Store.open(spark, str(tmp_path), verify=True)
    part.write_bytes(kept)
    Store.open(spark, str(tmp_path), verify=True)
    store.folder.move(store.snapshot().segments[0].name, "aside")
    with pytest.raises(Corrupt):
        Store.open(spark, str(tmp_path))


def test_texts_are_told_apart_over_micro_batches(spark, tmp_path):
    e = HashEmbedder(16)
    store = Store.open_or_create(spark, str(tmp_path / "store"), StoreConfig(16, "cosine", e.fingerprint))
    folder = tmp_path / "in"
    folder.mkdir()

    def run(mark):
        start_ingest(file_stream(spark, str(folder)), store, e, str(tmp_path / mark), IngestConfig(graph=None)).awaitTermination()
        return [r["payload"].split("\n", 1)[1] for r in store.reload().snapshot().rows().orderBy("ordinal", "row").collect()]

    (folder / "a.txt").write_text("one text")
    assert run("m") == ["one text"]
    (folder / "b.txt").write_text("one text")
    (folder / "c.txt").write_text("another")
    assert run("m") == ["one text", "another"]
    (folder / "d.txt").write_text("another")
    assert run("m") == ["one text", "another"]


def test_indexes_share_one_interface(spark):
    m = np.random.default_rng(3).standard_normal((200, 8))
    rows = spark.createDataFrame([(0, 0, i, i, [float(x) for x in v]) for i, v in enumerate(m)], "segment_id long, ordinal int, row long, id long, vector array<float>")
    for kind in (ExactIndex, GraphIndex):
        index = kind(rows, "l2", 8)
        assert isinstance(index, VectorIndex) and (index.dim, index.metric.value, len(index), index.is_empty()) == (8, "l2", 200, False)
        assert [r["id"] for r in index.search([(7, m[7])], 3).orderBy("rank").collect()][0] == 7


def test_progress_survives_a_report_that_fails(spark):
    def bad(_):
        raise ValueError

    with Progress(spark, bad) as live:
        live.phase("x")
        live.count(chunks=3)
        assert live.look() | {"seconds": 0} == {"phase": "x", "chunks": 3, "tasks": 0, "tasks_done": 0, "seconds": 0}


def test_arrivals_are_written_by_tasks_of_bounded_size():
    from tessera.queries import arrival_files

    assert arrival_files(0) == arrival_files(3 << 26) == 1 and arrival_files((3 << 26) + 1) == 2
    assert all(n / (3 * arrival_files(n)) <= 64 << 20 for n in (10**6, 10**9, 10**10, 10**12))
