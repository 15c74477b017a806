"""Command line: ingest, query, info, compact, bench, backend."""

from __future__ import annotations

import argparse
import json
import resource
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import ConfigError, Incompatible, TesseraError
from .functions import text as T
from .functions.embed import HashEmbedder
from .operators import knn
from .operators.chunker import ChunkerConfig
from .operators.hnsw import HnswParams
from .operators import stats
from .plans.ingest import SEGMENT_ROWS, IngestConfig, ingest
from .plans.scratch import scratch
from .plans.store import OpenOptions, Store, StoreConfig
from .sources.synthetic import clustered


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description="Text retrieval on Spark")
    p.add_argument("--store", default="./tessera-store")
    p.add_argument("--master", default="local[*]")
    p.add_argument("--log-level", default="ERROR")
    p.add_argument("--text", action="store_true", help="lines to read instead of JSON")
    p.add_argument("--verify", action="store_true", help="check every byte of the store before it is used")
    p.add_argument("--cache", action="store_true", help="keep what is read of the store in memory")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("ingest", help="chunk, embed and publish files")
    a.add_argument("paths", nargs="+")
    a.add_argument("--dim", type=int, default=384)
    a.add_argument("--chunk-bytes", type=int, default=1200)
    a.add_argument("--max-chunk-bytes", type=int, default=2400)
    a.add_argument("--batch", type=int, default=64)
    a.add_argument("--no-dedup", action="store_true")
    a.add_argument("--no-hnsw", action="store_true")
    a.add_argument("--no-sync", action="store_true", help="leave manifests to the file system's own time")
    a.add_argument("--workers", type=int, default=0, help="tasks that read and chunk files")
    a.add_argument("--segment-rows", type=int, default=SEGMENT_ROWS)
    a.add_argument("--progress", action="store_true", help="live counters on standard error")
    a.add_argument("--m", type=int, default=16)
    a.add_argument("--ef-construction", type=int, default=200)
    a = sub.add_parser("query", help="nearest chunks of a text")
    a.add_argument("text", nargs="+")
    a.add_argument("-k", type=int, default=5)
    a.add_argument("--ef", type=int, default=64)
    a.add_argument("--exact", action="store_true")
    a.add_argument("--full", action="store_true", help="whole chunks instead of snippets")
    a.add_argument("--repeat", type=int, default=1)
    sub.add_parser("info", help="segments of the store")
    a = sub.add_parser("compact", help="merge all segments")
    a.add_argument("--no-hnsw", action="store_true")
    a.add_argument("--vacuum", action="store_true")
    a = sub.add_parser("bench", help="synthetic recall and latency")
    for name, default in (("--n", 20_000), ("--dim", 128), ("--queries", 200), ("--k", 10), ("--ef", 64), ("--m", 16)):
        a.add_argument(name, type=int, default=default)
    sub.add_parser("backend", help="numeric libraries in use")
    return p


def _ingest(spark, a) -> dict:
    chunker, params = ChunkerConfig(a.chunk_bytes, a.max_chunk_bytes), None if a.no_hnsw else HnswParams.with_m(a.m, ef_construction=a.ef_construction)
    embedder = HashEmbedder(a.dim)
    store = Store.open_or_create(spark, a.store, StoreConfig(a.dim, "cosine", embedder.fingerprint), _options(a))
    tell = (lambda x: print(json.dumps(x), file=sys.stderr)) if a.progress else None
    config = IngestConfig(chunker, a.batch, dedup=not a.no_dedup, graph=params, segment_rows=a.segment_rows, workers=a.workers)
    report = ingest(spark, store, a.paths, embedder, config, tell=tell)
    return stats.with_rates(spark.createDataFrame([report])).first().asDict() | process()


def _options(a) -> OpenOptions:
    return OpenOptions(verify=a.verify, cache=a.cache, sync=not getattr(a, "no_sync", False))


def process() -> dict:
    """Memory of this process now and at its peak, in bytes, and the processor."""
    fields = {}
    for path in ("/proc/self/status", "/proc/cpuinfo"):
        try:
            with open(path) as f:
                for line in f:
                    name, _, value = line.partition(":")
                    fields.setdefault(name.strip(), value.strip())
        except OSError:  # not Linux
            pass
    now = int(fields.get("VmRSS", "0 kB").split()[0]) * 1024
    return {"rss_bytes": now, "peak_rss_bytes": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024, "cpu": fields.get("model name", "unknown")}


def time_per_call(call, *, least: float = 0.02) -> float:
    """Seconds a call takes, over as many calls as fill ``least`` seconds."""
    times = 1
    while True:
        began = time.perf_counter()
        for _ in range(times):
            call()
        took = time.perf_counter() - began
        if took >= least:
            return took / times
        times *= 2


def kernels(dims=(128, 384, 768, 1536), rows: int = 4096) -> list[dict]:
    """Time per row of the matrix product that searches use and of the loop that
    defines it, with operations and bytes a second and the gain."""
    import numpy as np

    out = []
    for dim in dims:
        r = np.random.default_rng(dim)
        block, q = r.standard_normal((rows, dim)), r.standard_normal(dim)
        flat, one = block[0].tolist(), q.tolist()
        for name, flops in (("dot", 2), ("cosine", 6)):
            whole = (lambda: block @ q) if name == "dot" else (lambda: block @ q / np.sqrt(np.einsum("ij,ij->i", block, block) * (q @ q)))
            plain = (lambda: sum(x * y for x, y in zip(one, flat))) if name == "dot" else (lambda: sum(x * y for x, y in zip(one, flat)) / (sum(x * x for x in one) * sum(y * y for y in flat)) ** 0.5)
            took, slow = time_per_call(whole) / rows, time_per_call(plain)
            out.append({"kernel": name, "dim": dim, "ns": took * 1e9, "gflops": flops * dim / took / 1e9, "gb_per_sec": 8 * dim / took / 1e9, "speedup": slow / took})
    return out


def _query(spark, a) -> dict:
    store = Store.open(spark, a.store, _options(a))
    embedder = HashEmbedder(store.config.dim)
    if embedder.fingerprint != store.config.fingerprint:
        raise Incompatible("the store was made with another model")
    if a.repeat < 1:
        raise ConfigError("repeat is at least 1")
    vector = embedder.embed_batch([" ".join(a.text)])[0]
    took = []
    for _ in range(a.repeat):
        began = time.perf_counter()
        hits = store.search([(0, vector)], k=a.k, ef=a.ef, mode="exact" if a.exact else "auto", payload=True).orderBy("rank")
        shown = hits.select("rank", "score", T.decode_payload("payload").alias("p")).select("rank", "score", "p.path", "p.begin", "p.end", "p.heading", (F.col("p.text") if a.full else T.snippet("p.text")).alias("text"))
        rows = [r.asDict() for r in shown.collect()]
        took.append(time.perf_counter() - began)
    took.sort()
    rank = lambda p: took[max(1, -(-p * len(took) // 100)) - 1]
    return {"hits": rows, "p50": rank(50), "p99": rank(99)}


def _info(spark, a) -> dict:
    store = Store.open(spark, a.store, _options(a))
    snap = store.snapshot()
    segments = snap.info().withColumn("size", T.format_bytes(F.col("bytes")))
    return {"generation": snap.generation, "dim": snap.config.dim, "metric": snap.config.metric, "fingerprint": f"{snap.config.fingerprint:016x}", "vectors": len(snap), "bytes": snap.mapped_bytes, "segments": [r.asDict() for r in segments.orderBy("ordinal").collect()]}


def _compact(spark, a) -> dict:
    store = Store.open(spark, a.store, _options(a))
    made = store.compact(params=None if a.no_hnsw else HnswParams())
    return {"compacted": made is not None, "report": made, "generation": store.generation, "removed": store.vacuum() if a.vacuum else []}


def _bench(spark, a) -> dict:
    if min(a.n, a.dim, a.queries, a.k, a.ef) <= 0:
        raise ConfigError("all sizes must be positive")
    store = Store.open_or_create(spark, scratch(spark, "bench"), StoreConfig(a.dim, "cosine", 0))
    built = store.publish(clustered(spark, a.n, a.dim), params=HnswParams.with_m(a.m, ef_construction=100))
    asked = [(r["id"], r["vector"]) for r in clustered(spark, a.queries, a.dim, seed=43).collect()]

    def timed(**options):
        began = time.perf_counter()
        hits = store.search(asked, k=a.k, **options).cache()
        hits.count()
        return hits, time.perf_counter() - began

    truth, took = timed(mode="exact")
    out = {"rows": built["rows"], "build_seconds": built["build_seconds"], "exact_seconds": took, "scan_gib_per_sec": a.queries * a.n * a.dim * 4 / 2**30 / took, "hnsw": []}
    for ef in (a.ef // 2, a.ef, 2 * a.ef):
        if ef >= a.k:
            found, took = timed(mode="approximate", ef=ef)
            out["hnsw"].append({"ef": ef, "seconds": took, "recall": knn.recall(found, truth, k=a.k).first()["recall"]})
    return out | {"kernels": kernels()} | process()


def _backend(spark, a) -> dict:
    import numpy as np

    config = np.show_config(mode="dicts")
    return {"numpy": np.__version__, "blas": config["Build Dependencies"]["blas"]["name"], "simd": config.get("SIMD Extensions", {}), "spark": spark.version}


def lines(value, indent: str = "") -> list[str]:
    """A report as aligned names and values, tables as one block per row."""
    if isinstance(value, dict):
        width = max(map(len, value), default=0)
        out = []
        for k, v in value.items():
            nested = isinstance(v, (dict, list)) and v
            out += [f"{indent}{k}:", *lines(v, indent + "  ")] if nested else [f"{indent}{k:<{width}}  {_shown(k, v)}"]
        return out
    if isinstance(value, list):
        return [x for k, v in enumerate(value) for x in [f"{indent}[{k}]", *lines(v, indent + "  ")]]
    return [f"{indent}{value}"]


def _shown(name: str, v) -> str:
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    if name.endswith("bytes"):
        unit = min(4, max(0, (int(v).bit_length() - 1) // 10))
        return f"{v} B" if not unit else f"{v / 1024**unit:.1f} {('KiB', 'MiB', 'GiB', 'TiB')[unit - 1]}"
    if name.endswith(("seconds", "p50", "p99")):
        return f"{v:.2f} s" if v >= 1 else f"{v * 1e3:.2f} ms"
    return f"{v:,}" if isinstance(v, int) else f"{v:,.3f}"


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.master(a.master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel(a.log_level)
    try:
        report = globals()[f"_{a.command}"](spark, a)
        print("\n".join(lines(report)) if a.text else json.dumps(report, default=str, ensure_ascii=False, indent=2))
        return 0
    except TesseraError as e:
        print(f"error: {e}")
        return 1


if __name__ == "__main__":
    raise SystemExit(main())
