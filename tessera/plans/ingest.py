"""Files to published segments: discover, read, chunk, drop duplicates, embed.

Texts are chunked once and stored; what is numbered, grouped and joined after
that are paths, positions and digests. Vectors are shuffled once, to the segments
of bounded size that they are published in.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, Incompatible, IngestError
from ..functions import text as T
from ..functions.embed import Embedder, embed_column
from ..operators.chunker import ChunkerConfig, chunk_documents
from ..operators.hnsw import HnswParams
from ..operators.rows import prefix_sums
from ..sources.files import MAX_FILE_BYTES, discover, read_files
from .progress import Progress
from .store import Store

#: Rows of a segment, whose graph is built in one task.
SEGMENT_ROWS = 32_768


@dataclass(frozen=True)
class IngestConfig:
    """``workers`` tasks read and chunk files (0: as many as Spark finds fit)."""

    chunker: ChunkerConfig = field(default_factory=ChunkerConfig)
    batch: int = 64
    max_file_bytes: int = MAX_FILE_BYTES
    dedup: bool = True
    graph: HnswParams | None = field(default_factory=HnswParams)
    segment_rows: int = SEGMENT_ROWS
    workers: int = 0

    def __post_init__(self):
        if self.batch <= 0 or self.max_file_bytes <= 0 or self.segment_rows <= 0 or self.workers < 0:
            raise ConfigError("batch, max_file_bytes and segment_rows must be positive, workers not negative")


def chunk_rows(files: DataFrame, config: ChunkerConfig) -> DataFrame:
    """path, pos, many, text, begin, end, heading, kind, digest, tokens: one row per chunk of
    (path, kind, text); ``many`` is the number of the file's chunks."""
    made = chunk_documents(files.where("text is not null").select("path", "kind", "text"), config=config)
    each = made.select("path", F.size("chunks").cast("long").alias("many"), F.posexplode("chunks").alias("pos", "c"))
    return each.select(
        "path", "pos", "many", F.col("c.text").alias("text"), F.col("c.start").alias("begin"), F.col("c.end").alias("end"), F.col("c.heading").alias("heading"), F.col("c.kind").alias("kind"), F.sha2("c.text", 256).alias("digest"), F.col("c.tokens").alias("tokens")
    )


def numbered_chunks(chunks: DataFrame, folder: str) -> DataFrame:
    """``chunks`` with ``seq``, their place in path and text order over all files: the
    chunks of the paths before (by components) and the place in the file. Only
    paths are sorted."""
    paths = chunks.where("pos = 0").select("path", "many")
    first = prefix_sums(paths, [F.split("path", "/")], "many", "before", folder)
    return chunks.join(first.select("path", "before"), "path").withColumn("seq", F.col("before") + F.col("pos")).drop("before")


def ingest_frame(
    store: Store, files: DataFrame, embedder: Embedder, config: IngestConfig = IngestConfig(), *, found: dict | None = None, batch: tuple[str, int] | None = None, tell: Callable[[dict], None] | None = None
) -> dict:
    """Publish the chunks of (path, kind, n_bytes, text); returns the report. A path
    stands for one file. With ``batch`` (source, number), texts that an earlier
    batch of the source has brought are duplicates too. ``tell`` gets live reports.
    Vectors are made in the job that writes them, so ``embed_nanos`` is the time of
    both."""
    if embedder.fingerprint != store.config.fingerprint or embedder.dim != store.config.dim:
        raise Incompatible("the embedder is not the one that the store was made with")
    began = time.time()
    folder, spark = store.folder, store.folder.spark
    mark = f".ingest-{time.time_ns():x}"
    at = lambda name: folder.at(f"{mark}/{name}")
    if config.workers:
        files = files.repartition(config.workers)
    try:
        with Progress(spark, tell) as live:
            live.phase("chunk")
            chunk_rows(files, config.chunker).write.parquet(at("chunks"))
            made = spark.read.parquet(at("chunks"))
            totals = files.agg(F.count(F.lit(1)), F.count("text"), F.coalesce(F.sum(F.when(F.col("text").isNotNull(), F.col("n_bytes"))), F.lit(0))).first()
            chunks, tokens = made.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
            report = {"files_total": totals[0], "files_skipped": totals[0] - totals[1], "files_done": totals[1], "bytes": totals[2], "chunks": chunks, "tokens": tokens}
            live.count(**report)
            live.phase("embed and publish")
            kept = numbered_chunks(made, at("paths"))
            if config.dedup:
                firsts = kept.groupBy("digest").agg(F.min("seq").alias("seq"))
                if batch and batch[1] > 0 and folder.exists(seen := f"seen-{batch[0]}"):
                    # Numbers of later batches are those of a batch that is delivered again.
                    firsts = firsts.join(spark.read.parquet(folder.at(seen)).where(F.col("batch") < batch[1]).select("digest"), "digest", "left_anti")
                kept = kept.join(firsts.select("seq"), "seq", "left_semi")
            n = firsts.count() if config.dedup else chunks
            report |= {"duplicates": chunks - n}
            live.count(**report)
            # The text goes to the embedder and back once; name, heading and place are put before it on either side.
            full = kept.select(F.col("seq").alias("id"), T.context("path", "heading", "text").alias("before"), T.payload("path", "begin", "end", "heading", F.lit("")).alias("head"), "text")
            rows = embed_column(full, embedder, ["before", "text"], rows=config.batch, metric=store.config.metric)
            rows = rows.select("id", "vector", F.concat("head", "text").alias("payload"))
            if batch and config.dedup:
                firsts.select("digest").write.mode("overwrite").parquet(folder.at(f"seen-{batch[0]}/batch={batch[1]}"))
            start = time.time()
            if n:
                # Vectors are made, shuffled to their segments and written in one job.
                made = store.publish(rows, params=config.graph, fingerprint=embedder.fingerprint, batch=batch, segment_rows=config.segment_rows, numbered=True, prepared=True)
                if made["rows"] != n:
                    raise IngestError(f"{made['rows']} of {n} chunks were written")
                report |= {"embed_nanos": int(made["write_seconds"] * 1e9)}
            report |= {"embedded": n, "written": n, "embed_nanos": report.get("embed_nanos", int((time.time() - start) * 1e9))}
            live.count(**report)
            live.phase("done")
    finally:
        folder.delete(mark)
    report |= {"seconds": time.time() - began, "generation": store.generation}
    for k, v in (found or {}).items():
        report[k] += v
    return report


def ingest(spark: SparkSession, store: Store, roots: list[str], embedder: Embedder, config: IngestConfig = IngestConfig(), *, tell: Callable[[dict], None] | None = None) -> dict:
    """Files below ``roots``; oversize, unreadable and non-UTF-8 files are counted as skipped."""
    found = discover(roots, max_file_bytes=config.max_file_bytes)
    files = read_files(spark, found).cache()
    try:
        return ingest_frame(store, files, embedder, config, found={"files_skipped": found.skipped}, tell=tell)
    finally:
        files.unpersist()
