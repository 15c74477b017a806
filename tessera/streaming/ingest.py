"""Continuous ingest: new files of a folder become segments, batch by batch.

The batch number is the key of idempotence: it is written in the manifest with
the segment, so a batch that is delivered again after a failure is skipped. Texts
are told apart over all batches of a source: digests of what each batch has
published stay beside the segments, under the batch's number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..functions.embed import Embedder
from ..plans.ingest import IngestConfig, ingest_frame
from ..plans.store import Store


def file_stream(spark: SparkSession, folder: str, *, files_per_batch: int = 1000) -> DataFrame:
    """path, kind, n_bytes, text of supported files as they arrive in ``folder``."""
    raw = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    text = F.col("content").cast("string")
    return raw.select("path", T.source_kind("path").alias("kind"), F.col("length").alias("n_bytes"), F.when(F.is_valid_utf8(text), text).alias("text")).where("kind is not null")


def start_ingest(stream: DataFrame, store: Store, embedder: Embedder, checkpoint: str, config: IngestConfig = IngestConfig(), *, name: str = "files", available_now: bool = True) -> StreamingQuery:
    """Publish every micro-batch of (path, kind, n_bytes, text) once."""

    def put(batch: DataFrame, number: int) -> None:
        if number > store.reload().last_batch(name):
            files = batch.persist()
            try:
                ingest_frame(store, files, embedder, config, batch=(name, number))
            finally:
                files.unpersist()

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
