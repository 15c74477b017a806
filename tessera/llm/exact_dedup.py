"""Exact deduplication by stateful streaming over built-in functions only.

Every row's normalised text (A-Z lower-cased, null as empty) is digested. A
Structured Streaming aggregation keyed by digest keeps, in RocksDB state
without expiry, the stable identifier of the copy that stays (largest doc_id),
the locator of its content (its file) and the number of copies. Rows whose
digest was seen more than once are hits: the full bytes at their locators are
compared, those of earlier calls on a lasting state too, and a digest that covers
several texts is split by text, so a collision never merges two documents.

Defined results
* null text equals the empty text; null doc_id sorts below every other and is
  kept only in a group without any other doc_id;
* rows repeated with the same doc_id and text are one document: each is
  returned, each is kept if that doc_id is the largest;
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workspace

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STATE = "spark.sql.streaming.stateStore"
#: State lives on disk; all stores of an executor share one bounded cache.
_CONF = {
    f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STATE}.rocksdb.maxMemoryUsageMB": "64",
    f"{_STATE}.rocksdb.writeBufferCacheRatio": "0.5",
    f"{_STATE}.rocksdb.highPriorityPoolRatio": "0.1",
    f"{_STATE}.rocksdb.writeBufferSizeMB": "1",
    f"{_STATE}.rocksdb.maxWriteBufferNumber": "2",
    # A store is closed, and its local files go, when its task has committed.
    f"{_STATE}.unloadOnCommit": "true",
}
#: Hit digests of which at most so many are broadcast (64-byte strings).
BROADCAST_DIGESTS = 100_000
#: Parts that the full-byte check of one digest is split into.
CHECK_PARTS = 64


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def _sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def streaming_groups(fingerprints: DataFrame) -> DataFrame:
    """The stateful operator on a streaming frame of (digest, doc_id, locator):
    one row per digest with the copy that stays and the number of copies."""
    return fingerprints.groupBy("digest").agg(
        F.max(F.struct("doc_id", "locator")).alias("head"), F.count(F.lit(1)).alias("group_size")
    )


def run_stream(spark: SparkSession, log: str, schema, folder: str) -> DataFrame:
    """Drive the stateful operator over the fingerprint log in ``folder`` and
    return its newest state per digest. Calling it again with the same folder
    continues from the stored state with rows added to the log since."""
    old = {k: spark.conf.get(k, None) for k in _CONF}
    for k, v in _CONF.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).parquet(log)

        def put(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/groups/batch={number}")

        query = (
            streaming_groups(stream)
            .writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/state")
            .foreachBatch(put)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    states = spark.read.parquet(f"{folder}/groups")
    return states.groupBy("digest").agg(
        F.max(F.struct("batch", "head", "group_size")).alias("last")
    ).select("digest", F.col("last.head.doc_id").alias("keep_id"), F.col("last.head.locator").alias("locator"), F.col("last.group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, *, digest: Callable[[Column], Column] = _sha256, folder: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, locator for every row of ``docs``
    (doc_id, text); ``locator`` is the file that holds the copy that stays. With
    ``folder`` (shared by all executors) the state outlives the call: later calls
    with it add their ``docs``, and the result has the rows of all calls."""
    spark = docs.sparkSession
    call = f"c{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    if folder is None:
        folder, texts = workspace.scratch(spark, "exact-dedup"), rows
    else:
        # Texts of a lasting state are kept beside it: locators must lead to their bytes in later calls too.
        rows.write.parquet(f"{folder}/content/call={call}")
        rows = spark.read.schema(rows.schema).parquet(f"{folder}/content/call={call}")
        texts = spark.read.schema(rows.schema).parquet(f"{folder}/content").select("doc_id", "norm")
    log, lasting = f"{folder}/log", texts is not rows
    marked = rows.select(
        "doc_id", digest(F.col("norm")).alias("digest"), _sha256(F.col("norm")).alias("text_sha256"), F.input_file_name().alias("locator"), F.lit(call).alias("call")
    )
    if digest is _sha256:
        marked = marked.drop("text_sha256")
    marked.write.mode("append").parquet(log)
    schema = marked.schema
    groups = workspace.materialise(run_stream(spark, log, schema, folder), "exact-groups")
    marks = spark.read.schema(schema).parquet(log)
    if digest is _sha256:
        marks = marks.withColumn("text_sha256", F.col("digest"))

    hits = groups.where("group_size > 1").select("digest")
    if lasting:
        hits = hits.join(marks.where(F.col("call") == call).select("digest"), "digest", "left_semi")
    known = marks
    marks = marks.drop("locator", "call")
    n_hits = hits.count()
    texts = texts.select("doc_id", "norm", digest(F.col("norm")).alias("digest"), *([F.input_file_name().alias("locator")] if lasting else []))
    side = F.broadcast(hits) if n_hits <= BROADCAST_DIGESTS else hits
    if lasting:
        hit = texts.join(known.join(side, "digest", "left_semi").select("digest", "locator").distinct(), ["digest", "locator"], "left_semi")
    else:
        hit = texts.join(side, "digest", "left_semi")
    # Each part sends two texts at most, however many copies it has.
    parts = hit.groupBy("digest", F.pmod(F.xxhash64("doc_id"), F.lit(CHECK_PARTS)).alias("part")).agg(
        F.min("norm").alias("low"), F.max("norm").alias("high")
    )
    mixed = parts.groupBy("digest").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("digest")
    if lasting:
        mixed.write.mode("append").parquet(f"{folder}/collisions")
        mixed = spark.read.schema(mixed.schema).parquet(f"{folder}/collisions").distinct()
    elif n_hits:
        mixed = workspace.materialise(mixed, "exact-collisions")
    joined = marks.join(groups, "digest", "left")
    if not lasting and not n_hits or mixed.isEmpty():
        return _result(joined)
    again = texts.join(mixed, "digest", "left_semi")
    split = again.groupBy("digest", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.lit("").alias("locator"))
    apart = _result(again.drop("locator").withColumn("text_sha256", _sha256(F.col("norm"))).join(split, ["digest", "norm"]))
    return _result(joined.join(mixed, "digest", "left_anti")).unionByName(apart)


def _result(joined: DataFrame) -> DataFrame:
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        "locator",
    )


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; rows repeated with the same
    doc_id and text come once."""
    marks = workspace.materialise(exact_dedup(docs).select("doc_id", "text_sha256", "kept"), "exact-marks")
    name, digest = workspace.own_names(docs, "gone", "sha")
    gone = marks.where("not kept").select(F.col("doc_id").alias(name), F.col("text_sha256").alias(digest))
    if gone.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        gone = F.broadcast(gone)
    sha = _sha256(normalised(F.col("text")))
    left = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col(name)) & (sha == F.col(digest)), "left_anti")
    if marks.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty():
        return left
    return left.withColumn(digest, sha).dropDuplicates(["doc_id", digest]).drop(digest)
