"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are the presence of its words, their stems (first 5
and 7 bytes of longer words, so that inflected forms share a weight), word pairs and
skip pairs (one word between), hashed into DIMENSIONS buckets. Training is FTRL-proximal:
every coordinate has a rate of its own, and L1 leaves most weights at exactly
zero, so the model that is broadcast is a few thousand numbers.

The fit uses at most about MAX_FIT labelled rows (chosen by a hash of doc_id).
They are dealt to SHARDS tasks; in each epoch every task continues from the
averaged state, and the states are averaged again. Scoring covers all rows and
whole texts.

Defined results
* null or empty text has the intercept's score;
* labels that are null or not 0/1 are ignored; for several labels of a doc_id
  the largest counts; without labels of both kinds every score is their mean
  (0 without any);
* a null doc_id falls on the crc32 of the empty string; rows repeated in the
  table are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workspace
from .kernels import batches, mix64, split_words, text_buffer
from .quality import remainder

MAX_FIT = 24_000
DIMENSIONS = 1 << 20
SHARDS = 4
EPOCHS = 4
ALPHA, BETA, L1, L2 = 3.0, 1.0, 2.0, 1e-3
THRESHOLD = 0.7
_WORD, _PAIR, _SKIP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Chosen, with ALPHA and L1, by log loss on training folds alone (README).
_STEMS = (5, 7)
_EDGE = np.zeros(256, bool)
_EDGE[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _bare(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """ASCII punctuation becomes space: a word is the same with and without a comma."""
    return np.where(_EDGE[data], np.uint8(32), data)


def hashed_features(column: pa.Array, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all texts one after the other, sorted and distinct in each,
    and the offsets of the texts. Bucket 0 is the intercept and always there."""
    data, offsets = text_buffer(column)
    words = split_words(_bare(data, offsets), offsets)
    h, counts = words.hashes, words.counts
    n = len(counts)
    owner = np.repeat(np.arange(n), counts)
    mask = np.uint64(dimensions - 1)
    found, own = [np.zeros(n, np.uint64), mix64(h ^ _WORD) & mask], [np.arange(n), owner]
    for size in _STEMS:
        longer = np.flatnonzero(words.ends - words.starts > size)
        if len(longer):
            stem = np.zeros(len(longer), np.uint64)
            for k in range(size):
                stem = (stem << np.uint64(8)) | words.data[words.starts[longer] + k]
            found.append(mix64(stem ^ np.uint64(size << 56)) & mask)
            own.append(owner[longer])
    for gap, salt in ((1, _PAIR), (2, _SKIP)):
        if len(h) > gap:
            same = np.flatnonzero(owner[gap:] == owner[:-gap])
            found.append(mix64(h[same] * salt + h[same + gap]) & mask)
            own.append(owner[same])
    keys = np.sort((np.concatenate(own).astype(np.uint64) << np.uint64(32)) | np.concatenate(found))
    if len(keys):
        keys = keys[np.r_[True, keys[1:] != keys[:-1]]]
    who = (keys >> np.uint64(32)).astype(np.int64)
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.int32), np.searchsorted(who, np.arange(n + 1))


def ftrl_epoch(z: np.ndarray, n: np.ndarray, buckets: np.ndarray, ends: np.ndarray, ys: np.ndarray) -> None:
    """One pass of FTRL-proximal over the rows, in place; all features are 1."""
    for k in range(len(ys)):
        x = buckets[ends[k] : ends[k + 1]]
        zx, nx = z[x], n[x]
        root = np.sqrt(nx)
        w = np.where(np.abs(zx) <= L1, 0.0, (np.sign(zx) * L1 - zx) / ((BETA + root) / ALPHA + L2))
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - ys[k]
        z[x] = zx + g - (np.sqrt(nx + g * g) - root) / ALPHA * w
        n[x] = nx + g * g


def sparse_weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2)).astype(np.float32)


def _train(shared, dimensions):
    def run(stream):
        z, n = (x.astype(np.float64) for x in shared.value)
        seen = 0
        for batch in batches(stream):
            buckets, ends = hashed_features(batch.column(1), dimensions)
            ftrl_epoch(z, n, buckets, ends, np.asarray(batch.column(0)))
            seen += batch.num_rows
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), *[pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in (z, n)]], names=["rows", "z", "n"])

    return run


def fit(train: DataFrame, *, dimensions: int = DIMENSIONS, shards: int = SHARDS, epochs: int = EPOCHS) -> np.ndarray:
    """Dense weights from rows (y, text); the state is shards x 8 MB an epoch.
    Texts are stored by shard and hashed anew in each epoch: their features
    would take several times the room."""
    sc = train.sparkSession.sparkContext
    dealt = workspace.materialise(train.select("y", "text").repartition(shards), "toxic-train").coalesce(shards)
    state = (np.zeros(dimensions, np.float32), np.zeros(dimensions, np.float32))
    for _ in range(epochs):
        shared = sc.broadcast(state)
        parts = dealt.mapInArrow(_train(shared, dimensions), "rows long, z binary, n binary").collect()
        shared.unpersist()
        if not parts:
            break
        total = sum(p["rows"] for p in parts)
        z, n = (sum(np.frombuffer(p[c], np.float32).astype(np.float64) * (p["rows"] / total) for p in parts) for c in ("z", "n"))
        state = (z.astype(np.float32), n.astype(np.float32))
    return sparse_weights(*(x.astype(np.float64) for x in state))


def _score(shared, threshold):
    def run(stream):
        buckets_of, values, constant, dimensions = shared.value
        weights = np.zeros(dimensions, np.float32)
        weights[buckets_of] = values
        for batch in batches(stream):
            if constant is None:
                buckets, ends = hashed_features(batch.column(1), dimensions)
                sums = np.add.reduceat(weights[buckets].astype(np.float64), ends[:-1])
                s = 1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35)))
            else:
                s = np.full(batch.num_rows, constant)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, *, max_fit: int = MAX_FIT, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text),
    learnt from ``labels`` (doc_id, toxic) of rows that are not held out."""
    spark = docs.sparkSession
    workspace.ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("double").alias("y"))
    known = known.where(remainder(3) != 1)
    total = known.count()
    if total > max_fit:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_fit / total))
    known = workspace.materialise(known, "toxic-labels")
    n, ones = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if n and 0 < ones < n:
        # About max_fit rows of 16 bytes at most: a bounded broadcast, and texts stay where they are.
        weights = fit(texts.join(F.broadcast(known), "doc_id"))
        used = np.flatnonzero(weights)
        model = (used.astype(np.int32), weights[used], None, DIMENSIONS)
    else:
        model = (np.zeros(0, np.int32), np.zeros(0, np.float32), float(ones / n) if n else 0.0, DIMENSIONS)
    shared = spark.sparkContext.broadcast(model)
    return texts.select("doc_id", "text", (remainder(3) == 1).alias("held_out")).mapInArrow(_score(shared, threshold), "doc_id long, held_out boolean, score double, predicted int")
