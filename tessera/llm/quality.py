"""Quality classifier: random Fourier features of document statistics.

Every text becomes a short vector of statistics. Random cosine features
approximate a Gaussian kernel over the standardised vectors; partitions sum
their parts of the normal equations, the sums give a ridge solution, and an
isotonic regression, fitted on labelled rows apart from those and linear between
its steps' centres, turns its output into a probability.

The fit uses at most about MAX_FIT labelled rows (chosen by a hash of doc_id);
scoring covers all rows and whole texts.

Defined results
* null or empty text is a vector of zeros and gets a score;
* labels that are null or not 0/1 are ignored; for several labels of a doc_id
  the largest counts; without labels of both kinds every score is their mean
  (0.5 without any);
* a null doc_id falls on the crc32 of the empty string; rows repeated in the
  table are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workspace
from .kernels import batches, split_words, text_buffer

MAX_FIT = 60_000
FEATURES = 256
GAMMA = 0.03
RIDGE = 1e-3
THRESHOLD = 0.3
BINS = 2048
_PARTS = 8

_KIND = np.full(256, 5, np.uint8)  # symbols
_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 0
_KIND[0x0A] = 1
_KIND[48:58] = 2
_KIND[65:91] = 3
_KIND[97:123] = 4
_KIND[128:] = 6
_KIND[[0x2E, 0x2C, 0x3B, 0x3A, 0x3F, 0x27, 0x22, 0x28, 0x29, 0x2D]] = 7
NAMES = (
    "log_words log_bytes word_mean word_sd newline digits upper lower symbols high stops distinct distinct_pairs repeat_next top_share symbol_words bare_symbols double_end caps_words line_words"
).split()


def statistics(column: pa.Array) -> np.ndarray:
    """One float64 row of NAMES per text of a column."""
    data, offsets = text_buffer(column)
    n = len(offsets) - 1
    words = split_words(data, offsets, lower=True)
    size = np.diff(offsets).astype(float)
    out = np.zeros((n, len(NAMES)))
    some = np.maximum(size, 1)
    kinds = _KIND[data]
    share = {}
    for k in range(1, 8):
        at = np.flatnonzero(kinds == k)
        share[k] = np.diff(np.searchsorted(at, offsets)) / some
    count = words.counts.astype(float)
    many = np.maximum(count, 1)
    owner = np.repeat(np.arange(n), words.counts)
    per = lambda x: np.bincount(owner, weights=x, minlength=n)
    length = (words.ends - words.starts).astype(float)
    mean = per(length) / many
    sd = np.sqrt(np.maximum(0, per(length**2) / many - mean**2))

    def distinct(hashes, own):
        keys = np.sort((own.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
        who = (keys[first] >> np.uint64(40)).astype(int)
        return who, np.diff(np.r_[first, len(keys)])

    who, times = distinct(words.hashes, owner)
    kinds_of_word = np.bincount(who, minlength=n) / many
    top = np.zeros(n)
    np.maximum.at(top, who, times)
    pairs = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, int)
    h = words.hashes
    two = h[pairs] * np.uint64(0x9E3779B97F4A7C15) + h[pairs + 1]
    who2, _ = distinct(two * np.uint64(0xBF58476D1CE4E5B9), owner[pairs])
    n_pairs = np.maximum(1, np.bincount(owner[pairs], minlength=n))
    again = np.bincount(owner[pairs], weights=(h[pairs] == h[pairs + 1]).astype(float), minlength=n)
    symbol = (kinds == 5) | (kinds == 7)
    last = symbol[words.ends - 1] if len(h) else np.zeros(0, bool)
    second = symbol[np.maximum(words.ends - 2, 0)] & (length >= 2) if len(h) else last
    strong = kinds[words.ends - 1] == 5 if len(h) else last
    caps = (kinds[words.starts] == 3) & (kinds[np.minimum(words.starts + 1, max(0, len(kinds) - 1))] == 3) & (length >= 2) if len(h) else last
    bare = symbol[words.starts] & (length == 1) if len(h) else last
    columns = [
        np.log1p(count), np.log1p(size), mean, sd, share[1], share[2], share[3], share[4], share[5], share[6], share[7], kinds_of_word, np.bincount(who2, minlength=n) / n_pairs, again / n_pairs,
        top / many, per(strong) / many, per(bare) / many, per(last & second) / many, per(caps) / many, np.log1p(count / (1 + share[1] * some)),
    ]
    for k, c in enumerate(columns):
        out[:, k] = c
    out[count == 0] = 0
    return out


def _measure(stream):
    for batch in batches(stream):
        m = statistics(batch.column(0))
        flat = pa.array(m.reshape(-1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), flat)
        yield pa.RecordBatch.from_arrays([lists, batch.column(1), batch.column(2)], names=["stats", "y", "apart"])


def _rows(batch, name="stats"):
    column = batch.column(batch.schema.get_field_index(name))
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _sums(fit, size):
    """Task: the sum of fit(stats, y) over the rows of a partition, as one row."""

    def run(stream):
        total = np.zeros(size)
        for batch in stream:
            if batch.num_rows:
                total += fit(_rows(batch), np.asarray(batch.column(1), dtype=np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    return run


def _added(rows: DataFrame, fit, size: int) -> np.ndarray:
    parts = rows.select("stats", "y").coalesce(_PARTS).mapInArrow(_sums(fit, size), "part binary").collect()
    return sum((np.frombuffer(r["part"]) for r in parts), np.zeros(size))


class Model:
    """Standardisation, cosine features, ridge weights and calibration steps."""

    def __init__(self, mean, scale, directions, phases, weights, xs, ys):
        self.mean, self.scale, self.directions, self.phases, self.weights, self.xs, self.ys = mean, scale, directions, phases, weights, xs, ys

    def design(self, stats):
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, z, np.ones((len(z), 1))])

    def raw(self, stats):
        return self.design(stats) @ self.weights

    def score(self, stats):
        if self.weights is None:
            return np.full(len(stats), self.ys)
        return np.clip(np.interp(self.raw(stats), self.xs, self.ys), 0.0, 1.0)


def isotonic(xs: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: non-decreasing means of total / weight over xs."""
    blocks: list[list[float]] = []
    for x, w, t in zip(xs, weight, total):
        if w <= 0:
            continue
        blocks.append([x * w, w, t])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fit(train: DataFrame, *, features: int = FEATURES, gamma: float = GAMMA, ridge: float = RIDGE) -> Model:
    """Fit on (stats, y, apart): rows with ``apart`` only calibrate."""
    d = len(NAMES)
    main, apart = train.where("not apart"), train.where("apart")
    first = _added(main, lambda s, y: np.concatenate([[len(y), y.sum()], s.sum(0), (s**2).sum(0)]), 2 + 2 * d)
    n, ones = first[:2]
    if n == 0 or ones in (0, n):
        return Model(None, None, None, None, None, None, float(ones / n) if n else 0.5)
    mean = first[2 : 2 + d] / n
    scale = np.sqrt(np.maximum(first[2 + d :] / n - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(7)
    model = Model(mean, scale, rng.normal(0, np.sqrt(2 * gamma), (d, features)), rng.uniform(0, 2 * np.pi, features), None, None, None)
    m = features + d + 1

    def equations(s, y):
        x = model.design(s)
        return np.concatenate([(x.T @ x).ravel(), x.T @ y])

    sums = _added(main, equations, m * m + m)
    a, b = sums[: m * m].reshape(m, m), sums[m * m :]
    penalty = np.full(m, ridge * n)
    penalty[-1] = 0
    model.weights = np.linalg.solve(a + np.diag(penalty), b)
    grid = np.linspace(-0.5, 1.5, BINS)

    def histogram(s, y):
        k = np.clip(np.searchsorted(grid, model.raw(s)), 0, BINS - 1)
        return np.concatenate([np.bincount(k, minlength=BINS), np.bincount(k, weights=y, minlength=BINS)])

    found = _added(apart, histogram, 2 * BINS)
    if not found[:BINS].sum():
        found = _added(main, histogram, 2 * BINS)
    model.xs, model.ys = isotonic(grid, found[:BINS], found[BINS:])
    return model


def _score(shared, threshold):
    def run(stream):
        for batch in batches(stream):
            s = shared.value.score(statistics(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    return run


def _keep(shared, threshold, at):
    def run(stream):
        for batch in batches(stream):
            good = shared.value.score(statistics(batch.column(at))) >= threshold
            yield batch.filter(pa.array(good))

    return run


def remainder(modulus: int):
    """crc32 of doc_id as text, modulo ``modulus``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def train_model(docs: DataFrame, labels: DataFrame, *, max_fit: int = MAX_FIT) -> Model:
    """Fit on the labelled rows of ``docs`` that are not held out. Labels of about
    ``max_fit`` rows at most (17 bytes each) are broadcast to the texts."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    known = known.withColumn("fold", remainder(5)).where("fold <> 0")
    n = known.count()
    if n > max_fit:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_fit / n))
    known = workspace.materialise(known, "quality-labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(known), "doc_id").select("text", "y", (F.col("fold") == 4).alias("apart"))
    return fit(workspace.materialise(rows.mapInArrow(_measure, "stats array<double>, y double, apart boolean"), "quality-train"))


def score_quality(docs: DataFrame, labels: DataFrame, *, max_fit: int = MAX_FIT, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text),
    learnt from ``labels`` (doc_id, quality) of rows that are not held out."""
    spark = docs.sparkSession
    workspace.ship(spark)
    shared = spark.sparkContext.broadcast(train_model(docs, labels, max_fit=max_fit))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.select("doc_id", "text", (remainder(5) == 0).alias("held_out")).mapInArrow(_score(shared, threshold), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, *, max_fit: int = MAX_FIT, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns."""
    spark = docs.sparkSession
    workspace.ship(spark)
    shared = spark.sparkContext.broadcast(train_model(docs, labels, max_fit=max_fit))
    return docs.mapInArrow(_keep(shared, threshold, docs.columns.index("text")), docs.schema)
