"""Language-model scoring by deleted interpolation.

A text is its words and one end. The probability of a token after its
predecessor mixes three estimates, maximum likelihood of the pair, maximum
likelihood of the token and the uniform distribution. The mixture weights
depend on how often the predecessor occurs (buckets by powers of two) and are
learnt by expectation-maximisation on held-out counts: training documents whose
crc32 leaves remainder DEV are taken out of the counts, and the weights
maximise the likelihood of their tokens. Scores then use all training counts.

Counts are exact over the whole corpus and are never gathered in one place:
1. The text is read in chunks of bounded size. A chunk sends its distinct
   tokens and pairs (64-bit hashes, sorted, with their counts) to the shards of
   the hash space, one row per chunk and shard. A word that fills a third of
   the corpus is one entry per chunk.
2. A shard adds up its keys and answers every chunk in the order it was asked.
3. Held-out pairs of each chunk meet the answers, and a bounded histogram of
   (bucket, pair estimate, token estimate) goes to the driver for EM.
4. Each chunk's texts meet its answers and are scored.
Chunks are named by their documents and by their place, the number of the
scan's split and of the chunk in it, so that copies of the same rows in the same
order are chunks of their own. The scan's splits are held fixed, so a task that
runs again cuts the same chunks; one cut differently could not be answered
wrongly: it would fail. ``docs`` is therefore a stored table, or a union of
such, not the output of a shuffle whose rows come in another order each time.

Defined results
* null or empty text is the end alone; a null doc_id counts as the empty id
  (held out); rows repeated are scored, and counted, each;
* without training documents every probability is 1; without held-out counts
  the three estimates weigh the same; an empty table gives an empty result;
* further columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import workspace
from .kernels import batches, mix64, release, split_words, text_buffer
from .quality import remainder

FOLDS, HELD, DEV = 10, 0, 9
CHUNK_BYTES = 6 << 20
SHARD_BYTES = 12 << 20
BUCKETS = 24
STEPS = 4
ROUNDS = 60
_END, _START = np.uint64(0x0E4D0E4D0E4D0E4D), np.uint64(0x57A27A2757A27A27)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def pack(counts: np.ndarray) -> bytes:
    """Counts in a byte each, those of 255 and more also in eight."""
    large = counts[counts >= 255].astype(np.int64)
    return np.int64(len(large)).tobytes() + large.tobytes() + np.minimum(counts, 255).astype(np.uint8).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    small = np.frombuffer(raw, np.uint8, offset=8 + 8 * n).astype(np.int64)
    if n:
        small[small == 255] = np.frombuffer(raw, np.int64, n, 8)
    return small


class Chunk:
    """Distinct tokens and pairs of some documents, sorted by hash."""

    def __init__(self, column: pa.Array, folds: np.ndarray):
        words = split_words(*text_buffer(column))
        hashes, counts = words.hashes, words.counts
        del words
        n = len(counts)
        self.sizes = counts + 1
        ends = np.cumsum(self.sizes)
        total = int(ends[-1]) if n else 0
        tokens = np.full(total, _END)
        inner = np.ones(total, bool)
        inner[ends - 1] = False
        tokens[inner] = hashes
        del hashes
        context = np.empty(total, np.uint64)
        context[1:] = tokens[:-1]
        context[ends - self.sizes] = _START
        self.starts, self.total = ends - self.sizes, total
        pairs = mix64(context * _PAIR + tokens)
        self.tokens, token_of = np.unique(tokens, return_inverse=True)
        self.token_of = token_of.astype(np.int32)
        del tokens, token_of
        self.pairs, first, pair_of = np.unique(pairs, return_index=True, return_inverse=True)
        self.pair_of = pair_of.astype(np.int32)
        del pairs, pair_of
        fold = np.repeat(folds, self.sizes)
        self.train = fold != HELD
        self.dev = fold == DEV
        # The start of a text is a context as often as the end is a token.
        self.token_of_pair = self.token_of[first]
        seen = context[first]
        at = np.searchsorted(self.tokens, np.where(seen == _START, _END, seen))
        self.context_of_pair = at

    def counts(self):
        count = lambda of, mask, n: np.bincount(of[mask], minlength=n)
        t, p = len(self.tokens), len(self.pairs)
        return [count(self.token_of, self.train, t), count(self.token_of, self.dev, t), count(self.pair_of, self.train, p), count(self.pair_of, self.dev, p)]


def _cut(stream, limit):
    """Batches -> (name, batch) chunks of about ``limit`` bytes."""
    held, size, split = [], 0, TaskContext.get().partitionId()
    numbers = itertools.count()

    def chunk():
        table = pa.Table.from_batches(held).combine_chunks()
        name = xxhash.xxh3_128()
        for c in (0, 1):
            column = table.column(c).combine_chunks()
            name.update(np.asarray(column.fill_null(-1)).tobytes())
        name.update(text_buffer(table.column(2))[1].tobytes())
        name.update(np.array([split, next(numbers)], np.int64).tobytes())
        return name.digest(), table

    for batch in batches(stream, max(1, limit // 4)):
        if held and size + batch.nbytes > limit:
            yield chunk()
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield chunk()


_ASK = pa.schema([("shard", pa.int32()), ("chunk", pa.binary()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("e", pa.binary()), ("f", pa.binary())])
_ASK_SQL = "shard int, chunk binary, part int, a binary, b binary, c binary, d binary, e binary, f binary"


def _shards_of(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shards that sorted keys fall into, and where each one's keys begin, with
    the end. Keys are dealt evenly (high half of key * shards), in their own order."""
    n = np.uint64(shards)
    low = ((keys & np.uint64(0xFFFFFFFF)) * n) >> np.uint64(32)
    at = ((keys >> np.uint64(32)) * n + low) >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    return at[first].astype(np.int64), np.r_[first, len(keys)]


def _ask(shards: int, limit: int):
    def run(stream):
        for name, table in _cut(stream, limit):
            release()
            chunk = Chunk(table.column(2), np.asarray(table.column(1)))
            del table
            tt, td, pt, pd = chunk.counts()
            (t_of, t_at), (p_of, p_at) = _shards_of(chunk.tokens, shards), _shards_of(chunk.pairs, shards)
            # Only shards that the chunk has keys for: work is bounded by its keys.
            asked = np.union1d(t_of, p_of)
            t_lo, t_hi = t_at[np.searchsorted(t_of, asked)], t_at[np.searchsorted(t_of, asked, side="right")]
            p_lo, p_hi = p_at[np.searchsorted(p_of, asked)], p_at[np.searchsorted(p_of, asked, side="right")]
            rows = []
            for s, t, p in zip(asked.tolist(), map(slice, t_lo, t_hi), map(slice, p_lo, p_hi)):
                rows.append((s, name, s, chunk.tokens[t].tobytes(), pack(tt[t]), pack(td[t]), chunk.pairs[p].tobytes(), pack(pt[p]), pack(pd[p])))
            held = np.flatnonzero(pd)
            if len(held):
                # Travels with the questions to be stored beside the answers.
                rows.append((-1 - int.from_bytes(name[:3], "little") % shards, name, -1, held.astype(np.uint32).tobytes(), pack(pd[held]), chunk.token_of_pair[held].astype(np.uint32).tobytes(), chunk.context_of_pair[held].astype(np.uint32).tobytes(), None, None))
            del chunk, tt, td, pt, pd
            for lo in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[lo : lo + 64]), _ASK)], schema=_ASK)

    return run


def _totals(keys: list[bytes], counts: list[list[bytes]]) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """Sums by key over several sorted lists, answered in the lists' own order."""
    arrays = [np.frombuffer(k, np.uint64) for k in keys]
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    _, of = np.unique(flat, return_inverse=True)
    cuts = np.cumsum([len(a) for a in arrays])[:-1]
    out, sums = [], []
    for column in counts:
        each = np.concatenate([unpack(c) for c in column]) if column else np.zeros(0, np.int64)
        total = np.bincount(of, weights=each).astype(np.int64)
        out.append([pack(x) for x in np.split(total[of], cuts)])
        sums.append(total)
    return out, sums


_ANSWER = pa.schema([("chunk", pa.binary()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("n_dev", pa.int64())])
_ANSWER_SQL = "chunk binary, part int, a binary, b binary, c binary, d binary, n long, v long, n_dev long"


def _answer(table: pa.Table) -> pa.Table:
    release()
    column = lambda name: table.column(name).to_pylist()
    chunk, part = column("chunk"), column("part")
    n = len(chunk)
    if part[0] == -1:
        a, b, c, d = (column(x) for x in "abcd")
        rest = [[None] * n] * 3
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip([chunk, part, a, b, c, d, *rest], _ANSWER)], schema=_ANSWER)
    (tt, td), (train, dev) = _totals(column("a"), [column("b"), column("c")])
    (pt, pd), _ = _totals(column("d"), [column("e"), column("f")])
    sums = [None, -2, None, None, None, None, int(train.sum()), int((train > 0).sum()), int(dev.sum())]
    columns = [chunk, part, tt, td, pt, pd, [None] * n, [None] * n, [None] * n]
    return pa.Table.from_arrays([pa.array([*x, y], f.type) for x, y, f in zip(columns, sums, _ANSWER)], schema=_ANSWER)


def _answers(table: pa.Table) -> list[np.ndarray]:
    """A chunk's answers in the order of its sorted keys."""
    order = np.argsort(np.asarray(table.column("part").combine_chunks()))
    return [np.concatenate([unpack(x[int(k)].as_py()) for k in order]) for x in (table.column(c).combine_chunks() for c in "abcd")]


def bucket_of(counts: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + floor(log2(count)), bounded."""
    return np.where(counts > 0, np.minimum(BUCKETS - 1, 1 + np.log2(np.maximum(counts, 1)).astype(int)), 0)


def estimates(pair, context, token, n):
    """Maximum-likelihood estimates of the pair and of the token (0 where undefined)."""
    return np.where(context > 0, pair / np.maximum(context, 1), 0.0), token / max(n, 1)


def _bin(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, 1 + np.round(-STEPS * np.log2(np.where(p > 0, p, 1.0))).astype(np.int64), 0)


def _held_out(n: int):
    def run(asked: pa.Table, answered: pa.Table) -> pa.Table:
        if not asked.num_rows or not answered.num_rows:
            raise RuntimeError("a chunk has no answers")
        tt, td, pt, pd = _answers(answered)
        row = {c: asked.column(c)[0].as_py() for c in "abcd"}
        at, times = np.frombuffer(row["a"], np.uint32), unpack(row["b"])
        token, context = np.frombuffer(row["c"], np.uint32), np.frombuffer(row["d"], np.uint32)
        two, one = estimates((pt - pd)[at], (tt - td)[context], (tt - td)[token], n)
        code = (bucket_of((tt - td)[context]) << 24) | (np.minimum(_bin(two), 4095) << 12) | np.minimum(_bin(one), 4095)
        codes, of = np.unique(code, return_inverse=True)
        return pa.Table.from_arrays([pa.array(codes), pa.array(np.bincount(of, weights=times).astype(np.int64))], names=["code", "times"])

    return run


def learn_weights(codes: np.ndarray, times: np.ndarray, v: int, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (pair, token, uniform) per bucket by EM on the histogram.
    A bucket without held-out tokens gets the weights of all buckets together."""
    bucket, b2, b1 = codes >> 24, (codes >> 12) & 4095, codes & 4095
    value = lambda b: np.where(b > 0, 2.0 ** (-(b - 1) / STEPS), 0.0)
    parts = np.stack([value(b2), value(b1), np.full(len(codes), 1.0 / (v + 1))])

    def em(mask):
        w, p, t = np.full(3, 1 / 3), parts[:, mask], times[mask]
        for _ in range(rounds):
            share = w[:, None] * p
            w = (share / share.sum(0) * t).sum(1) / t.sum()
        return w

    out = np.full((BUCKETS, 3), 1 / 3)
    if len(codes):
        out[:] = em(np.ones(len(codes), bool))
        for b in np.unique(bucket):
            out[b] = em(bucket == b)
    # No estimate may vanish: a token unknown to both others keeps a probability.
    out = np.maximum(out, 1e-6)
    return out / out.sum(1, keepdims=True)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(n: int, v: int, weights: np.ndarray):
    def run(texts: pa.Table, answered: pa.Table) -> pa.Table:
        if not texts.num_rows or not answered.num_rows:
            raise RuntimeError("a chunk has no answers")
        release()
        order = np.argsort(np.asarray(texts.column("place").combine_chunks()), kind="stable")
        texts = texts.take(pa.array(order))
        folds = np.asarray(texts.column("fold").combine_chunks())
        chunk = Chunk(texts.column("text"), folds)
        tt, _, pt, _ = _answers(answered)
        if len(tt) != len(chunk.tokens) or len(pt) != len(chunk.pairs):
            raise RuntimeError("a chunk was cut differently")
        base = np.log10((tt + 0.1) / (n + 0.1 * (v + 1)))
        context = tt[chunk.context_of_pair]
        two, one = estimates(pt, context, tt[chunk.token_of_pair], n)
        w = weights[bucket_of(context)]
        mixed = np.log10(np.minimum(1.0, w[:, 0] * two + w[:, 1] * one + w[:, 2] / (v + 1)))
        rows = len(chunk.sizes)
        owner = np.repeat(np.arange(rows), chunk.sizes)
        per = lambda x: np.bincount(owner, weights=x, minlength=rows)
        columns = [
            texts.column("doc_id"), pa.array(folds == HELD), pa.array(chunk.sizes, pa.int64()), pa.array(per(tt[chunk.token_of] > 0).astype(np.int64)), pa.array(np.full(rows, n), pa.int64()),
            pa.array(per(base[chunk.token_of])), pa.array(per(mixed[chunk.pair_of])),
        ]
        return pa.Table.from_arrays(columns, names=[x.split()[0] for x in _SCORES.split(", ")])

    return run


def _name_chunks(limit: int):
    def run(stream):
        for name, table in _cut(stream, limit):
            table = table.append_column("place", pa.array(np.arange(table.num_rows), pa.int32()))
            for batch in table.to_batches(max_chunksize=2048):
                yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows, pa.binary()), *batch.columns], names=["chunk", "doc_id", "fold", "text", "place"])

    return run


def score_documents(docs: DataFrame, *, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for
    every row of ``docs`` (doc_id, text), learnt from those not held out."""
    spark = docs.sparkSession
    workspace.ship(spark)
    workspace.steady_splits(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", remainder(FOLDS).cast("int").alias("fold"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(4, math.ceil(size / shard_bytes))
    answers = texts.mapInArrow(_ask(shards, chunk_bytes), _ASK_SQL).groupBy("shard").applyInArrow(_answer, _ANSWER_SQL)
    answers = workspace.materialise(answers, "lm-answers")
    n, v, n_dev = (int(x or 0) for x in answers.where("part = -2").agg(F.sum("n"), F.sum("v"), F.sum("n_dev")).first())

    replies = answers.where("part >= 0").select("chunk", "part", "a", "b", "c", "d")
    asked = answers.where("part = -1").select("chunk", "a", "b", "c", "d")
    found = asked.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_skip_missing(_held_out(n - n_dev)), "code long, times long")
    table = found.groupBy("code").agg(F.sum("times").alias("times")).toArrow()  # bounded by buckets and bins
    weights = learn_weights(np.asarray(table.column("code").combine_chunks()), np.asarray(table.column("times").combine_chunks()).astype(float), v)

    named = texts.mapInArrow(_name_chunks(chunk_bytes), "chunk binary, doc_id long, fold int, text string, place int")
    return named.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_score(n, v, weights), _SCORES)


def _skip_missing(inner):
    """Chunks without held-out pairs have answers that nobody asks for."""

    def run(asked: pa.Table, answered: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64())], names=["code", "times"])
        return inner(asked, answered)

    return run
