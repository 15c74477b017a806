import collections
import math
import zlib

import numpy as np
import pytest

from tessera.llm import lm_scoring as L


def model(rows):
    """The base counts, and the interpolated model from plain dictionaries."""
    tokens = [(i, (t or "").encode().lower().split() + ["<end>"]) for i, t in rows]
    fold = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10
    one, two, dev1, dev2 = (collections.Counter() for _ in range(4))
    for i, w in tokens:
        if fold(i):
            for a, b in zip(["<end>", *w], w):
                one[b] += 1
                two[a, b] += 1
                if fold(i) == 9:
                    dev1[b] += 1
                    dev2[a, b] += 1
    return tokens, fold, one, two, dev1, dev2


def test_scores_equal_a_plain_model(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(10_001, None), (10_002, ""), (10_003, "the " * 3000), (None, "of the"), (3, "one more text of 3")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, fold int").repartition(3)
    got = collections.defaultdict(list)
    for r in L.score_documents(df, chunk_bytes=60_000, shard_bytes=80_000).collect():
        got[r["doc_id"]].append(r)
    tokens, fold, one, two, dev1, dev2 = model(rows)
    n, v = sum(one.values()), len(one)
    # Weights from the exact estimates, without the histogram's rounding.
    codes = collections.Counter()
    for (a, b), times in dev2.items():
        c = one[a] - dev1[a]
        codes[(int(L.bucket_of(np.array([c]))[0]), (two[a, b] - dev2[a, b]) / c if c else 0.0, (one[b] - dev1[b]) / (n - sum(dev1.values())))] += times
    keys = np.array([(x << 24) | (int(L._bin(np.array([p]))[0]) << 12) | int(L._bin(np.array([q]))[0]) for x, p, q in codes])
    weights = L.learn_weights(keys, np.array(list(codes.values()), float), v)
    for i, w in tokens:
        base = sum(math.log10((one[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        known = sum(one[x] > 0 for x in w)
        score = 0.0
        for a, b in zip(["<end>", *w], w):
            x = weights[L.bucket_of(np.array([one[a]]))[0]]
            score += math.log10(min(1.0, x[0] * (two[a, b] / one[a] if one[a] else 0) + x[1] * one[b] / n + x[2] / (v + 1)))
        assert any(
            r["held_out"] == (fold(i) == 0) and (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), known, n) and r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score, rel=1e-6)
            for r in got[i]
        ), i
    assert sum(map(len, got.values())) == len(rows)


@pytest.mark.parametrize("chunk_bytes", [60_000, L.CHUNK_BYTES])
def test_rows_given_twice_in_the_same_order_are_scored_and_counted_each(spark, tmp_path, chunk_bytes):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    # The same rows in other chunks: every row next to its copy.
    docs.union(docs).orderBy("doc_id").coalesce(1).write.parquet(f"{tmp_path}/twice")
    beside = L.score_documents(spark.read.parquet(f"{tmp_path}/twice"), chunk_bytes=chunk_bytes)
    got, want = (sorted(tuple(r) for r in x.collect()) for x in (L.score_documents(docs.union(docs), chunk_bytes=chunk_bytes), beside))
    assert len(got) == 2 * docs.count() and got[0::2] == got[1::2]
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_equal_chunks_in_one_split(spark):
    df = spark.createDataFrame([(1, "a b " * 9000)] * 3 + [(9, "a b " * 9000)] * 2, "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = L.score_documents(df, chunk_bytes=20_000).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 5 and {r["train_tokens"] for r in got} == {5 * 18_001} and len({r["doc_id"] for r in got}) == 2


def test_interpolation_beats_the_base_on_held_out_texts(spark):
    held = L.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").selectExpr("sum(score) / sum(n_tokens) as s", "sum(base_score) / sum(n_tokens) as b").first()
    assert held["s"] > held["b"] + 0.3


def test_empty_and_untrained(spark):
    schema = "doc_id long, text string"
    assert L.score_documents(spark.createDataFrame([], schema)).collect() == []
    (row,) = L.score_documents(spark.createDataFrame([(None, "a b")], schema)).collect()
    assert row["held_out"] and (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0) and row["base_score"] == 0.0


@pytest.mark.parametrize("shards", [1, 4, 1000, 3_000_000_000])
def test_keys_go_to_few_shards_in_order(shards):
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 500, dtype=np.uint64))
    of, at = L._shards_of(keys, shards)
    assert np.repeat(of, np.diff(at)).tolist() == [int(k) * shards >> 64 for k in keys] and (np.diff(of) > 0).all()
    assert [x.tolist() for x in L._shards_of(keys[:0], shards)] == [[], [0]]


def test_many_more_shards_than_keys(spark):
    docs = spark.createDataFrame([(k, "a b c %d" % k) for k in range(40)] + [(41, None)], "doc_id long, text string").repartition(3)
    few, many = (sorted(tuple(r) for r in L.score_documents(docs, chunk_bytes=200, shard_bytes=n).collect()) for n in (1 << 20, 1))
    assert [r[:5] for r in few] == [r[:5] for r in many] and np.allclose([r[5:] for r in few], [r[5:] for r in many])


def test_counts_round_trip():
    c = np.array([0, 1, 254, 255, 256, 10**12])
    assert L.unpack(L.pack(c)).tolist() == c.tolist() and L.unpack(L.pack(c[:0])).tolist() == []


def test_em_finds_the_generating_weights():
    r = np.random.default_rng(7)
    b2, b1 = r.integers(1, 30, 4000), r.integers(1, 60, 4000)
    p2, p1 = 2.0 ** (-(b2 - 1) / 4), 2.0 ** (-(b1 - 1) / 4)
    times = 1e6 * (0.7 * p2 + 0.25 * p1 + 0.05 / 1001)
    w = L.learn_weights((5 << 24) | (b2 << 12) | b1, times, 1000, rounds=200)
    assert w.shape == (L.BUCKETS, 3) and np.allclose(w.sum(1), 1) and w[5, 0] > w[5, 1] > w[5, 2]
