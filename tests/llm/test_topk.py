import math
import random

from tessera.llm import topk


def brute(rows, k=5):
    good = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(256.0 * x) for x in v]))
    out = set()
    for qi, q in good:
        if qi % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in good if i != qi and len(v) == len(q))[:k]
            out |= {(qi, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def answer(df):
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()}


def test_ties_bad_vectors_and_lengths(spark):
    r = random.Random(5)
    rows = [(i, [r.choice((-1.0, 0.0, 0.5, 1.0)) for _ in range(4)]) for i in range(400)]
    rows += [(400, None), (450, []), (500, [1.0, None, 0.0, 0.0]), (550, [float("nan")] * 4), (600, [float("inf"), 0.0, 0.0, 0.0]), (650, [1.0, 2.0]), (651, [1.0, 2.0]), (None, [1.0] * 4), (-50, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string").repartition(3)
    assert answer(topk.exact_topk(df)) == brute(rows)
    assert answer(topk.exact_topk(df, tile=3)) == brute(rows)


def test_very_large_components_are_exact(spark):
    rows = [(0, [1e7, 1.0]), (1, [1e7, 2.0]), (2, [1e7, 3.0]), (50, [-1e7, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert answer(topk.exact_topk(df)) == brute(rows)


def test_empty_and_no_queries(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.exact_topk(spark.createDataFrame([], schema)).collect() == []
    assert topk.exact_topk(spark.createDataFrame([(1, [1.0])], schema)).collect() == []
    assert topk.exact_topk(spark.createDataFrame([(50, [1.0])], schema)).collect() == []


def test_rows_repeated_with_one_id(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [0.5, 2.0]), (4, [9.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    # Asked once, with the smaller vector; each row of another id is a candidate, none of its own.
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.exact_topk(df).collect())
    assert got == [(50, 1, 4, 131072), (50, 2, 3, 65536), (50, 3, 3, 65536), (50, 4, 4, 0)]
