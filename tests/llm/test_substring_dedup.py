import hashlib
import random

from tessera.llm import substring_dedup as S


def brute(rows, window):
    words = sorted(((i if i is not None else -(1 << 63)), i, (t or "").encode().split()) for i, t in rows)
    seen, out = {}, {}
    for _, i, w in words:
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[k : k + window]), (i, k)) != (i, k):
                keep[k : k + window] = [False] * window
        out[i] = (len(w), keep.count(False), hashlib.sha256(b" ".join(x for x, y in zip(w, keep) if y)).hexdigest())
    return out


def answer(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def test_equals_brute_force(spark):
    r = random.Random(4)
    passages = [" ".join(f"p{n}.{k}" for k in range(r.randrange(15, 70))) for n in range(6)]
    rows = []
    for i in range(150):
        parts = [" ".join(f"w{r.randrange(500)}" for _ in range(r.randrange(0, 60))) for _ in range(3)]
        parts[1:1] = [r.choice(passages)] if r.random() < 0.6 else []
        rows.append((i, "  ".join(parts) + ("\n" + passages[0] + " " + passages[0] if i % 9 == 0 else "")))
    rows += [(1000, "the " * 300), (1001, "the " * 100), (1002, rows[3][1]), (1003, None), (1004, ""), (1005, "The " * 30), (None, passages[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert answer(S.remove_repeats(df)) == brute(rows, 20)
    assert answer(S.remove_repeats(df, buffer=50)) == brute(rows, 20)
    assert answer(S.remove_repeats(df, window=5, gram=8)) == brute(rows, 5)


def test_nothing_is_broadcast_beyond_the_limit(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert answer(S.remove_repeats(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], 20)


def test_texts_larger_than_a_batch(spark):
    long = " ".join(f"w{k}" for k in range(1_500_000))  # 11 MB
    rows = [(1, long), (2, "x " + long[: len(long) // 2]), (3, "short")]
    assert answer(S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 20)


def test_rows_repeated_with_one_id(spark):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, long, 0), (1, long, 1), (2, long, 2)]
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, start int")).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(1, 0), (1, 0), (2, 40)]
    assert [tuple(x) for r in got if r["doc_id"] == 2 for x in r["removed"]] == [(0, 40)]


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_intervals():
    assert S.merge_intervals([5, 0, 3, 40], 4) == [(0, 9), (40, 44)] and S.merge_intervals([], 4) == []
