import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.1"


def held_out(spark, query, label, modulus, rest):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in query(spark, SF).collect()]
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) and 0 <= r["score"] <= 1
    test = [(r["predicted"], labels[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    return rows, np.array(test)


def test_quality_on_held_out_labels(spark):
    rows, t = held_out(spark, queries.op2_score_quality, "quality", 5, 0)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert (t[:, 0] == t[:, 1]).mean() > 0.98
    assert t[t[:, 1] == 1, 0].mean() > 0.995  # clean documents are kept


def test_toxicity_on_held_out_labels(spark):
    rows, t = held_out(spark, queries.op3_score_toxicity, "toxic", 3, 1)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert t[t[:, 1] == 1, 0].mean() > 0.8 and t[t[:, 1] == 0, 0].mean() < 0.01


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_edge_rows(spark, score):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "word " * 30000, 3), (4, "x", 4), (4, "x", 4), (None, "y", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = score(docs, labels).collect()
    assert len(rows) == 6 and len({r["score"] for r in rows}) == 1
    mixed = spark.createDataFrame([(i, k, k) for i in (2, 3, 4, 6, None) for k in (0, 1, None, 7)] + [(1, 0, 0)], "doc_id long, quality int, toxic int")
    rows = score(docs, mixed).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
    assert score(docs.limit(0), labels).collect() == []


def test_rows_that_stay_keep_their_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    good = {r["doc_id"] for r in quality.score_quality(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == good


def test_statistics_do_not_depend_on_the_batch():
    texts = ["One two  two.\nThree ### |", None, "", "ÄÖ ÄÖ !!", "a", "STOP STOP NOW"]
    whole = quality.statistics(pa.array(texts))
    for k, t in enumerate(texts):
        assert np.allclose(quality.statistics(pa.array([t], pa.string()))[0], whole[k])
    assert not whole[1].any() and not whole[2].any()


def test_isotonic_pools_violators():
    xs, ys = quality.isotonic(np.arange(5.0), np.ones(5), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(ys) >= 0).all() and ys[0] == 0 and ys[-1] == 1


def test_features_of_a_text_are_its_own():
    texts = ["you clown you", "", "You, clown: YOU!"]
    buckets, ends = toxicity.hashed_features(pa.array(texts))
    rows = [buckets[a:b].tolist() for a, b in zip(ends, ends[1:])]
    assert rows[0] == rows[2] and rows[1] == [0] and all(r[0] == 0 for r in rows)


def test_ftrl_learns_a_word_and_leaves_others_at_zero():
    r = np.random.default_rng(8)
    rows = [np.unique(np.r_[0, r.integers(2, 1000, 20), [1] if k % 2 else []]).astype(np.int64) for k in range(400)]
    ends = np.cumsum([0, *map(len, rows)])
    z, n = np.zeros(1024), np.zeros(1024)
    toxicity.ftrl_epoch(z, n, np.concatenate(rows), ends, np.arange(400) % 2)
    w = toxicity.sparse_weights(z, n)
    assert w[1] > 1 and (w != 0).sum() < 300


def plain_statistics(text):
    """One row of quality.NAMES from the text's definition, word by word."""
    raw = (text or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    words, lower = re.findall(rb"[^\x20\x09-\x0d]+", raw), re.findall(rb"[^\x20\x09-\x0d]+", low)
    n = len(words)
    if not n:
        return [0.0] * len(quality.NAMES)
    stops = b".,;:?'\"()-"
    is_stop = lambda b: b in stops
    is_symbol = lambda b: not (b in stops or b in b" \t\v\f\r\n" or 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128)
    share = lambda f: sum(map(f, raw)) / len(raw)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    pairs = list(zip(lower, lower[1:]))
    lines = raw.count(b"\n")
    some = lambda f: sum(map(f, words)) / n
    return [
        math.log1p(n), math.log1p(len(raw)), mean, math.sqrt(max(0, sum(x * x for x in lengths) / n - mean**2)),
        lines / len(raw), share(lambda b: 48 <= b < 58), share(lambda b: 65 <= b < 91), share(lambda b: 97 <= b < 123), share(is_symbol), share(lambda b: b >= 128), share(is_stop),
        len(set(lower)) / n, len(set(pairs)) / max(1, len(pairs)), sum(a == b for a, b in pairs) / max(1, len(pairs)), max(lower.count(w) for w in set(lower)) / n,
        some(lambda w: is_symbol(w[-1])), some(lambda w: len(w) == 1 and (is_symbol(w[0]) or is_stop(w[0]))),
        some(lambda w: len(w) > 1 and all(is_symbol(b) or is_stop(b) for b in w[-2:])), some(lambda w: len(w) > 1 and w[:2].isalpha() and w[:2].isupper()), math.log1p(n / (1 + lines)),
    ]


def test_statistics_equal_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["One two  two.\nThree ### |", None, "", "ÄÖ ÄÖ !!", "a", "STOP STOP (NOW) -", "x\x0b\x0cy"]
    assert np.allclose(quality.statistics(pa.array(texts)), [plain_statistics(t) for t in texts])


def test_quality_scores_equal_brute_force(spark):
    """The model from all rows at once: features, normal equations by least squares,
    and the isotonic regression by its min-max formula."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(10_001, None), (10_002, "")]
    labels = {i: int(sum(map(len, (t or "").split()[:3])) % 3 > 0) for i, t in docs}
    got = {r["doc_id"]: r for r in quality.score_quality(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in docs}
    x = {i: np.array(plain_statistics(t)) for i, t in docs}
    main, apart = [i for i, _ in docs if fold[i] in (1, 2, 3)], [i for i, _ in docs if fold[i] == 4]
    m = np.array([x[i] for i in main])
    mean, scale = m.mean(0), m.std(0)
    scale[scale < 1e-9] = 1.0
    rng = np.random.default_rng(7)
    w, b = rng.normal(0, math.sqrt(2 * quality.GAMMA), (len(mean), quality.FEATURES)), rng.uniform(0, 2 * np.pi, quality.FEATURES)

    def row(i):
        z = np.clip((x[i] - mean) / scale, -6, 6)
        return np.r_[np.sqrt(2 / len(b)) * np.cos(z @ w + b), z, 1.0]

    a = np.array([row(i) for i in main])
    root = np.sqrt(quality.RIDGE * len(main)) * np.eye(a.shape[1])
    root[-1] = 0
    beta = np.linalg.lstsq(np.vstack([a, root]), np.r_[[labels[i] for i in main], np.zeros(len(root))], rcond=None)[0]
    grid = np.linspace(-0.5, 1.5, quality.BINS)
    bins = {}
    for i in apart:
        bins.setdefault(min(quality.BINS - 1, int(np.searchsorted(grid, row(i) @ beta))), []).append(labels[i])
    keys = sorted(bins)
    mean_of = lambda p, q: np.mean([y for k in keys[p : q + 1] for y in bins[k]])
    level = [max(min(mean_of(p, q) for q in range(k, len(keys))) for p in range(k + 1)) for k in range(len(keys))]
    steps = {}
    for k, y in zip(keys, level):
        steps.setdefault(round(y, 9), []).extend([grid[k]] * len(bins[k]))
    xs, ys = [np.mean(v) for v in steps.values()], list(steps)
    off = [abs(got[i]["score"] - np.interp(row(i) @ beta, xs, ys)) for i, _ in docs]
    assert max(off) < 1e-5, max(off)


def plain_features(text):
    """The names of a text's features."""
    w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[!-/:-@\[-`{-~]", b" ", (text or "").encode()).lower())
    return {()} | {("w", x) for x in w} | {("s", k, x[:k]) for k in toxicity._STEMS for x in w if len(x) > k} | {("p", *p) for p in zip(w, w[1:])} | {("g", *p) for p in zip(w, w[2:])}


def test_toxicity_equals_brute_force(spark):
    """FTRL-proximal over features by name, one at a time, in the same order of rows."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [(float("er" in (t or "")[:40]), t) for _, t in docs[:120]] + [(1.0, None), (0.0, "You, YOU clown! clowns")]
    size = 1 << 28  # few features share a bucket
    buckets, ends = toxicity.hashed_features(pa.array([t for _, t in rows]), size)
    names = [plain_features(t) for _, t in rows]
    assert np.diff(ends).tolist() == list(map(len, names))
    z, n = {}, {}

    def weight(f):
        return 0.0 if abs(z.get(f, 0.0)) <= toxicity.L1 else (math.copysign(toxicity.L1, z[f]) - z[f]) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(2):
        for (y, _), x in zip(rows, names):
            w = {f: weight(f) for f in x}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for f in x:
                old = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / toxicity.ALPHA * w[f]
                n[f] = old + g * g
    used, place = np.unique(buckets, return_inverse=True)
    zz, nn = np.zeros(len(used)), np.zeros(len(used))
    for _ in range(2):
        toxicity.ftrl_epoch(zz, nn, place, ends, np.array([y for y, _ in rows]))
    got = np.add.reduceat(toxicity.sparse_weights(zz, nn)[place].astype(float), ends[:-1])
    assert np.allclose(got, [sum(map(weight, x)) for x in names], atol=1e-4) and np.abs(got).max() > 1
