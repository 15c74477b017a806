import collections
import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import components as C
from tessera.llm import near_dedup as N
from tessera.llm.components import connected_components


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))) if w else frozenset()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    index = collections.defaultdict(list)
    for i, s in sets.items():
        for v in s:
            index[v].append(i)
    for i, s in sets.items():
        for j, both in collections.Counter(j for v in s for j in index[v]).items():
            if j > i and 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def answer(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_equals_brute_force_on_documents(spark, size, percent):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert answer(N.near_duplicates(docs, shingle=size, percent=percent)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], size, percent)


def test_a_large_family_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 40)
    monkeypatch.setattr(N, "BLOCK_SHINGLES", 4000)
    r = random.Random(3)
    base, rows = [f"w{r.randrange(400)}" for _ in range(120)], []
    for i in range(300):
        w = list(base)
        for _ in range(r.randrange(0, 7)):
            w[r.randrange(len(w))] = f"x{r.randrange(9999)}"
        rows.append((i, " ".join(w[: len(w) - r.randrange(0, 30)])))
    rows += [(1000 + i, " ".join(base[:60] + [f"y{i}.{j}" for j in range(60)])) for i in range(60)]
    assert answer(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85)) == brute(rows, 3, 85)


def test_small_sets_at_the_threshold_are_linked_in_every_order(spark):
    # Texts of 9 words and the same without the last: 4 of 5 shingles. Its hash ranks anywhere among the five.
    rows, ranks = [], set()
    for n in range(40):
        w = [f"v{n}.{j}" for j in range(9)]
        rows += [(2 * n, " ".join(w)), (2 * n + 1, " ".join(w[:8]))]
        whole, part = N.shingle_sets(pa.array([rows[-2][1], rows[-1][1]]), 5)
        ranks.add(int(np.flatnonzero(~np.isin(whole, part))[0]))
    assert ranks == set(range(5))
    assert answer(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 5, 80)


def test_low_thresholds_miss_no_small_sets(spark):
    rows = [(1, "a"), (2, "a b"), (3, "c d e"), (4, "d x y"), (5, "f g h i"), (6, "f g p q")]
    assert answer(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1, percent=33)) == brute(rows, 1, 33)


@pytest.mark.parametrize("percent", [50, 67, 75, 80, 85, 95])
def test_shortest_runs_hold_in_every_order(percent):
    shortest = N.shortest_runs(percent, 64)
    for both, left, right in itertools.product(range(1, 6), range(3), range(3)):
        if not left + right or 100 * both < percent * (both + left + right):
            continue
        for marks in set(itertools.permutations("s" * both + "l" * left + "r" * right)) if both + left + right < 8 else ():
            longest = max(len(x) for x in "".join(marks).replace("l", "|").replace("r", "|").split("|"))
            assert longest >= max(shortest[both + left], shortest[both + right])


@pytest.mark.parametrize("percent,run", [(80, 3), (85, 3), (85, 2), (60, 3), (100, 3)])
def test_runs_counted_on(percent, run):
    chance = N.fewer_runs(percent / 100, 12, run)
    exact = np.zeros(14)
    for bits in itertools.product((0, 1), repeat=12):
        weight = math.prod(percent / 100 if b else 1 - percent / 100 for b in bits)
        exact[sum(all(bits[i : i + run]) for i in range(13 - run)) + 1] += weight
    assert np.allclose(chance, np.cumsum(exact), atol=1e-12)
    usual, fewer = N.sure_runs(percent, 64, run)
    chance = N.fewer_runs(percent / 100, 64, run)
    assert usual >= 1 and (usual == 1 or chance[usual] <= N.LOSS) and all(0 < m < usual for m in fewer.values())
    # Whole sets in random orders at the threshold share as many runs as their sizes promise.
    r = random.Random(4)
    for _ in range(2000):
        both = r.randrange(1, 64)
        apart = both * (100 - percent) // percent
        mine = r.randrange(0, apart + 1)
        if not apart or both + max(mine, apart - mine) > 64:
            continue
        marks = ["s"] * both + ["l"] * mine + ["r"] * (apart - mine)
        r.shuffle(marks)
        shared = sum(marks[i : i + run] == ["s"] * run for i in range(len(marks)))
        for n in (both + mine, both + apart - mine):
            # A single list is always kept; shorter runs stand in where none is shared.
            assert shared >= fewer.get(n, usual) or fewer.get(n, usual) == 1


def test_sure_runs_of_both_contracts():
    assert N.sure_runs(85, 64, 3)[0] == 5 and N.sure_runs(80, 64, 3)[0] == 2


def test_a_common_passage_ties_no_large_family(spark):
    # Every text holds the same passage, a quarter of its words, and is its own otherwise.
    r = random.Random(8)
    passage = [f"p{i}" for i in range(50)]
    rows = [(i, " ".join(passage + [f"u{i}.{j}" for j in range(150)])) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 400, 10)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for size, percent in ((3, 85), (5, 80)):
        marks = docs.mapInArrow(N._sketches(size, 64), "doc_id long, n_shingles long, h1 long, h2 long, sketch array<long>")
        classes = marks.selectExpr("doc_id as rep", "n_shingles as n", "sketch")
        largest = [r["count"] for r in N._families(classes, percent, 64, 3).groupBy("family").count().collect()]
        assert len(largest) >= 40 and max(largest) <= 40
        assert answer(N.near_duplicates(docs, shingle=size, percent=percent)) == brute(rows, size, percent)


def test_edge_rows(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, " \n", "s"), (4, "One", "s"), (5, "one", "s"), (6, "one two", "s"), (7, "ONE TWO", "s"), (None, "one", "s"), (9, "a b c d e", "s"), (9, "one", "s"), (10, "A b c d e", "s")]
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept string"), shingle=3, percent=85).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["component_id"])
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    # 9 was given twice, with the texts of 4 and of 10: it ties both groups.
    assert by == {1: {1}, 2: {2}, 3: {3}, 4: {4}, 5: {4}, 6: {6}, 7: {6}, None: {None}, 9: {4}, 10: {4}}
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_very_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(60000))
    rows = [(1, long), (2, long + " tail"), (3, long[: len(long) // 2])]
    assert answer(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == {1: (59996, 1), 2: (59997, 1), 3: (brute(rows, 5, 80)[3][0], 3)}


def test_one_of_each_stays(spark):
    rows = [(1, "a b c d e f g", 1), (2, "a b c d e f g", 2), (3, "q", 3), (3, "q", 4)]
    kept = N.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, kept int"))
    assert kept.columns == ["doc_id", "text", "kept"] and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_rows_that_stay_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 1, 2), (None, "a b c d e f", 1, 2), (4, None, 1, 2)], "doc_id long, text string, gone int, _Gone int")
    kept = N.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 4, None]
    assert N.keep_one_of_each(df.limit(0)).collect() == []


def test_nothing_is_broadcast_beyond_the_limit(spark, monkeypatch):
    monkeypatch.setattr(N, "BROADCAST_ROWS", 0)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
    assert answer(N.near_duplicates(docs)) == want
    assert sorted(r["doc_id"] for r in N.keep_one_of_each(docs).collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_union_sketches_estimate_similarity():
    r = np.random.default_rng(5)
    for k in (4, 16, 64):
        sets = [np.unique(r.integers(0, 400, r.integers(1, 200), dtype=np.uint64)) for _ in range(12)]
        sketches = [s[:k] for s in sets]
        shared = [(b, i, j) for b in range(1, 12) for i, x in enumerate(sketches[0]) for j, y in enumerate(sketches[b]) if x == y]
        shared.sort(key=lambda x: x[1])
        if not shared:
            continue
        found, guess, depth = N.union_estimates(sketches, 0, *map(np.array, zip(*shared)), k)
        for b, g, d in zip(found, guess, depth):
            union = np.union1d(sketches[0], sketches[b])[:k]
            assert d == len(union) and g == np.isin(union, np.intersect1d(sets[0], sets[b])).mean()


def reached(edges):
    """The smallest node that every node of ``edges`` reaches."""
    up = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a in up and b in up and up[a] != up[b]:
                up[a] = up[b] = min(up[a], up[b])
                changed = True
    return up


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (7, None), (10, 11), (11, 12), (12, 13), (13, 10)] + [(100 + k, 101 + k) for k in range(40)] + [(500, 500 + k) for k in range(1, 30)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in (1, 2, 3)} == {1} and got[5] == got[4] == 4 and 9 not in got and {got[k] for k in range(10, 14)} == {10}
    assert {got[k] for k in range(100, 141)} == {100} and {got[k] for k in range(500, 530)} == {500}


def test_few_edges_need_no_round_of_shuffles(spark):
    r = random.Random(6)
    edges = [(r.randrange(600), r.randrange(600)) for _ in range(400)] + [(1000 + k, 1001 + k) for k in range(500)] + [(-5, 2000), (2000, 3000), (None, 4), (9000, 9000)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), rounds=0).collect()}
    assert got == reached(edges)
    assert connected_components(spark.createDataFrame([], "a long, b long"), rounds=0).collect() == []


@pytest.mark.parametrize("limit", [0, 60, 150])
def test_more_edges_are_contracted_in_rounds(spark, monkeypatch, limit):
    # At 0 to the end; at 60 and 150 until so few are left.
    monkeypatch.setattr(C, "TASK_EDGES", limit)
    r = random.Random(7)
    edges = [(r.randrange(90), r.randrange(90)) for _ in range(300)] + [(200 + k, 201 + k) for k in range(20)]
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x["node"]: x["component"] for x in rows} == reached(edges) and len(rows) == len(reached(edges))


def test_near_duplicates_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(C, "TASK_EDGES", 0)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert answer(N.near_duplicates(docs, shingle=3, percent=85)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], 3, 85)


def test_compare_links_only_across_sides():
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 1, 2)]
    assert len(N.compare([1, 2, 3], sets, None, 85, 64)) == 2
    assert N.compare([1, 2, 3], sets, np.array([1, 1, 1]), 85, 64) == []
    assert len(list(N.shingle_sets(pa.array(["a b c d", None]), 3))) == 2
