import collections

import pytest

from tessera.llm import mixing


def docs(spark, n=3000):
    rows = [(i, " ".join("w" * (1 + i % 5) for _ in range(1 + i * 7 % 90)), "hot" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None) for i in range(n)]
    return rows + [(n, None, "s1"), (n + 1, "", "s1"), (n + 2, "alone " * 50, "tiny"), (5, "again", "s5")]


def test_targets_takes_and_positions(spark):
    rows = docs(spark)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, target int").repartition(5)
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    total = sum(len((t or "").split()) for _, t, _ in rows)
    by = collections.defaultdict(lambda: [0, 0, 0.0, 0])
    source = {i: s for i, _, s in rows}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and len(r["positions"]) == (r["taken"] // r["size"] if r["size"] else 0)
        assert list(r["positions"]) == sorted(r["positions"]) and all(0 <= x <= 1 for x in r["positions"])
        s = by[source[r["doc_id"]]]
        s[0] += r["size"]
        s[1] += r["taken"]
        s[2], s[3] = r["target"], r["source_size"]
    weights = dict(zip(sorted(by, key=lambda s: (s is None, s or "")), [5, 2, 1] * 9))
    assert sum(s[2] for s in by.values()) == pytest.approx(1.5 * total)
    levels = {round(s[2] / weights[k], 6) for k, s in by.items() if s[2] < 2 * s[0] - 1e-6}
    assert len(levels) == 1  # sources below their cap share by weight
    for k, (size, taken, target, said) in by.items():
        assert size == said and target <= 2 * size + 1e-6 and abs(taken - target) <= 90, k
        assert target == pytest.approx(2 * size) or target / weights[k] == pytest.approx(levels.copy().pop())
    assert sorted(got) == sorted(mixing.mix_sources(df.repartition(2)).collect())


def test_documents_come_in_training_order(spark):
    df = spark.createDataFrame(docs(spark, 300), "doc_id long, text string, source string")
    mixed = mixing.mix_sources(df)
    order = [(r["doc_id"], r["position"]) for r in mixing.training_order(mixed).collect()]
    assert [p for _, p in order] == sorted(p for _, p in order)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    assert collections.Counter(r["doc_id"] for r in out.collect()) == collections.Counter(i for i, _ in order)
    assert [r["doc_id"] for r in out.collect()] == [i for i, _ in order]


def test_empty_and_wordless(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix_sources(spark.createDataFrame([], schema)).collect() == []
    (row,) = mixing.mix_sources(spark.createDataFrame([(1, None, None)], schema)).collect()
    assert (row["size"], row["taken"], row["target"]) == (0, 0, 0.0)


def test_schedules_shift_sources_over_time(spark):
    rows = [(i, "w " * 20, f"s{i % 3}") for i in range(900)]
    order = mixing.training_order(mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 1, 1))).collect()
    half = len(order) // 2
    first = collections.Counter(r["doc_id"] % 3 for r in order[:half])
    assert first[0] > first[1] > first[2]  # slopes -0.5, 0, 0.5
