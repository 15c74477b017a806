import collections

import pytest

import corpus_pipeline as P
from tessera.llm import bpe, mixing, near_dedup, queries, workspace

SF = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    counts = []
    for n, (name, stage) in enumerate(P.STAGES):
        before = docs
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        ids = [r["doc_id"] for r in docs.collect()]
        counts.append(len(ids))
        if n < len(P.STAGES) - 1:
            assert docs.columns == columns, name
        old = [r["doc_id"] for r in before.collect()]
        assert set(ids) <= set(old)
        if n == 1:
            keep = {}
            for i in old:
                low = texts[i].translate({c: c + 32 for c in range(65, 91)})
                keep[low] = max(i, keep.get(low, i))
            assert sorted(ids) == sorted(keep.values())
        if n == 2:
            groups = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(before).collect()}
            assert sorted(ids) == sorted(set(groups.values()))
        if n == 3:
            assert max(collections.Counter(ids).values()) == 2
            order = [(r["position"], r["doc_id"]) for r in mixing.training_order(mixing.mix_sources(before)).collect()]
            order = [i for _, i in sorted(order)]
    assert counts[0] > 800 and counts == sorted(counts[:3], reverse=True) + counts[3:]
    rows = sorted(docs.select("position", "doc_id").collect())
    assert [r["doc_id"] for r in rows] == order and len({r["position"] for r in rows}) == len(rows)  # training order
    encoder = bpe.Encoder(bpe.load(queries.BYTE_BPE))
    for r in docs.limit(50).collect():
        assert r["ids"] == encoder.encode(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
        assert encoder.decode(r["ids"]) == texts[r["doc_id"]]


def test_run_is_repeatable(spark):
    once, again = (sorted((r["doc_id"], r["n_tokens"]) for r in P.run(spark, "/root/testdata/sf0.001").collect()) for _ in range(2))
    assert once == again and once


def test_training_order_survives_many_files(spark, tmp_path):
    df = spark.range(3000).selectExpr("id as doc_id", "repeat('word ', cast(id % 50 as int)) as text").repartitionByRange(12, "doc_id").sortWithinPartitions("doc_id")
    df.write.option("maxRecordsPerFile", 100).parquet(f"{tmp_path}/sorted")
    # Small splits, packed by size, come back in another order than they were written in.
    stored = spark.read.parquet(f"{tmp_path}/sorted")
    got = bpe.encode_checked(stored, queries.BYTE_BPE).select("position", "doc_id").collect()
    assert [r["doc_id"] for r in sorted(got)] == list(range(3000))
    assert {r["position"] for r in bpe.encode_checked(df, queries.BYTE_BPE).collect()} == {None}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone int, sha int, row int, position int, key string, bucket string, digest string, label int"
EXTRA = (1, 2, 3, 4, "k", "b", "d", 5)


@pytest.mark.parametrize("number", range(len(P.STAGES)))
def test_stages_on_odd_tables(spark, tmp_path, number):
    stage = P.STAGES[number][1]
    words = "plain words of a text that is read by people and by machines alike every day".split()
    texts = [None, "", " \n", " ".join(words), " ".join(words), " ".join(words[::-1]), " ".join(words) + " Again", "A" * 100_000, " ".join(words * 5000)]
    rows = [(k, t, None, "s" if k % 2 else None, None, *EXTRA) for k, t in enumerate(texts)]
    rows += [rows[3], (None, None, None, None, None, *[None] * 8), (None, " ".join(words[3:]), None, None, None, *EXTRA)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/odd")
    docs = spark.read.parquet(f"{tmp_path}/odd")
    out = stage(spark, docs, SF)
    found = out.collect()
    if number < len(P.STAGES) - 1:
        assert out.columns == docs.columns
        assert {tuple(r) for r in found} <= {tuple(r) for r in docs.collect()}
        ids = collections.Counter(r["doc_id"] for r in found)
        if number == 1:  # of 0, 1 and the null id the largest; 4 stands for 3 and its repeat
            assert ids == collections.Counter([1, 2, 4, 5, 6, 7, 8, None])
        if number == 2:  # null ids and texts without words stay; 3 stands for 4 and 6
            assert ids == collections.Counter([0, 1, 2, 3, 5, 7, 8, None, None])
        if number == 3:
            assert not ids.keys() & {0, 1, 2}
    else:
        assert len(found) == len(rows) and sum(r["n_tokens"] == 0 for r in found) == 3
    empty = stage(spark, docs.limit(0), SF)
    assert empty.columns == out.columns and empty.collect() == []


def test_own_names_never_clash(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Gone int, gone_ int, x int")
    assert workspace.own_names(df, "gone", "sha", "sha") == ["gone__", "sha", "sha_"]
