from pyspark.sql import functions as F

from tessera.llm import exact_dedup as X

ROWS = [(1, "Hello A", "s"), (2, "hello a", "t"), (3, "Ärger", "s"), (4, "ärger", "s"), (5, None, "s"), (6, "", "s"), (7, "hello a", "x"), (7, "hello a", "x"), (None, "HELLO A", "s"), (None, "alone", "s"), (8, "y" * 70000, None)]
SCHEMA = "doc_id long, text string, digest string"


def answer(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()), key=str)


EXPECTED = sorted(
    [(1, 7, 5, False), (2, 7, 5, False), (3, 3, 1, True), (4, 4, 1, True), (5, 6, 2, False), (6, 6, 2, True), (7, 7, 5, True), (7, 7, 5, True), (None, 7, 5, False), (None, None, 1, True), (8, 8, 1, True)], key=str
)


def test_groups_nulls_repeats_and_clashing_columns(spark):
    assert answer(X.exact_dedup(spark.createDataFrame(ROWS, SCHEMA))) == EXPECTED


def test_full_bytes_decide_when_digests_collide(spark):
    weak = lambda text: F.substring(F.sha2(text, 256), 1, 0)  # noqa: E731  every text collides
    assert answer(X.exact_dedup(spark.createDataFrame(ROWS, SCHEMA), digest=weak)) == EXPECTED


def test_empty_table(spark):
    assert X.exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rows_that_stay(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    kept = X.keep_first_copies(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([3, 4, 6, 7, None, 8], key=str)


def test_state_carries_over_to_later_rows(spark, tmp_path):
    folder = str(tmp_path / "dedup")
    X.exact_dedup(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), folder=folder).collect()
    later = X.exact_dedup(spark.createDataFrame([(3, "A")], "doc_id long, text string"), folder=folder)
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in later.collect()} == {(1, 3, 2), (2, 2, 1), (3, 3, 2)}


def test_a_collision_with_a_row_of_an_earlier_call(spark, tmp_path):
    weak = lambda text: F.substring(F.sha2(text, 256), 1, 0)  # noqa: E731  every text collides
    folder, schema = str(tmp_path / "dedup"), "doc_id long, text string"
    X.exact_dedup(spark.createDataFrame([(1, "AAA"), (4, "ccc")], schema), digest=weak, folder=folder).collect()
    second = X.exact_dedup(spark.createDataFrame([(2, "bbb"), (3, "aaa")], schema), digest=weak, folder=folder)
    assert answer(second) == [(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True), (4, 4, 1, True)]
    # A call whose own rows collide with nothing new still knows of it.
    third = X.exact_dedup(spark.createDataFrame([(5, "ddd")], schema), digest=weak, folder=folder)
    assert answer(third) == [(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True), (4, 4, 1, True), (5, 5, 1, True)]
    assert answer(X.exact_dedup(spark.createDataFrame([], schema), digest=weak, folder=folder)) == answer(third)


def test_locators_name_the_files_of_the_copies(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    for folder in (None, str(tmp_path / "state")):
        for r in X.exact_dedup(docs, folder=folder).collect():
            found = {x["doc_id"] for x in spark.read.parquet(r["locator"]).collect()}
            assert r["keep_id"] in found


def test_more_hits_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(X, "BROADCAST_DIGESTS", 0)
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert answer(X.exact_dedup(df)) == EXPECTED
    assert sorted((r["doc_id"] for r in X.keep_first_copies(df).collect()), key=str) == sorted([3, 4, 6, 7, None, 8], key=str)


def test_rows_that_stay_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 1, 2, 3), (2, "A", 1, 2, 3), (2, "A", 1, 2, 3)], "doc_id long, text string, gone int, _Gone int, sha int")
    kept = X.keep_first_copies(df)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == [(2, "A", 1, 2, 3)]
    assert X.keep_first_copies(df.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    text = X.exact_dedup(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
