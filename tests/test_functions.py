import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import ConfigError
from tessera.functions import hashing, text as T, vector as V
from tessera.functions.embed import HashEmbedder, embed_column
from tessera.metric import Metric
from tessera.rng import Xoshiro256pp


def one(spark, schema, row, *columns):
    return tuple(spark.createDataFrame([row], schema).select(*columns).first())


def test_vector_points(spark):
    s = "a array<float>, b array<float>"
    assert one(spark, s, ([1.0, 2.0, 3.0], [4.0, 5.0, 6.0]), V.dot("a", "b"), V.l2_sq("a", "b"), V.norm_sq("a")) == (32.0, 27.0, 14.0)
    assert one(spark, s, ([1.0, 1.0], [0.0, 0.0]), V.score("l2", "a", "b"), V.cosine("a", "b")) == (-2.0, 0.0)
    assert one(spark, s, ([1.0, 1.0], [-1.0, -1.0]), F.round(V.cosine("a", "b"), 9)) == (-1.0,)
    assert one(spark, s, ([1.0, 1.0], [1.0]), V.dot("a", "b"), V.l2_sq("a", "b"), V.cosine("a", "b")) == (None, None, None)
    unit = one(spark, s, ([3.0, 4.0], [0.0, 0.0]), V.normalize("a"), V.normalize("b"))
    assert unit[0] == pytest.approx([0.6, 0.8]) and unit[1] is None


def test_vector_truth_in_double(spark):
    r = random.Random(1)
    rows = [([r.uniform(-1, 1) for _ in range(n)], [r.uniform(-1, 1) for _ in range(n)]) for n in (1, 7, 16, 255, 384)]
    for (a, b), got in zip(rows, spark.createDataFrame(rows, "a array<float>, b array<float>").select(V.dot("a", "b"), V.cosine("a", "b")).collect()):
        x, y = np.float32(a).astype(float), np.float32(b).astype(float)
        assert got[0] == pytest.approx(x @ y, abs=1e-9) and got[1] == pytest.approx(x @ y / math.sqrt((x @ x) * (y @ y)), abs=1e-9)


def test_validation(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([1.0, 2.0],), ([1.0, nan],), ([inf, 0.0],), ([0.0, 0.0],), ([1.0],), (None,), ([3e38, 3e38],)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<float>").select(V.problem("v", 2, "cosine")).collect()]
    assert got == [None, "not_finite", "not_finite", "zero_norm", "dimension", "dimension", "zero_norm"]
    assert [r[0] for r in spark.createDataFrame(rows[:3], "v array<float>").select(V.first_not_finite("v")).collect()] == [-1, 1, 0]
    assert one(spark, "v array<float>", ([1.0] * 17,), F.size(V.pad("v")), V.padded_stride(F.lit(1536))) == (32, 1536)


def test_metric_names():
    assert Metric.parse("COS") is Metric.COSINE and Metric.parse("inner") is Metric.DOT and Metric.parse("euclidean") is Metric.L2
    assert [Metric.from_tag(m.tag) for m in Metric] == list(Metric) and Metric.COSINE.normalizes
    with pytest.raises(ConfigError):
        Metric.parse("hamming")


def test_text_functions(spark):
    rows = [("### Title ###", "Title"), ("#hashtag", None), ("####### no", None), ("#", ""), ("   ## a b", "a b"), ("    # code", None)]
    assert [r[0] for r in spark.createDataFrame(rows, "l string, h string").select(T.heading("l")).collect()] == [h for _, h in rows]
    assert one(spark, "t string", ("Hello, world!",), T.estimate_tokens("t")) == (4,)
    assert one(spark, "t string", ("été _x1 !?",), T.estimate_tokens("t")) == (4,)
    assert one(spark, "p string, q string, r string", ("a/B.MD", "a/.md", "x.tar.gz"), T.source_kind("p"), T.source_kind("q"), T.source_kind("r")) == ("markdown", None, None)
    assert one(spark, "t string", ("a \n b  " + "c" * 9,), T.snippet("t", 6)) == ("a b cc…",)
    assert one(spark, "n long", (1536,), T.format_bytes("n"), T.format_duration("n"), T.format_count(F.lit(1234567))) == ("1.5 KiB", "1.5 µs", "1,234,567")


def test_payload(spark):
    s = "path string, h string, text string"
    p = T.payload("path", F.lit(3), F.lit(9), "h", "text")
    assert tuple(one(spark, s, ("a\tb", "x\ny", "t\tu\nv"), T.decode_payload(p))[0]) == ("a b", 3, 9, "x y", "t\tu\nv")
    assert one(spark, s, ("a", None, ""), T.decode_payload(p))[0]["heading"] is None
    for bad in ("", "no line", "a\tb\tc\td\ntext", "a\t1\ttext"):
        assert one(spark, "v string", (bad,), T.decode_payload("v")) == (None,)
    assert one(spark, s, ("d/f.md", "H", "body"), T.contextual_text("path", "h", "text")) == ("f.md › H\nbody",)
    assert one(spark, s, ("d/f.md", "H", "# H\nbody"), T.contextual_text("path", "h", "text")) == ("f.md\n# H\nbody",)


def test_hash_pins():
    assert hashing.hash_bytes(b"") == 0xEFD01F60BA992926 and hashing.hash_bytes(b"abc") == 0x33EBAF9927CBC5BD
    data = np.frombuffer(b"abcabcx", np.uint8)
    got = hashing.hash_ranges(data, np.array([0, 3, 0, 2]), np.array([3, 6, 0, 7]))
    assert [int(x) for x in got] == [hashing.hash_bytes(x) for x in (b"abc", b"abc", b"", b"cabcx")]
    h = np.random.default_rng(2).integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)
    assert [int(x) for x in hashing.reduce_range(h, 384)] == [(int(x) * 384) >> 64 for x in h]


def test_hash_embedder(spark):
    e = HashEmbedder(256)
    a, b, c = e.embed_batch(["Memory mapped files give fast SIMD vector search", "fast vector search with SIMD over memory mapped files", "Bake the cake with butter and sugar"])
    assert a @ b > 0.6 and abs(a @ c) < 0.3
    assert (e.embed_batch(["SIMD"]) == e.embed_batch(["simd"])).all() and e.embed_batch(["SIMD"])[0, 234] == -1.0
    for t in ("", "---", "a the of", "?!"):
        assert np.linalg.norm(e.embed_batch([t])) == pytest.approx(1.0)
    assert [f"{HashEmbedder(d).fingerprint:016x}" for d in (64, 256, 384)] == ["abf7fdd7bc6467b0", "1775384c69285616", "19ef65a0f8864079"]
    with pytest.raises(ConfigError):
        HashEmbedder(4)
    batch = ["x y z", "", "été", "The"]
    assert (np.vstack([e.embed_batch([t]) for t in batch]) == e.embed_batch(batch)).all()
    rows = embed_column(spark.createDataFrame([(1, "x y z"), (2, None)], "id long, t string"), e, "t").collect()
    assert np.allclose(rows[0]["vector"], e.embed_batch(["x y z"])[0]) and len(rows[1]["vector"]) == 256


def test_generator():
    g = Xoshiro256pp(1)
    draws = [g.uniform() for _ in range(20000)]
    assert 0.49 < sum(draws) / len(draws) < 0.51 and all(0 <= x < 1 for x in draws)
    assert Xoshiro256pp(1).u64() == Xoshiro256pp(1).u64() != Xoshiro256pp(2).u64()
    assert {g.below(3) for _ in range(100)} == {0, 1, 2} and abs(float(g.gaussians(5000).std()) - 1) < 0.05


def test_entry_imports_without_the_removable_parts(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_exact_cosine' in q and not any(x.startswith('op') or x == 'pipeline' for x in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_prepared_rows_equal_the_expressions(spark, metric):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [3.0, 4.0]), (1, None), (2, []), (3, [1.0]), (4, [nan, 1.0]), (5, [1.0, inf]), (6, [0.0, 0.0]), (7, [1e-30, 0.0]), (8, [1e20, 0.0]), (9, [None, 1.0]), (10, [0.1, -0.7]), (11, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "id long, vector array<float>").repartition(3)
    made = {r["id"]: r for r in V.prepared(df, "vector", 2, metric, "why").collect()}
    told = df.select("id", V.problem("vector", 2, metric).alias("why"), (V.normalize("vector") if metric == "cosine" else F.col("vector")).alias("vector")).collect()
    for r in told:
        assert made[r["id"]]["why"] == r["why"]
        assert made[r["id"]]["vector"] == (None if r["why"] else r["vector"])
    assert V.prepared(df.limit(0), "vector", 2, metric, "why").collect() == []


def test_the_stored_number_is_rounded(spark):
    """As printf does: 1.005 is a little less than it reads, 2.675e9 ns too."""
    r = np.random.default_rng(1)
    n = [0.0, 0.5, 1.5, 2.5, 999.5, 999.4999, 1e3, 2.5e3, 1250.0, 1350.0, 1.005e6, 2.675e6, 1.005e9, 2.675e9, 1.115e9, 1.125e9, 1.375e9, 9.995e9, 999.995e9, 12345678901234567.0, 3e24]
    n += [float(k * 5 + 5) * 1e6 for k in r.integers(200, 10**6, 1000)] + [float(k) ** 3 for k in r.integers(1, 140_000, 3000)] + [(k * 10 + 5) * 10.0 for k in range(10, 9000, 7)]
    df = spark.createDataFrame([(x,) for x in n], "n double")
    units = ((1e3, 1, 0, "ns"), (1e6, 1e3, 1, "µs"), (1e9, 1e6, 2, "ms"), (float("inf"), 1e9, 2, "s"))
    for x, got in df.select("n", T.format_duration("n")).collect():
        by, digits, unit = next(u[1:] for u in units if x < u[0])
        assert got == f"{x / by:.{digits}f} {unit}", x
    assert [r[0] for r in spark.sql("select -2.675D as x union all select null").select(T._fixed(F.col("x"), 2, "s").alias("s")).collect()] == ["-2.67 s", None]
