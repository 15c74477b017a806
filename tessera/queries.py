"""Queries of the retrieval engine over the driver's tables, with their SQL.

Searches take as queries every vector whose id is divisible by 50. Scores are
rounded to six decimals after ranking.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vector as V
from .functions.embed import HashEmbedder, embed_column
from .metric import Metric
from .operators import hnsw, knn, stats
from .operators.chunker import ChunkerConfig, chunk_documents
from .operators.rows import dense_numbers, drop_duplicates
from .plans.index import ExactIndex, GraphIndex
from .plans.ingest import IngestConfig, ingest_frame
from .plans.scratch import scratch
from .plans.store import OpenOptions, Store, StoreConfig
from .sources.files import discover, read_files, write_files
from .streaming.ingest import start_ingest

DIM, K = 64, 10
EMBEDDER = 256
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- vector functions ---------------------------------------------------------
def _scaled(spark, sf_dir):
    """Rows of different lengths, so that the metrics rank differently."""
    grown = F.transform("embedding", lambda x: (x.cast("double") * (1 + F.col("vec_id") % 3)).cast("float"))
    return table(spark, sf_dir, "embeddings").select("vec_id", grown.alias("v"))


def _pairs(spark, sf_dir):
    e = _scaled(spark, sf_dir)
    return e.select("vec_id", F.col("v").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("b")), "vec_id")


_SCALED = "s as (select vec_id, list_transform(embedding, lambda x: (x::double * (1 + vec_id % 3))::float) as v from embeddings)"
_DOUBLES = f"with {_SCALED}, d as (select vec_id, list_transform(v, lambda x: x::double) as v from s), p as (select a.vec_id, a.v as a, b.v as b from d a join d b on b.vec_id = a.vec_id + 1)"
_DOT, _NORMS = "list_inner_product(a, b)", "(list_inner_product(a, a) * list_inner_product(b, b))"
_L2 = "list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i] - b[i]) * (a[i] - b[i])))"


@query(f"{_DOUBLES} select vec_id, round({_DOT}, 6) as dot from p")
def vec_dot(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", F.round(V.dot("a", "b"), 6).alias("dot"))


@query(f"{_DOUBLES} select vec_id, round({_L2}, 6) as l2_sq from p")
def vec_l2_sq(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", F.round(V.l2_sq("a", "b"), 6).alias("l2_sq"))


@query(f"{_DOUBLES} select vec_id, round(list_inner_product(v, v), 6) as norm_sq from d")
def vec_norm_sq(spark, sf_dir):
    return _scaled(spark, sf_dir).select("vec_id", F.round(V.norm_sq("v"), 6).alias("norm_sq"))


@query(f"{_DOUBLES} select vec_id, round({_DOT} / sqrt({_NORMS}), 6) as cosine from p")
def vec_cosine(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", F.round(V.cosine("a", "b"), 6).alias("cosine"))


@query(f"{_DOUBLES} select vec_id, round({_DOT} / sqrt({_NORMS}), 6) as cosine, round({_DOT}, 6) as dot, round(-{_L2}, 6) as l2 from p")
def vec_score_all_metrics(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", *[F.round(V.score(m, "a", "b"), 6).alias(m.value) for m in Metric])


@query(f"{_DOUBLES}, z as (select vec_id, v as a, case when vec_id % 5 = 0 then list_transform(v, lambda x: 0.0::double) else v end as b from d) select vec_id, round(case when {_NORMS} <= 1.1754943508222875e-38 then 0 else {_DOT} / sqrt({_NORMS}) end, 6) as cosine from z")
def vec_cosine_zero_guard(spark, sf_dir):
    """Every fifth vector is compared with the zero vector."""
    zero = F.when(F.col("vec_id") % 5 == 0, F.transform("v", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("v"))
    return _scaled(spark, sf_dir).select("vec_id", F.round(V.cosine(F.col("v"), zero), 6).alias("cosine"))


@query(f"{_DOUBLES} select vec_id, unnest(range(0, len(v))) as pos, round((unnest(v) / sqrt(list_inner_product(v, v)))::float::double, 6) as x from d")
def vec_normalize(spark, sf_dir):
    unit = _scaled(spark, sf_dir).select("vec_id", F.posexplode(V.normalize("v")).alias("pos", "x"))
    return unit.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double"), 6).alias("x"))


def _damaged(spark, sf_dir):
    kind, v = F.col("vec_id") % 7, F.col("embedding")
    spoilt = F.transform(v, lambda x, i: F.when(i == 3, F.lit(float("nan")).cast("float")).otherwise(x))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.when(kind == 0, spoilt).when(kind == 1, F.slice(v, 1, DIM - 1)).when(kind == 2, F.transform(v, lambda x: F.lit(0.0).cast("float"))).otherwise(v).alias("v"))


@query("select vec_id, case vec_id % 7 when 0 then 'not_finite' when 1 then 'dimension' when 2 then 'zero_norm' end as problem, case when vec_id % 7 = 0 then 3 else -1 end::bigint as first_bad from embeddings")
def vec_validate(spark, sf_dir):
    """Rows spoilt by NaN, a missing component or zeros are told apart."""
    return _damaged(spark, sf_dir).select("vec_id", V.problem("v", DIM, "cosine").alias("problem"), V.first_not_finite("v").alias("first_bad"))


@query("select d::bigint as dim, ((d + 15) // 16 * 16)::bigint as stride, round(d / ((d + 15) // 16 * 16)::double, 9) as efficiency from range(1, 3073) t(d)")
def padded_stride(spark, sf_dir):
    return spark.range(1, 3073).select(F.col("id").alias("dim"), V.padded_stride("id").alias("stride"), F.round(V.lane_efficiency("id"), 9).alias("efficiency"))


# -- exact search ---------------------------------------------------------------
def _asked(spark, sf_dir):
    """The stated query set: vectors whose vec_id is divisible by 50."""
    return _scaled(spark, sf_dir).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("query"))


def _rows(spark, sf_dir, metric):
    return knn.stored_rows(_scaled(spark, sf_dir), id_col="vec_id", vector_col="v", metric=metric, dim=DIM)


def _out(hits):
    return hits.select("query_id", "rank", "id", (F.round("score", 6) + 0.0).alias("score"))


def _knn_sql(metric: str, k: int = K, ordinal: str = "0") -> str:
    unit = "list_transform(v, lambda x: (x / sqrt(list_inner_product(v, v)))::float::double)" if metric == "cosine" else "v"
    asked = "list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))" if metric == "cosine" else "v"
    score = f"-{_L2}" if metric == "l2" else _DOT
    return (
        f"{_DOUBLES}, r as (select vec_id, {unit} as b from d), q as (select vec_id as query_id, {asked} as a from d where vec_id % 50 = 0), "
        f"x as (select query_id, vec_id as id, {score} as score from q, r), "
        f"y as (select *, row_number() over (partition by query_id order by score desc, {ordinal}, id)::int as rank from x) "
        f"select query_id, rank, id, round(score, 6) + 0.0 as score from y where rank <= {k}"
    )


def _exact(spark, sf_dir, metric, k=K):
    return _out(knn.search_frame(_rows(spark, sf_dir, metric), _asked(spark, sf_dir), k=k, metric=metric, dim=DIM))


@query(_knn_sql("cosine"))
def knn_exact_cosine(spark, sf_dir):
    return _exact(spark, sf_dir, "cosine")


@query(_knn_sql("dot"))
def knn_exact_dot(spark, sf_dir):
    return _exact(spark, sf_dir, "dot")


@query(_knn_sql("l2"))
def knn_exact_l2(spark, sf_dir):
    return _exact(spark, sf_dir, "l2")


@query(_knn_sql("dot", 100))
def knn_batch(spark, sf_dir):
    """k = 100 for all queries at once."""
    return _exact(spark, sf_dir, "dot", 100)


@query(_knn_sql("dot").replace("where rank <= 10", "where rank <= 10 and score >= 0.5"))
def knn_threshold_topk(spark, sf_dir):
    """Of the ten best, those that score at least 0.5."""
    return _out(knn.above(knn.search_frame(_rows(spark, sf_dir, "dot"), _asked(spark, sf_dir), k=K, metric="dot", dim=DIM), 0.5))


@query("select q.vec_id as query_id, count(*)::bigint as hits from embeddings q, embeddings e where q.vec_id % 50 = 0 group by q.vec_id")
def knn_k_clamp(spark, sf_dir):
    """More neighbours are asked for than there are rows: every row is a hit."""
    store = _store(spark, sf_dir)
    return store.search(_asked(spark, sf_dir), k=1_000_000_000, mode="exact").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))


@query(_knn_sql("cosine"))
def index_plugin(spark, sf_dir):
    """Exact search through the interface that all indexes share."""
    return _out(ExactIndex(_rows(spark, sf_dir, "cosine"), "cosine", DIM).search(_asked(spark, sf_dir), K))


@query(_knn_sql("l2"))
def knn_expressions(spark, sf_dir):
    """The defining expression form of search."""
    return _out(knn.search_expressions(_rows(spark, sf_dir, "l2"), _asked(spark, sf_dir), k=K, metric="l2"))


@query(_knn_sql("dot", K, "(2 - id % 3)"))
def knn_multi_segment(spark, sf_dir):
    """Three segments in reverse order share one ranking; ties go by ordinal, then row."""
    rows = _rows(spark, sf_dir, "dot").withColumn("segment_id", F.col("id") % 3).withColumn("ordinal", (2 - F.col("id") % 3).cast("int"))
    return _out(knn.search_frame(rows, _asked(spark, sf_dir), k=K, metric="dot", dim=DIM))


@query(_knn_sql("dot").replace("select query_id, rank, id, round(score, 6) + 0.0 as score from y", "select query_id, rank, id, coalesce(strlen(text), 0)::bigint as n_bytes from y join documents on id = doc_id"))
def knn_payload_join(spark, sf_dir):
    """Payloads are fetched for the hits only, after ranking."""
    hits = knn.search_frame(_rows(spark, sf_dir, "dot"), _asked(spark, sf_dir), k=K, metric="dot", dim=DIM)
    payloads = table(spark, sf_dir, "documents").select(F.lit(0).cast("long").alias("segment_id"), F.col("doc_id").alias("row"), F.col("text").alias("payload"))
    return knn.attach(hits, payloads, ["payload"]).select("query_id", "rank", "id", F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long").alias("n_bytes"))


@query(
    "with x as (select l_returnflag, l_orderkey, l_linenumber, l_quantity, row_number() over (partition by l_returnflag order by l_quantity desc, l_orderkey, l_linenumber)::int as rank from lineitem) "
    "select * from x where rank <= 100"
)
def topk_ties(spark, sf_dir):
    """Scores with many ties: the lower key wins."""
    hits = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("query_id"), F.col("l_quantity").alias("score"), F.col("l_orderkey").alias("ordinal"), F.col("l_linenumber").alias("row")
    )
    return knn.ranked(hits, 100).select(F.col("query_id").alias("l_returnflag"), F.col("ordinal").alias("l_orderkey"), F.col("row").alias("l_linenumber"), F.col("score").alias("l_quantity"), "rank")


@query(
    "with x as (select user_id % 10 as query_id, event_id, value, row_number() over (partition by user_id % 10 order by value desc, event_id)::int as rank from events where event_id % 4 <> 0) select query_id, event_id, rank from x where rank <= 20"
)
def topk_nan_rejected(spark, sf_dir):
    """Every fourth score is NaN and never ranks, though NaN sorts above all numbers."""
    score = F.when(F.col("event_id") % 4 == 0, float("nan")).otherwise(F.col("value"))
    hits = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("query_id"), score.alias("score"), F.lit(0).alias("ordinal"), F.col("event_id").alias("row"))
    return knn.ranked(hits, 20).select("query_id", F.col("row").alias("event_id"), "rank")


# -- store ------------------------------------------------------------------------
def _store(spark, sf_dir, *, parts=3, params=None, metric="dot", payload=False) -> Store:
    """A store of all vectors in ``parts`` segments (by vec_id modulo parts)."""
    store = Store.open_or_create(spark, scratch(spark, "store"), StoreConfig(DIM, metric, 0xFEED))
    rows = _scaled(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("v").alias("vector"))
    if payload:
        rows = rows.withColumn("payload", F.concat(F.lit("vector "), F.col("id").cast("string")))
    for part in range(parts):
        store.publish(rows.where(F.col("id") % parts == part), params=params)
    return store


@query(_knn_sql("dot"))
def compact_preserves_results(spark, sf_dir):
    """Three published segments, compacted, then searched."""
    store = _store(spark, sf_dir)
    before = store.search(_asked(spark, sf_dir), k=K)
    store.compact()
    after = store.search(_asked(spark, sf_dir), k=K)
    key = ["query_id", "rank", "id"]
    same = before.select(*key).exceptAll(after.select(*key)).isEmpty()
    return _out(after).where(F.lit(same))


@query("select (vec_id % 3)::int as ordinal, (vec_id % 3 + 1)::bigint as segment_id, count(*)::bigint as vectors, 'flat' as index, null::int as m, null::int as layers, true as sized, true as payload from embeddings group by all")
def segment_info(spark, sf_dir):
    return _store(spark, sf_dir, payload=True).snapshot().info().select("ordinal", "segment_id", "vectors", "index", "m", "layers", (F.col("bytes") > F.col("vectors") * 4).alias("sized"), "payload")


@query("select (vec_id // 100)::int as ordinal, count(*)::bigint as vectors, 'hnsw' as index, 16 as m, min(vec_id)::bigint as first, max(vec_id)::bigint as last from embeddings where vec_id < 100 * ((select max(vec_id) from embeddings) // 100 + 1) group by all")
def bounded_segments(spark, sf_dir):
    """One call publishes as many segments of 100 numbers as the rows need, each with its graph."""
    store = Store.open_or_create(spark, scratch(spark, "store"), StoreConfig(DIM, "cosine", 0xFEED))
    store.publish(_scaled(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("v").alias("vector")), params=hnsw.HnswParams(ef_construction=32), segment_rows=100, numbered=True)
    snap = Store.open(spark, store.folder.root, OpenOptions(verify=True, cache=True)).snapshot()
    found = snap.rows().groupBy("ordinal").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    return snap.info().join(found, "ordinal").select("ordinal", "vectors", "index", "m", "first", "last")


@query("select 3 as segments, 3 as generation, count(*)::bigint as vectors from embeddings")
def store_info(spark, sf_dir):
    store = _store(spark, sf_dir)
    return store.snapshot().info().agg(F.count(F.lit(1)).cast("int").alias("segments"), F.lit(store.generation).alias("generation"), F.sum("vectors").alias("vectors"))


@query("select 1 as ordinal, count(*)::bigint as vectors, 'verified' as state from embeddings")
def store_verify(spark, sf_dir):
    """Reopened, checked against its checksums and counted."""
    store = _store(spark, sf_dir, parts=1)
    again = Store.open(spark, store.folder.root, verify=True)
    return again.snapshot().rows().agg((F.max("ordinal") + 1).alias("ordinal"), F.count(F.lit(1)).alias("vectors")).withColumn("state", F.lit("verified"))


# -- approximate search --------------------------------------------------------------
@query()
def hnsw_search(spark, sf_dir):
    """Graph search over one segment per 8,192 ids."""
    rows = _rows(spark, sf_dir, "cosine").withColumn("segment_id", F.floor(F.col("id") / 8192)).withColumn("ordinal", F.col("segment_id").cast("int"))
    graphs = hnsw.stored_graphs(rows, "cosine")
    return _out(hnsw.search_graphs(rows, graphs, _asked(spark, sf_dir), k=K, ef=64, metric="cosine", dim=DIM))


@query("select count(*)::bigint as queries, 10 as k, true as good from embeddings where vec_id % 50 = 0")
def hnsw_recall(spark, sf_dir):
    """Whether recall at 10 against exact search reaches 0.95."""
    truth = knn.search_frame(_rows(spark, sf_dir, "cosine"), _asked(spark, sf_dir), k=K, metric="cosine", dim=DIM).withColumn("segment_id", F.floor(F.col("id") / 8192)).withColumnRenamed("id", "_id")
    found = hnsw_search(spark, sf_dir).select("query_id", F.floor(F.col("id") / 8192).alias("segment_id"), F.col("id").alias("row"))
    return knn.recall(found, truth, k=K).select("queries", "k", (F.col("recall") >= 0.95).alias("good"))


@query()
def hnsw_recall_value(spark, sf_dir):
    """Recall at 10 of the graph index against the exact one, as a number."""
    rows = _rows(spark, sf_dir, "cosine")
    exact, graph = (x.search(_asked(spark, sf_dir), K) for x in (ExactIndex(rows, "cosine", DIM), GraphIndex(rows.withColumn("segment_id", F.floor(F.col("id") / 8192)), "cosine", DIM)))
    place = F.floor(F.col("id") / 8192)
    return knn.recall(graph.withColumn("segment_id", place), exact.withColumn("segment_id", place), k=K)


@query("select count(*)::bigint as nodes, true as fine from embeddings")
def hnsw_levels(spark, sf_dir):
    """Level 1 and above holds a share of 1 / m of the nodes, within four standard deviations."""
    rows = _rows(spark, sf_dir, "cosine").withColumn("segment_id", F.floor(F.col("id") / 8192)).withColumn("ordinal", F.lit(0))
    levels = hnsw.build_graphs(rows, "cosine", hnsw.HnswParams(ef_construction=32)).where("node >= 0").groupBy("segment_id", "node").agg(F.max("layer").alias("level"))
    share, n = F.avg((F.col("level") >= 1).cast("double")), F.count(F.lit(1))
    return levels.agg(n.alias("nodes"), (F.abs(share - 1 / 16) <= 4 * F.sqrt(F.lit(1 / 16 * 15 / 16)) / F.sqrt(n)).alias("fine"))


# -- text -----------------------------------------------------------------------------
@query("select doc_id from (select doc_id, row_number() over (partition by text order by doc_id) as r from documents) where r = 1")
def docs_exact_dedup(spark, sf_dir):
    return drop_duplicates(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id")


@query("select count(*)::bigint as chunks, (count(*) - count(distinct text))::bigint as duplicates from documents")
def dedup_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = drop_duplicates(docs, "text", "doc_id").agg(F.count(F.lit(1)).alias("kept"))
    return docs.agg(F.count(F.lit(1)).alias("chunks")).join(F.broadcast(kept)).select("chunks", (F.col("chunks") - F.col("kept")).alias("duplicates"))


_TOKENS = r"(coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9_\x{80}-\x{10FFFF}]+'), lambda w: ceil(strlen(w) / 6.0))), 0) + length(regexp_replace(text, '[A-Za-z0-9_ \t\n\f\r\x{80}-\x{10FFFF}]', '', 'g')))::bigint"


@query(f"select doc_id, {_TOKENS} as tokens from documents")
def estimate_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens("text").alias("tokens"))


_EXTS = ["md", "TXT", "rs", "tar.gz", "Py", "pdf", "mdx", "", "c", "org"]
_KIND_SQL = "case " + " ".join(f"when lower(e) in ({', '.join(repr(x) for x in xs)}) then '{k}'" for k, xs in T.KINDS.items()) + " end"


@query(
    f"with p as (select doc_id, 'dir.d/' || source || '/f' || doc_id || case when doc_id % 10 = 7 then '' else '.' || list_extract({_EXTS!r}, (doc_id % 10 + 1)::int) end as path from documents), "
    rf"x as (select doc_id, path, regexp_extract(path, '[^/]\.([^./]+)$', 1) as e from p) select doc_id, path, {_KIND_SQL} as kind from x"
)
def source_kind_classify(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("doc_id") % 10 + 1).cast("int"))
    path = F.concat(F.lit("dir.d/"), F.col("source"), F.lit("/f"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 10 == 7, "").otherwise(F.concat(F.lit("."), ext)))
    return table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).select("doc_id", "path", T.source_kind("path").alias("kind"))


@query(
    "with l as (select doc_id, repeat(' ', (doc_id % 5)::int) || repeat('#', (doc_id % 8)::int) || case when doc_id % 3 = 0 then '' else ' ' end || source || ' ' || lang || case when doc_id % 2 = 0 then ' ##  ' else '' end as line from documents) "
    r"select doc_id, case when regexp_matches(line, '^ {0,3}#{1,6}([ \t].*)?$') then rtrim(regexp_replace(trim(regexp_extract(line, '^ {0,3}#{1,6}[ \t](.*)$', 1)), '#+$', '')) end as heading from l"
)
def heading_extract(spark, sf_dir):
    """Heading lines made from documents: indents, levels, missing spaces, closing marks."""
    i = F.col("doc_id")
    line = F.concat(F.repeat(F.lit(" "), (i % 5).cast("int")), F.repeat(F.lit("#"), (i % 8).cast("int")), F.when(i % 3 == 0, "").otherwise(" "), "source", F.lit(" "), "lang", F.when(i % 2 == 0, " ##  ").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", line.alias("line")).select("doc_id", T.heading("line").alias("heading"))



@query(
    "select doc_id, replace(source || chr(9) || lang, chr(9), ' ') as path, doc_id as begin, (doc_id + n_chars)::bigint as \"end\", case when doc_id % 3 <> 0 then 'head ' || lang end as heading, sha256(coalesce(text, '')) as text_sha256 from documents"
)
def payload_roundtrip(spark, sf_dir):
    """Encoded and decoded again: tabs and line ends in names become spaces."""
    i = F.col("doc_id")
    encoded = T.payload(F.concat("source", F.lit("\t"), "lang"), i, i + F.col("n_chars"), F.when(i % 3 != 0, F.concat(F.lit("head\n"), "lang")), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", T.decode_payload(encoded).alias("p")).select("doc_id", "p.path", "p.begin", "p.end", "p.heading", F.sha2("p.text", 256).alias("text_sha256"))


@query(
    "select doc_id, sha256(case when doc_id % 3 <> 0 and text not like '#%' then 'f' || doc_id || '.md › ' || lang || chr(10) || text else 'f' || doc_id || '.md' || chr(10) || text end) as given_sha256 from documents"
)
def contextual_text(spark, sf_dir):
    path = F.concat(F.lit("a/b\\f"), F.col("doc_id").cast("string"), F.lit(".md"))
    heading = F.when(F.col("doc_id") % 3 != 0, F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.contextual_text(path, heading, "text"), 256).alias("given_sha256"))


@query(r"with f as (select doc_id, regexp_replace(text, '\s+', ' ', 'g') as t from documents) select doc_id, trim(case when length(t) > 160 then substring(t, 1, 160) || '…' else t end) as snippet from f")
def snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet("text", 160).alias("snippet"))


@query(
    "select event_type, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.99) as p99, count(value)::bigint as n, round(count(value) / sum(value), 6) as qps from events group by event_type"
)
def latency_percentiles(spark, sf_dir):
    """Nearest-rank percentiles and throughput of a latency column."""
    events = table(spark, sf_dir, "events")
    ranks = stats.nearest_ranks(events, ["event_type"], "value", {"p50": 50, "p99": 99}, scratch(spark, "ranks"))
    totals = events.groupBy("event_type").agg(F.count("value").alias("n"), F.round(F.count("value") / F.sum("value"), 6).alias("qps"))
    return ranks.join(totals, "event_type").select("event_type", "p50", "p99", "n", "qps")


@query("select quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.99) as p99, count(value)::bigint as n, round(count(value) / sum(value), 6) as qps from events")
def latency_line(spark, sf_dir):
    """The same over all events, as one line."""
    return stats.latency_report(table(spark, sf_dir, "events"), "value", scratch(spark, "ranks")).withColumn("qps", F.round("qps", 6))


@query(
    f"with d as (select source, {_TOKENS} as tokens, strlen(text) as bytes from documents where text is not null), "
    "r as (select source, sum(tokens) as tokens, count(*) as chunks, sum(bytes) as bytes, count(*) % 7 as seconds from d group by source) "
    "select source, case when seconds > 0 then round(tokens / seconds::double, 6) else 0 end as tokens_per_sec, case when seconds > 0 then round(chunks / seconds::double, 6) else 0 end as chunks_per_sec, "
    "case when seconds > 0 then round(bytes / 1048576.0::double / seconds, 6) else 0 end as mib_per_sec, case when chunks > 0 then round(bytes / 1000.0::double / chunks, 6) else 0 end as micros_per_vector from r"
)
def report_rates(spark, sf_dir):
    """Rates of a run report per source; none where no time has passed."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    n = F.count(F.lit(1))
    report = d.groupBy("source").agg(F.sum(T.estimate_tokens("text")).alias("tokens"), n.alias("chunks"), F.sum(F.octet_length("text")).alias("bytes"), (n % 7).cast("double").alias("seconds"), n.alias("embedded"), F.sum(F.octet_length("text")).alias("embed_nanos"))
    rated = stats.with_rates(report)
    return rated.select("source", *[F.round(c, 6).alias(c) for c in ("tokens_per_sec", "chunks_per_sec", "mib_per_sec", "micros_per_vector")])


@query("select doc_id, row_number() over (order by source nulls first, doc_id) - 1 as seq from documents")
def dense_numbering(spark, sf_dir):
    """All rows numbered in order over the whole table."""
    return dense_numbers(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source", "doc_id"], "seq", scratch(spark, "numbers")).select("doc_id", "seq")


_LINES = r"l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents where text is not null)"


@query(rf"with {_LINES} select doc_id, count(*)::bigint as lines, count(*) filter (where regexp_matches(line, '^[ \t\n\f\r]*$'))::bigint as blank, count(*) filter (where regexp_matches(line, '^ {{0,3}}#{{1,6}}([ \t].*)?$'))::bigint as headings from l group by doc_id")
def line_kinds(spark, sf_dir):
    """Blank and heading lines of every whole text."""
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(T.is_blank("line")).alias("blank"), F.count_if(T.heading("line").isNotNull()).alias("headings"))


@query(
    "select doc_id, case when n_chars < 1024 then n_chars || ' B' when n_chars < 1048576 then printf('%.1f KiB', n_chars / 1024.0::double) else printf('%.1f MiB', n_chars / 1048576.0::double) end as bytes, "
    "case when n < 1000 then printf('%.0f ns', n) when n < 1e6 then printf('%.1f µs', n / 1e3) when n < 1e9 then printf('%.2f ms', n / 1e6) else printf('%.2f s', n / 1e9) end as duration, "
    "format('{:,}', n_chars::bigint) as count from (select doc_id, n_chars, (n_chars::double * n_chars * n_chars + doc_id) as n from documents where n_chars is not null)"
)
def console_formats(spark, sf_dir):
    """Sizes, durations and counts as the console prints them."""
    n = F.col("n_chars").cast("double") * F.col("n_chars") * F.col("n_chars") + F.col("doc_id")
    return table(spark, sf_dir, "documents").where("n_chars is not null").select("doc_id", T.format_bytes("n_chars").alias("bytes"), T.format_duration(n).alias("duration"), T.format_count("n_chars").alias("count"))


@query("select vec_id, 64 as used, list_sum(list_transform(p, lambda x: x::double))::double as total, len(p)::bigint as stride from (select vec_id, list_concat(embedding[1:50], list_transform(range(14), lambda x: 0.0::float)) as p from embeddings)")
def padded_rows(spark, sf_dir):
    """Rows of 50 components padded with zeros to 64."""
    padded = V.pad(F.slice("embedding", 1, 50))
    total = F.aggregate(padded, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.lit(64).alias("used"), total.alias("total"), F.size(padded).cast("long").alias("stride"))


# -- chunks, embeddings, ingest ------------------------------------------------------
def _chunked(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return chunk_documents(docs, kind=None, config=ChunkerConfig())


@query()
def chunk_report(spark, sf_dir):
    """Chunks per document and whether each is its own byte range, in order and within the limit."""
    raw = F.col("text").cast("binary")
    fine = F.forall("chunks", lambda c: (F.substring(raw, (c["start"] + 1).cast("int"), (c["end"] - c["start"]).cast("int")) == c["text"].cast("binary")) & (c["end"] - c["start"] <= 2400))
    return _chunked(spark, sf_dir).select("doc_id", F.size("chunks").alias("chunks"), fine.alias("fine"))


@query("select doc_id, sha256(regexp_replace(text, '\\s+', '', 'g')) as letters_sha256 from documents")
def chunk_coverage(spark, sf_dir):
    """Chunks leave out nothing but white space."""
    joined = F.concat_ws("", F.transform("chunks", lambda c: c["text"]))
    return _chunked(spark, sf_dir).select("doc_id", F.sha2(F.regexp_replace(joined, r"\s+", ""), 256).alias("letters_sha256"))


@query("select doc_id, sha256(regexp_replace(text, '\\s+', '', 'g')) as letters_sha256 from documents")
def chunk_markdown_coverage(spark, sf_dir):
    """The same with headings and fences told apart."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("markdown").alias("kind"))
    joined = F.concat_ws("", F.transform("chunks", lambda c: c["text"]))
    return chunk_documents(docs, kind="kind").select("doc_id", F.sha2(F.regexp_replace(joined, r"\s+", ""), 256).alias("letters_sha256"))


@query("select doc_id, [source, lang] as headings, ['mixed', 'prose'] as kinds, ['# ' || source || chr(10) || chr(10) || 'About ' || doc_id || '.' || chr(10) || chr(10) || '```' || chr(10) || '# no heading ' || doc_id || chr(10) || '```', '## ' || lang || ' ##' || chr(10) || chr(10) || 'End of ' || doc_id || '.'] as texts from documents where source is not null and lang is not null")
def chunk_structure(spark, sf_dir):
    """Headings start chunks, and a fence hides what looks like one."""
    i = F.col("doc_id").cast("string")
    page = F.concat(F.lit("# "), "source", F.lit("\n\nAbout "), i, F.lit(".\n\n```\n# no heading "), i, F.lit("\n```\n\n   \n## "), "lang", F.lit(" ##\n\nEnd of "), i, F.lit(".\n"))
    docs = table(spark, sf_dir, "documents").where("source is not null and lang is not null").select("doc_id", page.alias("text"), F.lit("markdown").alias("kind"))
    each = lambda field: F.transform("chunks", lambda c: c[field])
    return chunk_documents(docs, kind="kind").select("doc_id", each("heading").alias("headings"), each("kind").alias("kinds"), each("text").alias("texts"))


@query()
def hash_embed_documents(spark, sf_dir):
    """Unit vectors of all documents by feature hashing: squared norm and largest component."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = embed_column(docs, HashEmbedder(EMBEDDER), "text", rows=256)
    return made.select("doc_id", F.round(V.norm_sq("vector"), 4).alias("norm_sq"), F.round(F.array_max(F.transform("vector", F.abs)).cast("double"), 6).alias("largest"))


@query()
def semantic_search_documents(spark, sf_dir):
    """The five nearest documents of every benchmark passage."""
    e = HashEmbedder(EMBEDDER)
    docs = embed_column(table(spark, sf_dir, "documents").select("doc_id", "text"), e, "text", rows=256)
    rows = knn.stored_rows(docs, id_col="doc_id", vector_col="vector", metric="cosine", dim=EMBEDDER)
    passages = table(spark, sf_dir, "benchmark").select("item_id", "text")
    asked = embed_column(passages, e, "text").select(F.col("item_id").alias("query_id"), F.col("vector").alias("query"))
    return _out(knn.search_frame(rows, asked, k=5, metric="cosine", dim=EMBEDDER))


@query("select 64 as dim, 'abf7fdd7bc6467b0' as fingerprint union all select 256, '1775384c69285616' union all select 384, '19ef65a0f8864079'")
def fingerprint(spark, sf_dir):
    return spark.createDataFrame([(d, f"{HashEmbedder(d).fingerprint:016x}") for d in (64, 256, 384)], "dim int, fingerprint string")


@functools.cache
def _plain():
    return IngestConfig(graph=None)


@query(f"select count(*)::bigint as files_total, count(text)::bigint as files_done, 0::bigint as files_skipped, sum(strlen(text))::bigint as bytes, 1 as generation from documents")
def ingest_report(spark, sf_dir):
    """All documents as files: chunked, deduplicated, embedded and published."""
    e = HashEmbedder(64)
    store = Store.open_or_create(spark, scratch(spark, "ingest"), StoreConfig(64, "cosine", e.fingerprint))
    r = ingest_frame(store, _as_files(spark, sf_dir), e, _plain())
    assert r["written"] == r["chunks"] - r["duplicates"] == len(store.snapshot())
    return spark.createDataFrame([(r["files_total"], r["files_done"], r["files_skipped"], r["bytes"], r["generation"])], "files_total long, files_done long, files_skipped long, bytes long, generation int")


_WHOLE = rf"d as (select doc_id, text, strlen(text) as bytes, regexp_replace(text, '\s+$', '') as chunk from documents), c as (select chunk as text from d where regexp_matches(chunk, '\S')), t as (select {_TOKENS} as tokens from c)"


@query(
    f"with {_WHOLE} select (select count(*) from d)::bigint as files_total, (select count(text) from d)::bigint as files_done, 0::bigint as files_skipped, (select sum(bytes) from d)::bigint as bytes, (select count(*) from c)::bigint as chunks, (select sum(tokens) from t)::bigint as tokens, "
    "(select count(*) - count(distinct text) from c)::bigint as duplicates, (select count(distinct text) from c)::bigint as embedded, (select count(distinct text) from c)::bigint as written, 1 as generation, true as timed"
)
def ingest_counters(spark, sf_dir):
    """All counters of a run whose chunks are whole documents."""
    e = HashEmbedder(64)
    store = Store.open_or_create(spark, scratch(spark, "ingest"), StoreConfig(64, "cosine", e.fingerprint))
    r = ingest_frame(store, _as_files(spark, sf_dir), e, IngestConfig(ChunkerConfig(1 << 40, 1 << 40), graph=None))
    names = "files_total files_done files_skipped bytes chunks tokens duplicates embedded written".split()
    row = (*[r[n] for n in names], r["generation"], r["embed_nanos"] > 0 and r["seconds"] > 0)
    return spark.createDataFrame([row], ", ".join(f"{n} long" for n in names) + ", generation int, timed boolean")


def _as_files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.lit("text").alias("kind"), F.octet_length("text").cast("long").alias("n_bytes"), "text")


@query(
    "with f as (select 's-' || coalesce(source, '') || '/' || case when doc_id % 10 = 3 then '.hidden/' when doc_id % 10 = 4 then 'target/' else '' end || doc_id || case when doc_id % 10 = 5 then '.png' else '.txt' end as path, coalesce(text, '') as text, doc_id from documents where doc_id is not null) "
    "select path, strlen(text)::bigint as n_bytes, sha256(text) as text_sha256, (row_number() over (order by string_split(path, '/')) - 1)::bigint as place from f where doc_id % 10 not in (3, 4, 5)"
)
def file_discovery(spark, sf_dir):
    """Documents written as files, found again and read: hidden and skipped folders
    and other kinds are left out, paths come in order of their parts."""
    root, found = _written(spark, sf_dir)
    rows = read_files(spark, found)
    path = F.expr(f"substring(path, {len(root) + 2})")
    place = spark.createDataFrame([(p[len(root) + 1 :], k) for k, (p, _) in enumerate(found.files)], "path string, place long")
    return rows.select(path.alias("path"), "n_bytes", F.sha2("text", 256).alias("text_sha256")).join(place, "path")


def _written(spark, sf_dir):
    i, special = F.col("doc_id"), F.col("doc_id") % 10
    path = F.concat(F.lit("s-"), F.coalesce("source", F.lit("")), F.lit("/"), F.when(special == 3, ".hidden/").when(special == 4, "target/").otherwise(""), i.cast("string"), F.when(special == 5, ".png").otherwise(".txt"))
    root = scratch(spark, "files").removeprefix("file://")
    write_files(table(spark, sf_dir, "documents").where("doc_id is not null").select(path.alias("path"), F.coalesce("text", F.lit("")).alias("text")), root)
    return root, discover([root])


@query(
    "with f as (select coalesce(text, '') as text from documents where doc_id % 10 not in (3, 4, 5)), c as (select regexp_replace(text, '\\s+$', '') as chunk from f where regexp_matches(text, '\\S')) "
    "select (select count(*) from f)::bigint as files_total, (select count(*) from f)::bigint as files_done, 0::bigint as files_skipped, (select sum(strlen(text)) from f)::bigint as bytes, (select count(*) from c)::bigint as chunks, (select count(distinct chunk) from c)::bigint as vectors, (select count(distinct chunk) from c)::bigint as found"
)
def ingest_files_e2e(spark, sf_dir):
    """Files to a store to answers: every stored chunk is the nearest one to its own text."""
    _, found = _written(spark, sf_dir)
    e = HashEmbedder(128)
    store = Store.open_or_create(spark, scratch(spark, "ingest"), StoreConfig(128, "cosine", e.fingerprint))
    files = read_files(spark, found)
    r = ingest_frame(store, files, e, IngestConfig(ChunkerConfig(1 << 40, 1 << 40), graph=None))
    stored = store.snapshot().rows()
    asked = stored.select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    hits = store.search(asked, k=1, mode="exact")
    # Other texts may have the same vector; none is nearer.
    n = hits.where("round(score, 5) = 1").count()
    names = "files_total files_done files_skipped bytes chunks".split()
    return spark.createDataFrame([(*[r[x] for x in names], len(store.snapshot()), n)], ", ".join(f"{x} long" for x in names) + ", vectors long, found long")


def arrival_files(n_bytes: int) -> int:
    """Files of each of three micro-batches, so that none is written by a task of more
    than 64 MiB of text."""
    return max(1, -(-n_bytes // (3 * (64 << 20))))


@query("with c as (select regexp_replace(text, '\\s+$', '') as chunk from documents where regexp_matches(text, '\\S')) select sha256(chunk) as text_sha256 from c group by chunk")
def streaming_dedup(spark, sf_dir):
    """Documents that arrive in many micro-batches: each text is stored once over all of them."""
    e = HashEmbedder(16)
    store = Store.open_or_create(spark, scratch(spark, "ingest"), StoreConfig(16, "cosine", e.fingerprint))
    source, marks = scratch(spark, "arrivals"), scratch(spark, "marks")
    files = _as_files(spark, sf_dir)
    each = arrival_files(files.agg(F.sum("n_bytes")).first()[0] or 0)
    files.repartition(3 * each).write.parquet(source)
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", each).parquet(source)
    start_ingest(stream, store, e, marks, IngestConfig(ChunkerConfig(1 << 40, 1 << 40), graph=None)).awaitTermination()
    rows = store.reload().snapshot().rows()
    return rows.select(F.sha2(T.decode_payload("payload")["text"], 256).alias("text_sha256"))
