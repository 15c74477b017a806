"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers

from . import bpe, exact_dedup, html_extract, lm_scoring, mixing, near_dedup, quality, substring_dedup, topk, toxicity

#: The tokenizer file of op4 and the pipeline; operators take any path.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_score_lm(spark, sf_dir):
    return lm_scoring.score_documents(_documents(spark, sf_dir))


def op2_score_quality(spark, sf_dir):
    return quality.score_quality(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op3_score_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op4_encode_bpe(spark, sf_dir):
    return bpe.encoding_digests(_documents(spark, sf_dir), BYTE_BPE)


def op5_near_duplicates(spark, sf_dir):
    return near_dedup.near_duplicates(_documents(spark, sf_dir), shingle=3, percent=85)


def op6_remove_repeats(spark, sf_dir):
    return substring_dedup.remove_repeats(_documents(spark, sf_dir)).drop("removed")


def op7_exact_topk(spark, sf_dir):
    return topk.exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(_documents(spark, sf_dir)).drop("locator")


def op9_mix_sources(spark, sf_dir):
    return mixing.mix_sources(_documents(spark, sf_dir)).drop("positions")


def op10_extract_html(spark, sf_dir):
    return html_extract.extract_html(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {f.__name__: f for f in (op1_score_lm, op2_score_quality, op3_score_toxicity, op4_encode_bpe, op5_near_duplicates, op6_remove_repeats, op7_exact_topk, op8_exact_dedup, op9_mix_sources, op10_extract_html)}

_OP8 = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents),
g as (select norm, max(doc_id) as keep_id, count(*) as group_size from d group by norm)
select d.doc_id, g.keep_id, g.group_size, d.doc_id is not distinct from g.keep_id as kept, sha256(d.norm) as text_sha256
from d join g on d.norm = g.norm
"""

ORACLE = {"op6_remove_repeats": substring_dedup.ORACLE_SQL, "op7_exact_topk": topk.ORACLE_SQL, "op8_exact_dedup": _OP8, "op9_mix_sources": mixing.ORACLE_SQL}
