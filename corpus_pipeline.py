"""A training corpus from raw documents: five operators, one after the other.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage
before it kept and returns a DataFrame; ``run`` writes each as Parquet in the
shared folder and reads it back as the next one's input.

Defined results, for every stage: all but the last return the columns of their
input, whatever further columns it has and however those are named; an empty
table gives an empty one. Rows repeated with one doc_id and text come once after
exact dedup, rows of one doc_id once after near dedup. A null text is judged,
compared and encoded like the empty one; mixing leaves texts without words out,
as they hold nothing to train on. A null doc_id stays unless its text goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, exact_dedup, mixing, near_dedup, quality, queries, workspace


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_first_copies(docs)


def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8)."""
    return near_dedup.keep_one_of_each(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, once per copy that their source's target takes.
    The order is that of the stored rows: partition by partition, row by row."""
    return mixing.mixed_documents(docs)


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of what they decode to.
    ``position`` rises in training order, in which mixing stored the documents."""
    return bpe.encode_checked(docs, queries.BYTE_BPE)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("near dedup", dissimilar_documents),
    ("mixing", mixed_documents),
    ("bpe encoding", encoded_documents),
]

#: Transitive groups, a trained model and byte-pair encoding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = workspace.materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
