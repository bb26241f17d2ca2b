"""From raw documents to token ids in five stages, each written and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; all
but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namefold.llm import bpe, exact_dedup, mixing, quality_net, simhash
from namefold.llm.common import in_small_batches, table, text_key
from namefold.llm.queries import vocabulary
from namefold.scratch import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier does not reject."""
    in_small_batches(spark)
    return quality_net.classified(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id."""
    return exact_dedup.exact_dedup(docs).where("kept").select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document: that with the least doc_id, the first of those by text hash where ids repeat."""
    in_small_batches(spark)
    chosen = simhash.near_duplicates(docs).where(F.col("row.doc_id").eqNullSafe(F.col("component_id")))
    return chosen.groupBy("root").agg(F.min_by("row", text_key(F.col("row.text"))).alias("row")).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document and copy: its ids' number, their digest and the digest of what they decode to."""
    in_small_batches(spark)
    return bpe.token_digests(docs, vocabulary()).select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("mixing to target weights", mixed), ("bpe encoding and decoding", tokens)]
#: A trained classifier and byte-pair merging are beyond SQL; tests hold the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
    return materialize(STAGES[-1][1](spark, docs, sf_dir), "stage")
