"""One query per operator over its whole table, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namefold.llm import align, bpe, decontaminate, exact_dedup, html_blocks, line_dedup, merkle, mixing, quality_net, quality_rules, simhash, suffix_dedup, toxicity
from namefold.llm.common import in_small_batches, table
from namefold.llm.sql import DECONTAMINATE_SQL, EXACT_DEDUP_SQL, LINE_DEDUP_SQL, MERKLE_SQL, MIXING_SQL, QUALITY_RULES_SQL
from namefold.scratch import materialize

#: The vocabulary file; every executor has the package that holds it.
VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(key: str, sql: str | None = None):
    def register(function):
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql
        return function

    return register


@query("op1_quality_rules", QUALITY_RULES_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words",
    )


@query("op2_simhash")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
    )


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(F.col("row.doc_id").alias("doc_id"), "held_out", "score", "predicted", F.size("offending").alias("n_offending"))


@query("op4_quality_net")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_net.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(F.col("row.doc_id").alias("doc_id"), "held_out", "score", "predicted")


@query("op5_exact_dedup", EXACT_DEDUP_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@query("op6_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), vocabulary()).select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op8_html_blocks")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_blocks.main_text(table(spark, sf_dir, "pages"))
    return found.select(F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


@query("op9_line_dedup", LINE_DEDUP_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"),
    )


@query("op10_mixing", MIXING_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.copies(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
    )


@query("op11_decontaminate", DECONTAMINATE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op12_align")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    files = vocabulary(), vocabulary(PIECES)
    found = align.aligned(table(spark, sf_dir, "documents"), *files)
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    stored = materialize(found.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return align.linked(stored, align.load(*files).size_b).select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
    )


@query("op13_merkle", MERKLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.proofs(*merkle.manifest(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", "verified")
