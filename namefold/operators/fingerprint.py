"""Order-independent digests of the set ``{(name, labels)}``, per prefix bucket.

Unequal buckets tell where two copies differ. The digest is not the root of any
trie; it answers the same question, whether two copies hold the same set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_DIGITS = 2


def entries(rows: DataFrame) -> DataFrame:
    """Distinct trimmed, non-empty names with their labels and bucket."""
    name = F.trim(F.col("name"))
    return (
        rows.select(name.alias("name"), F.coalesce("labels", F.lit("")).alias("labels"))
        .filter(F.col("name") != "").distinct()
        .withColumn("bucket", F.substring(F.md5(F.col("name")), 1, BUCKET_DIGITS))
    )


def bucket_digests(rows: DataFrame) -> DataFrame:
    return entries(rows).groupBy("bucket").agg(
        F.count("*").alias("entries"), F.bit_xor(F.xxhash64("name", "labels")).alias("digest")
    )


def total_digest(digests: DataFrame) -> DataFrame:
    return digests.agg(F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"), F.bit_xor(F.xxhash64("bucket", "entries", "digest")).alias("digest"))


def compare(stored: DataFrame, declared: DataFrame, external: DataFrame, *, ours_at: int, external_at: int) -> DataFrame:
    """Per bucket whether three copies agree; null where one is missing.

    An external copy that is behind ours never agrees.
    """
    pack = lambda df, n: df.select("bucket", F.struct("entries", "digest").alias(n))
    joined = pack(stored, "s").join(pack(declared, "d"), "bucket", "full_outer").join(pack(external, "e"), "bucket", "full_outer")
    same = (F.col("s") == F.col("d")) & (F.col("d") == F.col("e")) & F.lit(external_at >= ours_at)
    missing = F.col("s").isNull() | F.col("d").isNull() | F.col("e").isNull()
    return joined.select(
        "bucket", F.col("s.entries").alias("stored_entries"), F.col("e.entries").alias("external_entries"),
        F.when(~missing, same).alias("agrees"),
    )
