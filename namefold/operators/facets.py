"""Inverted indexes as query results: nothing is stored or kept up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Facet name -> column of the record table.
FACETS = {
    "rarity": "rarity", "characters": "characters", "numeric_modifiers": "numeric_modifiers", "length": "length",
    "handle_type": "handle_type", "og": "og", "personalized": "personalized", "address": "address",
    "payment_key_hash": "payment_key_hash", "key_digest": "key_digest", "root": "root", "holder": "holder",
}


def facet_rows(records: DataFrame, facets: dict[str, str] | None = None) -> DataFrame:
    """``(facet, value, name)`` for every facet the table has; null values have no entry."""
    wanted = facets or {f: c for f, c in FACETS.items() if c in records.columns}
    entries = [F.struct(F.lit(f).alias("facet"), F.col(c).cast("string").alias("value")) for f, c in wanted.items()]
    rows = records.select("name", F.explode(F.array(*entries)).alias("e"))
    return rows.select("e.facet", "e.value", "name").filter(F.col("value").isNotNull())


def facet_counts(records: DataFrame, facets: dict[str, str] | None = None) -> DataFrame:
    """Names per facet value. A record table has one row per name, so counts shrink map-side."""
    return facet_rows(records, facets).groupBy("facet", "value").agg(F.count("*").alias("names"))


def index_differences(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Entries held only by one side: ``orphan`` (stored) or ``absent`` (recomputed)."""
    side = lambda df, n: df.select("facet", "value", "name").distinct().withColumn("__side", F.lit(n))
    both = side(stored, 1).unionByName(side(recomputed, 2)).groupBy("facet", "value", "name").agg(F.sum("__side").alias("s"))
    return both.filter("s <> 3").select("facet", "value", "name", F.when(F.col("s") == 1, "orphan").otherwise("absent").alias("status"))


def non_empty(records: DataFrame, column: str) -> DataFrame:
    """Keys with at least one member."""
    return records.filter(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).select(column).distinct()


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)
