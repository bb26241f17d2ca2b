"""Rules a snapshot must keep before anything is loaded from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namefold.operators import scan
from namefold.operators.reconcile import broken_rows, violations


def _hash(column: str) -> Column:
    return F.coalesce(F.col(column).rlike("^[a-fA-F0-9]{64}$"), F.lit(False))


def _natural(column: str) -> Column:
    return F.coalesce(F.col(column) >= 0, F.lit(False))


def snapshot_violations(envelope: DataFrame, outputs: DataFrame, mints: DataFrame, blocks: DataFrame, *, slot: int,
                        schema_version: int, network: str) -> DataFrame:
    """One row per rule and its number of violations.

    ``envelope``: ``slot, hash, schema_version, verified, root, chain_root, network``.
    """
    verified = (
        F.coalesce(F.col("verified"), F.lit(False)) & _hash("root")
        & F.coalesce(F.col("root") == F.col("chain_root"), F.lit(False)) & F.coalesce(F.col("network") == network, F.lit(False))
    )
    broken_output = ~(
        _hash("tx_id") & _hash("block_hash") & _natural("idx") & _natural("height") & _natural("lovelace")
        & F.coalesce(F.col("address") != "", F.lit(False)) & F.coalesce(F.col("utxo") != "", F.lit(False))
    )
    late = lambda column: ~(_natural(column) & (F.col(column) <= slot))
    # The ids are counted in tasks of a bounded number of rows, everything else in one pass per table.
    ids = outputs.select("utxo").repartition(scan.parts_for(outputs.count(), outputs.sparkSession), "utxo")
    parts = [
        broken_rows(envelope, {
            "envelope": ~(_natural("slot") & _hash("hash") & (F.col("schema_version") == schema_version)), "verification": ~verified}),
        broken_rows(outputs, {"output_shape": broken_output, "output_slot": late("slot")}),
        violations({"output_repeated": ids.groupBy("utxo").agg(F.count("*").alias("n")).filter("n > 1")}),
        broken_rows(mints, {"mint_slot": late("created_slot"), "mint_hash": ~_hash("tx_hash")}),
        broken_rows(blocks, {"block_slot": late("slot"), "block_hash": ~_hash("hash")}),
    ]
    return reduce(DataFrame.unionByName, parts)
