"""Point and list lookups, and records joined with their outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namefold.functions import assets
from namefold.operators.joins import left_lookup


def by_name(records: DataFrame, name: str) -> DataFrame:
    return records.filter(F.col("name") == name)


def by_hex(records: DataFrame, hex_name: str) -> DataFrame:
    """The record of the name in ``hex_name``, if that is still its identity."""
    wanted = F.lit(hex_name)
    return records.filter((F.col("name") == assets.name_of_hex(wanted)) & (F.col("hex") == wanted))


def _digests(keys: DataFrame) -> DataFrame:
    return keys.select(assets.key_digest(F.col("key")).alias("key_digest")).filter("key_digest is not null").distinct()


def lookup(records: DataFrame, keys: DataFrame, kind: str) -> DataFrame:
    """Records matching a key list (column ``key``).

    ``kind``: ``name``, ``hex``, ``holder``, ``stake_key_hash``, ``payment_key_hash``
    or ``address``. Keys without a match, and malformed ones, match nothing.
    """
    if kind == "name":
        return records.join(keys.select(F.col("key").alias("name")).distinct(), "name", "left_semi")
    if kind == "hex":
        listed = keys.select(assets.name_of_hex(assets.asset_hex(F.col("key"))).alias("name")).distinct()
        return records.join(listed, "name", "left_semi")
    if kind == "holder":
        direct = records.join(keys.select(F.col("key").alias("holder")).distinct(), "holder", "left_semi")
        hashed = records.join(_digests(keys), "key_digest", "left_semi")
        return direct.unionByName(hashed.select(*direct.columns)).dropDuplicates(["name"])
    if kind == "stake_key_hash":
        return records.join(_digests(keys), "key_digest", "left_semi")
    if kind in ("payment_key_hash", "address"):
        return records.join(keys.select(F.col("key").alias(kind)).distinct(), kind, "left_semi")
    raise ValueError(f"unknown list kind {kind}")


def children(records: DataFrame, root: str, handle_type: str | None = None) -> DataFrame:
    found = records.filter(F.col("root") == root)
    return found.filter(F.col("handle_type") == handle_type) if handle_type else found


def roots(records: DataFrame, public_minting: Column | None = None) -> DataFrame:
    """Records that are the root of at least one other, optionally open to the public."""
    with_children = records.filter(F.col("root").isNotNull()).select(F.col("root").alias("name")).distinct()
    found = records.join(with_children, "name", "left_semi")
    return found.filter(F.coalesce(public_minting, F.lit(False))) if public_minting is not None else found


def public_minting(settings: Column) -> Column:
    return F.coalesce(settings["virtual"]["public_minting_enabled"], F.lit(False)) | F.coalesce(
        settings["nft"]["public_minting_enabled"], F.lit(False)
    )


def outputs_from_slot(outputs: DataFrame, slot: int) -> DataFrame:
    return outputs.filter(F.col("slot") >= slot)


def with_outputs(records: DataFrame, outputs: DataFrame, pointers: dict[str, str], fields: list[str]) -> DataFrame:
    """Join outputs to each pointer column: ``{pointer: prefix}``."""
    joined = records
    for pointer, prefix in pointers.items():
        side = outputs.select(F.col("utxo").alias(pointer), *[F.col(f).alias(f"{prefix}_{f}") for f in fields])
        joined = left_lookup(joined, side, pointer)
    return joined


def datum_of(records: DataFrame, name: str) -> DataFrame:
    """The datum of a record, null without one; no row for an unknown name."""
    return records.filter((F.col("name") == name) & (F.col("utxo") != "")).select(
        "name", F.when(F.col("has_datum"), F.col("datum")).alias("datum")
    )


def with_content(records: DataFrame, content: DataFrame, links: list[str]) -> DataFrame:
    """Replace ``ipfs://`` links by the landed content ``(cid, json)``; other links give null."""
    joined = records
    for link in links:
        side = content.select(F.col("cid").alias("__link"), F.col("json").alias(f"{link}_content"))
        # A null never meets a row, so links of another kind stay out of the join.
        cid = F.when(F.col(link).startswith("ipfs://"), F.substring(F.col(link), F.lit(8), F.length(link)))
        joined = left_lookup(joined.withColumn("__link", cid), side, "__link").drop("__link")
    return joined
