"""The public view of current-state records, and the label registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namefold.functions import attributes


def personalized() -> Column:
    """`is_personalized` over the columns of a folded record."""
    content = ("designer", "portal", "socials")
    return attributes.is_personalized(
        F.col("image_hash"), F.col("standard_image_hash"), [F.col(c) for c in ("bg_image", "pfp_image", "bg_asset", "pfp_asset")],
        [F.col(c) for c in content], F.col("resolved_addresses"),
    )


def with_record_defaults(rows: DataFrame) -> DataFrame:
    """Values of fields nothing has set yet."""
    defaults = {"image": "", "standard_image": "", "image_hash": "", "standard_image_hash": "", "svg_version": "0", "utxo": "", "holder": ""}
    filled = rows.fillna({c: v for c, v in defaults.items() if c in rows.columns})
    numbers = {"amount": 1, "og_number": 0, "version": 0}
    return filled.fillna({c: v for c, v in numbers.items() if c in rows.columns})


def view(rows: DataFrame) -> DataFrame:
    """The public columns of records that have an output."""
    stripped = ("pfp_asset", "bg_asset", "image_hash", "standard_image_hash")
    plain = (
        "hex", "name", "image", "standard_image", "holder", "length", "og_number", "rarity", "utxo", "characters", "numeric_modifiers",
        "pfp_image", "bg_image", "resolved_addresses", "created_slot_number", "updated_slot_number", "has_datum", "svg_version",
        "last_update_address", "version", "handle_type", "policy", "sub_rarity", "sub_length", "sub_characters", "sub_numeric_modifiers",
        "virtual", "original_address", "last_edited_time",
    )
    # Columns that come with the record table of some users only.
    optional = [c for c in ("default_in_wallet", "payment_key_hash", "holder_type", "drep") if c in rows.columns]
    return with_record_defaults(rows).filter(F.col("utxo") != "").select(
        *plain, *optional, *[attributes.strip_0x(F.col(c)).alias(c) for c in stripped],
        attributes.pz_enabled(F.col("handle_type"), F.col("pz_enabled")).alias("pz_enabled"),
        personalized().alias("is_personalized"), (F.col("og_number") > 0).alias("og"),
    )


def registry_listing(rows: DataFrame, labels: str = "registry_labels") -> DataFrame:
    """Names with a non-empty label set."""
    return rows.filter(F.col(labels) != "").select("name", F.col(labels).alias("labels"))
