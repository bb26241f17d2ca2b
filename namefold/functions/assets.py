"""Token names: label prefix, plain name and the identity of the owner token."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label prefixes, four bytes as hex.
LABEL_VIRTUAL = "00000000"
LABEL_SETTINGS = "00001070"
LABEL_002 = "000020e0"
LABEL_003 = "00003090"
LABEL_004 = "000041c0"
LABEL_REFERENCE = "000643b0"
LABEL_OWNER = "000de140"
REGISTRY_LABELS = (LABEL_SETTINGS, LABEL_002, LABEL_003, LABEL_004)

# A label is framed by zero nibbles. No printable character starts with one, so
# the hex of a plain name can never look like a label.
_LABELLED = "^0[0-9a-f]{6}0"


def asset_hex(asset: Column) -> Column:
    """The token name without its ``policy.`` prefix."""
    return F.when(asset.contains("."), F.split_part(asset, F.lit("."), F.lit(2))).otherwise(asset)


def label_of(hex_name: Column) -> Column:
    return F.when(hex_name.rlike(_LABELLED), F.substring(hex_name, 1, 8))


def hex_of_name(name: Column) -> Column:
    return F.lower(F.hex(F.encode(name, "UTF-8")))


def name_of_hex(hex_name: Column) -> Column:
    """Text of the bytes after the label; bytes that are no UTF-8 become U+FFFD."""
    body = F.when(hex_name.rlike(_LABELLED), F.substring(hex_name, F.lit(9), F.length(hex_name))).otherwise(hex_name)
    return F.make_valid_utf8(F.unhex(body).cast("string"))


def owner_hex_of(hex_name: Column) -> Column:
    """Hex of the owner token: 000 stays, every other label becomes 222."""
    label = label_of(hex_name)
    body = F.substring(hex_name, F.lit(9), F.length(hex_name))
    return (
        F.when(label.isNull(), hex_name)
        .when(label == LABEL_VIRTUAL, hex_name)
        .otherwise(F.concat(F.lit(LABEL_OWNER), body))
    )


def parse_asset(asset: Column) -> Column:
    """``struct(label, name, owner_hex)`` of a token name."""
    hex_name = asset_hex(asset)
    return F.struct(
        label_of(hex_name).alias("label"),
        name_of_hex(hex_name).alias("name"),
        owner_hex_of(hex_name).alias("owner_hex"),
    )


def handle_type(name: Column, label: Column) -> Column:
    return (
        F.when(label == LABEL_VIRTUAL, "virtual_subhandle")
        .when(name.contains("@"), "nft_subhandle")
        .otherwise("handle")
    )


def asset_class(hex_name: Column) -> Column:
    """Class used when counting an enumeration of token names."""
    label = label_of(hex_name)
    return (
        F.when(label.isNull(), "kept_legacy")
        .when(label == LABEL_OWNER, "kept_222")
        .when(label == LABEL_VIRTUAL, "kept_000")
        .when(label == LABEL_REFERENCE, "dropped_100")
        .when(label == LABEL_SETTINGS, "dropped_001")
        .otherwise("dropped_other")
    )


def counts_as_mint(label: Column) -> Column:
    """Only plain, 222 and 000 tokens have a mint history."""
    return label.isNull() | label.isin(LABEL_OWNER, LABEL_VIRTUAL)


def burn_class(label: Column) -> Column:
    """``main`` ends the record, ``label`` drops one registry label, else ignored."""
    return (
        F.when(counts_as_mint(label), "main")
        .when(F.lower(label).isin(*REGISTRY_LABELS), "label")
    )


def utxo_tx(utxo: Column) -> Column:
    return F.split_part(utxo, F.lit("#"), F.lit(1))


def utxo_index(utxo: Column) -> Column:
    return F.split_part(utxo, F.lit("#"), F.lit(2)).try_cast("int")


def key_digest(hex_key: Column) -> Column:
    """md5 of the decoded bytes; text that is no even-length hex has no digest."""
    valid = hex_key.rlike("^([0-9a-fA-F]{2})*$")
    return F.when(valid, F.md5(F.unhex(hex_key)))
