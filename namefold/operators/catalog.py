"""Listings and the script catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namefold.functions import assets, attributes

MAX_SAFE = 9_007_199_254_740_991  # largest integer a double holds exactly


def listings(records: DataFrame, outputs: DataFrame, validators: DataFrame, *, holder: object | None = None,
             text: str | None = None) -> DataFrame:
    """Names on sale: records whose live output sits at a listed validator with valid payouts.

    ``outputs``: ``utxo, validator, slot, assets ARRAY<STRUCT<policy, hex>>,
    constructors, owner, listing_holder, payouts ARRAY<STRUCT<address, lovelace>>``.
    """
    if text is not None and len(text) < 3:
        raise ValueError("the name filter needs at least 3 characters")
    found = records
    if text:
        found = found.filter(F.lower("name").contains(text.lower()))
    offers = outputs.join(validators.select("validator").distinct(), "validator", "left_semi")
    joined = found.select("name", "hex", "policy", "utxo").join(offers, "utxo")
    label = assets.label_of(F.col("hex"))
    payouts = F.col("payouts")
    price = F.aggregate(payouts, F.lit(0).cast("decimal(38,0)"), lambda a, p: (a + p["lovelace"]).cast("decimal(38,0)"))
    amounts_ok = F.forall(
        payouts, lambda p: F.coalesce((p["lovelace"] >= 0) & (p["lovelace"] <= MAX_SAFE) & (p["address"] != ""), F.lit(False))
    )
    valid = (
        F.exists("assets", lambda a: (a["policy"] == F.col("policy")) & (a["hex"] == F.col("hex")))
        & (label.isNull() | (label == assets.LABEL_OWNER))
        & (assets.name_of_hex(F.col("hex")) == F.col("name"))
        & F.col("slot").between(0, MAX_SAFE)
        & (F.col("constructors") == 1)
        & (F.size(payouts) >= 1)
        & amounts_ok
        & (price <= MAX_SAFE)
    )
    rows = joined.filter(valid).select(
        "name", "hex", F.coalesce(label, F.lit("")).alias("label"), "policy", "utxo",
        F.coalesce("listing_holder", "owner").alias("holder"), "owner",
        F.try_element_at("payouts", F.lit(1))["address"].alias("payout_address"), price.alias("price"), "slot",
    )
    if holder is not None:
        rows = rows.filter((F.col("holder") == holder) | (F.col("owner") == holder))
    return rows


def latest_scripts(records: DataFrame, root: str, family_prefix: str | None = None) -> DataFrame:
    """Script names with bytes, the highest ordinal of a family marked latest, one row per script address.

    ``records``: ``name, script_address, cbor``. Of two names with one address the
    latest wins, then family, then the higher ordinal, then the name.
    """
    parsed = records.withColumn("s", attributes.script_name(F.col("name"), root)).filter(
        F.col("s").isNotNull() & (F.coalesce("cbor", F.lit("")) != "")
    ).select("name", "script_address", "cbor", "s.family", "s.ordinal")
    if family_prefix:
        parsed = parsed.filter(F.col("family").startswith(family_prefix.lower()))
    newest = parsed.groupBy("family").agg(F.max("ordinal").alias("newest"))
    marked = parsed.join(newest, "family").withColumn("latest", F.col("ordinal") == F.col("newest")).drop("newest")
    preference = F.struct((~F.col("latest")).alias("older"), "family", (-F.col("ordinal")).alias("back"), "name")
    return marked.groupBy("script_address").agg(
        F.min_by(F.struct("name", "family", "ordinal", "latest"), preference).alias("r")
    ).select("script_address", "r.*")


def validators(scripts: DataFrame, family: str) -> DataFrame:
    return scripts.filter(F.col("family") == family).select("validator").distinct()


