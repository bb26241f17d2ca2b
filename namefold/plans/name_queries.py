"""Attributes of names and the scalar parts of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from namefold.functions import assets, attributes
from namefold.operators import normalize
from namefold.plans.bindings import names, table, token_hex, with_views
from namefold.plans.registry import query

_RARITY = """CASE WHEN length({0}) = 1 THEN 'legendary' WHEN length({0}) = 2 THEN 'ultra_rare' WHEN length({0}) = 3 THEN 'rare'
  WHEN length({0}) BETWEEN 4 AND 7 THEN 'common' ELSE 'basic' END"""
_NUMBER = r"regexp_full_match({0}, '-?[0-9]+(\.[0-9]+)?')"
_CHARACTERS = (
    "concat_ws(',', CASE WHEN regexp_matches({0}, '[A-Za-z]') THEN 'letters' END,"
    " CASE WHEN regexp_matches({0}, '[0-9]') THEN 'numbers' END,"
    f" CASE WHEN regexp_matches({{0}}, '[-._]') AND NOT {_NUMBER} THEN 'special' END)"
)
_MODIFIERS = (
    f"concat_ws(',', CASE WHEN {_NUMBER} AND {{0}} LIKE '-%' THEN 'negative' END,"
    f" CASE WHEN {_NUMBER} AND contains({{0}}, '.') THEN 'decimal' END)"
)
ATTRIBUTE_SQL = {
    "rarity": _RARITY.format("name"), "characters": _CHARACTERS.format("name"), "numeric_modifiers": _MODIFIERS.format("name"),
}


@query("attr_rarity_length", with_views(f"""
SELECT name, {_RARITY.format('name')} AS rarity, CAST(length(name) AS INTEGER) AS length,
  CASE WHEN contains(name, '@') THEN CAST(length(split_part(name, '@', 1)) AS INTEGER) END AS sub_length,
  CASE WHEN contains(name, '@') THEN {_RARITY.format("split_part(name, '@', 1)")} END AS sub_rarity
FROM names""", "names"))
def attr_rarity_length(spark, sf_dir):
    name = F.col("name")
    sub = attributes.sub_part(name)
    return names(spark, sf_dir).select(
        "name", attributes.rarity(name).alias("rarity"), F.length(name).alias("length"), F.length(sub).alias("sub_length"),
        attributes.rarity(sub).alias("sub_rarity"),
    )


@query("attr_characters", with_views(f"""
SELECT name, {_CHARACTERS.format('name')} AS characters,
  CASE WHEN contains(name, '@') THEN {_CHARACTERS.format("split_part(name, '@', 1)")} END AS sub_characters
FROM names""", "names"))
def attr_characters(spark, sf_dir):
    sub = attributes.sub_part(F.col("name"))
    return names(spark, sf_dir).select(
        "name", attributes.characters(F.col("name")).alias("characters"),
        F.when(sub.isNotNull(), attributes.characters(sub)).alias("sub_characters"),
    )


@query("attr_numeric_modifiers", with_views(f"SELECT name, {_MODIFIERS.format('name')} AS numeric_modifiers FROM names", "names"))
def attr_numeric_modifiers(spark, sf_dir):
    return names(spark, sf_dir).select("name", attributes.numeric_modifiers(F.col("name")).alias("numeric_modifiers"))


@query("attr_name_hex", with_views("""
SELECT name, lower(hex(encode(name))) AS hex, CASE WHEN contains(name, '@') THEN split_part(name, '@', 2) END AS root,
  CASE WHEN contains(name, '@') THEN 'nft_subhandle' ELSE 'handle' END AS handle_type
FROM names""", "names"))
def attr_name_hex(spark, sf_dir):
    name = F.col("name")
    return names(spark, sf_dir).select(
        "name", assets.hex_of_name(name).alias("hex"), attributes.root_part(name).alias("root"),
        assets.handle_type(name, F.lit(None)).alias("handle_type"),
    )


@query("attr_key_digest", with_views("""
SELECT name, CASE WHEN asset_id % 11 <> 0 THEN md5(name) END AS digest FROM names""", "names"))
def attr_key_digest(spark, sf_dir):
    # Every eleventh key has an odd number of digits and no digest.
    key = F.concat(assets.hex_of_name(F.col("name")), F.when(F.col("asset_id") % 11 == 0, "0").otherwise(""))
    return names(spark, sf_dir).select("name", assets.key_digest(key).alias("digest"))


@query("attr_personalized", """
SELECT p_partkey AS asset_id,
  p_size % 3 <> p_partkey % 3 OR p_partkey % 13 = 0 OR p_partkey % 17 = 0 OR p_partkey % 19 = 0 AS personalized
FROM part""")
def attr_personalized(spark, sf_dir):
    key = F.col("p_partkey")
    addresses = F.create_map(
        F.lit("ada"), F.lit("a"), F.lit("btc"), F.when(key % 19 == 0, "b").otherwise(""), F.lit("eth"), F.lit(None).cast("string"),
    )
    flag = attributes.is_personalized(
        F.concat(F.lit("h"), F.col("p_size") % 3), F.concat(F.lit("h"), key % 3),
        [F.when(key % 13 == 0, "bg"), F.lit("")], [F.when(key % 17 == 0, "portal")], addresses,
    )
    return table(spark, sf_dir, "part").select(key.alias("asset_id"), flag.alias("personalized"))


@query("asset_name_parse", with_views("""
SELECT asset_id, label, name,
  CASE WHEN label IS NULL THEN body ELSE concat('000de140', body) END AS owner_hex,
  CASE WHEN contains(name, '@') THEN 'nft_subhandle' ELSE 'handle' END AS handle_type,
  concat('tx', asset_id) AS tx, CAST(asset_id % 7 AS INTEGER) AS idx
FROM (SELECT *, lower(hex(encode(name))) AS body,
        CASE asset_id % 3 WHEN 0 THEN '000de140' WHEN 1 THEN '000643b0' END AS label FROM names)""", "names"))
def asset_name_parse(spark, sf_dir):
    token = token_hex(F.col("name"), F.col("asset_id") % 3)
    token = F.when(F.col("asset_id") % 4 == 0, F.concat(F.lit("p0."), token)).otherwise(token)
    rows = names(spark, sf_dir).select(
        "asset_id", assets.parse_asset(token).alias("p"), F.concat(F.lit("tx"), "asset_id", F.lit("#"), F.col("asset_id") % 7).alias("utxo")
    )
    return rows.select(
        "asset_id", "p.label", "p.name", "p.owner_hex", assets.handle_type(F.col("p.name"), F.col("p.label")).alias("handle_type"),
        assets.utxo_tx(F.col("utxo")).alias("tx"), assets.utxo_index(F.col("utxo")).alias("idx"),
    )


@query("asset_class_counts", """
SELECT class, count(*) AS tokens, count(DISTINCT p_name) AS names
FROM (SELECT p_name, CASE p_partkey % 3 WHEN 0 THEN 'kept_222' WHEN 1 THEN 'dropped_100' ELSE 'kept_legacy' END AS class
      FROM part WHERE p_size % 10 > 0) GROUP BY class""")
def asset_class_counts(spark, sf_dir):
    tokens = table(spark, sf_dir, "part").select(
        token_hex(F.col("p_name"), F.col("p_partkey") % 3).alias("hex"), (F.col("p_size") % 10).alias("total_supply")
    )
    return normalize.class_counts(normalize.live_supply(tokens))


# Spellings of script languages met in the wild, and two unknown ones.
_SPELLINGS = ["plutus_v1", "plutus_v2", "plutus_v3", "plutusV1", "plutusV2", "plutusV3", "PlutusScriptV1", "PlutusScriptV2",
              "PlutusScriptV3", "plutus:v1", "plutus:v2", "plutus:v3", "native", "plutus:v9"]


@query("language_tag", f"""
SELECT p_partkey AS asset_id, s AS spelling,
  CASE WHEN s LIKE '%1' THEN '01' WHEN s LIKE '%2' THEN '02' WHEN s LIKE '%3' THEN '03' ELSE '02' END AS tag
FROM (SELECT p_partkey, list_extract({_SPELLINGS!r}, CAST(p_partkey % {len(_SPELLINGS)} AS INTEGER) + 1) AS s FROM part)""")
def language_tag(spark, sf_dir):
    spellings = F.array(*[F.lit(s) for s in _SPELLINGS])
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("asset_id"),
        F.element_at(spellings, (F.col("p_partkey") % len(_SPELLINGS) + 1).cast("int")).alias("spelling"),
    )
    return rows.withColumn("tag", attributes.language_tag(F.col("spelling")))


@query("settings_struct", """
SELECT p_partkey AS asset_id,
  CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 2 = 1 END AS nft_public, CASE WHEN p_partkey % 9 <> 0 THEN p_size % 2 = 1 END AS virtual_pz,
  CASE WHEN p_partkey % 9 <> 0 THEN concat('tier', p_size) END AS nft_tiers, CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_size AS BIGINT) END AS buy_down_price,
  CASE WHEN p_partkey % 9 <> 0 THEN p_type END AS agreed_terms, CASE WHEN p_partkey % 9 <> 0 THEN p_brand END AS payment_address
FROM part""")
def settings_struct(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    text = F.concat(
        F.lit("[["), key % 2, F.lit(',0,"tier'), size, F.lit('","s",1],[0,'), size % 2, F.lit(',"t","s",0],'), size,
        F.lit(',1,2,"'), F.col("p_type"), F.lit('",0,"'), F.col("p_brand"), F.lit('"]'),
    )
    text = F.when(key % 9 == 0, "oops").otherwise(text)
    return table(spark, sf_dir, "part").select(key.alias("asset_id"), attributes.settings_struct(text).alias("s")).select(
        "asset_id", F.col("s.nft.public_minting_enabled").alias("nft_public"), F.col("s.virtual.pz_enabled").alias("virtual_pz"),
        F.col("s.nft.tier_pricing").alias("nft_tiers"), "s.buy_down_price", "s.agreed_terms", "s.payment_address",
    )


@query("policy_settings", """
SELECT p_partkey AS asset_id, concat('ab', p_partkey) AS policy, CAST(p_partkey AS BIGINT) AS first_minting_slot,
  CASE WHEN p_size % 5 > 0 THEN CAST(p_size % 5 AS BIGINT) END AS last_minting_slot, CAST(NULL AS BIGINT) AS sunset_slot FROM part
UNION ALL
SELECT p_partkey, concat('cd', p_partkey), CAST(p_size AS BIGINT), NULL, CASE WHEN p_partkey > 0 THEN CAST(p_partkey AS BIGINT) END FROM part""")
def policy_settings(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    text = F.concat(
        F.lit('{"0xab'), key, F.lit('":['), key, F.lit(","), size % 5, F.lit(',-1],"cd'), key, F.lit('":{"first_minting_slot":'), size,
        F.lit(',"sunsetSlot":'), key, F.lit("}}"),
    )
    rows = table(spark, sf_dir, "part").select(key.alias("asset_id"), text.alias("settings"))
    return normalize.policy_settings(rows, ["asset_id"], "settings")


@query("script_name_parse", """
SELECT name, family, ordinal FROM (
  SELECT CASE WHEN p_partkey % 7 = 0 THEN concat(lower(p_type), '@contract') ELSE concat(lower(p_type), p_partkey, '@contract') END AS name,
    lower(p_type) AS family, CAST(p_partkey AS BIGINT) AS ordinal, p_partkey % 7 <> 0 AS ok FROM part) WHERE ok""")
def script_name_parse(spark, sf_dir):
    digits = F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_partkey").cast("string"))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lower("p_type"), digits, F.lit("@contract")).alias("name"))
    parsed = rows.withColumn("s", attributes.script_name(F.col("name"), "contract")).filter("s is not null")
    return parsed.select("name", "s.family", "s.ordinal")
