"""Attributes derived from a name or a record, row by row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


_NUMBER = r"^-?\d+(\.\d+)?$"


def rarity(name: Column) -> Column:
    n = F.length(name)
    return (
        F.when(n == 1, "legendary")
        .when(n == 2, "ultra_rare")
        .when(n == 3, "rare")
        .when(n.between(4, 7), "common")
        .when(n >= 8, "basic")
    )


def characters(name: Column) -> Column:
    """Classes present, joined by commas; a signed or decimal number is ``numbers``."""
    number = name.rlike(_NUMBER)
    return F.concat_ws(
        ",",
        F.when(name.rlike("[A-Za-z]"), "letters"),
        F.when(name.rlike("[0-9]"), "numbers"),
        F.when(name.rlike("[-._]") & ~number, "special"),
    )


def numeric_modifiers(name: Column) -> Column:
    number = name.rlike(_NUMBER)
    return F.concat_ws(
        ",",
        F.when(number & name.startswith("-"), "negative"),
        F.when(number & name.contains("."), "decimal"),
    )


def is_sub(name: Column) -> Column:
    return name.contains("@")


def sub_part(name: Column) -> Column:
    return F.when(is_sub(name), F.split_part(name, F.lit("@"), F.lit(1)))


def root_part(name: Column) -> Column:
    return F.when(is_sub(name), F.split_part(name, F.lit("@"), F.lit(2)))


def name_attributes(name: Column) -> list[Column]:
    """All columns that depend on the name alone."""
    sub = sub_part(name)
    return [
        F.length(name).alias("length"),
        rarity(name).alias("rarity"),
        characters(name).alias("characters"),
        numeric_modifiers(name).alias("numeric_modifiers"),
        F.length(sub).alias("sub_length"),
        rarity(sub).alias("sub_rarity"),
        F.when(sub.isNotNull(), characters(sub)).alias("sub_characters"),
        F.when(sub.isNotNull(), numeric_modifiers(sub)).alias("sub_numeric_modifiers"),
        root_part(name).alias("root"),
    ]


def _filled(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def is_personalized(
    image_hash: Column,
    standard_image_hash: Column,
    art: list[Column],
    content: list[Column],
    addresses: Column,
) -> Column:
    """An own image, background, picture, linked content or extra chain address."""
    checks = ~image_hash.eqNullSafe(standard_image_hash)
    for value in [*art, *content]:
        checks = checks | _filled(value)
    extra = F.exists(
        F.map_entries(addresses),
        lambda e: (e["key"] != "ada") & _filled(e["value"]),
    )
    return checks | F.coalesce(extra, F.lit(False))


def strip_0x(value: Column) -> Column:
    return F.regexp_replace(value, "^0x", "")


def pz_enabled(handle_type: Column, stored: Column) -> Column:
    """Stored flag, else true for root names only."""
    return F.coalesce(stored, F.when(handle_type == "handle", F.lit(True)))


def language_tag(spelling: Column, *, strict: bool = False) -> Column:
    """Two-digit script language tag out of the many spellings in use."""
    # Every accepted spelling ends in its version digit.
    known = spelling.rlike(r"^(plutus_v|plutusV|PlutusScriptV|plutus:v)[123]$")
    tag = F.when(known, F.concat(F.lit("0"), F.substring(spelling, -1, 1)))
    if strict:
        message = F.concat(F.lit("unknown script language "), F.coalesce(spelling, F.lit("null")))
        return F.coalesce(tag, F.raise_error(message).cast("string"))
    return F.coalesce(tag, F.lit("02"))


def script_name(name: Column, root: str) -> Column:
    """``struct(family, ordinal)`` of ``<family><digits>@root``, else null."""
    text = F.lower(name)
    pattern = rf"^(.+?)(\d+)@{root}$"
    return F.when(
        text.rlike(pattern),
        F.struct(
            F.regexp_extract(text, pattern, 1).alias("family"),
            F.regexp_extract(text, pattern, 2).try_cast("bigint").alias("ordinal"),
        ),
    )


def _flag(text: Column) -> Column:
    return text.isin("true", "1")


def settings_struct(datum_json: Column) -> Column:
    """Name the fields of a positional settings list; a broken list gives nulls.

    The list is two five-element lists (nft, virtual) and six scalars.
    """

    def tier(values: Column) -> Column:
        at = [F.try_element_at(values, F.lit(i)) for i in range(1, 6)]
        return F.struct(
            _flag(at[0]).alias("public_minting_enabled"),
            _flag(at[1]).alias("pz_enabled"),
            at[2].alias("tier_pricing"),
            at[3].alias("default_styles"),
            _flag(at[4]).alias("save_original_address"),
        )

    def named(items: Column) -> Column:
        at = {i: F.try_element_at(items, F.lit(i)) for i in range(1, 9)}
        return F.struct(
            _let(F.from_json(at[1], "array<string>"), tier).alias("nft"),
            _let(F.from_json(at[2], "array<string>"), tier).alias("virtual"),
            at[3].try_cast("bigint").alias("buy_down_price"),
            at[4].try_cast("bigint").alias("buy_down_paid"),
            at[5].try_cast("bigint").alias("buy_down_percent"),
            at[6].alias("agreed_terms"),
            _flag(at[7]).alias("migrate_sig_required"),
            at[8].alias("payment_address"),
        )

    return _let(F.from_json(datum_json, "array<string>"), named)


_ATTRIBUTES = (
    "STRUCT<image STRING, og_number BIGINT, version BIGINT>",
    "STRUCT<image_hash STRING, standard_image_hash STRING, standard_image STRING, bg_image STRING, bg_asset STRING,"
    " pfp_image STRING, pfp_asset STRING, svg_version STRING, default BOOLEAN, last_update_address STRING,"
    " original_address STRING, id_hash STRING, pz_enabled BOOLEAN, last_edited_time BIGINT, portal STRING,"
    " designer STRING, socials STRING, resolved_addresses MAP<STRING, STRING>,"
    " virtual STRUCT<expires_time BIGINT, public_mint BOOLEAN>>",
)


_PERSONAL = (
    "bg_image", "bg_asset", "pfp_image", "pfp_asset", "last_update_address", "original_address", "id_hash", "pz_enabled",
    "last_edited_time", "portal", "designer", "socials", "resolved_addresses", "virtual",
)


def is_attributes(datum_json: Column) -> Column:
    """Whether `datum_attributes` of a datum is not null, without reading its fields."""
    return F.coalesce(F.size(F.from_json(datum_json, "array<string>")) == 3, F.lit(False))


def datum_attributes(datum_json: Column) -> Column:
    """Attributes of a decoded ``[nft, version, project]`` datum; any other shape is null."""

    def parsed(items: Column) -> Column:
        return F.when(F.size(items) == 3, F.struct(
            F.from_json(F.try_element_at(items, F.lit(1)), _ATTRIBUTES[0]).alias("nft"),
            F.from_json(F.try_element_at(items, F.lit(3)), _ATTRIBUTES[1]).alias("project"),
        ))

    def named(datum: Column) -> Column:
        nft, project = datum["nft"], datum["project"]
        return F.when(datum.isNotNull(), F.struct(
            F.coalesce(nft["og_number"], F.lit(0)).alias("og_number"),
            F.coalesce(nft["image"], F.lit("")).alias("image"),
            nft["version"].alias("version"),
            F.coalesce(project["image_hash"], F.lit("")).alias("image_hash"),
            F.coalesce(project["standard_image_hash"], F.lit("")).alias("standard_image_hash"),
            F.coalesce(project["standard_image"], F.lit("")).alias("standard_image"),
            F.coalesce(project["svg_version"], F.lit("")).alias("svg_version"),
            F.coalesce(project["default"], F.lit(False)).alias("default"),
            *[project[f].alias(f) for f in _PERSONAL],
        ))

    return _let(_let(F.from_json(datum_json, "array<string>"), parsed), named)
