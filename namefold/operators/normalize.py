"""Blocks, transactions and outputs turned into flat rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, StructType

from namefold.functions import assets
from namefold.operators import state
from namefold.operators.joins import left_lookup

_OUTPUT = "struct<address: string, lovelace: decimal(38,0), datum: string, script: struct<language: string, cbor: string>>"


def only_block_type(blocks: DataFrame, block_type: str = "praos") -> DataFrame:
    """Blocks of the accepted type; any other type fails the job."""
    message = F.concat(F.lit("unsupported block type "), F.coalesce(F.col("type"), F.lit("null")))
    checked = F.when(F.col("type") == block_type, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return blocks.filter(checked)


def flatten_blocks(blocks: DataFrame, policies: Sequence[str] | None = None) -> DataFrame:
    """One row per asset of every output: block, tx position, output, policy, token, quantity.

    ``assets`` of an output is ``policy -> token hex -> quantity``; with
    ``policies`` only theirs are kept. ``rank`` puts outputs that hold a 222 token
    before the others of their block. All of it happens inside the nested
    columns, so neither the filter nor the rank needs a shuffle.
    """
    txs = blocks.select(
        F.col("id").alias("block_hash"), "height", "slot", F.posexplode("transactions").alias("tx_pos", "tx")
    )
    outs = txs.select(
        "block_hash", "height", "slot", "tx_pos", F.col("tx.id").alias("tx_id"), F.posexplode("tx.outputs").alias("idx", "out")
    )
    held = F.col("out.assets")
    if policies is not None:
        held = F.map_filter(held, lambda policy, _tokens: policy.isin(*policies))
    outs = outs.withColumn("held", held)
    owner = F.exists(
        F.map_values("held"), lambda tokens: F.exists(F.map_keys(tokens), lambda t: t.startswith(assets.LABEL_OWNER))
    )
    per_policy = outs.select(
        "block_hash", "height", "slot", "tx_pos", "tx_id", "idx", F.when(owner, 2).otherwise(3).alias("rank"),
        F.col("out.address").alias("address"), F.col("out.lovelace").alias("lovelace"), F.col("out.datum").alias("datum"),
        F.explode("held").alias("policy", "tokens"),
    )
    return per_policy.select("*", F.explode("tokens").alias("hex", "quantity")).drop("tokens").withColumn(
        "utxo", F.concat_ws("#", "tx_id", "idx")
    )


def fold_events(blocks: DataFrame, policies: Sequence[str], *, holder: Callable[[Column], Column],
                datum_holder: Callable[[Column], Column]) -> DataFrame:
    """Rows of the state fold straight from nested blocks (`landed.BLOCK_SCHEMA`), in one pass without a shuffle.

    Outputs spent in the block that made them are left out. A token whose net
    mint in its transaction is below zero is a burn, main or of a registry
    label; above zero, its outputs there are marked as minted. ``holder`` reads
    an address and ``datum_holder`` a datum: both codecs are the caller's. Null
    arrays and maps count as empty, tokens without a name are left out.
    """
    ref = lambda tx, index: F.concat_ws("#", tx, index.cast("string"))
    none = F.array().cast("array<string>")
    spent = F.flatten(F.transform("transactions", lambda t: F.coalesce(F.transform(t["inputs"], lambda i: ref(i["tx"], i["index"])), none)))
    mine = lambda by_policy: F.map_filter(by_policy, lambda policy, _tokens: policy.isin(*policies))

    def entries(by_policy: Column, extra: Callable[[Column, Column], list[Column]]) -> Column:
        """(policy, hex, ...) of a map policy -> token -> quantity, as one flat array."""
        per_policy = F.transform(F.map_entries(mine(by_policy)), lambda p: F.transform(
            F.map_entries(p["value"]), lambda t: F.struct(p["key"].alias("policy"), t["key"].alias("hex"), *extra(p["key"], t))))
        return F.flatten(per_policy)

    def label_class(token: Column) -> Column:
        return assets.burn_class(assets.label_of(token))

    def minted(tx: Column, policy: Column, token: Column) -> Column:
        return F.coalesce(F.try_element_at(F.try_element_at(tx["mint"], policy), token) > 0, F.lit(False))

    def burned(tx: Column) -> Column:
        rows = entries(tx["mint"], lambda _p, t: [
            F.when(label_class(t["key"]) == "main", "burn").otherwise("label_burn").alias("kind"),
            F.when(label_class(t["key"]) == "main", 0).otherwise(1).alias("rank"),
            F.lit(None).cast("int").alias("idx"), F.lit(False).alias("is_mint"), F.lit(None).cast(_OUTPUT).alias("out"), t["value"].alias("quantity")])
        return F.filter(rows, lambda r: (r["quantity"] < 0) & label_class(r["hex"]).isNotNull())

    def held(tx: Column) -> Column:
        def of_output(out: Column, idx: Column) -> Column:
            tokens = F.flatten(F.transform(F.map_values(mine(out["assets"])), F.map_keys))
            rank = F.when(F.exists(tokens, lambda t: t.startswith(assets.LABEL_OWNER)), 2).otherwise(3)
            body = F.struct(out["address"].alias("address"), out["lovelace"].alias("lovelace"), out["datum"].alias("datum"), out["script"].alias("script"))
            rows = entries(out["assets"], lambda p, t: [
                state.event_kind(assets.label_of(t["key"])).alias("kind"), rank.alias("rank"), idx.cast("int").alias("idx"),
                minted(tx, p, t["key"]).alias("is_mint"), body.cast(_OUTPUT).alias("out"), t["value"].alias("quantity")])
            return F.when(~F.array_contains(F.col("spent"), ref(tx["id"], idx)), rows)

        return F.flatten(F.filter(F.transform(tx["outputs"], of_output), lambda rows: rows.isNotNull()))

    txs = blocks.withColumn("spent", spent).select("slot", "spent", F.posexplode("transactions").alias("tx_pos", "tx"))
    empty = F.array().cast(f"array<struct<policy: string, hex: string, kind: string, rank: int, idx: int, is_mint: boolean, out: {_OUTPUT}, quantity: decimal(38,0)>>")
    both = F.concat(F.coalesce(burned(F.col("tx")), empty), F.coalesce(held(F.col("tx")), empty))
    rows = txs.select("slot", "tx_pos", F.col("tx.id").alias("tx_id"), F.inline(both))
    token = F.col("hex")
    script = F.when(F.col("out.script").isNotNull(), F.struct(F.col("out.script.language").alias("type"), F.col("out.script.cbor").alias("cbor")))
    return rows.select(
        assets.name_of_hex(token).alias("name"), "policy", assets.label_of(token).alias("label"), "hex", assets.owner_hex_of(token).alias("owner_hex"),
        "kind", "slot", "rank", F.col("tx_pos").cast("bigint").alias("tx_pos"), F.coalesce("idx", F.lit(0)).alias("idx"),
        F.when(F.col("idx").isNotNull(), ref(F.col("tx_id"), F.col("idx"))).alias("utxo"),
        F.col("out.address").alias("address"), holder(F.col("out.address")).alias("holder"), F.col("out.lovelace").alias("lovelace"),
        script.alias("script"), F.col("out.datum").alias("datum"), (F.col("is_mint") & (F.col("kind") == "owner")).alias("is_mint"),
        F.when(F.col("kind") == "virtual", datum_holder(F.col("out.datum"))).alias("datum_holder"),
    ).filter("name <> ''")


def flatten_inputs(blocks: DataFrame) -> DataFrame:
    """Outputs spent by the transactions of each block."""
    txs = blocks.select(F.col("id").alias("block_hash"), "slot", F.explode("transactions").alias("tx"))
    return txs.select("block_hash", "slot", F.col("tx.id").alias("tx_id"), F.explode("tx.inputs").alias("i")).select(
        "block_hash", "slot", "tx_id", F.concat_ws("#", F.col("i.tx"), F.col("i.index")).alias("utxo")
    )


def tracked(rows: DataFrame, policies: Sequence[str] | DataFrame, policy: str = "policy") -> DataFrame:
    """Rows of tracked policies; a long list comes as a table."""
    if isinstance(policies, DataFrame):
        return rows.join(policies.select(policy).distinct(), policy, "left_semi")
    return rows.filter(F.col(policy).isin(*policies))


def holds_tracked(assets_col: Column, policies: Sequence[str]) -> Column:
    """Whether an output's asset array (structs with ``policy_id``) has a tracked one."""
    return F.exists(assets_col, lambda a: a["policy_id"].isin(*policies))


def group_by_block(txs: DataFrame) -> DataFrame:
    """Block headers seen in transaction rows, with the number of distinct transactions."""
    return txs.groupBy("block_hash", "block_height", "absolute_slot").agg(F.count_distinct("tx_hash").alias("tx_count"))


def minted_in_output(outputs: DataFrame, mints: DataFrame) -> DataFrame:
    """Assets of an output that its own transaction mints (quantity above zero).

    Both sides are one row per asset; the result flags every output row.
    """
    minted = mints.filter(F.col("quantity") > 0).select("tx_id", "policy", "hex").distinct().withColumn("is_mint", F.lit(True))
    return outputs.join(minted, ["tx_id", "policy", "hex"], "left").withColumn("is_mint", F.coalesce("is_mint", F.lit(False)))


def burns(mints: DataFrame, token: str = "hex") -> DataFrame:
    """Burned tokens with their class; tokens of no class are left out."""
    return (
        mints.filter(F.col("quantity") < 0)
        .withColumn("burn_class", assets.burn_class(assets.label_of(F.col(token))))
        .filter(F.col("burn_class").isNotNull())
    )


def trim_metadata(metadata: Column, policies: Sequence[str], held: Column) -> Column:
    """Keep label 721, tracked policies and tokens the output holds (as text or hex).

    ``metadata`` is ``label -> policy -> token -> json``; ``held`` the array of
    token hexes. Empty levels vanish, ``version`` alone does not keep a label.
    """

    def tokens(_policy: Column, entries: Column) -> Column:
        return F.map_filter(
            entries, lambda token, _v: F.array_contains(held, token) | F.array_contains(held, assets.hex_of_name(token))
        )

    def policy_map(_label: Column, by_policy: Column) -> Column:
        kept = F.map_filter(by_policy, lambda policy, _v: policy.isin(*policies, "version"))
        trimmed = F.transform_values(kept, lambda p, entries: F.when(p == "version", entries).otherwise(tokens(p, entries)))
        return F.map_filter(trimmed, lambda _p, entries: F.size(entries) > 0)

    labels = F.map_filter(metadata, lambda label, _v: label == "721")
    shrunk = F.transform_values(labels, policy_map)
    return F.map_filter(shrunk, lambda _l, by_policy: F.exists(F.map_keys(by_policy), lambda p: p != "version"))


def resolve_datum(outputs: DataFrame, datums: DataFrame) -> DataFrame:
    """Inline datum, else the one landed under the output's datum hash, else null."""
    by_hash = datums.groupBy("datum_hash").agg(F.min("datum").alias("__datum"))
    return (
        left_lookup(outputs, by_hash, "datum_hash")
        .withColumn("datum", F.coalesce(F.nullif("inline_datum", F.lit("")), "__datum"))
        .drop("__datum")
    )


def net_asset_delta(outputs: DataFrame, inputs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Outputs minus inputs per transaction and asset; what nets to zero is left out."""
    signed = outputs.select(*keys, F.col("quantity")).unionByName(inputs.select(*keys, (-F.col("quantity")).alias("quantity")))
    return signed.groupBy(*keys).agg(F.sum("quantity").alias("quantity")).filter(F.col("quantity") != 0)


def merge_output_records(records: DataFrame, keys: Sequence[str], order: Sequence[str], fields: Sequence[str],
                         token: str = "hex") -> DataFrame:
    """Duplicate reads of an output: per field the first non-null value wins.

    ``assets`` counts the union of the tokens; `merged_tokens` lists them.
    """
    position = F.struct(*order)
    return records.groupBy(*keys).agg(
        *[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), position)).alias(f) for f in fields],
        F.count_distinct(token).alias("assets"),
    )


def merged_tokens(records: DataFrame, keys: Sequence[str], policy: str = "policy", token: str = "hex") -> DataFrame:
    return records.select(*keys, policy, token).distinct()


def drop_failed(txs: DataFrame) -> DataFrame:
    """Successful transactions; a row without header fields or hash is an error."""
    broken = F.col("tx_hash").isNull() | F.col("block_hash").isNull() | F.col("height").isNull()
    checked = F.when(broken, F.raise_error(F.lit("transaction without hash or block header")).cast("boolean")).otherwise(
        F.coalesce(F.col("successful"), F.lit(True))
    )
    return txs.filter(checked)


def canonical_json(value: Column, kind: DataType) -> Column:
    """Text of a nested value of the type ``kind`` that does not depend on the order its keys came in.

    Keys of maps and fields of structs are sorted by code point at every level,
    arrays keep their order, integers beyond 53 bits and decimals become text, so that no
    reader rounds them. A null field counts like an absent one; other nulls
    are ``null``.
    """
    quoted = lambda text: F.regexp_replace(F.to_json(F.array(text.cast("string"))), r"^\[|\]$", "")

    def entry(key: Column, body: Column) -> Column:
        return F.concat(quoted(key), F.lit(":"), body)

    if isinstance(kind, StructType):
        fields = [F.when(value[f.name].isNotNull(), entry(F.lit(f.name), canonical_json(value[f.name], f.dataType))) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    elif isinstance(kind, MapType):
        pairs = F.transform(F.array_sort(F.map_keys(value)), lambda k: entry(k, canonical_json(F.element_at(value, k), kind.valueType)))
        text = F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
    elif isinstance(kind, ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda v: canonical_json(v, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, LongType):
        text = F.when(F.abs(value) < 1 << 53, value.cast("string")).otherwise(quoted(value))
    elif isinstance(kind, (BooleanType, IntegerType, ShortType, ByteType, DoubleType, FloatType)):
        text = value.cast("string")
    else:
        text = quoted(value)
    return F.when(value.isNotNull(), text).otherwise(F.lit("null"))


def class_counts(tokens: DataFrame, token: str = "hex") -> DataFrame:
    """Tokens and distinct names per class; nameless tokens are skipped."""
    hex_name = F.col(token)
    classed = tokens.filter(hex_name != "").select(
        assets.asset_class(hex_name).alias("class"), assets.name_of_hex(hex_name).alias("name")
    )
    return classed.groupBy("class").agg(F.count("*").alias("tokens"), F.count_distinct("name").alias("names"))


def live_supply(assets_df: DataFrame, supply: str = "total_supply") -> DataFrame:
    return assets_df.filter(F.col(supply) > 0)


def restrict_to_names(asset_rows: DataFrame, names: DataFrame) -> DataFrame:
    """Asset rows of listed names; outputs without one vanish with their rows."""
    return asset_rows.join(names.select("name").distinct(), "name", "left_semi")


def expand_mints(sources: DataFrame, history: DataFrame, live_names: DataFrame) -> DataFrame:
    """All mint events of live names.

    ``sources`` has the first mint of a token with its ``mint_count``; tokens
    minted more than once get the positive events of ``history`` they lack.
    """
    indexable = sources.filter(assets.counts_as_mint(assets.label_of(F.col("hex"))))
    repeated = indexable.filter("mint_count > 1").select("policy", "hex", "mint_count")
    # The keys with the transaction in them are balanced; the join by token alone
    # comes last, where a token with very many mints can still be split.
    extra = (
        history.filter("quantity > 0").select("policy", "hex", "tx_hash").distinct()
        .join(indexable.select("policy", "hex", "tx_hash"), ["policy", "hex", "tx_hash"], "left_anti")
        .join(repeated, ["policy", "hex"])
        .select("policy", "hex", "tx_hash", "mint_count")
    )
    every = indexable.select("policy", "hex", "tx_hash", "mint_count").unionByName(extra)
    named = every.withColumn("name", assets.name_of_hex(F.col("hex")))
    return named.join(live_names.select("name").distinct(), "name", "left_semi")


def unspent_asset_rows(outputs: DataFrame, requested: DataFrame) -> DataFrame:
    """Assets of unspent outputs that were asked for, with the label of the request.

    ``outputs`` is one row per asset with ``is_spent``.
    """
    return outputs.filter(~F.coalesce(F.col("is_spent"), F.lit(False))).join(requested, ["policy", "hex"])


def policy_settings(rows: DataFrame, keys: Sequence[str], settings_json: str) -> DataFrame:
    """One row per policy of a settings map whose values are tuples or objects.

    ``0x`` is stripped from the policy; an end slot of 0 or less means none. A
    value of another shape, or one that is no number, is an error.
    """
    entries = rows.select(*keys, F.explode(F.from_json(settings_json, "map<string,string>")).alias("policy", "value"))
    value = F.col("value")
    as_tuple = F.from_json(value, "array<string>")
    as_object = F.from_json(value, "map<string,string>")
    fail = F.raise_error(F.concat(F.lit("invalid policy settings "), F.coalesce(value, F.lit("null"))))

    def slot(position: int, *spellings: str) -> Column:
        spelled = F.coalesce(*[F.try_element_at(as_object, F.lit(s)) for s in spellings], F.lit("0"))
        text = (
            F.when(value.startswith("[") & (F.size(as_tuple) >= 3), F.try_element_at(as_tuple, F.lit(position)))
            .when(value.startswith("{"), spelled)
        )
        return F.coalesce(text.try_cast("double"), fail.cast("double")).cast("bigint")

    def optional(number: Column) -> Column:
        return F.when(number > 0, number)

    return entries.select(
        *keys, F.regexp_replace("policy", "^0[xX]", "").alias("policy"),
        slot(1, "first_minting_slot", "firstMintingSlot").alias("first_minting_slot"),
        optional(slot(2, "last_minting_slot", "lastMintingSlot")).alias("last_minting_slot"),
        optional(slot(3, "sunset_slot", "sunsetSlot")).alias("sunset_slot"),
    )
