"""Comparison of stored state with another enumeration of the same ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of one side only, as ``left_only`` or ``right_only``, found in one shuffle."""
    side = lambda df, n: df.select(*keys).distinct().withColumn("__side", F.lit(n))
    both = side(left, 1).unionByName(side(right, 2)).groupBy(*keys).agg(F.sum("__side").alias("s"))
    return both.filter("s <> 3").select(*keys, F.when(F.col("s") == 1, "left_only").otherwise("right_only").alias("side"))


def difference_counts(difference: DataFrame) -> DataFrame:
    return difference.groupBy("side").agg(F.count("*").alias("keys"))


def attribute_diff(left: DataFrame, right: DataFrame, key: str, slot: str, fields: Sequence[str]) -> DataFrame:
    """One row per key and finding.

    ``missing_left`` / ``missing_right``, ``updated_after`` where the slots
    differ (nothing else is compared then), or the field that differs.
    """
    pack = lambda df, n: df.select(key, F.struct(slot, *fields).alias(n))
    joined = pack(left, "l").join(pack(right, "r"), key, "full_outer")
    differs = [
        F.when(~F.col("l")[f].eqNullSafe(F.col("r")[f]), F.struct(
            F.lit(f).alias("finding"), F.col("l")[f].cast("string").alias("left_value"), F.col("r")[f].cast("string").alias("right_value")
        )) for f in fields
    ]

    def whole(finding: str, left_value: Column, right_value: Column) -> Column:
        return F.array(F.struct(F.lit(finding).alias("finding"), left_value.cast("string").alias("left_value"),
                                right_value.cast("string").alias("right_value")))

    none = F.lit(None)
    findings = (
        F.when(F.col("l").isNull(), whole("missing_left", none, none))
        .when(F.col("r").isNull(), whole("missing_right", none, none))
        .when(~F.col("l")[slot].eqNullSafe(F.col("r")[slot]), whole("updated_after", F.col("l")[slot], F.col("r")[slot]))
        .otherwise(F.filter(F.array(*differs), lambda f: f.isNotNull()))
    )
    return joined.select(key, F.explode(findings).alias("f")).select(key, "f.*")


def ownership_audit(stored: DataFrame, asset_rows: DataFrame) -> DataFrame:
    """``ok``, ``mismatch`` (one other output) or ``unresolved`` (none or several) per stored row.

    ``asset_rows`` is one row per asset of an output; only positive quantities hold.
    """
    holding = asset_rows.filter(F.col("quantity") > 0).groupBy("policy", "hex").agg(
        F.count_distinct("utxo").alias("outputs"), F.min("utxo").alias("canonical")
    )
    joined = stored.join(holding, ["policy", "hex"], "left")
    one = F.coalesce(F.col("outputs") == 1, F.lit(False))
    status = F.when(one & (F.col("canonical") == F.col("utxo")), "ok").when(one, "mismatch").otherwise("unresolved")
    return joined.select(
        "name", "policy", "hex", "utxo", F.coalesce("outputs", F.lit(0)).alias("outputs"),
        F.when(one, F.col("canonical")).alias("canonical"), status.alias("status"),
    )


def orphans(outputs: DataFrame, canonical: DataFrame, from_slot: int = 0) -> DataFrame:
    """Stored outputs of the window whose block is not canonical."""
    return outputs.filter((F.col("slot") >= from_slot) & F.col("block_hash").isNotNull()).join(
        canonical.select(F.col("hash").alias("block_hash")).distinct(), "block_hash", "left_anti"
    )


def missed_blocks(canonical: DataFrame, scanned: DataFrame, cursor: tuple[int, str]) -> DataFrame:
    """Canonical blocks up to the cursor that were never processed.

    Empty when the cursor block itself is not canonical: its rollback is handled
    by a forward scan from the last common block.
    """
    slot, cursor_hash = cursor
    anchor = canonical.filter(F.col("hash") == cursor_hash).select(F.lit(True).alias("anchored")).limit(1)
    unseen = canonical.filter(F.col("slot") <= slot).join(scanned.select("hash").distinct(), "hash", "left_anti")
    return unseen.filter(F.coalesce(anchor.scalar(), F.lit(False)))


def drift(stored: DataFrame, canonical: DataFrame) -> DataFrame:
    """Rows whose stored transaction differs from the canonical one, both present."""
    known = canonical.select("name", F.col("tx_id").alias("canonical_tx"))
    return stored.join(known, "name").filter(F.col("tx_id") != F.col("canonical_tx"))


def payload_differences(left: DataFrame, right: DataFrame, key: str, order: str, payload: Sequence[str]) -> DataFrame:
    """Transactions that only one feed has, that sit elsewhere in their block, or whose content differs."""
    pack = lambda df, n: df.select(key, F.col(order).alias(f"{n}_order"), F.struct(*payload).alias(n))
    joined = pack(left, "l").join(pack(right, "r"), key, "full_outer")
    finding = (
        F.when(F.col("l").isNull(), "omitted_left")
        .when(F.col("r").isNull(), "omitted_right")
        .when(~F.col("l_order").eqNullSafe(F.col("r_order")), "order")
        .when(~F.col("l").eqNullSafe(F.col("r")), "payload")
    )
    return joined.select(key, finding.alias("finding")).filter(F.col("finding").isNotNull())


def sorted_assets(assets_col: Column) -> Column:
    """Asset structs in a fixed order, quantities as text."""
    return F.array_sort(F.transform(assets_col, lambda a: F.struct(
        a["policy_id"].alias("policy_id"), a["asset_name"].alias("asset_name"), a["quantity"].cast("string").alias("quantity"))))


def type_mismatches(stored: DataFrame, canonical: DataFrame, tag) -> DataFrame:
    """Stored against canonical script type: ``same``, ``mismatch`` or ``unresolved``.

    Both have ``utxo`` and ``type``; ``tag`` maps a spelling to its language.
    """
    known = canonical.filter(F.col("type").isNotNull()).groupBy("utxo").agg(F.min("type").alias("canonical_type"))
    joined = stored.join(known, "utxo", "left")
    status = (
        F.when(F.col("canonical_type").isNull(), "unresolved")
        .when(tag(F.col("type")) != tag(F.col("canonical_type")), "mismatch")
        .otherwise("same")
    )
    return joined.withColumn("status", status)


def transition_counts(mismatches: DataFrame) -> DataFrame:
    return (
        mismatches.filter(F.col("status") == "mismatch")
        .groupBy(F.coalesce(F.nullif("type", F.lit("")), F.lit("(empty)")).alias("from_type"), F.col("canonical_type").alias("to_type"))
        .agg(F.count("*").alias("rows"))
    )


def repeated(rows: DataFrame, key: str = "name") -> DataFrame:
    """Keys an enumeration returned more than once."""
    return rows.groupBy(key).agg(F.count("*").alias("copies")).filter("copies > 1")


def unresolved_by_label(wanted: DataFrame, resolved: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    return wanted.join(resolved.select(*keys).distinct(), list(keys), "left_anti").groupBy(label).agg(F.count("*").alias("items"))


def output_disagreements(outputs: DataFrame, tx_outputs: DataFrame) -> DataFrame:
    """Outputs whose own transaction tells something else.

    Both sides: ``utxo, address, value`` and one row per asset
    (``policy, hex, quantity``). The transaction must hold the output exactly
    once with the same address, value and assets.
    """
    keys = ["utxo"]

    def digest(df: DataFrame, prefix: str) -> DataFrame:
        # Equal multisets of rows have equal counts and sums of independent row hashes.
        row = F.struct("policy", "hex", "quantity")
        return df.groupBy(*keys).agg(
            F.count_distinct("address", "value").alias(f"{prefix}_heads"),
            F.min(F.struct("address", "value")).alias(f"{prefix}_head"),
            F.count("*").alias(f"{prefix}_assets"),
            F.sum(F.xxhash64(row).cast("decimal(38,0)")).alias(f"{prefix}_sum"),
            F.sum(F.xxhash64(F.lit(1), row).cast("decimal(38,0)")).alias(f"{prefix}_sum2"),
        )

    joined = digest(outputs, "o").join(digest(tx_outputs, "t"), keys, "left")
    same_assets = (F.col("o_assets") == F.col("t_assets")) & (F.col("o_sum") == F.col("t_sum")) & (F.col("o_sum2") == F.col("t_sum2"))
    finding = (
        F.when(F.col("t_heads").isNull(), "missing_output")
        .when((F.col("t_heads") > 1) | (F.col("o_heads") > 1), "duplicated_output")
        .when(~F.col("o_head").eqNullSafe(F.col("t_head")), "address_or_value")
        .when(~same_assets, "assets")
    )
    return joined.select("utxo", finding.alias("finding")).filter(F.col("finding").isNotNull())


def broken_rows(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule with the number of rows its condition holds for, counted in one pass."""
    counts = rows.agg(*[F.count_if(condition).alias(rule) for rule, condition in rules.items()])
    pairs = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("violations")) for rule in rules])
    return counts.select(F.inline(pairs))


def violations(rules: dict[str, DataFrame]) -> DataFrame:
    """One row per rule with the number of rows that break it; zero counts stay."""
    parts = [rows.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations") for rule, rows in rules.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
