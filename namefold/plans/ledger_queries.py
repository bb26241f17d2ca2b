"""Normalisation of the ledger and the projection to current state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namefold.functions import assets
from namefold.operators import normalize, state
from namefold.plans import bindings as b
from namefold.plans.bindings import table, with_views
from namefold.plans.registry import query
from namefold.scratch import materialize, release, scratch_path, shuffles_dropped
from namefold.sources import landed

LEDGER_ORDER = ["slot", "tx_id", "idx"]


@query("net_asset_delta", """
SELECT tx_id, asset_id, CAST(sum(q) AS BIGINT) AS quantity FROM (
  SELECT l_orderkey AS tx_id, l_partkey AS asset_id, CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE l_returnflag <> 'R'
  UNION ALL SELECT l_orderkey, l_partkey, -CAST(l_quantity AS BIGINT) FROM lineitem WHERE l_returnflag = 'R')
GROUP BY tx_id, asset_id HAVING sum(q) <> 0""")
def net_asset_delta(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("tx_id"), F.col("l_partkey").alias("asset_id"), F.col("l_quantity").cast("bigint").alias("quantity"), "l_returnflag"
    )
    spent = F.col("l_returnflag") == "R"
    return normalize.net_asset_delta(lines.filter(~spent), lines.filter(spent), ["tx_id", "asset_id"])


@query("merge_duplicate_outputs", """
SELECT l_orderkey AS tx_id, l_linenumber AS idx,
  arg_min(d, CASE WHEN d IS NOT NULL THEN (l_partkey, l_suppkey, d) END) AS datum,
  arg_min(s, CASE WHEN s IS NOT NULL THEN (l_partkey, l_suppkey, d2) END) AS script, count(DISTINCT l_partkey) AS assets
FROM (SELECT *, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS d2,
        CASE WHEN l_partkey % 3 = 0 THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS d,
        CASE WHEN l_partkey % 4 = 1 THEN concat('s', l_suppkey) END AS s FROM lineitem)
GROUP BY l_orderkey, l_linenumber""")
def merge_duplicate_outputs(spark, sf_dir):
    shipped = F.col("l_shipdate").cast("date").cast("string")
    records = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("tx_id"), F.col("l_linenumber").alias("idx"), "l_partkey", "l_suppkey", shipped.alias("day"),
        F.when(F.col("l_partkey") % 3 == 0, shipped).alias("datum"),
        F.when(F.col("l_partkey") % 4 == 1, F.concat(F.lit("s"), "l_suppkey")).alias("script"),
    )
    return normalize.merge_output_records(
        records, ["tx_id", "idx"], ["l_partkey", "l_suppkey", "day"], ["datum", "script"], token="l_partkey"
    )


@query("datum_resolution", """
SELECT l_orderkey AS tx_id, l_linenumber AS idx, l_partkey AS asset_id, l_suppkey AS supplier,
  CASE WHEN l_returnflag = 'A' THEN concat('inline', l_linestatus) WHEN l_returnflag = 'N' AND p_partkey % 4 <> 0 THEN p_brand END AS datum
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""")
def datum_resolution(spark, sf_dir):
    outputs = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("tx_id"), F.col("l_linenumber").alias("idx"), F.col("l_partkey").alias("asset_id"),
        F.col("l_suppkey").alias("supplier"), F.when(F.col("l_returnflag") == "A", F.concat(F.lit("inline"), "l_linestatus")).alias("inline_datum"),
        F.when(F.col("l_returnflag") == "N", F.md5(F.col("l_partkey").cast("string"))).alias("datum_hash"),
    )
    datums = table(spark, sf_dir, "part").filter(F.col("p_partkey") % 4 != 0).select(
        F.md5(F.col("p_partkey").cast("string")).alias("datum_hash"), F.col("p_brand").alias("datum")
    )
    return normalize.resolve_datum(outputs, datums).select("tx_id", "idx", "asset_id", "supplier", "datum")


_LABEL_BY_ASSET = """CASE asset_id % 5 WHEN 0 THEN '000de140' WHEN 1 THEN '000643b0' WHEN 3 THEN '00000000' WHEN 4 THEN '00001070' END"""


def _labelled(df: DataFrame) -> DataFrame:
    """Ledger rows under one of five labels, by asset."""
    pick = F.col("asset_id") % 5
    label = (
        F.when(pick == 0, assets.LABEL_OWNER).when(pick == 1, assets.LABEL_REFERENCE)
        .when(pick == 3, assets.LABEL_VIRTUAL).when(pick == 4, assets.LABEL_SETTINGS)
    )
    body = assets.hex_of_name(F.concat(F.lit("n"), F.col("asset_id")))
    return df.withColumn("hex", F.concat(F.coalesce(label, F.lit("")), body))


@query("burn_split", with_views(f"""
SELECT tx_id, idx, concat('n', asset_id) AS name, CASE asset_id % 5 WHEN 4 THEN 'label' ELSE 'main' END AS burn_class
FROM ledger WHERE is_burn = 1 AND asset_id % 5 <> 1""", "ledger"))
def burn_split(spark, sf_dir):
    mints = _labelled(b.ledger(spark, sf_dir)).withColumn("quantity", F.when(F.col("is_burn") == 1, -1).otherwise(1))
    return normalize.burns(mints).select("tx_id", "idx", assets.name_of_hex(F.col("hex")).alias("name"), "burn_class")


_MINTS = f"""mints AS (SELECT concat('n', asset_id) AS name, slot, CAST(tx_id AS VARCHAR) AS tx_hash, concat('m', tx_id % 3) AS metadata
  FROM ledger WHERE tx_id % 5 = 0 AND is_burn = 0 AND coalesce({_LABEL_BY_ASSET}, '000de140') IN ('000de140', '00000000'))"""


def _mints(spark, sf_dir) -> DataFrame:
    events = _labelled(b.ledger(spark, sf_dir)).filter((F.col("tx_id") % 5 == 0) & (F.col("is_burn") == 0)).select(
        assets.parse_asset(F.col("hex")).alias("p"), "slot", F.col("tx_id").cast("string").alias("tx_hash"),
        F.concat(F.lit("m"), F.col("tx_id") % 3).alias("metadata"),
    ).select("p.label", "p.name", "slot", "tx_hash", "metadata")
    return state.mint_history(events.unionByName(events))  # a replay adds nothing


@query("mint_history", with_views(f"""
WITH {_MINTS} SELECT DISTINCT name, slot AS created_slot, tx_hash, metadata FROM mints""", "ledger"))
def mint_history(spark, sf_dir):
    return _mints(spark, sf_dir)


@query("first_mint", with_views(f"""
WITH {_MINTS} SELECT name, slot AS created_slot, tx_hash, metadata FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY slot, tx_hash) AS rn FROM mints) WHERE rn = 1""", "ledger"))
def first_mint(spark, sf_dir):
    return state.first_mint(_mints(spark, sf_dir))


@query("missing_mint_check", with_views("""
SELECT DISTINCT concat('n', asset_id) AS name FROM ledger WHERE asset_id % 13 = 0""", "ledger"))
def missing_mint_check(spark, sf_dir):
    rows = b.ledger(spark, sf_dir).select(F.concat(F.lit("n"), "asset_id").alias("name"), "asset_id")
    return state.missing_mints(rows, rows.filter(F.col("asset_id") % 13 != 0))


@query("current_owner", with_views("""
SELECT asset_id, holder, utxo, slot, value FROM (
  SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY slot DESC, tx_id DESC, idx DESC) AS rn FROM ledger)
WHERE rn = 1 AND is_burn = 0""", "ledger"))
def current_owner(spark, sf_dir):
    return state.current_owner(
        b.ledger(spark, sf_dir), ["asset_id"], LEDGER_ORDER, F.col("is_burn") == 1, ["holder", "utxo", "slot", "value"]
    )


# One step per event and name: the state machine written out, to check the fold.
FOLD_ORACLE = """
WITH kept AS (
  SELECT * FROM asset_events WHERE NOT (kind = 'reference' AND NOT has_datum)),
one_burn AS (
  SELECT *, row_number() OVER (PARTITION BY name, slot, kind ORDER BY tx_id, idx, hex) AS burn_no FROM kept),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY slot, rank, tx_id, idx, hex) AS n
  FROM one_burn WHERE kind <> 'burn' OR burn_no = 1),
minted AS (SELECT name, min(slot) AS slot FROM asset_events WHERE kind NOT IN ('burn', 'label_burn') GROUP BY name),
folded AS (
  SELECT name, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS amount, '' AS hex, '' AS utxo, '' AS address, CAST('' AS VARCHAR) AS holder,
    CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS created, CAST(NULL AS VARCHAR) AS reference_utxo, CAST('' AS VARCHAR) AS image,
    CAST(0 AS BIGINT) AS og, CAST(NULL AS VARCHAR) AS settings_utxo, CAST('' AS VARCHAR) AS labels, false AS is_default, false AS has_datum,
    false AS is_virtual, CAST(NULL AS VARCHAR) AS btc
  FROM (SELECT DISTINCT name FROM ordered)
  UNION ALL
  SELECT f.name, e.n,
    CASE WHEN e.kind = 'burn' THEN greatest(f.amount - 1, 0) WHEN e.kind = 'label_burn' THEN f.amount WHEN f.amount = 0 THEN 1
         WHEN e.kind = 'owner' AND e.is_mint AND f.utxo <> '' AND f.utxo <> e.utxo AND f.hex = e.owner_hex THEN f.amount + 1 ELSE f.amount END,
    CASE WHEN e.kind IN ('burn', 'label_burn') THEN CASE WHEN e.kind = 'burn' AND f.amount <= 1 THEN '' ELSE f.hex END
         WHEN f.amount = 0 OR e.kind = 'owner' THEN e.owner_hex ELSE f.hex END,
    CASE WHEN e.kind = 'burn' AND f.amount <= 1 THEN '' WHEN e.kind IN ('owner', 'virtual') THEN e.utxo ELSE f.utxo END,
    CASE WHEN e.kind = 'burn' AND f.amount <= 1 THEN '' WHEN e.kind = 'virtual' AND e.has_datum THEN concat('da', e.tx_id) WHEN e.kind = 'owner' THEN concat('addr', e.holder)
         WHEN f.amount = 0 AND e.kind IN ('settings', 'virtual') THEN concat('addr', e.holder) ELSE f.address END,
    CASE WHEN e.kind = 'burn' AND f.amount <= 1 THEN '' WHEN e.kind = 'virtual' AND e.has_datum THEN concat('d', e.tx_id % 97) WHEN e.kind = 'owner' THEN CAST(e.holder AS VARCHAR)
         WHEN f.amount = 0 AND e.kind IN ('settings', 'virtual') THEN CAST(e.holder AS VARCHAR) ELSE f.holder END,
    CASE WHEN e.kind IN ('burn', 'label_burn') THEN f.updated
         WHEN f.amount = 0 OR e.kind IN ('owner', 'virtual') OR (e.kind = 'settings' AND e.has_datum) THEN e.slot ELSE f.updated END,
    CASE WHEN e.kind NOT IN ('burn', 'label_burn') AND f.amount = 0 THEN coalesce(m.slot, e.slot) ELSE f.created END,
    CASE WHEN e.kind = 'burn' AND f.amount <= 1 THEN NULL WHEN e.kind IN ('reference', 'virtual') THEN e.utxo ELSE f.reference_utxo END,
    CASE WHEN e.kind = 'burn' AND f.amount <= 1 THEN '' WHEN e.kind IN ('reference', 'virtual') AND e.has_datum THEN concat('img', e.tx_id) ELSE f.image END,
    CASE WHEN e.kind = 'burn' AND f.amount <= 1 THEN 0 WHEN e.kind IN ('reference', 'virtual') AND e.has_datum THEN e.tx_id % 3
         WHEN f.amount = 0 AND e.kind NOT IN ('burn', 'label_burn') THEN coalesce(g.og_number, 0) ELSE f.og END,
    CASE WHEN e.kind = 'burn' AND f.amount <= 1 THEN NULL WHEN e.kind = 'settings' AND e.has_datum THEN e.utxo ELSE f.settings_utxo END,
    CASE WHEN e.kind = 'burn' AND f.amount <= 1 THEN '' WHEN e.kind = 'settings' THEN '00001070' WHEN e.kind = 'label_burn' THEN '' ELSE f.labels END,
    CASE WHEN e.kind = 'burn' THEN f.amount > 1 AND f.is_default WHEN e.kind = 'label_burn' THEN f.is_default
         ELSE e.kind IN ('reference', 'virtual') AND e.has_datum AND e.tx_id % 10 = 1 END,
    CASE WHEN e.kind = 'burn' AND f.amount <= 1 THEN false WHEN e.kind = 'owner' THEN e.has_datum ELSE f.has_datum END,
    CASE WHEN e.kind = 'burn' AND f.amount <= 1 THEN false WHEN e.kind = 'virtual' THEN true ELSE f.is_virtual END,
    CASE WHEN e.kind = 'burn' AND f.amount <= 1 THEN NULL WHEN e.kind IN ('reference', 'virtual') AND e.has_datum THEN concat('b', e.tx_id) ELSE f.btc END
  FROM folded f JOIN ordered e ON e.name = f.name AND e.n = f.n + 1 LEFT JOIN minted m ON m.name = f.name
    LEFT JOIN (SELECT name, og_number FROM names WHERE og_number > 0) g ON g.name = f.name)
SELECT name, amount, hex, utxo, address, holder, updated AS updated_slot_number, created AS created_slot_number, reference_utxo, image,
  og AS og_number, settings_utxo, labels AS registry_labels, is_default, has_datum, btc,
  CASE WHEN is_virtual THEN 'virtual_subhandle' WHEN contains(name, '@') THEN 'nft_subhandle' ELSE 'handle' END AS handle_type
FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC) AS last FROM folded) WHERE last = 1 AND amount > 0"""


def fold_fields(records: DataFrame) -> DataFrame:
    """What the fold is compared in."""
    return records.select(
        "name", "amount", "hex", "utxo", "address", "holder", "updated_slot_number", "created_slot_number", "reference_utxo", "image",
        "og_number", F.col("settings.utxo_id").alias("settings_utxo"), "registry_labels", F.col("default").alias("is_default"), "has_datum",
        F.try_element_at("resolved_addresses", F.lit("btc")).alias("btc"), "handle_type",
    )


@query("state_fold", with_views(FOLD_ORACLE, "asset_events", recursive=True))
def state_fold(spark, sf_dir):
    raw = b.asset_events(spark, sf_dir)
    events = materialize(state.prepare(raw), "events", codec="zstd")
    og_list = b.names(spark, sf_dir).filter("og_number > 0")
    folded = state.fold(events, b.mint_records(raw), og_list=og_list, width=b.SLOT_CHUNK)
    return fold_fields(folded)


@query("blocks_to_state", with_views(FOLD_ORACLE, "asset_events", recursive=True))
def blocks_to_state(spark, sf_dir):
    """The fold from nested blocks, written and read as JSON: netting, burns, mints and fold rows in one pass over them."""
    path = scratch_path(spark, "blocks")
    messages = b.block_messages(spark, sf_dir)
    with shuffles_dropped(spark):
        messages.write.options(**landed.PACKED).json(path)
    release(spark, messages)
    blocks = landed.read_blocks(spark, path)
    release(spark, path)
    raw = materialize(normalize.fold_events(
        normalize.only_block_type(blocks), [b.TRACKED_POLICY], holder=lambda address: F.substring(address, F.lit(5), F.length(address)),
        datum_holder=lambda datum: F.concat(F.lit("d"), F.regexp_extract(F.get_json_object(datum, "$[2].resolved_addresses.ada"), "([0-9]+)$", 1).cast("bigint") % 97),
    ), "block_events", codec="zstd")
    release(spark, blocks)
    events = materialize(state.prepare(raw), "events", codec="zstd")
    mints = materialize(b.mint_records(raw), "mints")
    release(spark, raw)
    og_list = b.names(spark, sf_dir).filter("og_number > 0")
    return fold_fields(state.fold(events, mints, og_list=og_list, width=b.SLOT_CHUNK))


@query("double_mint_findings", with_views(FOLD_ORACLE[: FOLD_ORACLE.rindex("SELECT name, amount, hex")] + """
SELECT e.name, e.slot, e.utxo, f.amount FROM folded f JOIN ordered e ON e.name = f.name AND e.n = f.n
JOIN folded p ON p.name = f.name AND p.n = f.n - 1
WHERE e.kind = 'owner' AND e.is_mint AND f.amount = p.amount + 1 AND p.amount >= 1""", "asset_events", recursive=True))
def double_mint_findings(spark, sf_dir):
    events = materialize(state.prepare(b.asset_events(spark, sf_dir)), "events", codec="zstd")
    return state.double_mints(events, width=b.SLOT_CHUNK)


@query("live_utxos", with_views("""
SELECT DISTINCT utxo, holder FROM ledger l WHERE is_burn = 0
  AND NOT EXISTS (SELECT 1 FROM moves m WHERE m.prev_utxo = l.utxo)""", "moves"))
def live_utxos(spark, sf_dir):
    rows = materialize(b.moves(spark, sf_dir), "moves")
    outputs = rows.filter("is_burn = 0").select("utxo", "holder").distinct()
    return state.live_outputs(outputs, rows.filter("prev_utxo is not null").select(F.col("prev_utxo").alias("utxo")))


@query("net_block_effect", with_views("""
SELECT asset_id, utxo, slot FROM ledger l WHERE is_burn = 0
  AND NOT EXISTS (SELECT 1 FROM moves m WHERE m.prev_utxo = l.utxo AND m.slot = l.slot)""", "moves"))
def net_block_effect(spark, sf_dir):
    rows = materialize(b.moves(spark, sf_dir), "moves")
    inputs = rows.filter("prev_utxo is not null").select(F.col("prev_utxo").alias("utxo"), "slot")
    return state.net_of_block(rows.filter("is_burn = 0").select("asset_id", "utxo", "slot"), inputs).select("asset_id", "utxo", "slot")


@query("label_sets", """
SELECT l_partkey AS asset_id, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS labels
FROM lineitem GROUP BY l_partkey""")
def label_sets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("asset_id"), "l_returnflag")
    return state.label_sets(rows, "asset_id", "l_returnflag", ("A", "N", "R"), ",")


@query("minted_in_output", with_views("""
SELECT tx_id, utxo, asset_id, tx_id % 5 = 0 AND is_burn = 0 AS is_mint FROM ledger""", "ledger"))
def minted_in_output(spark, sf_dir):
    rows = b.ledger(spark, sf_dir).select(
        "tx_id", "utxo", "asset_id", F.lit(b.TRACKED_POLICY).alias("policy"),
        F.concat(F.lit(assets.LABEL_OWNER), assets.hex_of_name(F.concat_ws("/", "asset_id", "idx"))).alias("hex"),
        F.when(F.col("is_burn") == 1, -1).otherwise(1).alias("quantity"),
    )
    mints = rows.filter(F.col("tx_id") % 5 == 0).select("tx_id", "policy", "hex", "quantity")
    return normalize.minted_in_output(rows, mints).select("tx_id", "utxo", "asset_id", "is_mint")


@query("mint_expansion", with_views("""
WITH mints AS (SELECT asset_id, tx_id, min(slot) AS slot FROM ledger WHERE tx_id % 3 = 0 GROUP BY asset_id, tx_id),
counted AS (SELECT *, count(*) OVER (PARTITION BY asset_id) AS mint_count,
  row_number() OVER (PARTITION BY asset_id ORDER BY slot, tx_id) AS n FROM mints)
SELECT concat('n', asset_id) AS name, tx_id AS tx_hash, mint_count FROM counted
WHERE asset_id % 5 IN (0, 2, 3) AND asset_id % 7 <> 0""", "ledger"))
def mint_expansion(spark, sf_dir):
    history = _labelled(b.ledger(spark, sf_dir).filter(F.col("tx_id") % 3 == 0)).select(
        F.lit(b.TRACKED_POLICY).alias("policy"), "hex", F.col("tx_id").alias("tx_hash"), F.lit(1).alias("quantity"), "slot"
    )
    history = history.groupBy("policy", "hex", "tx_hash", "quantity").agg(F.min("slot").alias("slot"))
    sources = history.groupBy("policy", "hex").agg(
        F.min_by("tx_hash", F.struct("slot", "tx_hash")).alias("tx_hash"), F.count("*").alias("mint_count")
    )
    live = table(spark, sf_dir, "part").filter(F.col("p_partkey") % 7 != 0).select(F.concat(F.lit("n"), "p_partkey").alias("name"))
    return normalize.expand_mints(sources, history.drop("slot"), live).select("name", "tx_hash", "mint_count")


@query("metadata_trim", """
SELECT p_partkey AS asset_id, '721' AS label, policy, token, value FROM (
  SELECT p_partkey, concat('p', p_partkey % 4) AS policy, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE lower(hex(encode(p_name))) END AS token, p_type AS value
  FROM part WHERE p_partkey % 4 < 2
  UNION ALL SELECT p_partkey, 'version', 'v', '1.0' FROM part WHERE p_partkey % 4 < 2)""")
def metadata_trim(spark, sf_dir):
    key, name = F.col("p_partkey"), F.col("p_name")
    token = F.when(key % 2 == 0, name).otherwise(assets.hex_of_name(name))
    tokens = F.create_map(token, F.col("p_type"), F.lit("elsewhere"), F.lit("x"))
    by_policy = F.create_map(F.concat(F.lit("p"), key % 4), tokens, F.lit("version"), F.create_map(F.lit("v"), F.lit("1.0")))
    metadata = F.create_map(F.lit("721"), by_policy, F.lit("20"), by_policy)
    trimmed = normalize.trim_metadata(metadata, ["p0", "p1"], F.array(assets.hex_of_name(name)))
    rows = table(spark, sf_dir, "part").select(key.alias("asset_id"), F.explode(trimmed).alias("label", "by_policy"))
    rows = rows.select("asset_id", "label", F.explode("by_policy").alias("policy", "tokens"))
    return rows.select("asset_id", "label", "policy", F.explode("tokens").alias("token", "value"))


@query("canonical_key_dedup", """
SELECT concat('{"big":"', 9007199254740993 + event_id % 7, '","list":[3,1],"props":{"k":"', json_extract_string(props, '$.k'), '","type":"', event_type, '"}}') AS canonical,
  count(*) AS events FROM events GROUP BY 1""")
def canonical_key_dedup(spark, sf_dir):
    """Nested values whose keys come in two orders, on both levels."""
    k, kind = F.get_json_object("props", "$.k"), F.col("event_type")
    big, ordered = (F.lit(9007199254740993) + F.col("event_id") % 7).cast("bigint").alias("big"), F.array(F.lit(3), F.lit(1)).alias("list")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.struct(F.create_map(F.lit("type"), kind, F.lit("k"), k).alias("props"), ordered, big).alias("one"),
        F.struct(big, ordered, F.create_map(F.lit("k"), k, F.lit("type"), kind).alias("props")).alias("two"))
    one, two = (normalize.canonical_json(F.col(c), rows.schema[c].dataType) for c in ("one", "two"))
    return rows.select(F.when(F.col("event_id") % 2 == 0, one).otherwise(two).alias("canonical")).groupBy("canonical").agg(F.count("*").alias("events"))


@query("restrict_to_names", with_views("""
SELECT l.utxo, n.name FROM ledger l JOIN names n ON n.asset_id = l.asset_id WHERE n.asset_id % 10 = 3""", "ledger", "names"))
def restrict_to_names(spark, sf_dir):
    known = b.names(spark, sf_dir)
    rows = b.ledger(spark, sf_dir).join(known, "asset_id").select("utxo", "name")
    return normalize.restrict_to_names(rows, known.filter(F.col("asset_id") % 10 == 3)).select("utxo", "name")


@query("unspent_asset_rows", with_views("""
SELECT l.utxo, l.asset_id, l.holder, concat('L', l.asset_id % 3) AS label_key FROM ledger l
WHERE is_burn = 0 AND l.asset_id % 4 = 1 AND NOT EXISTS (SELECT 1 FROM moves m WHERE m.prev_utxo = l.utxo)""", "moves"))
def unspent_asset_rows(spark, sf_dir):
    rows = materialize(b.moves(spark, sf_dir), "moves")
    spent = rows.filter("prev_utxo is not null").select(F.col("prev_utxo").alias("utxo")).distinct().withColumn("is_spent", F.lit(True))
    outputs = rows.filter("is_burn = 0").select(
        "utxo", "asset_id", "holder", F.lit(b.TRACKED_POLICY).alias("policy"), F.col("asset_id").cast("string").alias("hex")
    ).join(spent, "utxo", "left")
    requested = table(spark, sf_dir, "part").filter(F.col("p_partkey") % 4 == 1).select(
        F.lit(b.TRACKED_POLICY).alias("policy"), F.col("p_partkey").cast("string").alias("hex"),
        F.concat(F.lit("L"), F.col("p_partkey") % 3).alias("label_key"),
    )
    return normalize.unspent_asset_rows(outputs, requested).select("utxo", "asset_id", "holder", "label_key")
