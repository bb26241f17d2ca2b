"""Reconciliation, repair and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namefold.functions import attributes
from namefold.operators import chain, constraints, fingerprint, reconcile, repair, state
from namefold.plans import bindings as b
from namefold.plans.bindings import table, with_views
from namefold.plans.ledger_queries import FOLD_ORACLE, fold_fields
from namefold.plans.registry import query
from namefold.scratch import materialize, release


@query("set_diff_two_way", with_views("""
SELECT name, 'left_only' AS side FROM names WHERE asset_id % 11 = 0
UNION ALL SELECT name || '!', 'right_only' FROM names WHERE asset_id % 17 = 0 AND asset_id % 11 <> 0""", "names"))
def set_diff_two_way(spark, sf_dir):
    rows = b.names(spark, sf_dir)
    other = rows.filter(F.col("asset_id") % 11 != 0)
    extra = other.filter(F.col("asset_id") % 17 == 0).select(F.concat("name", F.lit("!")).alias("name"))
    return reconcile.set_difference(rows.select("name"), other.select("name").unionByName(extra), ["name"])


@query("set_diff_counts", with_views("""
SELECT 'left_only' AS side, count(*) AS keys FROM names WHERE asset_id % 11 = 0""", "names"))
def set_diff_counts(spark, sf_dir):
    rows = b.names(spark, sf_dir)
    return reconcile.difference_counts(reconcile.set_difference(rows, rows.filter(F.col("asset_id") % 11 != 0), ["name"]))


@query("attribute_diff", with_views("""
SELECT name, 'missing_right' AS finding, CAST(NULL AS VARCHAR) AS left_value, CAST(NULL AS VARCHAR) AS right_value FROM current_names WHERE asset_id % 13 = 0
UNION ALL SELECT concat('new', name), 'missing_left', NULL, NULL FROM current_names WHERE asset_id % 13 <> 0 AND asset_id % 19 = 0
UNION ALL SELECT name, 'updated_after', CAST(updated_slot AS VARCHAR), CAST(updated_slot + 1 AS VARCHAR) FROM current_names WHERE asset_id % 13 <> 0 AND asset_id % 19 <> 0 AND asset_id % 5 = 0
UNION ALL SELECT name, 'utxo', utxo, concat(utxo, 'x') FROM current_names WHERE asset_id % 13 <> 0 AND asset_id % 19 <> 0 AND asset_id % 5 <> 0 AND asset_id % 3 = 0
UNION ALL SELECT name, 'holder', CAST(holder AS VARCHAR), NULL FROM current_names WHERE asset_id % 13 <> 0 AND asset_id % 19 <> 0 AND asset_id % 5 <> 0 AND asset_id % 4 = 0
UNION ALL SELECT name, 'missing_right', NULL, NULL FROM current_names WHERE asset_id % 13 <> 0 AND asset_id % 19 = 0""", "current_names"))
def attribute_diff(spark, sf_dir):
    rows = b.current_names(spark, sf_dir)
    key = F.col("asset_id")
    other = rows.filter(key % 13 != 0).select(
        F.when(key % 19 == 0, F.concat(F.lit("new"), "name")).otherwise(F.col("name")).alias("name"),
        F.when(key % 5 == 0, F.col("updated_slot") + 1).otherwise(F.col("updated_slot")).alias("updated_slot"),
        F.when(key % 3 == 0, F.concat("utxo", F.lit("x"))).otherwise(F.col("utxo")).alias("utxo"),
        F.when(key % 4 == 0, F.lit(None)).otherwise(F.col("holder")).alias("holder"),
    )
    return reconcile.attribute_diff(rows, other, "name", "updated_slot", ["utxo", "holder"])


def _asset_rows(spark, sf_dir) -> DataFrame:
    """Canonical holdings: live outputs of each asset, some doubled, some elsewhere."""
    rows = b.current_names(spark, sf_dir)
    key = F.col("asset_id")
    base = rows.filter(key % 7 != 0).select(
        F.lit(b.TRACKED_POLICY).alias("policy"), F.col("name").alias("hex"),
        F.when(key % 5 == 0, F.concat("utxo", F.lit("9"))).otherwise(F.col("utxo")).alias("utxo"), F.lit(1).alias("quantity"))
    second = rows.filter(key % 6 == 0).select(
        F.lit(b.TRACKED_POLICY).alias("policy"), F.col("name").alias("hex"), F.lit("second#0").alias("utxo"),
        F.when(key % 4 == 0, 0).otherwise(1).alias("quantity"))
    return base.unionByName(base).unionByName(second)


@query("ownership_audit", with_views("""
SELECT name, 'p0' AS policy, name AS hex, utxo, outputs, CASE WHEN outputs = 1 THEN canonical END AS canonical,
  CASE WHEN outputs = 1 AND canonical = utxo THEN 'ok' WHEN outputs = 1 THEN 'mismatch' ELSE 'unresolved' END AS status
FROM (SELECT name, utxo, CAST((asset_id % 7 <> 0) AS INTEGER) + CAST((asset_id % 6 = 0 AND asset_id % 4 <> 0) AS INTEGER) AS outputs,
    CASE WHEN asset_id % 7 = 0 THEN 'second#0' WHEN asset_id % 5 = 0 THEN concat(utxo, '9') ELSE utxo END AS canonical FROM current_names)""", "current_names"))
def ownership_audit(spark, sf_dir):
    stored = b.current_names(spark, sf_dir).select("name", F.lit(b.TRACKED_POLICY).alias("policy"), F.col("name").alias("hex"), "utxo")
    return reconcile.ownership_audit(stored, _asset_rows(spark, sf_dir))


def _canonical(spark, sf_dir) -> DataFrame:
    """The other side's chain: some blocks carry another hash."""
    swapped = F.when(F.col("height") % 23 == 0, F.concat(F.lit("x"), "hash")).otherwise(F.col("hash"))
    return b.blocks(spark, sf_dir).withColumn("hash", swapped)


def _stored_outputs(spark, sf_dir) -> DataFrame:
    return b.ledger(spark, sf_dir).join(b.blocks(spark, sf_dir).select("slot", F.col("hash").alias("block_hash"), "height"), "slot")


@query("orphans", with_views("""
SELECT DISTINCT n.name FROM ledger l JOIN blocks k ON k.slot = l.slot JOIN names n ON n.asset_id = l.asset_id
WHERE k.height % 23 = 0 AND l.slot >= 300""", "ledger", "blocks", "names"))
def orphans(spark, sf_dir):
    found = reconcile.orphans(_stored_outputs(spark, sf_dir), _canonical(spark, sf_dir), from_slot=300)
    return found.join(b.names(spark, sf_dir), "asset_id").select("name").distinct()


@query("missed_blocks", with_views("""
SELECT k.height, k.slot, count(DISTINCT l.asset_id) AS names FROM blocks k LEFT JOIN ledger l ON l.slot = k.slot
WHERE k.slot <= 2000 AND (k.height % 17 = 0) GROUP BY k.height, k.slot""", "ledger", "blocks"))
def missed_blocks(spark, sf_dir):
    canonical = b.blocks(spark, sf_dir)
    cursor_hash = _hash_of_day("1995-01-01")
    unseen = reconcile.missed_blocks(canonical, b.scanned(spark, sf_dir), (2000, cursor_hash))
    touched = b.ledger(spark, sf_dir).groupBy("slot").agg(F.count_distinct("asset_id").alias("names"))
    return unseen.join(touched, "slot", "left").select("height", "slot", F.coalesce("names", F.lit(0)).alias("names"))


def _hash_of_day(day: str) -> str:
    import hashlib

    return hashlib.md5(day.encode()).hexdigest()


@query("drift", with_views("""
SELECT name, CAST(split_part(utxo, '#', 1) AS VARCHAR) AS tx_id, CAST(CAST(split_part(utxo, '#', 1) AS BIGINT) + 1 AS VARCHAR) AS canonical_tx
FROM current_names WHERE asset_id % 9 = 0""", "current_names"))
def drift(spark, sf_dir):
    rows = b.current_names(spark, sf_dir).select("name", F.split_part("utxo", F.lit("#"), F.lit(1)).alias("tx_id"), "asset_id")
    moved = F.when(F.col("asset_id") % 9 == 0, (F.col("tx_id").cast("bigint") + 1).cast("string")).otherwise(F.col("tx_id"))
    canonical = rows.filter(F.col("asset_id") % 8 != 1).select("name", moved.alias("tx_id"))
    return reconcile.drift(rows.drop("asset_id"), canonical.unionByName(
        rows.filter((F.col("asset_id") % 8 == 1) & (F.col("asset_id") % 9 == 0)).select("name", moved.alias("tx_id"))))


@query("repair_apply", with_views("""
SELECT asset_id, name, holder, utxo, updated_slot FROM current_names""", "current_names"))
def repair_apply(spark, sf_dir):
    """Stored state misses the last event of affected names; the repair refolds them only."""
    events = b.ledger(spark, sf_dir)
    truth = b.current_names(spark, sf_dir).select("asset_id", "name", "holder", "utxo", "updated_slot")
    bad = F.col("asset_id") % 10 == 4
    stored = truth.withColumn("utxo", F.when(bad, "stale#0").otherwise(F.col("utxo")))
    affected = b.names(spark, sf_dir).filter(bad).select("asset_id")
    refolded = state.current_owner(
        events.join(affected, "asset_id", "left_semi"), ["asset_id"], ["slot", "tx_id", "idx"], F.col("is_burn") == 1, ["holder", "utxo", "slot"])
    fresh = refolded.join(b.names(spark, sf_dir), "asset_id").select("asset_id", "name", "holder", "utxo", F.col("slot").alias("updated_slot"))
    return stored.join(affected, "asset_id", "left_anti").unionByName(fresh)


@query("repair_outputs", with_views("""
SELECT utxo, asset_id FROM ledger WHERE is_burn = 0""", "ledger"))
def repair_outputs(spark, sf_dir):
    """Orphaned outputs of a bad slot range are replaced by the canonical rows of their names."""
    rows = b.ledger(spark, sf_dir).filter("is_burn = 0").select(
        "utxo", "asset_id", F.lit(b.TRACKED_POLICY).alias("policy"), F.concat(F.lit("n"), "asset_id").alias("hex"),
        F.concat(F.lit("n"), "asset_id").alias("name"), "slot")
    bad = F.col("slot") % 97 == 5
    stored = rows.withColumn("utxo", F.when(bad, F.concat(F.lit("orphan"), "utxo")).otherwise(F.col("utxo")))
    stale = stored.filter(F.col("utxo").startswith("orphan"))
    return repair.repair_outputs(stored, stale, rows.filter(bad), stale).select("utxo", "asset_id")


@query("repair_records", with_views("""
WITH kept AS (SELECT * FROM asset_events WHERE kind IN ('owner', 'burn'))
SELECT k.name, CAST(1 AS BIGINT) AS amount, n.asset_id % 10 = 7 AS stale FROM (
  SELECT name, kind, row_number() OVER (PARTITION BY name ORDER BY slot DESC, rank DESC, tx_id DESC, idx DESC, hex DESC) AS rn FROM kept) k
JOIN names n ON n.name = k.name WHERE rn = 1 AND kind = 'owner'""", "asset_events"))
def repair_records(spark, sf_dir):
    """Affected names are refolded without counting their mints twice; the others stay."""
    events = state.prepare(b.asset_events(spark, sf_dir).filter(F.col("kind").isin("owner", "burn")))
    events = materialize(events, "events", codec="zstd")
    mints = b.mint_records(events)
    folded = materialize(state.fold(events, mints, count_double_mints=False, width=b.SLOT_CHUNK), "records")
    affected = b.names(spark, sf_dir).filter(F.col("asset_id") % 10 == 2).select("name")
    stored = folded.withColumn("utxo", F.when(F.col("name").startswith("-"), "stale#0").otherwise(F.col("utxo")))
    return repair.repair_records(stored, events, mints, affected, width=b.SLOT_CHUNK).select(
        "name", "amount", (F.col("utxo") == "stale#0").alias("stale"))


# The state machine without its step for a second mint.
_NO_DOUBLE_MINTS = FOLD_ORACLE.replace("""
         WHEN e.kind = 'owner' AND e.is_mint AND f.utxo <> '' AND f.utxo <> e.utxo AND f.hex = e.owner_hex THEN f.amount + 1 ELSE f.amount END,""", " ELSE f.amount END,")
_SINGLE, _LIVE = _NO_DOUBLE_MINTS.split("\nSELECT name, amount, hex", 1)


@query("repair_records_whole", with_views(f"""{_SINGLE}, live AS (SELECT name, amount, hex{_LIVE})
SELECT l.* REPLACE (CASE WHEN n.asset_id % 10 = 7 THEN 'stale#0' ELSE l.utxo END AS utxo, CASE WHEN n.asset_id % 10 = 7 THEN 'stale' ELSE l.holder END AS holder,
  CASE WHEN n.asset_id % 10 = 7 THEN 'stale' ELSE l.image END AS image, CASE WHEN n.asset_id % 10 = 7 THEN NULL ELSE l.settings_utxo END AS settings_utxo,
  CASE WHEN n.asset_id % 10 = 7 THEN 0 ELSE l.og_number END AS og_number, CASE WHEN n.asset_id % 10 = 7 THEN NOT l.is_default ELSE l.is_default END AS is_default)
FROM live l JOIN names n ON n.name = l.name""", "asset_events", recursive=True))
def repair_records_whole(spark, sf_dir):
    """Events of all kinds. Stored records of affected names are damaged, lost or ended long ago; those of other names stay as damaged as they are."""
    raw = b.asset_events(spark, sf_dir)
    events = materialize(state.prepare(raw), "events", codec="zstd")
    mints = materialize(b.mint_records(raw), "mints")
    release(spark, raw)
    names = materialize(b.names(spark, sf_dir), "names")
    og_list = names.filter("og_number > 0").select("name", "og_number")
    folded = materialize(state.fold(events, mints, og_list=og_list, count_double_mints=False, width=b.SLOT_CHUNK), "records")
    key = F.col("asset_id")
    affected = names.filter(key % 2 == 0).select("name")
    bad = (key % 10).isin(2, 4, 7)
    fields = folded.columns
    damaged = folded.join(names.select("name", "asset_id"), "name").filter(key % 10 != 6)
    for field, value in (("utxo", F.lit("stale#0")), ("holder", F.lit("stale")), ("image", F.lit("stale")), ("og_number", F.lit(0).cast("bigint")), ("default", ~F.col("default")), ("settings", F.lit(None))):
        damaged = damaged.withColumn(field, F.when(bad, value).otherwise(F.col(field)))
    ended = affected.join(folded, "name", "left_anti").withColumn("utxo", F.lit("stale#0"))
    stored = damaged.select(*fields).unionByName(ended, allowMissingColumns=True)
    return fold_fields(repair.repair_records(stored, events, mints, affected, og_list=og_list, width=b.SLOT_CHUNK))


_MINTS_AT = "mints AS (SELECT DISTINCT concat('n', asset_id) AS name, slot AS created_slot, tx_id FROM ledger WHERE tx_id % 5 = 0)"


@query("mint_rollback", with_views(f"""
WITH {_MINTS_AT} SELECT name, created_slot, tx_id FROM mints
WHERE NOT (created_slot >= 1500 AND name IN (SELECT concat('n', p_partkey) FROM part WHERE p_partkey % 3 = 0))""", "ledger"))
def mint_rollback(spark, sf_dir):
    ledger = b.ledger(spark, sf_dir)
    mints = ledger.filter(F.col("tx_id") % 5 == 0).select(
        F.concat(F.lit("n"), "asset_id").alias("name"), F.col("slot").alias("created_slot"), "tx_id").distinct()
    affected = table(spark, sf_dir, "part").filter(F.col("p_partkey") % 3 == 0).select(F.concat(F.lit("n"), "p_partkey").alias("name"))
    orphaned = b.blocks(spark, sf_dir).filter(F.col("slot") >= 1500).select(F.lit(1500).alias("slot"))
    return repair.rollback_mints(mints, affected, orphaned)


_COVERAGE_SQL = """WITH covered AS (
  SELECT height, slot, hash, tx_count, discovered, received,
    CASE WHEN tx_count IS NULL OR tx_count < 0 THEN 'bad_count' WHEN discovered <> tx_count THEN 'discovery_incomplete'
         WHEN received <> discovered THEN 'payload_incomplete' ELSE 'complete' END AS status
  FROM (SELECT k.height, k.slot, k.hash, CASE WHEN k.height % 400 = 399 THEN NULL WHEN k.height % 300 = 299 THEN -1 ELSE k.tx_count END AS tx_count,
      coalesce(t.discovered, 0) AS discovered, coalesce(t.received, 0) AS received
    FROM blocks k LEFT JOIN (
      SELECT date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS slot, count(*) AS discovered, count(*) FILTER (WHERE o_orderkey % 601 <> 0) AS received
      FROM orders WHERE o_orderkey % 701 <> 0 GROUP BY 1) t ON t.slot = k.slot))
"""


def _covered(spark, sf_dir) -> DataFrame:
    height = F.col("height")
    blocks = b.blocks(spark, sf_dir)
    claimed = F.when(height % 400 == 399, F.lit(None)).when(height % 300 == 299, -1).otherwise(F.col("tx_count"))
    txs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx_id"), b.slot_of("o_orderdate").alias("slot")).join(
        blocks.select("slot", "hash"), "slot")
    discovered = txs.filter(F.col("tx_id") % 701 != 0)
    return chain.coverage(blocks.withColumn("tx_count", claimed), discovered, discovered.filter(F.col("tx_id") % 601 != 0))


@query("block_coverage", with_views(_COVERAGE_SQL + "SELECT height, hash, discovered, received, status FROM covered WHERE status <> 'complete'", "blocks"))
def block_coverage(spark, sf_dir):
    return _covered(spark, sf_dir).filter("status <> 'complete'").select("height", "hash", "discovered", "received", "status")


@query("coverage_cursor", with_views(_COVERAGE_SQL + """
SELECT height, slot, hash FROM covered WHERE height < (SELECT min(height) FROM covered WHERE status <> 'complete') ORDER BY height DESC LIMIT 1""", "blocks"))
def coverage_cursor(spark, sf_dir):
    return chain.cursor_after(_covered(spark, sf_dir))


@query("height_gaps", with_views("""
SELECT height AS after_height, height + 1 AS missing_height FROM (
  SELECT height, lead(height) OVER (ORDER BY height) AS following FROM scanned) WHERE following > height + 1""", "scanned"))
def height_gaps(spark, sf_dir):
    return chain.height_gaps(b.scanned(spark, sf_dir))


@query("keep_latest_n", with_views("SELECT slot, hash FROM scanned ORDER BY slot DESC, hash DESC LIMIT 300", "scanned"))
def keep_latest_n(spark, sf_dir):
    return chain.keep_latest(b.scanned(spark, sf_dir), 300).select("slot", "hash")


@query("ledger_range", with_views("SELECT slot, hash FROM scanned WHERE slot BETWEEN 100 AND 900", "scanned"))
def ledger_range(spark, sf_dir):
    return chain.ledger_range(b.scanned(spark, sf_dir), 100, 900).select("slot", "hash")


@query("payload_parity", """
SELECT o_orderkey AS tx_id, CASE WHEN o_orderkey % 211 = 0 THEN 'omitted_right' WHEN o_orderkey % 223 = 0 THEN 'order' ELSE 'payload' END AS finding
FROM orders WHERE o_orderkey % 211 = 0 OR o_orderkey % 223 = 0 OR (o_orderkey % 7 = 0 AND o_orderkey % 5 = 0)""")
def payload_parity(spark, sf_dir):
    key = F.col("o_orderkey")
    asset = lambda name, qty: F.struct(F.lit("p").alias("policy_id"), F.lit(name).alias("asset_name"), qty.alias("quantity"))
    cents = (F.col("o_totalprice") * 100).cast("bigint")
    rows = table(spark, sf_dir, "orders").select(
        key.alias("tx_id"), key.alias("position"), F.col("o_custkey").alias("address"), cents.alias("value"),
        F.array(asset("a", F.lit(1)), asset("b", F.lit(2))).alias("assets"))
    # The second feed orders assets differently, leaves some out, moves some, edits some.
    other = rows.filter(F.col("tx_id") % 211 != 0).select(
        "tx_id", F.when(F.col("tx_id") % 223 == 0, -1).otherwise(F.col("position")).alias("position"), "address",
        F.when((F.col("tx_id") % 7 == 0) & (F.col("tx_id") % 5 == 0), F.col("value") + 1).otherwise(F.col("value")).alias("value"),
        F.reverse("assets").alias("assets"))
    tidy = lambda df: df.withColumn("assets", reconcile.sorted_assets(F.col("assets")))
    return reconcile.payload_differences(tidy(rows), tidy(other), "tx_id", "position", ["address", "value", "assets"])


@query("type_transition_counts", """
SELECT CASE WHEN p_partkey % 3 = 0 THEN 'plutusV1' WHEN p_partkey % 3 = 1 THEN 'plutusV2' ELSE '(empty)' END AS from_type,
  CASE WHEN p_partkey % 2 = 0 THEN 'PlutusScriptV2' ELSE 'PlutusScriptV3' END AS to_type, count(*) AS rows
FROM part WHERE p_partkey % 13 <> 0 AND NOT (p_partkey % 3 <> 0 AND p_partkey % 2 = 0) GROUP BY 1, 2""")
def type_transition_counts(spark, sf_dir):
    key = F.col("p_partkey")
    stored = table(spark, sf_dir, "part").select(
        key.cast("string").alias("utxo"), F.when(key % 3 == 0, "plutusV1").when(key % 3 == 1, "plutusV2").otherwise("").alias("type"))
    canonical = table(spark, sf_dir, "part").select(
        key.cast("string").alias("utxo"), F.when(key % 13 != 0, F.when(key % 2 == 0, "PlutusScriptV2").otherwise("PlutusScriptV3")).alias("type"))
    return reconcile.transition_counts(reconcile.type_mismatches(stored, canonical, attributes.language_tag))


@query("duplicates_check", """
SELECT p_name AS name, count(*) AS copies FROM part GROUP BY p_name HAVING count(*) > 1""")
def duplicates_check(spark, sf_dir):
    return reconcile.repeated(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))


@query("unresolved_by_label", """
SELECT l_returnflag AS label, count(*) AS items FROM lineitem WHERE NOT EXISTS (
  SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'F') GROUP BY l_returnflag""")
def unresolved_by_label(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tx_id"), F.col("l_returnflag").alias("label"))
    resolved = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("tx_id"))
    return reconcile.unresolved_by_label(wanted, resolved, ["tx_id"])


@query("bulk_repoint", with_views("""
SELECT name, from_utxo, to_utxo, CASE WHEN name = '' OR NOT coalesce(regexp_full_match(to_utxo, '[0-9a-f]+#[0-9]+'), false) THEN 'invalid'
    WHEN NOT live OR from_utxo IS NULL THEN 'missing' WHEN from_utxo = to_utxo THEN 'unchanged' ELSE 'updated' END AS status
FROM (SELECT CASE WHEN asset_id % 37 = 0 THEN '' ELSE name END AS name, CASE WHEN asset_id % 37 <> 0 AND asset_id % 5 <> 0 THEN utxo END AS from_utxo,
    CASE WHEN asset_id % 7 = 0 THEN 'nonsense' WHEN asset_id % 3 = 0 THEN utxo WHEN asset_id % 3 = 1 THEN other ELSE 'ffff#1' END AS to_utxo,
    asset_id % 3 <> 2 AND asset_id % 7 <> 0 AS live
  FROM (SELECT *, (SELECT min(utxo) FROM ledger) AS other FROM current_names))""", "current_names"))
def bulk_repoint(spark, sf_dir):
    rows = b.current_names(spark, sf_dir)
    key = F.col("asset_id")
    outputs = b.ledger(spark, sf_dir).select("utxo")
    other = outputs.agg(F.min("utxo")).scalar()
    updates = rows.select(
        F.when(key % 37 == 0, "").otherwise(F.col("name")).alias("name"),
        F.when(key % 7 == 0, "nonsense").when(key % 3 == 0, F.col("utxo")).when(key % 3 == 1, other).otherwise("ffff#1").alias("utxo"))
    records = rows.filter(key % 5 != 0).select("name", F.col("utxo").alias("settings_utxo"))
    return repair.repoint(records, updates, outputs)


@query("bulk_retype", """
SELECT p_name || p_partkey AS name, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS from_type,
  CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN p_type ELSE 'plutusV3' END AS new_type,
  CASE WHEN p_partkey % 11 = 0 THEN 'invalid' WHEN p_partkey % 4 = 0 THEN 'missing' WHEN p_partkey % 9 = 0 THEN 'invalid'
       WHEN p_partkey % 2 = 0 THEN 'unchanged' ELSE 'updated' END AS status FROM part""")
def bulk_retype(spark, sf_dir):
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part").withColumn("name", F.concat("p_name", "p_partkey"))
    updates = part.select("name", F.when(key % 11 == 0, "").when(key % 2 == 0, F.col("p_type")).otherwise("plutusV3").alias("new_type"))
    records = part.filter(key % 4 != 0).select("name", F.col("p_type").alias("type"), F.when(key % 9 == 0, "").otherwise("4e").alias("cbor"))
    return repair.retype(records, updates)


@query("state_trim", with_views("""
SELECT name FROM current_names WHERE asset_id % 3 = 2 AND created_slot < 1900 AND updated_slot < 2350""", "current_names"))
def state_trim(spark, sf_dir):
    rows = b.current_names(spark, sf_dir).select(
        "name", b.token_hex(F.col("name"), F.when(F.col("asset_id") % 3 == 2, 2).otherwise(0)).alias("hex"),
        (F.col("created_slot") + 450).alias("created_slot_number"), F.col("updated_slot").alias("updated_slot_number"))
    return repair.trim_state(rows, 2350).select("name")


_TARGETS = "plan AS (SELECT * FROM current_names WHERE asset_id % 5 = 1)"


@query("repair_precheck", with_views(f"""
WITH {_TARGETS}, pointed AS (SELECT * FROM plan WHERE asset_id % 3 <> 0), missing AS (SELECT DISTINCT utxo FROM current_names WHERE asset_id % 7 = 0),
held AS (SELECT utxo, name FROM current_names WHERE utxo NOT IN (SELECT utxo FROM missing) AND asset_id % 11 <> 0)
SELECT 'empty_plan' AS rule, 0 AS violations
UNION ALL SELECT 'repeated_target', (SELECT count(*) FROM plan WHERE asset_id % 4 = 0)
UNION ALL SELECT 'stored_identity', (SELECT count(*) FROM plan WHERE asset_id % 3 = 0)
UNION ALL SELECT 'source_missing', (SELECT count(*) FROM pointed WHERE utxo NOT IN (SELECT utxo FROM held))
UNION ALL SELECT 'target_not_in_source', (SELECT count(*) FROM pointed p WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.utxo = p.utxo AND h.name = p.name))
UNION ALL SELECT 'source_unplanned', (SELECT count(*) FROM held WHERE utxo IN (SELECT utxo FROM pointed) AND name NOT IN (SELECT name FROM plan))
UNION ALL SELECT 'canonical_missing', (SELECT count(*) FROM plan WHERE asset_id % 13 = 0)
UNION ALL SELECT 'canonical_repeated', (SELECT count(*) FROM plan WHERE asset_id % 13 <> 0 AND asset_id % 17 = 0)
UNION ALL SELECT 'canonical_unplanned', 0
UNION ALL SELECT 'reads_differ', (SELECT count(*) FROM plan WHERE asset_id % 13 <> 0 AND asset_id % 17 = 0)""", "current_names"))
def repair_precheck(spark, sf_dir):
    key = F.col("asset_id")
    rows = materialize(b.current_names(spark, sf_dir).withColumn("policy", F.lit(b.TRACKED_POLICY)).withColumn("hex", F.col("name")), "rows")
    plan = rows.filter(key % 5 == 1)
    targets = plan.unionByName(plan.filter(key % 4 == 0)).select("name", "policy", "hex")
    records = rows.filter(key % 3 != 0).select("name", "policy", "hex", "utxo")
    missing = rows.filter(key % 7 == 0).select("utxo").distinct()
    stored = rows.filter(key % 11 != 0).join(missing, "utxo", "left_anti").select("utxo", "policy", "hex")
    first = plan.filter(key % 13 != 0).select("utxo", "policy", "hex")
    second = first.unionByName(plan.filter((key % 13 != 0) & (key % 17 == 0)).select(F.lit("elsewhere#0").alias("utxo"), "policy", "hex"))
    return repair.precheck(targets, records, stored, first, second)


@query("asof_owner", with_views("""
SELECT asset_id, holder, utxo, moved_after FROM (
  SELECT l.asset_id, l.holder, l.utxo, row_number() OVER (PARTITION BY l.asset_id ORDER BY l.slot DESC, l.tx_id DESC, l.idx DESC) AS rn,
    EXISTS (SELECT 1 FROM ledger x WHERE x.asset_id = l.asset_id AND x.slot > 1200 AND (x.is_burn = 1 OR x.tx_id % 50 = 0)) AS moved_after
  FROM ledger l WHERE l.slot <= 1200) WHERE rn = 1""", "ledger"))
def asof_owner(spark, sf_dir):
    events = b.ledger(spark, sf_dir)
    minted_or_burned = (F.col("is_burn") == 1) | (F.col("tx_id") % 50 == 0)
    return repair.asof_owner(events, 1200, ["asset_id"], ["slot", "tx_id", "idx"], ["holder", "utxo"], minted_or_burned)


@query("asof_by_inputs", with_views("""
WITH last AS (SELECT asset_id AS token, max(CASE WHEN slot > 1200 AND (is_burn = 1 OR tx_id % 50 = 0) THEN 1 ELSE 0 END) AS changed,
    arg_max(concat(utxo, '/', asset_id), (slot, tx_id, idx)) FILTER (WHERE slot <= 1200) AS held FROM ledger GROUP BY asset_id)
SELECT token, CASE WHEN changed = 0 THEN held END AS utxo,
  CASE WHEN changed = 1 THEN 'supply_changed' WHEN held IS NULL THEN 'no_unique_output' ELSE 'ok' END AS status FROM last""", "ledger"))
def asof_by_inputs(spark, sf_dir):
    own = lambda utxo: F.concat(utxo, F.lit("/"), F.col("asset_id"))  # noqa: E731 - one output per token
    rows = materialize(b.moves(spark, sf_dir), "moves")
    holdings = rows.select(F.col("asset_id").alias("token"), own("utxo").alias("utxo"), "slot")
    newest = rows.groupBy("asset_id").agg(F.max_by(F.struct("utxo", "slot"), F.struct("slot", "tx_id", "idx")).alias("e"))
    current = newest.select(F.col("asset_id").alias("token"), own(F.col("e.utxo")).alias("utxo"), "e.slot")
    inputs = rows.filter("prev_utxo is not null").select(own("prev_utxo").alias("utxo"), "slot")
    supply = rows.filter("is_burn = 1 or tx_id % 50 = 0").select(F.col("asset_id").alias("token"), "slot")
    return repair.asof_by_inputs(current, holdings, inputs, supply, 1200)


@query("output_tx_agreement", with_views("""
SELECT utxo, CASE WHEN tx_id % 101 = 0 THEN 'missing_output' WHEN tx_id % 103 = 0 THEN 'duplicated_output'
    WHEN tx_id % 107 = 0 THEN 'address_or_value' ELSE 'assets' END AS finding
FROM (SELECT DISTINCT utxo, tx_id FROM ledger) WHERE tx_id % 101 = 0 OR tx_id % 103 = 0 OR tx_id % 107 = 0 OR tx_id % 109 = 0""", "ledger"))
def output_tx_agreement(spark, sf_dir):
    tx = F.col("tx_id")
    rows = b.ledger(spark, sf_dir).select(
        "utxo", "tx_id", F.col("holder").cast("string").alias("address"), F.lit(5).cast("bigint").alias("value"), F.lit(b.TRACKED_POLICY).alias("policy"),
        F.col("asset_id").cast("string").alias("hex"), F.lit(1).alias("quantity"))
    seen = rows.filter(tx % 101 != 0).withColumn("value", F.when(tx % 107 == 0, 6).otherwise(F.col("value")).cast("bigint")).withColumn(
        "quantity", F.when((tx % 109 == 0) & (tx % 103 != 0) & (tx % 107 != 0), 2).otherwise(F.col("quantity")))
    twice = seen.filter(tx % 103 == 0).withColumn("address", F.lit("other"))
    return reconcile.output_disagreements(rows, seen.unionByName(twice))


def _forked(spark, sf_dir) -> DataFrame:
    """The chain and a second branch that leaves it 12 blocks below the top."""
    rows = materialize(b.blocks(spark, sf_dir), "blocks")
    top = rows.agg(F.max("height")).scalar()
    branch = rows.filter(F.col("height") > top - 12).select(
        "height", "slot", F.concat(F.lit("f"), "hash").alias("hash"),
        F.when(F.col("height") == top - 11, F.col("parent")).otherwise(F.concat(F.lit("f"), "parent")).alias("parent"), "tx_count")
    return rows.unionByName(branch)


_FORKED = """forked AS (SELECT height, slot, hash, parent FROM blocks UNION ALL
  SELECT height, slot, concat('f', hash), CASE WHEN height = (SELECT max(height) FROM blocks) - 11 THEN parent ELSE concat('f', parent) END
  FROM blocks WHERE height > (SELECT max(height) FROM blocks) - 12)"""
_WALK = """{name} AS (SELECT hash, slot, parent, 0 AS depth FROM forked WHERE hash = {tip}
  UNION ALL SELECT n.hash, n.slot, n.parent, w.depth + 1 FROM {name} w JOIN forked n ON n.hash = w.parent AND n.slot < w.slot WHERE w.depth < 64)"""
_TOP_HASH = "(SELECT hash FROM blocks ORDER BY height DESC LIMIT 1)"


def _top_hash(rows: DataFrame) -> str:
    """Tips are arguments of the operator; the chain has one highest block."""
    return rows.agg(F.max_by("hash", F.struct("height", "hash"))).first()[0]


@query("common_ancestor", with_views(f"""
WITH {_FORKED}, {_WALK.format(name='old_walk', tip=_TOP_HASH)}, {_WALK.format(name='new_walk', tip="concat('f', " + _TOP_HASH + ")")}
SELECT n.hash, n.slot, o.depth AS old_depth, n.depth AS new_depth FROM new_walk n JOIN old_walk o ON o.hash = n.hash ORDER BY n.depth LIMIT 1""", "blocks", recursive=True))
def common_ancestor(spark, sf_dir):
    rows = materialize(_forked(spark, sf_dir), "forked")
    tip = _top_hash(rows.filter(F.length("hash") == 32))
    return chain.common_ancestor(rows, tip, "f" + tip)


@query("descends_from", with_views(f"""
WITH {_FORKED}, {_WALK.format(name='walk', tip=_TOP_HASH)}
SELECT bool_or(hash = (SELECT hash FROM blocks WHERE height = (SELECT max(height) FROM blocks) - 40)) AS descends, max(depth) AS walked, 'inside' AS point FROM walk
UNION ALL SELECT false, max(depth), 'beyond' FROM walk""", "blocks", recursive=True))
def descends_from(spark, sf_dir):
    rows = materialize(_forked(spark, sf_dir), "forked")
    main = rows.filter(F.length("hash") == 32)
    tip = _top_hash(main)
    top = main.agg(F.max("height")).first()[0]
    points = {r["height"]: r for r in main.filter(F.col("height").isin(top - 40, top - 70)).collect()}
    walk = materialize(chain.ancestors(rows, tip), "walk")
    result = None
    for point, height in (("inside", top - 40), ("beyond", top - 70)):
        part = chain.descends_from(walk, points[height]["hash"], points[height]["slot"]).withColumn("point", F.lit(point))
        result = part if result is None else result.unionByName(part)
    return result


@query("set_fingerprint", with_views("""
WITH e AS (SELECT name, substr(md5(name), 1, 2) AS bucket, asset_id FROM names)
SELECT bucket, count(*) AS stored_entries, nullif(count(*) FILTER (WHERE asset_id % 41 <> 0), 0) AS external_entries,
  CASE WHEN count(*) FILTER (WHERE asset_id % 41 <> 0) > 0 THEN count(*) FILTER (WHERE asset_id % 41 = 0 OR asset_id % 43 = 0) = 0 END AS agrees
FROM e GROUP BY bucket""", "names"))
def set_fingerprint(spark, sf_dir):
    key = F.col("asset_id")
    rows = b.names(spark, sf_dir).select("name", F.lit("00001070").alias("labels"), "asset_id")
    declared = rows.unionByName(rows).withColumn("name", F.concat(F.lit(" "), "name"))  # repeats and blanks change nothing
    external = rows.filter(key % 41 != 0).withColumn("labels", F.when(key % 43 == 0, "").otherwise(F.col("labels")))
    digests = [fingerprint.bucket_digests(df) for df in (rows, declared, external)]
    return fingerprint.compare(*digests, ours_at=10, external_at=10)


@query("snapshot_constraints", with_views("""
WITH o AS (SELECT DISTINCT utxo, tx_id, idx, slot FROM ledger)
SELECT 'envelope' AS rule, 0 AS violations UNION ALL SELECT 'verification', 0
UNION ALL SELECT 'output_shape', count(*) FROM o WHERE tx_id % 97 = 0 OR tx_id % 89 = 0
UNION ALL SELECT 'output_slot', count(*) FROM o WHERE slot > 2300
UNION ALL SELECT 'output_repeated', count(*) FROM o WHERE tx_id % 83 = 0
UNION ALL SELECT 'mint_slot', count(*) FROM o WHERE tx_id % 5 = 0 AND slot > 2300
UNION ALL SELECT 'mint_hash', count(*) FROM o WHERE tx_id % 5 = 0 AND tx_id % 97 = 0
UNION ALL SELECT 'block_slot', count(*) FROM blocks WHERE slot > 2300
UNION ALL SELECT 'block_hash', count(*) FROM blocks WHERE height % 61 = 0""", "ledger", "blocks"))
def snapshot_constraints(spark, sf_dir):
    tx = F.col("tx_id")
    long_hash = lambda column: F.concat(F.md5(column.cast("string")), F.md5(column.cast("string")))
    base = materialize(b.ledger(spark, sf_dir).select("utxo", "tx_id", "idx", "slot").distinct(), "outputs")
    outputs = base.select(
        "utxo", F.when(tx % 97 == 0, "short").otherwise(long_hash(tx)).alias("tx_id"), long_hash(F.col("slot")).alias("block_hash"), "idx", "slot",
        F.lit(1).alias("height"), F.lit(1).alias("lovelace"), F.when(tx % 89 == 0, "").otherwise("addr").alias("address"), tx.alias("n"))
    outputs = outputs.unionByName(outputs.filter((F.col("n") % 83 == 0)).withColumn("address", F.lit("addr")).withColumn("tx_id", long_hash(F.col("n"))).withColumn("slot", F.lit(0).cast("bigint")))
    mints = base.filter(tx % 5 == 0).select(F.col("slot").alias("created_slot"), F.when(tx % 97 == 0, "short").otherwise(long_hash(tx)).alias("tx_hash"))
    blocks = b.blocks(spark, sf_dir).select("slot", F.when(F.col("height") % 61 == 0, "x").otherwise(long_hash(F.col("height"))).alias("hash"))
    root = long_hash(F.lit("root"))
    envelope = blocks.agg(F.lit(2300).alias("slot"), long_hash(F.lit("tip")).alias("hash"), F.lit(1).alias("schema_version"), F.lit(True).alias("verified"),
                          root.alias("root"), root.alias("chain_root"), F.lit("main").alias("network"))
    return constraints.snapshot_violations(envelope, outputs, mints, blocks, slot=2300, schema_version=1, network="main")


def _feeds(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two feeds: even heights processed up to 2300, odd heights to their tip."""
    feed = F.when(F.col("height") % 2 == 0, "even").otherwise("odd")
    rows = b.blocks(spark, sf_dir).withColumn("feed", feed)
    tips = rows.groupBy("feed").agg(F.min("slot").alias("first_slot"), F.max("slot").alias("tip_slot"))
    return rows.filter((F.col("feed") == "odd") | (F.col("slot") <= 2000)), tips


_FEEDS = """WITH f AS (SELECT *, CASE WHEN height % 2 = 0 THEN 'even' ELSE 'odd' END AS feed FROM blocks),
g AS (SELECT feed, min(slot) AS first_slot, max(slot) AS tip_slot, max(slot) FILTER (WHERE feed = 'odd' OR slot <= 2000) AS current_slot FROM f GROUP BY feed)
"""


@query("feed_freshness", with_views(_FEEDS + """
SELECT feed, tip_slot, current_slot, tip_slot - current_slot AS lag, tip_slot - current_slot < 300 AS caught_up FROM g""", "blocks"))
def feed_freshness(spark, sf_dir):
    scanned, tips = _feeds(spark, sf_dir)
    return chain.freshness(scanned, tips, 300)


@query("feed_progress", with_views(_FEEDS + """
SELECT feed, (current_slot - first_slot) * 10000 // (tip_slot - first_slot) AS covered_bp, tip_slot - current_slot AS remaining_slots,
  (tip_slot - current_slot) * 86400 > 900 AS behind FROM g""", "blocks"))
def feed_progress(spark, sf_dir):
    scanned, tips = _feeds(spark, sf_dir)
    return chain.progress(scanned, tips, 86_400, 900)
