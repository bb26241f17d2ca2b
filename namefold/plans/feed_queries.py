"""Sources, sinks and the streaming job over feeds written from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namefold.functions import assets
from namefold.operators import normalize, state
from namefold.plans import bindings as b
from namefold.plans.bindings import table, with_views
from namefold.plans.ledger_queries import FOLD_ORACLE, fold_fields
from namefold.plans.registry import query
from namefold.scratch import materialize, release, scratch_path, shuffles_dropped
from namefold.sources import landed, sinks, snapshot
from namefold.streaming import ingest


@query("nest_and_flatten", """
SELECT concat('t', l_orderkey) AS tx_id, lower(hex(encode(concat('n', l_partkey)))) AS body, p_brand AS policy, l_orderkey % 100 AS slot,
  CASE WHEN l_partkey % 3 = 0 THEN 2 ELSE 3 END AS rank, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand IN ('Brand#1', 'Brand#7', 'Brand#13') GROUP BY ALL""")
def nest_and_flatten(spark, sf_dir):
    """Line items as one-output block messages, written and read as JSON, flattened in fold order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("decimal(38,0)").alias("q"))
    lines = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    token = b.token_hex(F.concat(F.lit("n"), "l_partkey"), F.col("l_partkey") % 3)
    output = F.struct(
        F.lit("addr").alias("address"), F.col("q").alias("lovelace"),
        F.create_map("p_brand", F.create_map(token, "q"), F.lit("untracked"), F.create_map(F.lit("00"), F.col("q"))).alias("assets"))
    # The row's key makes the output id unique per asset, as the 222-first rule works per output.
    tx = F.struct(
        F.concat(F.lit("t"), "l_orderkey", F.lit("/"), "l_partkey").alias("id"), F.array(F.struct(F.lit("in").alias("tx"), F.lit(0).alias("index"))).alias("inputs"),
        F.array(output).alias("outputs"))
    messages = lines.select(
        F.concat(F.lit("b"), F.col("l_orderkey") % 100).alias("id"), (F.col("l_orderkey") % 100).alias("height"),
        (F.col("l_orderkey") % 100).alias("slot"), F.lit("praos").alias("type"), F.array(tx).alias("transactions"))
    path = scratch_path(spark, "blocks")
    messages.write.json(path)
    blocks = normalize.only_block_type(landed.read_blocks(spark, path))
    ordered = normalize.flatten_blocks(blocks, ["Brand#1", "Brand#7", "Brand#13"])
    label = assets.label_of(F.col("hex"))
    body = F.when(label.isNull(), F.col("hex")).otherwise(F.substring(F.col("hex"), F.lit(9), F.length("hex")))
    return ordered.groupBy(
        F.split_part("tx_id", F.lit("/"), F.lit(1)).alias("tx_id"), body.alias("body"), "policy", "slot", "rank"
    ).agg(F.sum("quantity").cast("bigint").alias("quantity"))


@query("transaction_feed", """
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS block_hash, count(*) AS tx_count FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def transaction_feed(spark, sf_dir):
    """Orders as transactions in JSON, failed ones dropped, grouped back to blocks."""
    key = F.col("o_orderkey").cast("string")
    rows = table(spark, sf_dir, "orders").select(
        key.alias("tx_hash"), F.col("o_orderdate").cast("date").cast("string").alias("block_hash"), b.slot_of("o_orderdate").alias("block_height"),
        b.slot_of("o_orderdate").alias("absolute_slot"), (F.col("o_orderstatus") != "P").alias("successful"),
        F.array(F.struct(key.alias("tx_hash"), F.lit(0).alias("tx_index"))).alias("inputs"))
    path = scratch_path(spark, "txs")
    rows.unionByName(rows).write.json(path)  # a payload delivered twice counts once
    txs = landed.read_transactions(spark, path).withColumn("height", F.col("block_height"))
    return normalize.group_by_block(normalize.drop_failed(txs)).select("block_hash", "tx_count")


def _feed_rows(spark, sf_dir) -> DataFrame:
    """Events as feed rows: sign-ups mint, errors burn, the rest moves a name."""
    number, user = F.col("slot"), F.col("key")
    name = F.concat(F.lit("u"), user)
    burn = F.col("kind") == "burn"
    holder = F.concat(F.lit("h"), number % 37)
    return b.feed(spark, sf_dir).select(
        (number * 2).alias("seq"), F.lit("apply").alias("action"), "slot", "height", F.md5(F.col("height").cast("string")).alias("hash"),
        F.concat(F.lit("e"), number).alias("tx_hash"), (number % 13 != 5).alias("successful"), F.lit(b.TRACKED_POLICY).alias("policy"), name.alias("name"),
        F.when(~burn, assets.LABEL_OWNER).alias("label"),
        F.concat(F.when(burn, "").otherwise(assets.LABEL_OWNER), assets.hex_of_name(name)).alias("hex"),
        F.when(burn, "burn").otherwise("owner").alias("kind"), F.lit(0).alias("idx"), F.concat(F.lit("addr"), holder).alias("address"),
        holder.alias("holder"), (F.col("kind") == "mint").alias("is_mint"))


@query("event_feed_read", with_views("""
SELECT slot, height, concat('u', key) AS name, CASE WHEN kind = 'burn' THEN 'burn' ELSE 'owner' END AS kind FROM feed WHERE slot % 13 <> 5""", "feed"))
def event_feed_read(spark, sf_dir):
    path = scratch_path(spark, "events")
    _feed_rows(spark, sf_dir).write.json(path)
    rows = normalize.tracked(landed.read_events(spark, path), [b.TRACKED_POLICY])
    return normalize.drop_failed(rows.withColumnRenamed("hash", "block_hash")).select("slot", "height", "name", "kind")


def _snapshot(spark, sf_dir, slot: int) -> dict[str, DataFrame]:
    rows = b.ledger(spark, sf_dir)
    mints = rows.filter((F.col("tx_id") % 5 == 0) & (F.col("is_burn") == 0)).select(
        F.concat(F.lit("n"), "asset_id").alias("name"), F.col("slot").alias("created_slot"), F.col("tx_id").cast("string").alias("tx_hash")).distinct()
    path = scratch_path(spark, "snapshot")
    snapshot.write_snapshot(path, rows.select("utxo", "asset_id", "slot", "holder"), mints, b.scanned(spark, sf_dir), slot)
    return snapshot.read_snapshot(spark, path)


@query("snapshot_cutoff", with_views("""
SELECT 'outputs' AS part, count(*) AS rows, max(slot) AS newest FROM ledger WHERE slot <= 1500
UNION ALL SELECT 'mints', count(*), max(slot) FROM (SELECT DISTINCT asset_id, slot, tx_id FROM ledger WHERE slot <= 1500 AND tx_id % 5 = 0 AND is_burn = 0)
UNION ALL SELECT 'blocks', count(*), max(slot) FROM scanned WHERE slot <= 1500""", "ledger", "scanned"))
def snapshot_cutoff(spark, sf_dir):
    tables = _snapshot(spark, sf_dir, 1500)
    count = lambda part, slot: tables[part].agg(F.count("*").alias("rows"), F.max(slot).alias("newest")).select(
        F.lit(part).alias("part"), "rows", "newest")
    return count("outputs", "slot").unionByName(count("mints", "created_slot")).unionByName(count("blocks", "slot"))


@query("snapshot_read", with_views("SELECT utxo, asset_id, slot, holder FROM ledger WHERE slot <= 1500", "ledger"))
def snapshot_read(spark, sf_dir):
    return _snapshot(spark, sf_dir, 1500)["outputs"]


@query("snapshot_mint_history", with_views("""
SELECT DISTINCT concat('n', asset_id) AS name, slot AS created_slot, CAST(tx_id AS VARCHAR) AS tx_hash FROM ledger
WHERE slot <= 1500 AND tx_id % 5 = 0 AND is_burn = 0 AND asset_id % 4 <> 2""", "ledger"))
def snapshot_mint_history(spark, sf_dir):
    live = table(spark, sf_dir, "part").filter(F.col("p_partkey") % 4 != 2).select(F.concat(F.lit("n"), "p_partkey").alias("name"))
    return snapshot.mint_rows_at(_snapshot(spark, sf_dir, 2000)["mints"], live, 1500)


@query("names_text", with_views("SELECT name AS value FROM names", "names"))
def names_text(spark, sf_dir):
    path = scratch_path(spark, "names")
    sinks.write_names(b.names(spark, sf_dir), path)
    return spark.read.text(path)


@query("report_json", with_views("SELECT name, asset_id FROM names WHERE og_number > 0", "names"))
def report_json(spark, sf_dir):
    path = scratch_path(spark, "report")
    sinks.write_report(b.names(spark, sf_dir).filter("og_number > 0").select("name", "asset_id"), path)
    return spark.read.schema("name STRING, asset_id BIGINT").json(path)


ROWS_PER_FILE = 500_000


def _shares(rows: DataFrame, slices: int) -> int:
    """Files that each of so many equal ranges of ``seq`` is written as: one for a small feed, so many that no task writes much more
    than `ROWS_PER_FILE` for a large one. Every range must fill all of them, as a batch is a number of files."""
    first, last = rows.agg(F.min("seq"), F.max("seq")).first()
    at = F.floor((F.col("seq") - first) * slices / (last - first + 1))
    counts = [r["count"] for r in rows.groupBy(at.alias("at")).count().collect()]
    shares = -(-max(counts) // ROWS_PER_FILE)
    # Rows are dealt in turn by each task that reads them.
    return shares if len(counts) == slices and min(counts) >= 2 * shares * rows.rdd.getNumPartitions() else 1


def _land(rows: DataFrame, feed: str, files: int, shares: int = 1, *, packed: bool = False) -> None:
    """Land the rows in so many steps, oldest first, each as so many files; ``packed`` ones (gzip) take a fifth of the room."""
    first, last = rows.agg(F.min("seq"), F.max("seq")).first()
    width = (last - first) // files + 1
    for k in range(files):
        part = rows.filter(F.col("seq").between(first + k * width, first + (k + 1) * width - 1))
        part = part.repartition(shares) if shares > 1 else part.coalesce(1)
        with shuffles_dropped(part.sparkSession):
            part.write.mode("append").options(**landed.PACKED if packed else {}).json(feed)


def _run_feed(spark, rows: DataFrame, slices: int, kind: type[ingest.BlockLedger]) -> tuple[ingest.BlockLedger, int]:
    """Land the feed slice by slice, each in two steps, and resume the same job after each; a batch takes the files of one step."""
    feed = scratch_path(spark, "feed")
    job = kind(spark, scratch_path(spark, "work"))
    if isinstance(job, ingest.CurrentState):
        job.policies = (b.TRACKED_POLICY,)
        job.strict = False  # many users of the feed never signed up
    top = rows.agg(F.max("seq")).first()[0] + 1
    shares = _shares(rows, 2 * slices)
    for part in range(slices):
        _land(rows.filter(F.col("seq").between(top * part // slices, top * (part + 1) // slices - 1)), feed, 2, shares)
        ingest.run(job, feed, files_per_batch=shares)
    return job, ingest.last_batch(job)


_STREAM_ORACLE = """
WITH e AS (SELECT concat('u', key) AS name, slot, kind, row_number() OVER (PARTITION BY key ORDER BY slot) AS n
  FROM feed WHERE height < (SELECT max(height) FROM feed) AND slot % 13 <> 5),
capped AS (SELECT *, row_number() OVER (PARTITION BY name, slot ORDER BY n) AS r FROM e),
folded AS (
  SELECT name, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS amount, '' AS utxo, '' AS holder, CAST(0 AS BIGINT) AS updated FROM (SELECT DISTINCT name FROM e)
  UNION ALL
  SELECT f.name, e.n, CASE WHEN e.kind = 'burn' THEN greatest(f.amount - 1, 0) WHEN f.amount = 0 THEN 1 WHEN e.kind = 'mint' THEN f.amount + 1 ELSE f.amount END,
    CASE WHEN e.kind = 'burn' THEN f.utxo ELSE concat('e', e.slot, '#0') END, CASE WHEN e.kind = 'burn' THEN f.holder ELSE concat('h', e.slot % 37) END,
    CASE WHEN e.kind = 'burn' THEN f.updated ELSE e.slot END
  FROM folded f JOIN e ON e.name = f.name AND e.n = f.n + 1)
SELECT name, amount, utxo, holder, updated AS updated_slot_number FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC) AS last FROM folded) WHERE last = 1 AND amount > 0"""


@query("stream_current_state", with_views(_STREAM_ORACLE, "feed", recursive=True))
def stream_current_state(spark, sf_dir):
    rows = _feed_rows(spark, sf_dir)
    repeated = rows.unionByName(rows.filter(F.col("slot") % 10 == 3))  # delivered twice
    foreign = rows.filter(F.col("slot") % 10 == 6).withColumn("policy", F.lit("untracked")).withColumn("hex", F.lit("00"))
    repeated = repeated.unionByName(foreign)
    job, batch = _run_feed(spark, repeated, 2, ingest.CurrentState)
    return job.records(batch).select("name", "amount", "utxo", "holder", "updated_slot_number")


def _whole_feed(spark, sf_dir, events: DataFrame) -> DataFrame:
    """Events of all kinds as feed rows, some delivered twice; every block has a row without a name, and an empty block closes the feed."""
    outputs = events.filter(~F.col("kind").isin(*state.BURNS))
    # The ledger's names all were minted once: where no mint is told, the first output is it.
    first = outputs.groupBy("name").agg(F.min(F.struct("slot", "rank", "tx_pos", "idx", "hex")).alias("f")).select(
        "name", "f.*", F.lit(True).alias("__first"))
    marked = events.join(first, ["name", "slot", "rank", "tx_pos", "idx", "hex"], "left")
    blocks = b.blocks(spark, sf_dir).select("slot", "height", "hash")
    step = 10_000_000_000
    seq = (F.col("slot") + 1) * step
    rows = marked.join(blocks, "slot").select(
        (seq + F.col("tx_pos")).alias("seq"), "slot", "height", "hash", F.col("tx_pos").cast("string").alias("tx_hash"), F.lit(True).alias("successful"),
        "policy", "name", "label", "hex", "kind", "idx", "address", "holder", (F.col("is_mint") | F.coalesce("__first", F.lit(False))).alias("is_mint"),
        "lovelace", "script", "datum", "datum_holder", F.when(F.col("is_mint"), F.concat(F.lit('{"tx":'), "tx_pos", F.lit("}"))).alias("metadata"))
    end = blocks.agg((F.max("slot") + 1).alias("slot"), (F.max("height") + 1).alias("height"), F.lit("end").alias("hash"))
    empty = blocks.unionByName(end).withColumn("seq", seq)
    rows = rows.unionByName(rows.filter(F.col("idx") == 2)).unionByName(empty, allowMissingColumns=True)
    return rows.withColumn("action", F.lit("apply"))


@query("stream_whole_state", with_views(FOLD_ORACLE, "asset_events", recursive=True))
def stream_whole_state(spark, sf_dir):
    """All kinds of events through the job, two of six steps in a batch, against the same SQL as the batch fold."""
    feed = scratch_path(spark, "feed")
    events = b.asset_events(spark, sf_dir)
    rows = materialize(_whole_feed(spark, sf_dir, events), "rows", codec="zstd")
    release(spark, events)
    shares = _shares(rows, 6)
    _land(rows, feed, 6, shares, packed=True)
    release(spark, rows)
    og_list = materialize(b.names(spark, sf_dir).filter("og_number > 0").select("name", "og_number"), "og")
    job = ingest.CurrentState(spark, scratch_path(spark, "work"), policies=(b.TRACKED_POLICY,), compact_every=2, og_list=og_list)
    ingest.run(job, feed, files_per_batch=2 * shares)
    return fold_fields(job.records(ingest.last_batch(job)))


@query("stream_complete_blocks", with_views("""
SELECT height, md5(CAST(height AS VARCHAR)) AS hash, count(*) AS slots FROM feed WHERE height < (SELECT max(height) FROM feed) GROUP BY height""", "feed"))
def stream_complete_blocks(spark, sf_dir):
    job, batch = _run_feed(spark, _feed_rows(spark, sf_dir), 2, ingest.BlockLedger)
    return job.table("blocks", batch).groupBy("height", "hash").agg(F.count("*").alias("slots"))


@query("stream_undo_log", with_views("""
SELECT u.slot, u.height, u.height <= a.applied AS applied, a.blocks FROM (SELECT * FROM feed WHERE slot = (SELECT max(slot) * 6 // 10 FROM feed)) u,
  (SELECT max(height) AS applied, count(DISTINCT height) AS blocks FROM feed
   WHERE height < (SELECT max(slot) * 6 // 10 // 10 FROM feed)) a""", "feed"))
def stream_undo_log(spark, sf_dir):
    """An undo in the middle of the feed: what came before is applied, the rest is held."""
    rows = _feed_rows(spark, sf_dir)
    at = F.floor(rows.agg(F.max("slot")).scalar() * 6 / 10)
    undo = rows.filter(F.col("slot") == at).withColumn("action", F.lit("undo")).withColumn("seq", F.col("seq") + 1)
    job, batch = _run_feed(spark, rows.unionByName(undo), 2, ingest.BlockLedger)
    blocks = job.table("blocks", batch).agg(F.count_distinct("height")).scalar()
    return job.undo_log(batch).select("slot", "height", "applied", blocks.alias("blocks"))


@query("stream_progress", with_views("""
SELECT count(*) AS blocks, max(height) AS last_height, false AS halted FROM (SELECT DISTINCT height FROM feed WHERE height < (SELECT max(height) FROM feed))""", "feed"))
def stream_progress(spark, sf_dir):
    job, batch = _run_feed(spark, _feed_rows(spark, sf_dir), 2, ingest.BlockLedger)
    return job.table("status", batch).agg(F.sum("blocks").alias("blocks"), F.max("last_height").alias("last_height"), F.bool_or("halted").alias("halted"))
