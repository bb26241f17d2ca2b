"""Ledger-shaped views over the driver's tables.

`SQL` holds the same views as query text for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from namefold.functions import assets
from namefold.operators import scan, state
from namefold.scratch import materialize, release
from namefold.sources.landed import BLOCK_SCHEMA

SLOT_CHUNK = 400  # slots are days here, about 2,400 of them
TRACKED_POLICY = "p0"
TRANSACTIONS = BLOCK_SCHEMA.split("transactions ")[1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slot_of(date: str) -> Column:
    return F.datediff(F.col(date).cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint")


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    number = key.cast("string")
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    name = (
        F.when(key % 5 == 0, number)
        .when(key % 5 == 1, F.concat(word(1), number))
        .when(key % 5 == 2, F.concat(F.lit("-"), number))
        .when(key % 5 == 3, F.concat(number, F.lit(".5")))
        .otherwise(F.concat(word(1), number, F.lit("@"), word(2)))
    )
    return table(spark, sf_dir, "part").select(
        key.alias("asset_id"), name.alias("name"), F.when(key % 97 == 1, key).otherwise(0).alias("og_number")
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per asset moved by an output (an output may hold several assets).

    Lines and orders are dealt by order once, so that neither the sums nor the
    join move them again, and a task holds a bounded number of lines. If one order
    holds very many lines, they are summed up before the join: their three keys
    spread evenly, and the join after it can be split.
    """
    burn = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), 1).otherwise(0)
    every = table(spark, sf_dir, "lineitem").filter("l_orderkey IS NOT NULL").select(
        F.col("l_orderkey").alias("tx_id"), F.col("l_linenumber").alias("idx"), F.col("l_partkey").alias("asset_id"),
        burn.alias("is_burn"), F.col("l_extendedprice").cast("decimal(18,2)").alias("value"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("tx_id"), F.col("o_custkey").alias("holder"), slot_of("o_orderdate").alias("slot")
    )
    if not scan.frequent(every, "tx_id", state.HOT_ROWS):
        parts = scan.parts_for(every.count(), spark)
        every, orders = every.repartition(parts, "tx_id"), orders.repartition(parts, "tx_id")
    lines = every.groupBy("tx_id", "idx", "asset_id").agg(F.max("is_burn").alias("is_burn"), F.sum("value").cast("decimal(18,2)").alias("value"))
    return lines.join(orders, "tx_id").withColumn("utxo", F.concat_ws("#", "tx_id", "idx"))


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger with the output that held the asset before (the input of the event).

    An asset with very many lines is walked by ranges of slots, all others by one window.
    """
    rows = ledger(spark, sf_dir).filter("asset_id IS NOT NULL AND slot IS NOT NULL")
    order, columns = ["slot", "tx_id", "idx"], {"utxo": "prev_utxo", "slot": "prev_slot"}
    hot = scan.frequent(table(spark, sf_dir, "lineitem"), "l_partkey", state.HOT_ROWS)
    if hot:
        rows = materialize(rows, "ledger")
        few, many = rows.filter(~F.col("asset_id").isin(hot)), rows.filter(F.col("asset_id").isin(hot))
    else:
        few, many = rows, None
    along = Window.partitionBy("asset_id").orderBy(*order)
    walked = few.select("*", *[F.lag(source).over(along).alias(new) for source, new in columns.items()])
    if many is None:
        return walked
    chunked = scan.with_previous(scan.with_chunk(many, "slot", SLOT_CHUNK), ["asset_id"], order, columns).drop(scan.CHUNK)
    return walked.unionByName(chunked)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderdate").cast("date").alias("dt"))
        .agg(F.count_distinct("o_orderkey").alias("tx_count"))
    )
    numbered = scan.with_position(
        days.withColumn(scan.CHUNK, F.year("dt") * 12 + F.month("dt")), "dt", "height"
    ).drop(scan.CHUNK)
    hashed = numbered.select(
        F.col("height").cast("bigint").alias("height"), slot_of("dt").alias("slot"),
        F.md5(F.col("dt").cast("string")).alias("hash"), "tx_count",
    )
    hashed = materialize(hashed, "blocks")
    parents = hashed.select((F.col("height") + 1).alias("height"), F.col("hash").alias("parent"))
    return hashed.join(parents, "height", "left").select("height", "slot", "hash", "parent", "tx_count")


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of processed blocks; some are missing."""
    return blocks(spark, sf_dir).filter(F.col("height") % 17 != 0).select("height", "slot", "hash")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("slot"), F.floor(F.col("event_id") / 10).cast("bigint").alias("height"),
        F.col("user_id").alias("key"),
        F.when(F.col("event_type") == "signup", "mint").when(F.col("event_type") == "error", "burn").otherwise("update")
        .alias("kind"),
    )


def token_hex(name: Column, selector: Column) -> Column:
    """Token name under one of three labels, or none."""
    body = assets.hex_of_name(name)
    return (
        F.when(selector == 0, F.concat(F.lit(assets.LABEL_OWNER), body))
        .when(selector == 1, F.concat(F.lit(assets.LABEL_REFERENCE), body))
        .otherwise(body)
    )


def current_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, owner and pointer of every live asset; ``created_slot`` is its first slot."""
    events = ledger(spark, sf_dir)
    newest = F.struct("slot", "tx_id", "idx")
    live = events.groupBy("asset_id").agg(
        F.max_by(F.struct("holder", "utxo", "slot", "value", "is_burn"), newest).alias("e"), F.min("slot").alias("created_slot")
    ).filter(F.col("e.is_burn") == 0)
    return live.join(names(spark, sf_dir), "asset_id").select(
        "asset_id", "name", "og_number", F.col("e.holder").alias("holder"), F.col("e.utxo").alias("utxo"),
        F.col("e.slot").alias("updated_slot"), F.col("e.value").alias("value"), "created_slot",
    )


def asset_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows as fold events of all kinds, after the net effect of their block."""
    raw, spent_here = _moves_and_spent(spark, sf_dir)
    net = raw.filter("named").drop("prev_utxo", "prev_slot").join(spent_here, ["utxo", "slot"], "left")
    # The rows are still narrow here; texts are made of those that stay.
    events = materialize(_events(net.filter((F.col("is_burn") == 1) | F.col("spent").isNull())), "asset_events", codec="zstd")
    release(spark, raw, spent_here)
    return events


def _moves_and_spent(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Landed moves with their names (``named`` where the asset has one), and the outputs spent in the slot that made them.

    The names are joined where the moves lie by asset already. An output made in
    one slot only is spent there if its next move is in that slot; of orders told
    with several slots every input stays.
    """
    known = names(spark, sf_dir).select("asset_id", "name", F.lit(True).alias("named"))
    raw = materialize(moves(spark, sf_dir).join(known, "asset_id", "left"), "moves", codec="zstd")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("tx"), slot_of("o_orderdate").alias("s"))
    several = materialize(orders.groupBy("tx").agg(F.min("s").alias("a"), F.max("s").alias("b")).filter("a <> b").select("tx"), "several")
    inputs = raw.filter("prev_utxo IS NOT NULL").select(F.col("prev_utxo").alias("utxo"), "slot", "prev_slot")
    same = inputs.filter("prev_slot = slot")
    other = inputs.filter("prev_slot <> slot").withColumn("tx", F.split_part("utxo", F.lit("#"), F.lit(1))).join(several, "tx", "left_semi").drop("tx")
    spent = materialize(same.unionByName(other).select("utxo", "slot").distinct(), "spent")
    return raw, spent.withColumn("spent", F.lit(True))


def block_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ledger rows nested as blocks, before any netting: one block per slot and asset, one transaction per row.

    The rows of one asset in one of some 2,400 slots are one message. Outputs
    before a row's own are empty, so that it keeps its index. An output may hold
    several assets: what the slot spends of the message's outputs is repeated in
    a last transaction of inputs alone.
    """
    raw, spent = _moves_and_spent(spark, sf_dir)
    # Dealt out while they are narrow: texts are made where the rows of a message lie. Neighbours share names, which packs well.
    dealt = raw.filter("named").join(spent, ["utxo", "slot"], "left").repartitionByRange("asset_id", "slot").sortWithinPartitions("asset_id", "slot")
    rows = _events(dealt, "asset_id", "prev_utxo", "spent")
    burn = F.col("kind").isin(*state.BURNS)
    one = lambda quantity: F.create_map("policy", F.create_map("hex", F.lit(quantity).cast("decimal(38,0)")))
    output = F.struct("address", "lovelace", one(1).alias("assets"), "datum", F.struct(F.col("script.type").alias("language"), F.col("script.cbor").alias("cbor")).alias("script"))
    blank = F.lit(None).cast("struct<address: string, lovelace: decimal(38,0), assets: map<string, map<string, decimal(38,0)>>, datum: string, script: struct<language: string, cbor: string>>")
    ref = lambda utxo: F.struct(assets.utxo_tx(F.col(utxo)).alias("tx"), assets.utxo_index(F.col(utxo)).alias("index"))
    tx = F.struct(
        F.col("tx_pos").alias("pos"), "idx", F.col("tx_pos").cast("string").alias("id"),
        F.when(F.col("prev_utxo").isNotNull(), F.array(ref("prev_utxo"))).alias("inputs"),
        F.when(~burn, F.concat(F.array_repeat(blank, F.col("idx")), F.array(output))).alias("outputs"),
        F.when(burn, one(-1)).when(F.col("is_mint"), one(1)).alias("mint"), F.lit("{}").alias("metadata"),
    )
    place = lambda t: t["pos"] * 1000 + t["idx"]
    in_order = F.array_sort(F.collect_list(tx), lambda left, right: F.signum(place(left) - place(right)).cast("int"))
    grouped = rows.groupBy("slot", "asset_id").agg(in_order.alias("txs"), F.collect_set(F.when(F.col("spent"), ref("utxo"))).alias("spends"))
    nested = F.transform("txs", lambda t: F.struct(*(t[c].alias(c) for c in ("id", "inputs", "outputs", "mint", "metadata"))))
    last = F.array(F.struct(F.lit("spends").alias("id"), F.col("spends").alias("inputs"), F.lit(None).alias("outputs"), F.lit(None).alias("mint"), F.lit(None).alias("metadata")))
    return grouped.select(
        F.concat_ws("/", "slot", "asset_id").alias("id"), F.col("slot").alias("height"), "slot", F.lit("praos").alias("type"),
        F.concat(nested.cast(TRANSACTIONS), last.cast(TRANSACTIONS)).alias("transactions"))


def _events(joined: DataFrame, *more: str) -> DataFrame:
    pick = (F.col("tx_id") + F.col("idx")) % 7
    body = assets.hex_of_name(F.col("name"))
    burned = F.col("is_burn") == 1
    label = (
        F.when(pick == 5, assets.LABEL_SETTINGS)
        .when(burned, F.lit(None))
        .when(pick == 3, assets.LABEL_REFERENCE)
        .when(F.col("asset_id") % 10 == 4, assets.LABEL_VIRTUAL)  # half of the names with a root
        .when(F.col("tx_id") % 2 == 0, assets.LABEL_OWNER)
    )
    kind = F.when(burned, F.when(pick == 5, "label_burn").otherwise("burn"))
    with_kind = joined.withColumn("label", label)
    with_kind = with_kind.withColumn("hex", F.concat(F.coalesce("label", F.lit("")), body))
    with_kind = with_kind.withColumn("kind", F.coalesce(kind, state.event_kind(F.col("label"))))
    holder = F.col("holder").cast("string")
    datum = (
        F.when((F.col("kind") == "reference") & (F.col("tx_id") % 3 != 0), _pz_datum())
        .when((F.col("kind") == "virtual") & (F.col("tx_id") % 2 == 0), _pz_datum())
        .when((F.col("kind") == "settings") & (F.col("tx_id") % 4 != 0),
              F.concat(F.lit('[[1,0,"t","s",1],[0,1,"u","v",0],'), F.col("tx_id"), F.lit(',2,3,"terms",0,"pay"]')))
        .when((F.col("kind") == "owner") & (F.col("tx_id") % 6 == 0), F.lit("{}"))
    )
    rank = F.when(F.col("kind") == "burn", 0).when(F.col("kind") == "label_burn", 1).when(
        F.col("label") == assets.LABEL_OWNER, 2).otherwise(3)
    return with_kind.select(
        "name", F.lit(TRACKED_POLICY).alias("policy"), "label", "hex", assets.owner_hex_of(F.col("hex")).alias("owner_hex"),
        "kind", "slot", rank.alias("rank"), F.col("tx_id").alias("tx_pos"), "idx", "utxo",
        F.concat(F.lit("addr"), holder).alias("address"), holder.alias("holder"),
        F.col("value").cast("decimal(38,0)").alias("lovelace"),
        F.struct(F.lit("plutusV2").alias("type"), F.lit("00").alias("cbor")).alias("script"),
        datum.alias("datum"), ((F.col("kind") == "owner") & (F.col("tx_id") % 5 == 0)).alias("is_mint"),
        F.when(F.col("kind") == "virtual", F.concat(F.lit("d"), F.col("tx_id") % 97)).alias("datum_holder"), *more,
    )


def _pz_datum() -> Column:
    tx = F.col("tx_id")
    return F.concat(
        F.lit('[{"image":"img'), tx, F.lit('","og_number":'), tx % 3, F.lit(',"version":1},1,{"image_hash":"h'), tx % 5,
        F.lit('","standard_image_hash":"h0","default":'), F.when(tx % 10 == 1, "true").otherwise("false"),
        F.lit(',"resolved_addresses":{"ada":"0xda'), tx, F.lit('","btc":"b'), tx, F.lit('"}}]'),
    )


def mint_records(events: DataFrame) -> DataFrame:
    """Every mint, and the first output of each name: the ledger's names all were minted once."""
    def record(rows: DataFrame) -> DataFrame:
        return rows.select("name", F.col("slot").alias("created_slot"), F.col("tx_pos").cast("string").alias("tx_hash"), F.lit("{}").alias("metadata"))

    outputs = events.filter(~F.col("kind").isin(*state.BURNS))
    first = outputs.groupBy("name").agg(F.min(F.struct("slot", "tx_pos")).alias("f")).select("name", "f.*")
    return record(events.filter("is_mint")).unionByName(record(first)).distinct()


_SLOT = "date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE))"

SQL = {
    "names": """SELECT p_partkey AS asset_id,
  CASE p_partkey % 5
    WHEN 0 THEN CAST(p_partkey AS VARCHAR)
    WHEN 1 THEN concat(split_part(p_name, ' ', 1), CAST(p_partkey AS VARCHAR))
    WHEN 2 THEN concat('-', CAST(p_partkey AS VARCHAR))
    WHEN 3 THEN concat(CAST(p_partkey AS VARCHAR), '.5')
    ELSE concat(split_part(p_name, ' ', 1), CAST(p_partkey AS VARCHAR), '@', split_part(p_name, ' ', 2)) END AS name,
  CASE WHEN p_partkey % 97 = 1 THEN p_partkey ELSE 0 END AS og_number
FROM part""",
    "ledger": f"""SELECT l_partkey AS asset_id, {_SLOT} AS slot, l_orderkey AS tx_id, l_linenumber AS idx, o_custkey AS holder,
  concat(l_orderkey, '#', l_linenumber) AS utxo,
  max(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 1 ELSE 0 END) AS is_burn,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS value
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
GROUP BY l_partkey, {_SLOT}, l_orderkey, l_linenumber, o_custkey""",
    "moves": """SELECT *, lag(utxo) OVER w AS prev_utxo, lag(slot) OVER w AS prev_slot
FROM ledger WINDOW w AS (PARTITION BY asset_id ORDER BY slot, tx_id, idx)""",
    "blocks": """SELECT height, slot, hash, lag(hash) OVER (ORDER BY height) AS parent, tx_count
FROM (SELECT dense_rank() OVER (ORDER BY dt) AS height, date_diff('day', DATE '1995-01-01', dt) AS slot,
        md5(CAST(dt AS VARCHAR)) AS hash, tx_count
      FROM (SELECT CAST(o_orderdate AS DATE) AS dt, count(DISTINCT o_orderkey) AS tx_count FROM orders GROUP BY 1) g) x""",
    "scanned": "SELECT height, slot, hash FROM blocks WHERE height % 17 <> 0",
    "feed": """SELECT event_id AS slot, event_id // 10 AS height, user_id AS key,
  CASE event_type WHEN 'signup' THEN 'mint' WHEN 'error' THEN 'burn' ELSE 'update' END AS kind
FROM events""",
    "current_names": """SELECT l.asset_id, n.name, n.og_number, l.holder, l.utxo, l.slot AS updated_slot, l.value, l.created_slot
FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY slot DESC, tx_id DESC, idx DESC) AS rn,
        min(slot) OVER (PARTITION BY asset_id) AS created_slot FROM ledger) l
JOIN names n ON n.asset_id = l.asset_id WHERE rn = 1 AND is_burn = 0""",
    "asset_events": """SELECT name, label, concat(coalesce(label, ''), body) AS hex,
  CASE WHEN label IS NULL THEN body WHEN label = '00000000' THEN concat(label, body) ELSE concat('000de140', body) END AS owner_hex,
  kind, slot, CASE WHEN kind = 'burn' THEN 0 WHEN kind = 'label_burn' THEN 1 WHEN label = '000de140' THEN 2 ELSE 3 END AS rank,
  tx_id, idx, utxo, holder, value,
  CASE kind WHEN 'reference' THEN tx_id % 3 <> 0 WHEN 'virtual' THEN tx_id % 2 = 0 WHEN 'settings' THEN tx_id % 4 <> 0
       WHEN 'owner' THEN tx_id % 6 = 0 ELSE false END AS has_datum,
  kind = 'owner' AND tx_id % 5 = 0 AS is_mint
FROM (
  SELECT *, CASE WHEN is_burn = 1 THEN CASE WHEN pick = 5 THEN 'label_burn' ELSE 'burn' END
                 WHEN label IS NULL OR label = '000de140' THEN 'owner' WHEN label = '00000000' THEN 'virtual'
                 WHEN label = '00001070' THEN 'settings' ELSE 'reference' END AS kind
  FROM (
    SELECT m.*, n.name, lower(hex(encode(n.name))) AS body, (tx_id + idx) % 7 AS pick,
      CASE WHEN (tx_id + idx) % 7 = 5 THEN '00001070' WHEN is_burn = 1 THEN NULL
           WHEN (tx_id + idx) % 7 = 3 THEN '000643b0'
           WHEN m.asset_id % 10 = 4 THEN '00000000'
           WHEN tx_id % 2 = 0 THEN '000de140' END AS label
    FROM moves m JOIN names n ON n.asset_id = m.asset_id) a) b
WHERE kind IN ('burn', 'label_burn')
   OR NOT EXISTS (SELECT 1 FROM moves s WHERE s.prev_utxo = b.utxo AND s.slot = b.slot)""",
}

_NEEDS = {
    "names": [], "ledger": [], "moves": ["ledger"], "blocks": [], "scanned": ["blocks"], "feed": [],
    "current_names": ["names", "ledger"], "asset_events": ["names", "moves"],
}


def with_views(query: str, *views: str, recursive: bool = False) -> str:
    """Prefix a query with the view definitions it uses."""
    wanted: list[str] = []

    def need(view: str) -> None:
        for other in _NEEDS[view]:
            need(other)
        if view not in wanted:
            wanted.append(view)

    for view in views:
        need(view)
    clauses = ",\n".join(f"{view} AS ({SQL[view]})" for view in wanted)
    keyword = "WITH RECURSIVE" if recursive else "WITH"
    body = query.strip()
    if body.upper().startswith("WITH "):
        return f"{keyword} {clauses},\n{body[5:].lstrip()}"
    return f"{keyword} {clauses}\n{body}"
