"""Facets, search, holders, lookups and catalogs over a record table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namefold.functions import assets, attributes
from namefold.operators import catalog, facets, holders, lookup, search, state
from namefold.operators.records import registry_listing, view
from namefold.operators.search import SearchSpec
from namefold.plans import bindings as b
from namefold.plans.bindings import table, with_views
from namefold.plans.name_queries import ATTRIBUTE_SQL
from namefold.plans.registry import query

_RECORDS = f"""records AS (
  SELECT asset_id, name, CAST(holder AS VARCHAR) AS holder, og_number, utxo, value, created_slot AS created_slot_number,
    updated_slot AS updated_slot_number, {', '.join(f'{sql} AS {name}' for name, sql in ATTRIBUTE_SQL.items())},
    CAST(length(name) AS INTEGER) AS length, CASE WHEN contains(name, '@') THEN split_part(name, '@', 2) END AS root,
    CASE WHEN contains(name, '@') THEN 'nft_subhandle' ELSE 'handle' END AS handle_type,
    concat(CASE WHEN asset_id % 2 = 0 THEN '000de140' ELSE '' END, lower(hex(encode(name)))) AS hex, concat('addr', holder) AS address,
    md5(concat('pay', holder)) AS payment_key_hash, md5(CAST(holder AS VARCHAR)) AS key_digest, asset_id % 7 = 3 AS is_personalized,
    asset_id % 50 = 7 AS "default"
  FROM current_names)"""


def _sql(text: str, *views: str) -> str:
    return with_views(f"WITH {_RECORDS}{', ' if text.strip().startswith('WITH ') else ' '}{text.strip().removeprefix('WITH ')}", "current_names", *views)


def records(spark, sf_dir) -> DataFrame:
    name, holder = F.col("name"), F.col("holder").cast("string")
    return b.current_names(spark, sf_dir).select(
        "asset_id", "name", holder.alias("holder"), "og_number", "utxo", "value", F.col("created_slot").alias("created_slot_number"),
        F.col("updated_slot").alias("updated_slot_number"), *attributes.name_attributes(name),
        assets.handle_type(name, F.lit(None)).alias("handle_type"),
        F.concat(F.when(F.col("asset_id") % 2 == 0, assets.LABEL_OWNER).otherwise(""), assets.hex_of_name(name)).alias("hex"),
        F.concat(F.lit("addr"), holder).alias("address"), F.md5(F.concat(F.lit("pay"), holder)).alias("payment_key_hash"),
        assets.key_digest(assets.hex_of_name(holder)).alias("key_digest"), (F.col("asset_id") % 7 == 3).alias("is_personalized"),
        (F.col("asset_id") % 50 == 7).alias("default"),
    )


_FACETS = {f: f for f in ("rarity", "characters", "numeric_modifiers", "length", "handle_type", "root", "holder", "address", "payment_key_hash")}
_FACET_ROWS = "facet_rows AS (" + " UNION ALL ".join(
    [f"SELECT '{f}' AS facet, CAST({c} AS VARCHAR) AS value, name FROM records WHERE {c} IS NOT NULL" for f, c in _FACETS.items()]
    + ["SELECT 'og', CASE WHEN og_number > 0 THEN '1' ELSE '0' END, name FROM records"]
    + ["SELECT 'personalized', CASE WHEN is_personalized THEN '1' ELSE '0' END, name FROM records"]
) + ")"


def _faceted(df: DataFrame) -> DataFrame:
    flagged = df.withColumn("og", facets.flag(F.col("og_number") > 0)).withColumn("personalized", facets.flag(F.col("is_personalized")))
    return flagged


@query("facet_index", _sql(f"WITH {_FACET_ROWS} SELECT facet, value, count(*) AS names FROM facet_rows GROUP BY facet, value"))
def facet_index(spark, sf_dir):
    return facets.facet_counts(_faceted(records(spark, sf_dir)), {**_FACETS, "og": "og", "personalized": "personalized"})


@query("non_empty_roots", _sql("SELECT DISTINCT root FROM records WHERE root IS NOT NULL"))
def non_empty_roots(spark, sf_dir):
    return facets.non_empty(records(spark, sf_dir), "root")


@query("facet_audit", _sql("""
SELECT 'holder' AS facet, holder AS value, name, 'absent' AS status FROM records WHERE asset_id % 29 = 0
UNION ALL SELECT 'rarity', rarity, name, 'absent' FROM records WHERE asset_id % 29 = 0
UNION ALL SELECT 'holder', 'ghost', name, 'orphan' FROM records WHERE asset_id % 31 = 0 AND asset_id % 29 <> 0
UNION ALL SELECT 'holder', holder, name, 'absent' FROM records WHERE asset_id % 31 = 0 AND asset_id % 29 <> 0"""))
def facet_audit(spark, sf_dir):
    rows = records(spark, sf_dir)
    wanted = {"holder": "holder", "rarity": "rarity"}
    # The stored index lost some names and kept a holder that is gone.
    stale = rows.filter(F.col("asset_id") % 29 != 0).withColumn(
        "holder", F.when(F.col("asset_id") % 31 == 0, "ghost").otherwise(F.col("holder"))
    )
    return facets.index_differences(facets.facet_rows(stale, wanted), facets.facet_rows(rows, wanted))


_ALL_FACETS = {**_FACETS, "og": "og", "personalized": "personalized", "key_digest": "key_digest"}
_ALL_ROWS = _FACET_ROWS.removesuffix(")") + " UNION ALL SELECT 'key_digest', key_digest, name FROM records WHERE key_digest IS NOT NULL)"


@query("facet_index_whole", _sql(f"WITH {_ALL_ROWS} SELECT facet, value, count(*) AS names FROM facet_rows GROUP BY facet, value"))
def facet_index_whole(spark, sf_dir):
    return facets.facet_counts(_faceted(records(spark, sf_dir)), _ALL_FACETS)


@query("facet_audit_whole", _sql(f"""WITH {_ALL_ROWS}
SELECT facet, facet_rows.value, name, 'absent' AS status FROM facet_rows JOIN records USING (name) WHERE asset_id % 29 = 0 OR asset_id % 31 = 0
UNION ALL SELECT facet, 'ghost', name, 'orphan' FROM facet_rows JOIN records USING (name) WHERE asset_id % 31 = 0 AND asset_id % 29 <> 0"""))
def facet_audit_whole(spark, sf_dir):
    """Every facet of the stored index lost some names and kept values that are gone."""
    rows = _faceted(records(spark, sf_dir))
    key = F.col("asset_id")
    stale = facets.facet_rows(rows.filter((key % 29 != 0) & (key % 31 == 0)), _ALL_FACETS).withColumn("value", F.lit("ghost"))
    stored = facets.facet_rows(rows.filter((key % 29 != 0) & (key % 31 != 0)), _ALL_FACETS).unionByName(stale)
    return facets.index_differences(stored, facets.facet_rows(rows, _ALL_FACETS))


_CONJUNCTIVE = SearchSpec(rarity="common", length="4-6", text="1")
_CONJUNCTIVE_SQL = "rarity = 'common' AND length BETWEEN 4 AND 6 AND (contains(name, '1') OR contains(hex, '1'))"


@query("search_conjunctive", _sql(f"""
SELECT name, rarity, length, holder, (SELECT count(*) FROM records WHERE {_CONJUNCTIVE_SQL}) AS total
FROM records WHERE {_CONJUNCTIVE_SQL} ORDER BY name LIMIT 100"""))
def search_conjunctive(spark, sf_dir):
    found = search.matches(records(spark, sf_dir), _CONJUNCTIVE)
    return search.page(found).select("name", "rarity", "length", "holder", search.total(found).scalar().alias("total"))


@query("search_all_terms", _sql("""
SELECT name, hex, holder FROM records WHERE characters = 'letters,numbers' AND is_personalized
  AND handle_type = 'handle' AND utxo <> '' UNION ALL
SELECT name, hex, holder FROM records WHERE og_number > 0 AND length BETWEEN 3 AND 9"""))
def search_all_terms(spark, sf_dir):
    rows = records(spark, sf_dir)
    one = search.matches(rows, SearchSpec(characters="letters,numbers", numeric_modifiers="", personalized=True, handle_type="handle", has_utxo=True))
    two = search.matches(rows, SearchSpec(og=True, length="3-9"))
    return one.select("name", "hex", "holder").unionByName(two.select("name", "hex", "holder"))


@query("search_hex_text", _sql("SELECT name FROM records WHERE contains(name, '2d3') OR contains(hex, '2d3')"))
def search_hex_text(spark, sf_dir):
    return search.matches(records(spark, sf_dir), SearchSpec(text="2d3")).select("name")


@query("search_page_desc", _sql("SELECT name, holder, utxo FROM records ORDER BY name DESC LIMIT 50 OFFSET 50"))
def search_page_desc(spark, sf_dir):
    return search.page(records(spark, sf_dir), number=2, size=50, sort="desc").select("name", "holder", "utxo")


@query("search_unfiltered_page", _sql("SELECT name, (SELECT count(*) FROM records) AS total FROM records ORDER BY name LIMIT 100 OFFSET 100"))
def search_unfiltered_page(spark, sf_dir):
    rows = records(spark, sf_dir)
    names = search.page(search.matches(rows, SearchSpec()), number=2, names_only=True)
    return names.select("name", search.total(rows).scalar().alias("total"))


@query("search_random")
def search_random(spark, sf_dir):
    return search.page(records(spark, sf_dir), size=100, sort="random", seed=7).select("name", "holder")


@query("search_with_defaults", _sql("""
WITH ranked AS (SELECT holder, name, row_number() OVER (PARTITION BY holder ORDER BY og_number = 0, og_number, length, created_slot_number, name) AS rn,
    min(CASE WHEN "default" THEN name END) OVER (PARTITION BY holder) AS explicit FROM records),
defaults AS (SELECT holder, coalesce(explicit, name) AS default_in_wallet FROM ranked WHERE rn = 1)
SELECT r.name, r.holder, d.default_in_wallet FROM (SELECT * FROM records WHERE rarity = 'basic' ORDER BY name LIMIT 100) r
JOIN defaults d ON d.holder = r.holder"""))
def search_with_defaults(spark, sf_dir):
    page, _total = search.search(records(spark, sf_dir), SearchSpec(rarity="basic"))
    return page.select("name", "holder", "default_in_wallet")


@query("search_slot_page", _sql("""
SELECT name, updated_slot_number, 'asc' AS direction FROM (SELECT * FROM records WHERE updated_slot_number >= 2000 ORDER BY updated_slot_number, name LIMIT 40)
UNION ALL SELECT name, updated_slot_number, 'desc' FROM (
  SELECT * FROM records WHERE updated_slot_number <= 2300 ORDER BY updated_slot_number DESC, name DESC LIMIT 40)"""))
def search_slot_page(spark, sf_dir):
    rows = records(spark, sf_dir)
    one = lambda slot, sort: search.slot_page(rows, slot, size=40, sort=sort).select(
        "name", "updated_slot_number", F.lit(sort).alias("direction"))
    return one(2000, "asc").unionByName(one(2300, "desc"))


@query("name_list_filter", _sql("""
SELECT name, holder FROM records WHERE name IN (SELECT name FROM names WHERE asset_id % 6 = 1) AND rarity = 'basic'""", "names"))
def name_list_filter(spark, sf_dir):
    listed = b.names(spark, sf_dir).filter(F.col("asset_id") % 6 == 1)
    return search.matches(records(spark, sf_dir), SearchSpec(rarity="basic", names=listed)).select("name", "holder")


@query("lookup_name", _sql("SELECT name, holder, utxo FROM records WHERE name IN ('-102', '53.5', 'nobody')"))
def lookup_name(spark, sf_dir):
    rows = records(spark, sf_dir).select("name", "holder", "utxo")
    return lookup.by_name(rows, "-102").unionByName(lookup.by_name(rows, "53.5")).unionByName(lookup.by_name(rows, "nobody"))


@query("lookup_hex_exact", _sql("""
SELECT name, hex FROM records WHERE name IN ('-102', '-187') AND hex IN ('000de1402d313032', '2d313837', '000de1402d313837', '2d313032')"""))
def lookup_hex_exact(spark, sf_dir):
    rows = records(spark, sf_dir).select("name", "hex")
    found = None
    for hex_name in ("000de1402d313032", "2d313032", "2d313837", "000de1402d313837"):  # every second one is a stale identity
        part = lookup.by_hex(rows, hex_name)
        found = part if found is None else found.unionByName(part)
    return found


def _customers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("holder"), "c_nationkey")


@query("reverse_lookup_holder", _sql("""
SELECT name, holder FROM records WHERE holder IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey = 3)
  OR key_digest IN (SELECT md5(CAST(c_custkey AS VARCHAR)) FROM customer WHERE c_nationkey IN (4))"""))
def reverse_lookup_holder(spark, sf_dir):
    customers = _customers(spark, sf_dir)
    direct = customers.filter("c_nationkey = 3").select(F.col("holder").alias("key"))
    hashed = customers.filter("c_nationkey = 4").select(assets.hex_of_name(F.col("holder")).alias("key"))
    return lookup.lookup(records(spark, sf_dir), direct.unionByName(hashed).filter("length(key) > 0"), "holder").select("name", "holder")


@query("reverse_lookup_key", _sql("""
SELECT name, 'stake' AS kind FROM records WHERE key_digest IN (SELECT md5(CAST(c_custkey AS VARCHAR)) FROM customer WHERE c_nationkey = 5 AND c_custkey % 2 = 0)
UNION ALL SELECT name, 'payment' FROM records WHERE payment_key_hash IN (SELECT md5(concat('pay', c_custkey)) FROM customer WHERE c_nationkey = 6)
UNION ALL SELECT name, 'address' FROM records WHERE address IN (SELECT concat('addr', c_custkey) FROM customer WHERE c_nationkey = 7)"""))
def reverse_lookup_key(spark, sf_dir):
    rows, customers = records(spark, sf_dir), _customers(spark, sf_dir)
    holder = F.col("holder")
    # Odd customers send a malformed key, which matches nothing.
    stake = customers.filter("c_nationkey = 5").select(
        F.concat(assets.hex_of_name(holder), F.when(holder.cast("int") % 2 == 1, "0").otherwise("")).alias("key"))
    payment = customers.filter("c_nationkey = 6").select(F.md5(F.concat(F.lit("pay"), holder)).alias("key"))
    address = customers.filter("c_nationkey = 7").select(F.concat(F.lit("addr"), holder).alias("key"))
    found = None
    for keys, kind, tag in ((stake, "stake_key_hash", "stake"), (payment, "payment_key_hash", "payment"), (address, "address", "address")):
        part = lookup.lookup(rows, keys, kind).select("name", F.lit(tag).alias("kind"))
        found = part if found is None else found.unionByName(part)
    return found


@query("reverse_lookup_hexlist", _sql("SELECT name, hex FROM records WHERE name IN (SELECT name FROM names WHERE asset_id % 8 = 2)", "names"))
def reverse_lookup_hexlist(spark, sf_dir):
    listed = b.names(spark, sf_dir).filter(F.col("asset_id") % 8 == 2)
    keys = listed.select(b.token_hex(F.col("name"), F.col("asset_id") % 3).alias("key"))
    return lookup.lookup(records(spark, sf_dir), keys, "hex").select("name", "hex")


_DEFAULTS = """WITH ranked AS (SELECT *, row_number() OVER (
    PARTITION BY holder ORDER BY og_number = 0, og_number, length, created_slot_number, name) AS rn,
    min(CASE WHEN "default" THEN name END) OVER (PARTITION BY holder) AS explicit, count(*) OVER (PARTITION BY holder) AS total FROM records)
"""


@query("default_name", _sql(_DEFAULTS + """
SELECT holder, coalesce(explicit, name) AS default_name, explicit IS NOT NULL AS manually_set FROM ranked WHERE rn = 1"""))
def default_name(spark, sf_dir):
    return holders.default_names(records(spark, sf_dir))


@query("owners_with_defaults", _sql(_DEFAULTS + """
SELECT r.name, r.holder, r.utxo, coalesce(d.explicit, d.name) AS default_in_wallet FROM records r
JOIN ranked d ON d.holder = r.holder AND d.rn = 1"""))
def owners_with_defaults(spark, sf_dir):
    """Who holds each name now, and what is each holder's default name?"""
    rows = records(spark, sf_dir)
    return holders.with_default_names(rows, rows).select("name", "holder", "utxo", "default_in_wallet")


@query("holder_ranking", _sql(_DEFAULTS + """
SELECT holder, total, coalesce(explicit, name) AS default_name, explicit IS NOT NULL AS manually_set
FROM ranked WHERE rn = 1 ORDER BY total DESC, holder DESC LIMIT 50 OFFSET 50"""))
def holder_ranking(spark, sf_dir):
    return holders.ranking(records(spark, sf_dir), number=2, size=50)


@query("holder_members", _sql(_DEFAULTS + """
SELECT r.holder, r.name FROM records r JOIN (SELECT holder FROM ranked WHERE rn = 1 ORDER BY total DESC, holder DESC LIMIT 20) p ON p.holder = r.holder"""))
def holder_members(spark, sf_dir):
    rows = records(spark, sf_dir)
    return holders.members(holders.ranking(rows, size=20), rows)


@query("holder_detail", _sql(_DEFAULTS + """
SELECT holder, total, coalesce(explicit, name) AS default_name, explicit IS NOT NULL AS manually_set FROM ranked WHERE rn = 1 AND holder = '118'"""))
def holder_detail(spark, sf_dir):
    return holders.detail(records(spark, sf_dir), "118")


@query("stats_totals", _sql("SELECT count(*) AS total_names, count(DISTINCT holder) AS total_holders FROM records"))
def stats_totals(spark, sf_dir):
    return holders.totals(records(spark, sf_dir))


@query("children_of_root", _sql("SELECT name, root, holder FROM records WHERE root = 'gear' AND handle_type = 'nft_subhandle'"))
def children_of_root(spark, sf_dir):
    return lookup.children(records(spark, sf_dir), "gear", "nft_subhandle").select("name", "root", "holder")


@query("root_listing", _sql("""
SELECT DISTINCT split_part(p_name, ' ', 2) AS name FROM part
WHERE split_part(p_name, ' ', 2) IN (SELECT root FROM records) AND length(split_part(p_name, ' ', 2)) % 2 = 0"""))
def root_listing(spark, sf_dir):
    """Roots open to the public; the words that names end in stand for the root records."""
    rows = records(spark, sf_dir).select("name", "root")
    words = table(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name")).distinct()
    every = rows.unionByName(words.withColumn("root", F.lit(None).cast("string")))
    off, on = F.struct(F.lit(False).alias("public_minting_enabled")), F.struct((F.length("name") % 2 == 0).alias("public_minting_enabled"))
    settings = F.struct(off.alias("nft"), on.alias("virtual"))
    return lookup.roots(every, lookup.public_minting(settings)).select("name")


@query("record_with_utxo", with_views("""
SELECT c.name, c.holder, c.utxo, o.assets AS out_assets, o.value AS out_value, p.assets AS ref_assets
FROM current_names c
LEFT JOIN (SELECT utxo, count(*) AS assets, CAST(sum(value) AS DECIMAL(38,2)) AS value FROM ledger GROUP BY utxo) o ON o.utxo = c.utxo
LEFT JOIN (SELECT utxo, count(*) AS assets FROM ledger GROUP BY utxo) p ON p.utxo = CASE WHEN c.asset_id % 3 = 0 THEN concat(c.asset_id, '#1') END""", "current_names", "ledger"))
def record_with_utxo(spark, sf_dir):
    outputs = b.ledger(spark, sf_dir).groupBy("utxo").agg(F.count("*").alias("assets"), F.sum("value").alias("value"))
    rows = b.current_names(spark, sf_dir).withColumn(
        "reference_utxo", F.when(F.col("asset_id") % 3 == 0, F.concat("asset_id", F.lit("#1"))))
    joined = lookup.with_outputs(rows, outputs, {"utxo": "out", "reference_utxo": "ref"}, ["assets", "value"])
    return joined.select("name", "holder", "utxo", "out_assets", "out_value", "ref_assets")


@query("datum_lookup", _sql("""
SELECT name, CASE WHEN asset_id % 2 = 0 THEN concat('d', value) END AS datum FROM records WHERE name IN ('-102', '53.5')"""))
def datum_lookup(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("has_datum", F.col("asset_id") % 2 == 0).withColumn("datum", F.concat(F.lit("d"), "value"))
    return lookup.datum_of(rows, "-102").unionByName(lookup.datum_of(rows, "53.5"))


@query("utxos_from_slot", with_views("SELECT utxo, asset_id, slot FROM ledger WHERE slot >= 1800 OR (utxo = '77#1' AND slot < 1800)", "ledger"))
def utxos_from_slot(spark, sf_dir):
    rows = b.ledger(spark, sf_dir).select("utxo", "asset_id", "slot")
    one = rows.filter((F.col("utxo") == "77#1") & (F.col("slot") < 1800))
    return lookup.outputs_from_slot(rows, 1800).unionByName(one)


@query("content_enrichment", """
SELECT d.doc_id, d.lang, CASE WHEN d.doc_id % 3 <> 0 AND q.doc_id IS NOT NULL THEN concat(q.quality, '/', q.toxic) END AS portal_content,
  CASE WHEN s.doc_id IS NOT NULL THEN concat(s.quality, '/', s.toxic) END AS designer_content
FROM documents d LEFT JOIN labels q ON q.doc_id = d.doc_id LEFT JOIN labels s ON s.doc_id = d.doc_id + 1""")
def content_enrichment(spark, sf_dir):
    doc = F.col("doc_id")
    content = table(spark, sf_dir, "labels").select(doc.cast("string").alias("cid"), F.concat_ws("/", "quality", "toxic").alias("json"))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", F.concat(F.when(doc % 3 == 0, "https://").otherwise("ipfs://"), doc).alias("portal"),
        F.concat(F.lit("ipfs://"), doc + 1).alias("designer"))
    return lookup.with_content(rows, content, ["portal", "designer"]).select("doc_id", "lang", "portal_content", "designer_content")


@query("listings_price", _sql("""
SELECT name, hex, label, policy, utxo, holder, owner, payout_address, price, slot FROM (
  SELECT r.name, r.hex, CASE WHEN asset_id % 2 = 0 THEN '000de140' ELSE '' END AS label, 'p0' AS policy, r.utxo,
    CASE WHEN asset_id % 3 = 0 THEN concat('stake', r.holder) ELSE concat('own', r.holder) END AS holder, concat('own', r.holder) AS owner,
    concat('pay', asset_id) AS payout_address, CAST(floor(value) AS BIGINT) + asset_id AS price, updated_slot_number AS slot
  FROM records r WHERE asset_id % 4 = 1 AND asset_id % 5 <> 0 AND asset_id % 7 <> 0 AND asset_id % 11 <> 0 AND contains(name, '123') = false
    AND contains(lower(name), '@') = false)"""))
def listings_price(spark, sf_dir):
    rows = records(spark, sf_dir).withColumn("policy", F.lit(b.TRACKED_POLICY))
    key = F.col("asset_id")
    payout = lambda address, amount: F.struct(address.alias("address"), amount.alias("lovelace"))
    payouts = F.array(
        payout(F.concat(F.lit("pay"), key), F.floor("value").cast("bigint")),
        payout(F.lit("royalty"), F.when(key % 11 == 0, -1).otherwise(key)),  # a negative payout spoils the listing
    )
    outputs = rows.select(
        "utxo", F.when(key % 4 == 1, "market").otherwise("elsewhere").alias("validator"), F.col("updated_slot_number").alias("slot"),
        F.array(F.struct("policy", F.when(key % 5 == 0, "00").otherwise(F.col("hex")).alias("hex"))).alias("assets"),
        F.when(key % 7 == 0, 2).otherwise(1).alias("constructors"), F.concat(F.lit("own"), "holder").alias("owner"),
        F.when(key % 3 == 0, F.concat(F.lit("stake"), "holder")).alias("listing_holder"), payouts.alias("payouts"),
    )
    markets = rows.select(F.lit("market").alias("validator")).distinct()
    listed = catalog.listings(rows.filter(~F.col("name").contains("123") & ~F.col("name").contains("@")), outputs, markets)
    return listed.withColumn("price", F.col("price").cast("bigint"))


@query("latest_per_family", """
WITH parsed AS (SELECT concat(lower(p_type), p_partkey, '@contract') AS name, lower(p_type) AS family, CAST(p_partkey AS BIGINT) AS ordinal,
    concat('script', p_size) AS script_address FROM part WHERE p_partkey % 9 <> 0 AND lower(p_type) LIKE 's%'),
marked AS (SELECT *, ordinal = max(ordinal) OVER (PARTITION BY family) AS latest FROM parsed)
SELECT script_address, name, family, ordinal, latest FROM (
  SELECT *, row_number() OVER (PARTITION BY script_address ORDER BY NOT latest, family, -ordinal, name) AS rn FROM marked) WHERE rn = 1""")
def latest_per_family(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lower("p_type"), "p_partkey", F.lit("@contract")).alias("name"), F.concat(F.lit("script"), "p_size").alias("script_address"),
        F.when(F.col("p_partkey") % 9 != 0, "4e").alias("cbor"))
    return catalog.latest_scripts(rows, "contract", "s")


@query("validator_set", "SELECT DISTINCT md5(p_brand) AS validator FROM part WHERE lower(p_type) = 'economy'")
def validator_set(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.lower("p_type").alias("family"), F.md5("p_brand").alias("validator"))
    return catalog.validators(rows, "economy")


@query("record_view", _sql("""
SELECT name, hex, holder, rarity, og_number, og_number > 0 AS og, utxo, concat('aa', asset_id % 4) AS image_hash,
  CASE WHEN asset_id % 3 = 0 THEN concat('bb', asset_id) END AS bg_asset, '0' AS svg_version, 0 AS version,
  asset_id % 4 <> 1 OR asset_id % 3 = 0 AS is_personalized,
  CASE WHEN asset_id % 10 = 0 THEN false WHEN handle_type = 'handle' THEN true END AS pz_enabled, length, characters, handle_type, '' AS image
FROM records WHERE asset_id % 23 <> 0"""))
def record_view(spark, sf_dir):
    key = F.col("asset_id")
    text = lambda value=None: F.lit(value).cast("string")
    rows = records(spark, sf_dir).select(
        "*", F.concat(F.lit("0xaa"), key % 4).alias("image_hash"), F.lit("0xaa1").alias("standard_image_hash"),
        F.when(key % 3 == 0, F.concat(F.lit("0xbb"), key)).alias("bg_asset"), F.when(key % 10 == 0, False).alias("pz_enabled"),
        text().alias("svg_version"), F.lit(None).cast("int").alias("version"), F.create_map(F.lit("ada"), F.col("address")).alias("resolved_addresses"),
        F.lit(b.TRACKED_POLICY).alias("policy"), F.lit(False).alias("has_datum"), F.lit(None).cast("bigint").alias("last_edited_time"),
        *[text().alias(c) for c in ("image", "standard_image", "pfp_image", "pfp_asset", "bg_image", "designer", "portal", "socials",
                                    "last_update_address", "original_address", "virtual")],
    ).withColumn("utxo", F.when(key % 23 == 0, "").otherwise(F.col("utxo")))
    return view(rows).select(
        "name", "hex", "holder", "rarity", "og_number", "og", "utxo", "image_hash", "bg_asset", "svg_version", "version", "is_personalized",
        "pz_enabled", "length", "characters", "handle_type", "image")


@query("registry_listing", """
SELECT name, labels FROM (SELECT l_partkey AS name, string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) FILTER (WHERE l_returnflag <> 'N' AND l_quantity > 47) AS labels
FROM lineitem GROUP BY l_partkey) WHERE labels <> ''""")
def registry_listing_of_flags(spark, sf_dir):
    flags = F.when(F.col("l_quantity") > 47, F.col("l_returnflag"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("name"), flags.alias("flag"))
    return registry_listing(state.label_sets(rows, "name", "flag", ("A", "R")), "labels")
