"""Reconciliation, repair, chain and search operators on small frames."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from namefold.functions import assets
from namefold.operators import catalog, chain, fingerprint, lookup, normalize, reconcile, repair, search
from namefold.operators.joins import left_lookup
from namefold.operators.search import SearchSpec


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def names(df, column="name"):
    return sorted(r[column] for r in df.collect())


def test_ownership_audit(spark):
    stored = frame(spark, "name string, policy string, hex string, utxo string",
                   *[(n, "p", n, f"{n}#0") for n in ("same", "other", "absent", "two", "sold")])
    rows = frame(spark, "policy string, hex string, utxo string, quantity int", ("p", "same", "same#0", 1), ("p", "same", "same#0", 1),
                 ("p", "other", "other#1", 1), ("p", "two", "two#0", 1), ("p", "two", "two#1", 1), ("p", "sold", "sold#0", 0), ("q", "absent", "absent#0", 1))
    out = {r["name"]: r["status"] for r in reconcile.ownership_audit(stored, rows).collect()}
    assert out == {"same": "ok", "other": "mismatch", "absent": "unresolved", "two": "unresolved", "sold": "unresolved"}


BLOCKS = "height bigint, slot bigint, hash string, parent string"


def test_ancestry(spark):
    main = [(i, i * 10, f"m{i}", f"m{i - 1}") for i in range(1, 100)]
    fork = [(i, i * 10 + 1, f"f{i}", f"f{i - 1}" if i > 91 else "m90") for i in range(91, 100)]
    blocks = frame(spark, BLOCKS, *main, *fork)
    found = chain.common_ancestor(blocks, "m99", "f99").first()
    assert (found["hash"], found["old_depth"], found["new_depth"]) == ("m90", 9, 9)
    assert chain.common_ancestor(blocks, "m99", "f99", depth=5).isEmpty()
    walk = chain.ancestors(blocks, "m99")
    assert walk.count() == 65 and walk.agg(F.max("depth")).first()[0] == 64
    assert chain.descends_from(walk, "m40", 400).first()["descends"] and not chain.descends_from(walk, "m34", 340).first()["descends"]
    assert not chain.descends_from(walk, "m40", 401).first()["descends"]


def test_ancestry_needs_falling_slots(spark):
    blocks = frame(spark, BLOCKS, (1, 10, "a", None), (2, 30, "b", "a"), (3, 30, "c", "b"))
    assert names(chain.ancestors(blocks, "c"), "hash") == ["c"]


def test_coverage_stops_at_the_first_incomplete_block(spark):
    blocks = frame(spark, "height bigint, slot bigint, hash string, tx_count double",
                   (1, 1, "a", 2.0), (2, 2, "b", 0.0), (3, 3, "c", 1.0), (4, 4, "d", 1.5), (5, 5, "e", None), (6, 6, "f", -1.0), (7, 7, "g", 1.0))
    found = frame(spark, "hash string, tx_id string", ("a", "1"), ("a", "2"), ("a", "2"), ("c", "3"), ("g", "4"))
    got = frame(spark, "hash string, tx_id string", ("a", "1"), ("a", "2"), ("b", "3"), ("g", "4"))
    covered = chain.coverage(blocks, found, got)
    assert {r["hash"]: r["status"] for r in covered.collect()} == {
        "a": "complete", "b": "complete", "c": "payload_incomplete", "d": "bad_count", "e": "bad_count", "f": "bad_count", "g": "complete"}
    assert chain.cursor_after(covered).first()["hash"] == "b"
    assert chain.cursor_after(covered.filter("height > 2")).isEmpty()


def test_missed_blocks_need_a_canonical_cursor(spark):
    canonical = frame(spark, "height bigint, slot bigint, hash string", (1, 1, "a"), (2, 2, "b"), (3, 3, "c"))
    scanned = frame(spark, "slot bigint, hash string", (1, "a"))
    assert names(reconcile.missed_blocks(canonical, scanned, (2, "b")), "hash") == ["b"]
    assert reconcile.missed_blocks(canonical, scanned, (2, "x")).isEmpty()


def test_fingerprint_ignores_order_blanks_and_repeats(spark):
    rows = [(f"n{i}", "") for i in range(50)]
    one = fingerprint.total_digest(fingerprint.bucket_digests(frame(spark, "name string, labels string", *rows))).first()
    two = fingerprint.total_digest(fingerprint.bucket_digests(
        frame(spark, "name string, labels string", ("", ""), (" n3 ", ""), *reversed(rows)))).first()
    three = fingerprint.total_digest(fingerprint.bucket_digests(
        frame(spark, "name string, labels string", *rows[1:], ("n0", assets.LABEL_SETTINGS)))).first()
    assert one == two and one != three


def test_a_copy_that_is_behind_never_agrees(spark):
    digest = fingerprint.bucket_digests(frame(spark, "name string, labels string", ("a", "")))
    agrees = lambda **at: fingerprint.compare(digest, digest, digest, **at).first()["agrees"]
    assert agrees(ours_at=5, external_at=5) and not agrees(ours_at=5, external_at=4)
    assert fingerprint.compare(digest, digest, digest.filter("false"), ours_at=5, external_at=5).first()["agrees"] is None


def test_net_delta_drops_transfers(spark):
    rows = lambda *r: frame(spark, "tx string, asset string, quantity decimal(38,0)", *r)
    from decimal import Decimal as D
    out = normalize.net_asset_delta(rows(("t", "a", D(3)), ("t", "b", D(1))), rows(("t", "a", D(3)), ("t", "c", D(2))), ["tx", "asset"])
    assert {(r["asset"], int(r["quantity"])) for r in out.collect()} == {("b", 1), ("c", -2)}


def test_first_non_null_wins_per_field(spark):
    rows = frame(spark, "tx string, n int, datum string, script string, hex string", ("t", 1, None, "s1", "a"), ("t", 2, "d2", "s2", "b"), ("t", 3, "d3", None, "a"))
    out = normalize.merge_output_records(rows, ["tx"], ["n"], ["datum", "script"]).first()
    assert (out["datum"], out["script"], out["assets"]) == ("d2", "s1", 2)
    assert names(normalize.merged_tokens(rows.withColumn("policy", F.lit("p")), ["tx"]), "hex") == ["a", "b"]


def test_failed_transactions(spark):
    schema = "tx_hash string, block_hash string, height bigint, successful boolean"
    assert names(normalize.drop_failed(frame(spark, schema, ("a", "b", 1, True), ("c", "b", 1, False), ("d", "b", 1, None))), "tx_hash") == ["a", "d"]
    with pytest.raises(Exception, match="without hash"):
        normalize.drop_failed(frame(spark, schema, (None, "b", 1, True))).collect()


RECORDS = "name string, hex string, holder string, length int, rarity string, characters string, og_number int, is_personalized boolean, updated_slot_number bigint, utxo string"


def record(name, holder="h", slot=1, og=0, pz=False):
    return (name, name.encode().hex(), holder, len(name), "common", "letters", og, pz, slot, f"{name}#0")


def test_search_terms(spark):
    rows = frame(spark, RECORDS, record("burrito"), record("taco", "x", 5, og=3), record("barbacoa", "x", 9, pz=True), record("salsa"))
    found = lambda **terms: names(search.matches(rows, SearchSpec(**terms)))
    assert found(text="bur") == ["burrito"] and found(length="27-28") == [] and found(length="4-5") == ["salsa", "taco"]
    assert found(length="0") == found(og=False, personalized=False, rarity="") == ["barbacoa", "burrito", "salsa", "taco"]
    assert found(text="7461636f") == ["taco"] and found(text="BUR") == []
    assert found(holder="x", og=True) == ["taco"] and found(personalized=True) == ["barbacoa"] and found(holder="nobody") == []
    assert found(names=frame(spark, "name string", ("taco",), ("none",))) == ["taco"]
    assert search.total(search.matches(rows, SearchSpec(holder="x"))).first()["total"] == 2
    assert [r["name"] for r in search.page(rows, number=2, size=2).collect()] == ["salsa", "taco"]
    assert [r["name"] for r in search.slot_page(rows, 5, sort="desc").collect()] == ["taco", "salsa", "burrito"]
    assert search.slot_page(rows, 99, sort="asc").isEmpty()
    with pytest.raises(ValueError):
        search.page(rows, size=251)


def test_lookup_ignores_malformed_keys(spark):
    rows = frame(spark, "name string, holder string, key_digest string, payment_key_hash string, address string",
                 ("a", "h1", None, "p1", "x1"), ("b", "h2", "187ef4436122d1cc2f40dc2b92f0eba0", "p2", "x2"))
    keys = lambda *k: frame(spark, "key string", *[(i,) for i in k])
    found = lambda kind, *k: names(lookup.lookup(rows, keys(*k), kind))
    assert found("holder", "h1", "6162", "h1") == ["a", "b"] and found("stake_key_hash", "6162", "616") == ["b"]
    assert found("payment_key_hash", "p1") == ["a"] and found("address", "x2", "x9") == ["b"]
    assert found("hex", "p.000643b061", "62", "zz") == ["a", "b"] and found("name", "a") == ["a"]
    with pytest.raises(ValueError):
        found("colour", "x")


def test_listings(spark):
    rows = frame(spark, "name string, hex string, policy string, utxo string",
                 *[(n, n.encode().hex(), "p", f"{n}#0") for n in ("good", "two", "bad", "gone", "empty")])
    schema = ("utxo string, validator string, slot bigint, assets array<struct<policy:string,hex:string>>, constructors int, owner string,"
              " listing_holder string, payouts array<struct<address:string,lovelace:bigint>>")
    out = lambda n, k, payouts: (f"{n}#0", "v", 900, [("p", n.encode().hex())], k, "own", None, payouts)
    outputs = frame(spark, schema, out("good", 1, [("a", 5_000_000), ("b", 2_000_000)]), out("two", 2, [("a", 1)]), out("bad", 1, [("a", -1)]), out("empty", 1, []))
    found = lambda **f: catalog.listings(rows, outputs, frame(spark, "validator string", ("v",)), **f).collect()
    (row,) = found()
    assert (row["name"], int(row["price"]), row["slot"], row["payout_address"]) == ("good", 7_000_000, 900, "a")
    assert len(found(holder="own", text="GOO")) == 1 and not found(holder="other") and not found(text="xyz")


def test_first_writer_keeps_a_script_address(spark):
    rows = frame(spark, "name string, script_address string, cbor string", ("pers1@root", "s1", "00"), ("pers2@root", "s1", "00"),
                 ("pers3@root", "s3", None), ("other1@root", "s2", "00"), ("nodigits@root", "s4", "00"), ("pers9@else", "s5", "00"))
    out = {r["script_address"]: (r["name"], r["latest"]) for r in catalog.latest_scripts(rows, "root").collect()}
    assert out == {"s1": ("pers2@root", True), "s2": ("other1@root", True)}


def test_repoint_and_apply(spark):
    records = frame(spark, "name string, settings_utxo string", ("a", "aa#0"), ("b", "bb#0"), ("c", None))
    updates = frame(spark, "name string, utxo string", ("a", "bb#0"), ("b", "bb#0"), ("c", "bb#0"), ("d", "bb#0"), ("a", "cc#0"), ("b", "oops"), (" ", "bb#0"))
    classed = repair.repoint(records, updates, frame(spark, "utxo string", ("aa#0",), ("bb#0",)))
    got = sorted((r["name"], r["to_utxo"], r["status"]) for r in classed.collect())
    assert got == [(" ", "bb#0", "invalid"), ("a", "bb#0", "updated"), ("a", "cc#0", "missing"), ("b", "bb#0", "unchanged"), ("b", "oops", "invalid"),
                   ("c", "bb#0", "missing"), ("d", "bb#0", "missing")]
    assert {r["name"]: r["settings_utxo"] for r in repair.apply_repoint(records, classed).collect()} == {"a": "bb#0", "b": "bb#0", "c": None}


def test_precheck_of_a_sound_plan_has_no_violations(spark):
    targets = frame(spark, "name string, policy string, hex string", ("a", "p", "a"), ("b", "p", "b"))
    records = targets.withColumn("utxo", F.concat("name", F.lit("#0")))
    held = records.select("utxo", "policy", "hex")
    assert {r["violations"] for r in repair.precheck(targets, records, held, held, held).collect()} == {0}
    out = repair.precheck(targets.limit(0), records, held, held, held.limit(0))
    assert {r["rule"]: r["violations"] for r in out.collect()}["empty_plan"] == 1


def test_output_disagreements_see_swapped_assets(spark):
    schema = "utxo string, address string, value bigint, policy string, hex string, quantity int"
    rows = frame(spark, schema, ("u", "a", 1, "p", "x", 1), ("u", "a", 1, "p", "y", 2), ("w", "a", 1, "p", "x", 1))
    swapped = frame(spark, schema, ("u", "a", 1, "p", "x", 2), ("u", "a", 1, "p", "y", 1), ("w", "a", 1, "p", "x", 1))
    assert reconcile.output_disagreements(rows, rows).isEmpty()
    assert [tuple(r) for r in reconcile.output_disagreements(rows, swapped).collect()] == [("u", "assets")]


def test_rows_without_a_key_keep_their_place_in_lookups(spark):
    rows = frame(spark, "n int, k string", (1, "a"), (2, None), (3, None), (4, "z")).withColumn("m", F.create_map(F.lit("x"), "n"))
    side = frame(spark, "k string, v int", ("a", 10), (None, 20))
    out = {r["n"]: (r["k"], r["v"]) for r in left_lookup(rows, side, "k").collect()}
    assert out == {1: ("a", 10), 2: (None, None), 3: (None, None), 4: ("z", None)}


def test_constraints_pass_over_a_table_once(spark):
    from namefold.operators import reconcile

    rows = spark.createDataFrame([(1,), (None,), (7,)], "n int")
    found = reconcile.broken_rows(rows, {"big": F.col("n") > 5, "none": F.col("n").isNull(), "never": F.lit(False)})
    assert {tuple(r) for r in found.collect()} == {("big", 1), ("none", 1), ("never", 0)}
