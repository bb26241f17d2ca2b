"""The fold against a plain step-by-step state machine, and its named cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from namefold.functions import assets
from namefold.operators import facets, holders, scan, state
from namefold.operators.records import view

LABELS = {"owner": assets.LABEL_OWNER, "plain": None, "virtual": assets.LABEL_VIRTUAL, "settings": assets.LABEL_SETTINGS,
          "reference": assets.LABEL_REFERENCE, "other": assets.LABEL_002}
PZ = '[{"image":"img","og_number":7},1,{"image_hash":"h","default":%s,"resolved_addresses":{"btc":"b"}}]'
SETTINGS = '[[1,0,"t","s",1],[0,1,"u","v",0],5,2,3,"terms",0,"pay"]'


def event(name, kind, slot, n=0, *, mint=False, holder="h", datum=None, label=None):
    token = LABELS.get(label or kind)
    body = name.encode().hex()
    real = "owner" if kind == "plain" else kind
    rank = {"burn": 0, "label_burn": 1}.get(kind, 2 if token == assets.LABEL_OWNER else 3)
    owner_hex = body if token is None else ((assets.LABEL_VIRTUAL if token == assets.LABEL_VIRTUAL else assets.LABEL_OWNER) + body)
    utxo = None if kind in state.BURNS else f"t{slot}#{n}"
    return (name, "p", token, (token or "") + body, owner_hex, real, slot, rank, n, n, utxo, f"addr_{holder}", holder, None, None, datum, mint, "datum_" + holder)


def fold(spark, rows, prior=None, **options):
    events = state.prepare(spark.createDataFrame(rows, state.EVENT_SCHEMA))
    mints = events.filter("is_mint").select(
        "name", F.col("slot").alias("created_slot"), F.lit("t").alias("tx_hash"), F.lit("{}").alias("metadata"))
    return state.fold(events, mints, prior, width=options.pop("width", 3), strict=options.pop("strict", False), **options)


def by_name(df):
    return {r["name"]: r for r in df.collect()}


def test_named_cases(spark):
    rows = [
        # migration: the plain token is burned and a 222 token minted in one block
        event("migrated", "plain", 1, mint=True), event("migrated", "burn", 5, label="plain"), event("migrated", "owner", 5, 1, mint=True),
        event("migrated", "reference", 5, 2, datum=PZ % "false"),
        # a second copy survives one burn
        event("twice", "owner", 1, mint=True), event("twice", "owner", 2, mint=True), event("twice", "burn", 3),
        # out of order rows end at the newest output; content survives the move
        event("moved", "owner", 9, holder="new"), event("moved", "owner", 1, mint=True), event("moved", "reference", 2, datum=PZ % "true"),
        event("gone", "owner", 1, mint=True), event("gone", "burn", 2),
        # settings and labels
        event("tagged", "owner", 1, mint=True), event("tagged", "settings", 2, datum=SETTINGS), event("tagged", "other", 3),
        event("untagged", "owner", 1, mint=True), event("untagged", "settings", 2), event("untagged", "label_burn", 3, label="settings"),
        event("skipped", "reference", 4),
        event("sub@root", "virtual", 3, datum=PZ % "false", mint=True),
    ]
    out = by_name(fold(spark, rows))
    assert set(out) == {"migrated", "twice", "moved", "tagged", "untagged", "sub@root"}
    assert (out["migrated"]["amount"], out["migrated"]["utxo"], out["migrated"]["reference_utxo"]) == (1, "t5#1", "t5#2")
    assert out["migrated"]["hex"].startswith(assets.LABEL_OWNER) and out["migrated"]["created_slot_number"] == 1
    assert out["twice"]["amount"] == 1
    moved = out["moved"]
    assert (moved["holder"], moved["updated_slot_number"], moved["created_slot_number"], moved["image"]) == ("new", 9, 1, "img")
    assert moved["resolved_addresses"] == {"ada": "addr_new", "btc": "b"} and moved["default"] is False
    assert out["tagged"]["registry_labels"] == assets.LABEL_SETTINGS + assets.LABEL_002
    assert out["tagged"]["settings"]["settings"]["buy_down_price"] == 5 and out["tagged"]["updated_slot_number"] == 2
    assert out["untagged"]["registry_labels"] == "" and out["untagged"]["updated_slot_number"] == 1
    assert out["sub@root"]["handle_type"] == "virtual_subhandle" and out["sub@root"]["utxo"] == "t3#0"


def test_prior_amount_of_a_migrated_name_drops_to_one(spark):
    start = fold(spark, [event("epic", "plain", 1, mint=True), event("epic", "plain", 2, mint=True)])
    assert by_name(start)["epic"]["amount"] == 2
    step = fold(spark, [event("epic", "burn", 5, label="plain"), event("epic", "owner", 5, 1, mint=True)], start)
    assert by_name(step)["epic"]["amount"] == 1 and by_name(step)["epic"]["hex"].startswith(assets.LABEL_OWNER)


def random_events(seed):
    rng = random.Random(seed)
    rows = []
    for name in [f"n{i}" for i in range(12)] + ["hot"]:
        hot = name == "hot"
        for slot in sorted(rng.sample(range(1, 400), 160 if hot else rng.randint(1, 25))):
            kind = rng.choices(["owner", "plain", "burn", "settings", "reference", "other", "label_burn"], [6, 3, 3, 1, 2, 1, 1])[0]
            datum = {"settings": SETTINGS, "reference": PZ % rng.choice(["true", "false"])}.get(kind) if rng.random() < 0.7 else None
            rows.append(event(name, kind, slot, mint=kind in ("owner", "plain") and rng.random() < 0.5, holder=f"h{rng.randint(0, 3)}",
                              datum=datum, label="settings" if kind == "label_burn" else None))
    return rows


def machine(rows):
    """The rules one event at a time."""
    states = {}
    for row in sorted(rows, key=lambda r: (r[0], r[6], r[7], r[8], r[9], r[3])):
        name, _p, token, _hex, owner_hex, kind, slot, *_ = row
        utxo, address, datum, mint = row[10], row[11], row[15], row[16]
        if kind == "reference" and datum is None:
            continue
        now = states.get(name)
        if kind == "burn":
            if now:
                now["amount"] -= 1
                if now["amount"] <= 0:
                    del states[name]
            continue
        if kind == "label_burn":
            if now:
                now["labels"].discard(token)
            continue
        new = now is None
        if new:
            now = states[name] = {"amount": 1, "hex": owner_hex, "owner_seen": None, "utxo": "", "labels": set(), "image": "",
                                  "updated": slot, "address": "" if kind == "reference" else address}
        if kind == "owner":
            if mint and now["utxo"] and now["hex"] == owner_hex:
                now["amount"] += 1
            now |= {"hex": owner_hex, "utxo": utxo, "updated": slot, "address": address}
        if kind == "settings" and datum:
            now["updated"] = slot
        if kind == "reference":
            now["image"] = "img"
        if token in assets.REGISTRY_LABELS:
            now["labels"].add(token)
        now["default"] = kind == "reference" and '"default":true' in datum
    return states


def seen(rows):
    return {
        r["name"]: (r["amount"], r["hex"], r["utxo"], r["updated_slot_number"], r["address"], r["registry_labels"], r["image"], r["default"])
        for r in rows.values()
    }


def expected(states):
    return {n: (s["amount"], s["hex"], s["utxo"], s["updated"], s["address"], "".join(sorted(s["labels"])), s["image"], s["default"])
            for n, s in states.items()}


@pytest.mark.parametrize("width", [7, 50_000])
def test_random_lifecycles(spark, width):
    rows = random_events(3)
    assert seen(by_name(fold(spark, rows, width=width))) == expected(machine(rows))


def test_batches_in_order_give_the_rebuild(spark):
    rows = random_events(5)
    cut = [[r for r in rows if lo <= r[6] < lo + 200] for lo in (0, 200)]
    first = fold(spark, cut[0])
    second = fold(spark, cut[1], first)
    stepped = by_name(first) | {n: r for n, r in by_name(second).items()}
    gone = {n for n, r in by_name(second).items() if not r["exists"]}
    assert seen({n: r for n, r in stepped.items() if n not in gone}) == expected(machine(rows))


def test_late_rows_never_overwrite(spark):
    start = fold(spark, [event("late", "owner", 10, mint=True, holder="now")])
    step = by_name(fold(spark, [event("late", "owner", 4, mint=True, holder="old"), event("late", "settings", 5, datum=SETTINGS)], start))["late"]
    assert (step["holder"], step["updated_slot_number"], step["created_slot_number"]) == ("now", 10, 4)
    assert step["registry_labels"] == assets.LABEL_SETTINGS and step["settings"] is None
    equal = by_name(fold(spark, [event("late", "owner", 10, 1, holder="again")], start))["late"]
    assert equal["holder"] == "again"


def test_net_effect_of_a_block(spark):
    outputs = spark.createDataFrame([("a#0", 1), ("b#0", 1), ("c#0", 1)], "utxo string, slot bigint")
    inputs = spark.createDataFrame([("a#0", 1), ("b#0", 2)], "utxo string, slot bigint")
    assert {r["utxo"] for r in state.net_of_block(outputs, inputs).collect()} == {"b#0", "c#0"}
    assert {r["utxo"] for r in state.live_outputs(outputs, inputs).collect()} == {"c#0"}


def test_chunked_scans_equal_a_plain_walk(spark):
    rng = random.Random(11)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 9)}", i, rng.choice([-1, 0, 1]), rng.choice([None, 0, 1])) for i in range(600)]
    df = scan.with_chunk(spark.createDataFrame(rows, "k string, i bigint, a int, f int"), "i", 37)
    counted = scan.with_counter(df, ["k"], ["i"], F.col("a"), F.col("f"), "x")
    out = {r["i"]: (r["x"], r["before"]) for r in scan.with_previous(counted, ["k"], ["i"], {"i": "before"}).collect()}
    value, last = {}, {}
    for key, i, add, floor in rows:
        value[key] = value.get(key, 0) + add
        if floor is not None:
            value[key] = max(value[key], floor)
        assert out[i] == (value[key], last.get(key))
        last[key] = i


def test_default_names(spark):
    rows = [("og1", "a", 124, 5), ("og2", "a", 123, 9), ("x", "a", 0, 1), ("long", "b", 0, 1), ("abc", "b", 0, 9), ("10", "c", 0, 3), ("11", "c", 0, 3)]
    df = spark.createDataFrame(rows, "name string, holder string, og_number bigint, created_slot_number bigint")
    assert {r["holder"]: r["default_name"] for r in holders.default_names(df).collect()} == {"a": "og2", "b": "abc", "c": "10"}


def test_moved_names_leave_no_index_entry(spark):
    rng = random.Random(1)
    owner = {f"n{i}": f"h{rng.randint(0, 20)}" for i in range(300)}
    stored = dict(owner)
    for name in rng.sample(sorted(owner), 120):
        owner[name] = f"h{rng.randint(0, 20)}"
    make = lambda d: facets.facet_rows(spark.createDataFrame(list(d.items()), "name string, holder string"), {"holder": "holder"})
    assert facets.index_differences(make(owner), make(owner)).count() == 0
    changed = sum(stored[n] != owner[n] for n in owner)
    assert facets.index_differences(make(stored), make(owner)).count() == 2 * changed


def test_listed_numbers_yield_to_the_datum(spark):
    listed = spark.createDataFrame([("old", 3), ("own", 4)], "name string, og_number bigint")
    rows = [event("old", "owner", 1, mint=True), event("own", "owner", 1, mint=True), event("own", "reference", 2, datum=PZ % "false"),
            event("new", "owner", 1, mint=True)]
    assert {n: r["og_number"] for n, r in by_name(fold(spark, rows, og_list=listed)).items()} == {"old": 3, "own": 7, "new": 0}


def test_view_of_folded_records(spark):
    rows = [event("plain", "owner", 1, mint=True), event("art", "owner", 1, mint=True), event("art", "reference", 2, datum=PZ % "false"),
            event("sub@root", "owner", 1, mint=True), event("pending", "settings", 1, datum=SETTINGS)]
    out = by_name(view(fold(spark, rows)))
    assert set(out) == {"plain", "art", "sub@root"}  # no output, no view
    assert out["plain"]["pz_enabled"] and out["sub@root"]["pz_enabled"] is None
    assert out["art"]["is_personalized"] and not out["plain"]["is_personalized"] and out["sub@root"]["sub_length"] == 3


def test_virtual_token_belongs_where_its_datum_says(spark):
    datum = '[{"image":"i"},1,{"resolved_addresses":{"ada":"0xfeed","btc":"b"}}]'
    out = by_name(fold(spark, [event("sub@root", "virtual", 3, datum=datum, mint=True, holder="contract")]))["sub@root"]
    assert (out["address"], out["holder"]) == ("feed", "datum_contract")
    assert out["resolved_addresses"] == {"ada": "feed", "btc": "b"}
    bare = by_name(fold(spark, [event("sub@root", "virtual", 3, mint=True, holder="contract")]))["sub@root"]
    assert (bare["address"], bare["holder"]) == ("addr_contract", "contract")


def test_two_assets_of_one_output_are_no_double_mint(spark):
    first = event("one", "owner", 1, mint=True)
    other = (*first[:1], "q", *first[2:])
    assert by_name(fold(spark, [first, other]))["one"]["amount"] == 1
    start = fold(spark, [first])
    assert by_name(fold(spark, [first], start))["one"]["amount"] == 1
    assert by_name(fold(spark, [first, event("one", "owner", 2, mint=True)]))["one"]["amount"] == 2


def test_a_name_without_mint_record_stops_the_fold(spark):
    with pytest.raises(state.MissingMintError, match="stray"):
        fold(spark, [event("stray", "owner", 1), event("known", "owner", 1, mint=True)], strict=True)
    assert set(by_name(fold(spark, [event("known", "owner", 1, mint=True), event("gone", "burn", 2)], strict=True))) == {"known"}


def test_members_of_more_holders_than_a_page(spark):
    records = spark.range(400).select(F.concat(F.lit("h"), "id").alias("holder"), F.concat(F.lit("n"), "id").alias("name"))
    assert holders.members(records.select("holder"), records).count() == 400


def test_long_names_keep_all_their_letters(spark):
    long = "61" * (1 << 20)
    row = spark.createDataFrame([(assets.LABEL_REFERENCE + long,)], "h string").select(F.length(assets.owner_hex_of(F.col("h"))).alias("o")).first()
    assert row["o"] == 8 + len(long)


@pytest.mark.parametrize("rows_of_hot_names", [20, 1_000_000])
def test_hot_names_by_slot_ranges_equal_one_pass(spark, monkeypatch, rows_of_hot_names):
    monkeypatch.setattr(state, "HOT_ROWS", rows_of_hot_names)
    rows = random_events(8)
    assert seen(by_name(fold(spark, rows, width=7))) == expected(machine(rows))
    events = state.prepare(spark.createDataFrame(rows, state.EVENT_SCHEMA))
    few, hot = state._by_size(events)
    assert (hot is None) == (rows_of_hot_names > 160)
    if hot is not None:
        assert {r["name"] for r in hot.select("name").distinct().collect()} >= {"hot"}
    assert {tuple(r) for r in state.double_mints(events, width=7).collect()} == {
        tuple(r) for r in state.copy_counter(events, width=7).filter(state._is_double() & (F.col("copies") > 1)).select("name", "slot", "utxo", "copies").collect()}


def test_the_fold_sorts_wide_rows_by_name_once(spark):
    events = state.prepare(spark.createDataFrame(random_events(2), state.EVENT_SCHEMA))
    plan = state._partial_in_order(events, None, True)._jdf.queryExecution().executedPlan().toString()
    wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(name" in line]
    # The other one holds what `prepare` keeps of burns.
    assert len(wide) <= 2
