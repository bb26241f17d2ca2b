"""Vectors of the scalar functions."""

from __future__ import annotations

import re
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from namefold.functions import assets, attributes, registry
from namefold.operators import normalize, state
from namefold.sources import landed

POLICY = "ab" * 28
ONE = Decimal(1)


def values(spark, rows, *columns):
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    out = df.select("v", *[c(F.col("v")).alias(f"c{i}") for i, c in enumerate(columns)]).collect()
    return {r["v"]: (r["c0"] if len(columns) == 1 else tuple(r[1:])) for r in out}


def test_rarity(spark):
    expected = {".": "legendary", "__": "ultra_rare", "_._": "rare", "common": "common", "will_be_common": "basic",
                "barbacoa": "basic", "burrito": "common", "taco": "common"}
    assert values(spark, list(expected), attributes.rarity) == expected


def test_characters(spark):
    expected = {"test1234": "letters,numbers", "barbacoa": "letters", "-12.5": "numbers", "a-1": "letters,numbers,special", "_": "special"}
    assert values(spark, list(expected), attributes.characters) == expected


def test_numeric_modifiers(spark):
    expected = {"-1": "negative", "0.1": "decimal", "-0.1": "negative,decimal"}
    expected |= dict.fromkeys(["1a", "1", "-.-", "--1", "1.2."], "")
    assert values(spark, list(expected), attributes.numeric_modifiers) == expected


@pytest.mark.parametrize("asset, label, owner", [
    ("6275727269746f", None, "6275727269746f"),
    (f"{POLICY}.6275727269746f", None, "6275727269746f"),
    (f"{POLICY}.000de1406275727269746f", assets.LABEL_OWNER, "000de1406275727269746f"),
    (f"{POLICY}.000643b06275727269746f", assets.LABEL_REFERENCE, "000de1406275727269746f"),
    (f"{POLICY}.000000006275727269746f", assets.LABEL_VIRTUAL, "000000006275727269746f"),
])
def test_asset_names(spark, asset, label, owner):
    parsed = values(spark, [asset], assets.parse_asset)[asset]
    assert (parsed["label"], parsed["name"], parsed["owner_hex"]) == (label, "burrito", owner)


def test_bytes_that_are_no_text_do_not_fail(spark):
    assert "�" in values(spark, ["fffe41"], assets.name_of_hex)["fffe41"]


def test_key_digest_ignores_malformed_keys(spark):
    out = values(spark, ["6162", "616", "zz"], assets.key_digest)
    assert out["6162"] and out["616"] is None and out["zz"] is None


def test_label_sets(spark):
    one, two = assets.LABEL_SETTINGS, assets.LABEL_002
    add = lambda label: lambda c: registry.ensure_label(c, F.lit(label))
    assert values(spark, ["", two, one + two], add(one)) == {"": one, two: one + two, one + two: one + two}
    drop = lambda c: registry.ensure_no_label(c, F.lit(one))
    assert values(spark, ["", two, one + two], drop) == {"": "", two: two, one + two: two}


@pytest.mark.parametrize("joined, amount, message", [
    (assets.LABEL_SETTINGS, 1, "LABEL_ALREADY_PRESENT"), ("", -1, "LABEL_ABSENT"), ("", 2, "INVALID_AMOUNT")])
def test_strict_label_changes_fail(spark, joined, amount, message):
    strict = lambda c: registry.apply_label(c, F.lit(assets.LABEL_SETTINGS), F.lit(amount))
    with pytest.raises(Exception, match=message):
        values(spark, [joined], strict)


def test_script_language(spark):
    out = values(spark, ["plutus:v3", "PlutusScriptV1", "native"], attributes.language_tag)
    assert out == {"plutus:v3": "03", "PlutusScriptV1": "01", "native": "02"}
    with pytest.raises(Exception, match="unknown script language"):
        values(spark, ["native"], lambda c: attributes.language_tag(c, strict=True))


def test_policy_settings_reject_other_shapes(spark):
    rows = spark.createDataFrame([("a", '{"0xAB":[5,0,"7"]}')], "k string, s string")
    out = normalize.policy_settings(rows, ["k"], "s").first()
    assert (out["policy"], out["first_minting_slot"], out["last_minting_slot"], out["sunset_slot"]) == ("AB", 5, None, 7)
    for bad in ('{"a":3}', '{"a":[1,2]}', '{"a":["x",1,2]}'):
        with pytest.raises(Exception, match="invalid policy settings"):
            normalize.policy_settings(spark.createDataFrame([("a", bad)], "k string, s string"), ["k"], "s").collect()


def test_datum_attributes_need_three_elements(spark):
    good = '[{"image":"i","og_number":4},1,{"default":true,"resolved_addresses":{"btc":"b"}}]'
    out = values(spark, [good, '[{"image":"i"}]', "{}"], attributes.datum_attributes)
    assert out[good]["og_number"] == 4 and out[good]["default"] and out[good]["resolved_addresses"] == {"btc": "b"}
    assert out['[{"image":"i"}]'] is None and out["{}"] is None


def test_personalized_ignores_the_own_address(spark):
    df = spark.range(1).select(
        attributes.is_personalized(F.lit("h"), F.lit("h"), [F.lit(None)], [F.lit("")], F.create_map(F.lit("ada"), F.lit("x"))).alias("plain"),
        attributes.is_personalized(F.lit("h"), F.lit("h"), [F.lit("bg")], [], F.create_map(F.lit("ada"), F.lit("x"))).alias("art"),
        attributes.is_personalized(F.lit("h"), F.lit("h"), [], [], F.create_map(F.lit("btc"), F.lit("x"))).alias("chain"),
        attributes.is_personalized(F.lit("h"), F.lit(None), [], [], F.create_map(F.lit("btc"), F.lit(""))).alias("image"))
    assert tuple(df.first()) == (False, True, True, True)


def test_canonical_json_of_nested_values(spark):
    kind = "b struct<y: int, x: map<string, array<struct<q: string, p: bigint>>>>, a decimal(38,0), t boolean"
    rows = [((None, {"k\"2": [("z", 1), None], "k1": []}), Decimal(5), True), ((2, None), None, None), (None, None, None), ((1, {"m": [(None, -(1 << 53)), ("é", 7)]}), Decimal(10**30), False)]
    df = spark.createDataFrame([(r,) for r in rows], f"v struct<{kind.replace('b struct', 'b: struct').replace('a decimal', 'a: decimal').replace('t boolean', 't: boolean')}>")
    got = [r[0] for r in df.select(normalize.canonical_json(F.col("v"), df.schema["v"].dataType)).collect()]
    assert got == [
        '{"a":"5","b":{"x":{"k\\"2":[{"p":1,"q":"z"},null],"k1":[]}},"t":true}', '{"b":{"y":2}}', "{}",
        '{"a":"1000000000000000000000000000000","b":{"x":{"m":[{"p":"-9007199254740992"},{"p":7,"q":"é"}]},"y":1},"t":false}']


def test_fold_events_in_one_pass(spark):
    text = lambda t: t.encode().hex()
    owner, settings, legacy = "000de140" + text("bob"), "00001070" + text("bob"), text("amy")
    out = lambda held, datum=None: ("addr1", Decimal(5), held, datum, ("v2", "00"))
    txs = [
        ("t1", None, [out({POLICY: {owner: ONE, settings: ONE}, "other": {owner: ONE}}), out({POLICY: {legacy: ONE}})], {POLICY: {owner: ONE, settings: ONE, legacy: ONE}, "other": {owner: -ONE}}, None),
        ("t2", [("t1", 1), ("t0", 3)], [None, out(None), out({POLICY: {legacy: ONE, "": ONE}}, "{}")], {POLICY: {settings: -ONE, "000643b0" + text("bob"): -ONE, "00000000" + text("eve"): -ONE}}, "{}"),
        ("t3", [], None, None, None),
    ]
    blocks = spark.createDataFrame([("b", 1, 10, "praos", txs), ("c", 2, 11, "praos", []), ("d", 3, 12, "praos", None)], landed.BLOCK_SCHEMA)
    found = normalize.fold_events(blocks, [POLICY], holder=lambda a: F.concat(F.lit("h"), a), datum_holder=lambda d: d)
    assert found.columns == [f.split()[0] for f in re.sub("<[^>]*>", "", state.EVENT_SCHEMA.replace("(38,0)", "")).split(", ")]
    got = {(r["name"], r["kind"], r["rank"], r["tx_pos"], r["utxo"], r["is_mint"], r["holder"], r["datum"]) for r in found.collect()}
    assert got == {
        # The legacy token of t1 is spent in its block and so left out; the reference token's burn changes no record.
        ("bob", "owner", 2, 0, "t1#0", True, "haddr1", None), ("bob", "settings", 2, 0, "t1#0", False, "haddr1", None),
        ("amy", "owner", 3, 1, "t2#2", False, "haddr1", "{}"),
        ("bob", "label_burn", 1, 1, None, False, None, None), ("eve", "burn", 0, 1, None, False, None, None)}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_read_many_at_a_time(spark, tmp_path):
    outputs = '[{"address": "a", "lovelace": 5, "assets": {"p": {"k%d": 1, "k": %s}}, "datum": {"x": [1.50, "z"]}}]'
    block = '{"id": "b%d", "height": 1, "slot": 2, "type": "praos", "transactions": [{"id": "t", "outputs": ' + outputs + ', "metadata": {"721": 1e5}}]}'
    lines = [block % (i, i, "9" * 38) for i in range(2500)]
    odd = ["", "  ", ' {"id": 5, "more": [1]}\t', "{}", '{"id": "first"},{"id": "not read"}', '{"id": "x"} ]', "{'id': 'single'}", f"[{lines[0]}, {lines[1]}]", "[]", '{"id": "a", "id": "b"}']
    documents = [d for b in landed._documents()(iter([pa.RecordBatch.from_arrays([pa.array(lines + odd)], ["value"])])) for d in b.column(0).to_pylist()]
    assert len(documents) < 20
    (tmp_path / "blocks.json").write_text("\n".join(lines + odd))
    plain = spark.read.schema(landed.BLOCK_SCHEMA).option("mode", "FAILFAST").json(str(tmp_path))
    found = landed.read_blocks(spark, str(tmp_path))
    assert found.schema == plain.schema and sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    assert found.count() == 2508


@pytest.mark.parametrize("broken", ["null", "5", '{"id": "b"', '{"transactions": [{}', '{"height": "x"}', '{"height": NaN}', '{"transactions": [5]}', "\u00a0"])
def test_unreadable_blocks_fail(spark, tmp_path, broken):
    # The second line would close what the first leaves open.
    (tmp_path / "blocks.json").write_text("\n".join(['{"id": "a"}', broken, "{}]}", '{"id": "c"}']))
    with pytest.raises(Exception):  # noqa: B017 - the parser's own
        landed.read_blocks(spark, str(tmp_path)).collect()
