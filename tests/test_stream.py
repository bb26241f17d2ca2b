"""The ingest job: gate, repeated delivery, undo, gaps, restart."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from namefold.functions import assets
from namefold.operators import state
from namefold.plans import feed_queries
from namefold.scratch import materialize, release
from namefold.sources import landed, snapshot
from namefold.streaming import ingest


def row(seq, height, name="n", kind="owner", *, action="apply", tx=None, holder="h", mint=False, idx=0):
    body = name.encode().hex() if name else None
    owner = kind == "owner"
    return {"seq": seq, "action": action, "slot": height * 10, "height": height, "hash": f"b{height}", "tx_hash": tx or f"t{seq}", "successful": True,
            "policy": "p", "name": name, "label": assets.LABEL_OWNER if owner else None,
            "hex": None if name is None else (assets.LABEL_OWNER if owner else "") + body, "kind": kind, "idx": idx, "address": f"addr_{holder}",
            "holder": holder, "is_mint": mint}


def land(folder, number, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"part{number}.json").write_text("\n".join(json.dumps(r) for r in rows))


def holders(job):
    return {r["name"]: (r["holder"], r["amount"]) for r in job.records(ingest.last_batch(job)).collect()}


def test_blocks_are_applied_once_complete(spark, tmp_path):
    feed, job = tmp_path / "feed", ingest.CurrentState(spark, str(tmp_path / "work"), compact_every=2)
    land(feed, 1, [row(1, 1, "a", mint=True), row(2, 1, "b", mint=True), row(3, 2, "a", holder="x"), row(3, 2, "a", holder="x"), row(4, 3, "b", "burn")])
    ingest.run(job, str(feed))
    assert holders(job) == {"a": ("x", 1), "b": ("h", 1)}  # block 3 is the tip
    # c is minted and moved inside block 4, d is made and burned away in 4 and 5
    land(feed, 2, [row(5, 4, "c", tx="m", mint=True), row(6, 4, "c", "spend", tx="m"), row(7, 4, "c", holder="y"), row(8, 4, "d", mint=True),
                   row(9, 5, "d", "burn"), row(10, 6, None, None)])
    ingest.run(job, str(feed))
    assert holders(job) == {"a": ("x", 1), "c": ("y", 1)}
    land(feed, 3, [row(11, 6, "b", mint=True), row(12, 7, None, None)])
    ingest.run(job, str(feed))
    last = ingest.last_batch(job)
    assert holders(job) == {"a": ("x", 1), "b": ("h", 1), "c": ("y", 1)}
    made = {r["name"]: r["created_slot_number"] for r in job.records(last).collect()}
    assert made == {"a": 10, "b": 10, "c": 40}  # the history of b outlives its burn
    assert sorted(r["height"] for r in job.table("blocks", last).collect()) == [1, 2, 3, 4, 5, 6]
    # a repeated micro-batch writes the same tables
    before = sorted(map(str, job.records(last).collect()))
    job.process(landed.read_events(spark, str(feed / "part3.json")), last)
    assert sorted(map(str, job.records(last).collect())) == before


def test_a_gap_stops_the_job(spark, tmp_path):
    feed, job = tmp_path / "feed", ingest.BlockLedger(spark, str(tmp_path / "work"))
    land(feed, 1, [row(1, 1), row(2, 3), row(3, 4)])
    with pytest.raises(Exception, match="skipped a height"):
        ingest.run(job, str(feed))


def test_late_rows_of_an_applied_block_stop_the_job(spark, tmp_path):
    feed, job = tmp_path / "feed", ingest.BlockLedger(spark, str(tmp_path / "work"))
    land(feed, 1, [row(1, 1, "a", tx="t"), row(2, 1, "b", tx="t"), row(3, 2), row(4, 3)])
    ingest.run(job, str(feed))
    land(feed, 2, [row(5, 1, "a", tx="t"), row(6, 4)])  # a part of block 1 delivered again says nothing new
    ingest.run(job, str(feed))
    last = ingest.last_batch(job)
    assert sorted(r["height"] for r in job.table("blocks", last).collect()) == [1, 2, 3]
    land(feed, 3, [row(7, 1, "cc", tx="t"), row(8, 5)])
    with pytest.raises(Exception, match="1 rows of applied blocks came late, the first for height 1"):
        ingest.run(job, str(feed))


def test_a_tip_bounds_the_run(spark, tmp_path):
    feed, job = tmp_path / "feed", ingest.BlockLedger(spark, str(tmp_path / "work"), until=3)
    land(feed, 1, [row(1, 1), row(2, 2), row(3, 3)])
    with pytest.raises(ingest.EndedBeforeTipError, match="ended at height 2, before 3"):
        ingest.run(job, str(feed))
    land(feed, 2, [row(4, 4), row(5, 5), row(6, 6)])
    ingest.run(job, str(feed))
    last = ingest.last_batch(job)
    assert sorted(r["height"] for r in job.table("blocks", last).collect()) == [1, 2, 3]
    assert sorted(r["height"] for r in job.table("held", last).filter(f"batch = {last}").collect()) == [4, 5, 6]


def test_an_undo_halts_until_resumed(spark, tmp_path):
    feed, job = tmp_path / "feed", ingest.BlockLedger(spark, str(tmp_path / "work"))
    land(feed, 1, [row(1, 1), row(2, 2), row(3, 3), row(4, 3, action="undo"), row(5, 3) | {"hash": "c3"}, row(6, 4)])
    ingest.run(job, str(feed))
    land(feed, 2, [row(7, 5)])
    ingest.run(job, str(feed))
    last = ingest.last_batch(job)
    assert sorted(r["height"] for r in job.table("blocks", last).collect()) == [1, 2]
    assert [(r["height"], r["applied"]) for r in job.undo_log(last).collect()] == [(3, False)]
    assert job.table("status", last).filter(f"batch = {last}").first()["halted"]
    assert job.table("held", last).filter(f"batch = {last}").count() == 5
    job.resume(last)
    land(feed, 3, [row(8, 6)])
    ingest.run(job, str(feed))
    last = ingest.last_batch(job)
    assert sorted((r["height"], r["hash"]) for r in job.table("blocks", last).collect()) == [(1, "b1"), (2, "b2"), (3, "c3"), (4, "b4"), (5, "b5")]
    assert not job.table("status", last).filter(f"batch = {last}").first()["halted"]


def test_an_applied_block_cannot_be_undone_in_place(spark, tmp_path):
    feed, job = tmp_path / "feed", ingest.BlockLedger(spark, str(tmp_path / "work"))
    land(feed, 1, [row(1, 1), row(2, 2), row(3, 3), row(4, 2, action="undo")])
    job.process(landed.read_events(spark, str(feed)), 0)
    assert [(r["height"], r["applied"]) for r in job.undo_log(0).collect()] == [(2, True)]
    with pytest.raises(ingest.UndoneStateError):
        job.resume(0)


def test_one_document_snapshot(spark, tmp_path):
    document = {"slot": 9, "hash": "h", "utxoSchemaVersion": 1, "mintingData": {"n": [{"created_slot": 1, "txHash": "t"}, {"created_slot": 2, "txHash": "u"}]},
                "utxos": [{"id": "t#0", "tx_id": "t", "index": 0, "slot": 3, "address": "a", "lovelace": 5, "handles": [{"policy": "p", "assets": ["6e"]}]}],
                "scannedBlocks": [{"slot": 3, "hash": "b"}]}
    (tmp_path / "snapshot.json").write_text(json.dumps(document, indent=1))
    tables = snapshot.read_documents(spark, str(tmp_path / "snapshot.json"))
    assert tables["outputs"].first()["utxo"] == "t#0" and tables["blocks"].first()["hash"] == "b"
    assert sorted((r["name"], r["created_slot"], r["tx_hash"]) for r in tables["mints"].collect()) == [("n", 1, "t"), ("n", 2, "u")]


def test_a_corrupt_record_aborts_the_publish(spark, tmp_path):
    rows = spark.createDataFrame([("u", 1), (None, 2)], "utxo string, slot bigint")
    mints = spark.createDataFrame([("n", 1)], "name string, created_slot bigint")
    blocks = spark.createDataFrame([(1, "b")], "slot bigint, hash string")
    with pytest.raises(Exception, match="corrupt record in outputs"):
        snapshot.write_snapshot(str(tmp_path / "s"), rows, mints, blocks, 5)


def token(seq, height, kind, label, datum, **more):
    """An output of a labelled token with all that a landed event can carry."""
    return row(seq, height, "v@a", kind, **{k: v for k, v in more.items() if k in ("mint", "holder")}) | {
        "label": label, "hex": label + b"v@a".hex(), "datum": datum, "lovelace": 7, "script": {"type": "plutusV2", "cbor": "00"},
        "datum_holder": "told" if kind == "virtual" else None, "metadata": '{"m":1}' if more.get("mint") else None}


def test_the_stream_folds_whole_events(spark, tmp_path):
    pz = lambda n: f'[{{"image":"img{n}","og_number":0,"version":1}},1,{{"default":true,"resolved_addresses":{{"ada":"0xda{n}","btc":"b{n}"}}}}]'
    settings = '[[1,0,"t","s",1],[0,1,"u","v",0],5,2,3,"terms",0,"pay"]'
    rows = [
        token(1, 1, "virtual", assets.LABEL_VIRTUAL, pz(1), mint=True),
        row(2, 1, "n", mint=True) | {"lovelace": 9, "script": {"type": "plutusV3", "cbor": "01"}, "datum": "{}", "metadata": '{"n":2}'},
        token(3, 2, "settings", assets.LABEL_SETTINGS, settings), token(4, 3, "reference", assets.LABEL_REFERENCE, pz(4)), row(5, 4, None, None)]
    feed, job = tmp_path / "feed", ingest.CurrentState(spark, str(tmp_path / "work"), compact_every=2)
    for k, part in enumerate((rows[:3], rows[3:])):
        land(feed, k, part)
        job.process(landed.read_events(spark, str(feed / f"part{k}.json")), k)
    last = 1
    got = {r["name"]: r for r in job.records(last).collect()}
    land(tmp_path / "all", 0, rows)
    every = ingest.fold_events(landed.read_events(spark, str(tmp_path / "all")))
    mints = job.table("mints", last).drop("batch")
    want = {r["name"]: r for r in state.fold(state.prepare(every), mints).collect()}
    assert {n: {c: r[c] for c in want[n].asDict()} for n, r in got.items()} == {n: r.asDict() for n, r in want.items()}
    v, n = got["v@a"], got["n"]
    assert (v["holder"], v["address"], v["image"], v["default"], v["resolved_addresses"]["btc"]) == ("told", "da1", "img4", True, "b4")
    assert v["settings"]["utxo_id"] == "t3#0" and v["registry_labels"] == assets.LABEL_SETTINGS and v["reference_utxo"] == "t4#0"
    assert (n["lovelace"], n["script"]["type"], n["datum"]) == (9, "plutusV3", "{}")
    assert {(r["name"], r["metadata"]) for r in mints.collect()} == {("v@a", '{"m":1}'), ("n", '{"n":2}')}


def test_a_large_feed_lands_each_step_as_several_files(spark, tmp_path, monkeypatch):
    from namefold.plans import feed_queries

    monkeypatch.setattr(feed_queries, "ROWS_PER_FILE", 150, raising=False)
    rows = spark.range(1000).select(F.col("id").alias("seq")).coalesce(1)
    shares = feed_queries._shares(rows, 2)
    assert shares == 4
    feed_queries._land(rows, str(tmp_path / "feed"), 2, shares)
    assert len(list((tmp_path / "feed").glob("*.json"))) == 8
    assert spark.read.schema("seq bigint").json(str(tmp_path / "feed")).distinct().count() == 1000
    sparse = rows.filter("seq < 500 or seq > 997")
    assert feed_queries._shares(sparse, 2) == 1  # a step of two rows cannot fill them


def test_a_batch_leaves_only_its_own_tables(spark, tmp_path):
    """What a batch lands on the way goes when it ends, and landed steps are packed."""
    scratch = Path(spark.conf.get("spark.checkpoint.dir"), "namefold")
    before = set(scratch.glob("*"))
    feed, job = tmp_path / "feed", ingest.CurrentState(spark, str(tmp_path / "work"))
    rows = [row(1, 1, "a", mint=True), row(2, 2, "a", holder="x"), row(3, 3, "a", holder="y"), row(4, 4, None, None)]
    feed_queries._land(spark.createDataFrame(rows, "seq bigint, action string, slot bigint, height bigint, hash string, tx_hash string, successful boolean, policy string, name string,"
                                             " label string, hex string, kind string, idx int, address string, holder string, is_mint boolean"), str(feed), 2, packed=True)
    assert len(list(feed.glob("*.json.gz"))) == len(list(feed.glob("part-*"))) == 2
    ingest.run(job, str(feed))
    assert ingest.last_batch(job) == 1 and holders(job) == {"a": ("y", 1)}
    assert {p.name.split("-")[0] for p in set(scratch.glob("*")) - before} <= {"minted"}


def test_a_landed_table_keeps_no_shuffle_files_and_can_be_released(spark):
    def shuffled():
        disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}

    before = shuffled()
    counts = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    some = materialize(counts.filter("k > 2"), "some")
    assert not shuffled() - before
    folder, kept = (Path(t.inputFiles()[0].removeprefix("file:")).parent for t in (counts, some))
    release(spark, counts, str(kept.parent.parent / "elsewhere"), str(kept.parent))
    assert not folder.exists() and kept.exists() and some.count() == 4
