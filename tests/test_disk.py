"""What jobs leave in the scratch folder: tables that no later step reads are gone before the result is read."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pytest
from compare import difference

import __spark_entry__ as entry
from namefold.plans import bindings

SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp",
    "part": "p_partkey bigint, p_name string, p_brand string",
}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = {
        "part": [(k, f"red{k % 3} blue{k % 5} x", f"Brand#{k % 3}") for k in range(1, 41)],
        "orders": [(k, k % 11, "F", datetime(1995, 1, 2) + timedelta(days=k * 7 % 60)) for k in range(1, 121)],
        "lineitem": [(k, k * i % 40 + 1, 1, i, 2.0, 10.5 * i + k, "RNA"[(k + i) % 3], "FO"[k % 2]) for k in range(1, 121) for i in range(1, 5)],
    }
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(rows[name], schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.mark.parametrize("key, stay", [
    ("blocks_to_state", {"events", "mints", "minted", "several"}),
    ("repair_records_whole", {"events", "mints", "minted", "several", "names", "records"}),
    ("rebuild_from_snapshot", {"snapshot", "records", "minted", "several", "blocks"}),
])
def test_tables_on_the_way_are_gone(spark, sf_dir, key, stay):
    scratch = Path(spark.conf.get("spark.checkpoint.dir"), "namefold")
    before = set(scratch.glob("*"))
    found = entry.queries()[key](spark, sf_dir)
    left = [p.name.split("-")[0] for p in set(scratch.glob("*")) - before]
    assert set(left) <= stay and left.count("records") <= 1
    con = duckdb.connect()
    for name in SCHEMAS:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet/*.parquet'")
    assert difference(found, con, entry.oracle_sql()[key]) is None


def test_messages_are_dealt_out_before_their_texts_are_made(spark, sf_dir):
    plan = bindings.block_messages(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert any("rangepartitioning(asset_id" in line for line in dealt)
    assert not any("hashpartitioning(slot" in line for line in dealt)
