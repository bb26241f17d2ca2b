"""Runs registered queries and their SQL side by side.

``python tests/compare.py [sf] [key ...]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
          " conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value: object) -> str:
    if isinstance(value, (bool, type(None), str)):
        return repr(value)
    if isinstance(value, (int, float, Decimal)):
        return f"{float(value):.10g}"
    return repr(str(value))


def difference(df, con, sql: str) -> str | None:
    """None if both give the same rows under the same column names."""
    expected = con.sql(sql)
    columns = sorted(df.columns)
    if columns != sorted(expected.columns):
        return f"columns {columns} against {sorted(expected.columns)}"
    order = [expected.columns.index(c) for c in columns]
    theirs = Counter(tuple(normal(row[i]) for i in order) for row in expected.fetchall())
    ours = Counter(tuple(normal(row[c]) for c in columns) for row in df.collect())
    if ours == theirs:
        return None if ours else "both are empty"
    return f"{columns}: {sum(ours.values())} rows against {sum(theirs.values())}; ours {list((ours - theirs))[:2]} theirs {list((theirs - ours))[:2]}"


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for key in sys.argv[2:] or queries:
        start = time.time()
        try:
            df = queries[key](spark, sf_dir)
            found = difference(df, con, oracles[key]) if key in oracles else f"(rows only) {df.count()}"
            wrong = found and not found.startswith("(rows only)")
        except Exception as error:  # noqa: BLE001 - a report line, not a handler
            found, wrong = f"{type(error).__name__}: {str(error)[:900]}", True
        bad += bool(wrong)
        print(f"{'BAD' if wrong else 'ok '} {key} {time.time() - start:.1f}s {found or ''}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
