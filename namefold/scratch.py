"""Where jobs put the tables they cut lineage with or hand from step to step."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared folder the session names.

    Without that setting only a local session may go on: executors on other
    machines could not see a folder of the driver's machine.
    """
    base = spark.conf.get(CHECKPOINT_SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a shared folder")
        base = tempfile.mkdtemp(prefix="namefold-")
        spark.conf.set(CHECKPOINT_SETTING, base)
    return f"{base.rstrip('/')}/namefold/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes inside remove their shuffle files when they are done: the written table stands for them. Else files stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP_SETTING, "false")
    spark.conf.set(_CLEANUP_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP_SETTING, before)


def materialize(df: DataFrame, label: str, *, codec: str | None = None, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` once and read it back, so that later steps neither recompute
    it nor depend on executors that hold it. ``codec`` other than the session's is for large tables,
    ``group_bytes`` for large rows: a reader holds up to 4,096 rows at once, but never more than a row group of that size."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write
    if codec:
        writer = writer.option("compression", codec)
    if group_bytes:
        writer = writer.options(**{"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 16})
    with shuffles_dropped(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes the tables of `materialize` that these read (or folders of `scratch_path`), so that a job's disk holds only what it still needs.

    No later step may read them. Only folders right below the scratch folder go; whatever else a table reads stays.
    """
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    root = jvm.org.apache.hadoop.fs.Path(f"{spark.conf.get(CHECKPOINT_SETTING).rstrip('/')}/namefold")
    files = root.getFileSystem(conf)
    below = f"{files.makeQualified(root).toUri().getPath()}/"
    paths = [p for t in tables for p in ([t] if isinstance(t, str) else t.inputFiles())]
    paths = [jvm.org.apache.hadoop.fs.Path(p).toUri().getPath() for p in paths]
    for folder in {p.removeprefix(below).split("/")[0] for p in paths if p.startswith(below)} - {""}:
        files.delete(jvm.org.apache.hadoop.fs.Path(root, folder), True)
