"""What several operators share: the word pattern, table readers and the documented training bounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows that go to a Python worker together where whole texts go there: the setting counts rows only, and 10,000 texts have no size bound worth the name.
BATCH_ROWS = 1_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(spark: SparkSession) -> None:
    """Lowers the session's batch size to `BATCH_ROWS`; a lower one stays."""
    rows = int(spark.conf.get(_BATCH_SETTING))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(text: Column) -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(text.cast("string"), F.lit(""))


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key's decimal text, modulo ``folds``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def text_key(text: Column) -> Column:
    """Tells rows of one doc_id but different texts apart; rows equal in both are one document to the operators that use it."""
    return F.xxhash64(whole_text(text))


def text_groups(texts: pa.Array, characters: int = 1 << 20) -> Iterator[list[str]]:
    """The texts of a batch in lists of about so many characters, so that a worker never holds a whole batch as Python objects."""
    group, weight = [], 0
    for k in range(len(texts)):
        group.append(texts[k].as_py())
        weight += len(group[-1])
        if weight >= characters:
            yield group
            group, weight = [], 0
    if group:
        yield group


def training_rows(docs: DataFrame, labels: DataFrame, target: str, folds: int, held_out: int, per_class: int) -> DataFrame:
    """At most ``per_class`` labelled documents of each class, never of the held-out fold: (doc_id, text, y).

    The choice is by a hash of doc_id, so reruns fit on the same rows. Labels
    that are null or contradict each other for one doc_id are left out. Rows
    that repeat a doc_id come once, with the least text of it.
    """
    clean = (
        labels.select(F.col("doc_id").alias("k"), F.col(target).cast("int").alias("y"))
        .where("k IS NOT NULL AND y IN (0, 1)")
        .where(crc_fold(F.col("k"), folds) != held_out)
        .groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top")
    )
    order = F.xxhash64(F.col("k"), F.lit(target))
    picked = [clean.where(F.col("y") == y).orderBy(order, "k").limit(per_class).select("k", "y") for y in (0, 1)]
    texts = docs.select(F.col("doc_id").alias("k"), whole_text(F.col("text")).alias("text"))
    # 2 * per_class rows of a key and a label: a size fixed by the parameter.
    some = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "k")
    return some.groupBy("k").agg(F.min("text").alias("text"), F.min("y").alias("y")).select(F.col("k").alias("doc_id"), "text", "y")
