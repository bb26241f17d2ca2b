"""Running values along an ordered key that stay balanced when one key is hot.

A plain window over ``key`` puts every row of that key into one task. Here a key
is first cut into chunks of its order (ranges of slots). Rows are shuffled by
``(key, chunk)``, each chunk is summed up to one row, the few summary rows of a
key carry the running value from chunk to chunk, and the carry is joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK = "chunk"
ROWS_PER_TASK = 500_000


def with_chunk(df: DataFrame, slot: str, width: int) -> DataFrame:
    """Add the chunk column the functions below expect. Keeping it between two of
    them lets the second one reuse the first one's partitioning."""
    return df.withColumn(CHUNK, F.floor(F.col(slot) / F.lit(width)).cast("bigint"))


def parts_for(rows: int, spark: SparkSession) -> int:
    """Partitions for so many narrow rows, so that what a task holds does not grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def frequent(df: DataFrame, key: str, rows: int) -> list:
    """Keys with more than so many rows, by a sketch of bounded size made in one pass without a shuffle.

    The sketch is exact for few keys and may miss or add some near the bound:
    use it to choose where work is done, never what comes out.
    """
    found = df.filter(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, 1000, 10000)").alias("top")).first()["top"]
    return [r["item"] for r in found or [] if r["count"] > rows]


def with_last_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Add the last non-null ``value`` of the rows before this one, per key."""
    rows = df.withColumn("__value", value)
    position = F.struct(*order)
    tails = rows.groupBy(*keys, CHUNK).agg(
        F.max_by("__value", F.when(F.col("__value").isNotNull(), position)).alias("__tail")
    )
    along_chunks = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*keys, CHUNK, F.last("__tail", ignorenulls=True).over(along_chunks).alias("__carry"))
    in_chunk = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("__seen", F.last("__value", ignorenulls=True).over(in_chunk))
        .join(carried, [*keys, CHUNK])
        .withColumn(name, F.coalesce("__seen", "__carry"))
        .drop("__value", "__seen", "__carry")
    )


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """``lag`` of several columns (``{source: new name}``) over ``keys``."""
    value = F.struct(*[F.col(source).alias(new) for source, new in columns.items()])
    seen = with_last_seen(df, keys, order, value, "__prev")
    return seen.select("*", *[F.col("__prev")[new].alias(new) for new in columns.values()]).drop("__prev")


def with_counter(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], add: Column, floor: Column, name: str
) -> DataFrame:
    """Counter after each row, where a row does ``x -> max(x + add, floor)`` from 0.

    Such steps compose to a step of the same form, so a chunk is one summary row.
    With ``s`` the running sum of ``add``, the value is ``s + max(start, max(floor - s))``.
    A null ``floor`` only adds.
    """
    rows = df.withColumn("__add", add).withColumn("__floor", floor)
    in_chunk = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__sum", F.sum("__add").over(in_chunk))
    rows = rows.withColumn("__lift", F.max(F.col("__floor") - F.col("__sum")).over(in_chunk))

    chunks = rows.groupBy(*keys, CHUNK).agg(F.sum("__add").alias("__total"), F.max("__lift").alias("__top"))
    along = Window.partitionBy(*keys).orderBy(CHUNK)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("__before", F.coalesce(F.sum("__total").over(before), F.lit(0)))
    highest = F.max(F.col("__top") - F.col("__before")).over(before)
    starts = chunks.select(
        *keys, CHUNK, (F.col("__before") + F.greatest(F.lit(0), highest)).alias("__start")
    )
    return (
        rows.join(starts, [*keys, CHUNK])
        .withColumn(name, (F.col("__sum") + F.greatest("__start", "__lift")).cast("bigint"))
        .drop("__add", "__floor", "__sum", "__lift", "__start")
    )


def with_position(df: DataFrame, order: str, name: str) -> DataFrame:
    """1-based position of distinct ``order`` values over the whole table.

    Only the one-row-per-chunk offsets pass through a single task.
    """
    counts = df.groupBy(CHUNK).agg(F.count("*").alias("__n"))
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(CHUNK, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    in_chunk = Window.partitionBy(CHUNK).orderBy(order)
    return (
        df.withColumn("__rank", F.row_number().over(in_chunk))
        .join(offsets, CHUNK)
        .withColumn(name, F.col("__offset") + F.col("__rank"))
        .drop("__rank", "__offset")
    )
