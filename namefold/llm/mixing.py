"""Mixing sources to target weights: a repetition rate per source, whole copies plus one seeded coin for the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namefold.llm.common import WORD, whole_text
from namefold.scratch import materialize

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix"


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources by code point, null last, take the weights in turn. Targets share
    the sum of all sizes, none above ``most`` times its source's size: with
    sources in the order of cap / weight, all before some point get their cap
    and all from there on one common level times their weight. The windows
    run over one row per source, after the sizes were summed.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = total.select(
        "source", "source_size",
        F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights))) + 1).alias("weight"),
        (F.col("source_size") * most).alias("cap"),
    ).withColumn("at", F.row_number().over(Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))))
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(onward)
    leveled = ranked.withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("at", "level"))
    return leveled.withColumn("level", F.min(fits).over(whole)["level"]).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"),
    )


def numbered(rows: DataFrame, same: list[str]) -> DataFrame:
    """Adds ``number``: 0, 1, 2, ... among the rows that agree in ``same``; which of them gets which is open.

    Only rows that repeat are moved. They are written with the task that read
    them, counted by group and task, and numbered within a task after the number
    of those in earlier tasks: a group of any size is spread over its tasks.
    """
    match = lambda other: [F.col(f"r.{c}").eqNullSafe(F.col(f"{other}.{c}")) for c in same]
    repeated = materialize(rows.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1").select(*same), "repeated").alias("t")
    single = rows.alias("r").join(repeated, match("t"), "left_anti").withColumn("number", F.lit(0).cast("long"))
    many = materialize(rows.alias("r").join(repeated, match("t"), "left_semi").withColumn("task", F.spark_partition_id()), "repeats")
    counts = many.groupBy(*same, "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*same).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*same, "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")).alias("o")
    within = many.withColumn("nth", F.row_number().over(Window.partitionBy(*same, "task").orderBy(F.lit(0)))).alias("r")
    joined = within.join(offsets, [*match("o"), F.col("r.task") == F.col("o.task")])
    return single.unionByName(joined.select(*(F.col(f"r.{c}") for c in rows.columns), (F.col("offset") + F.col("nth") - 1).alias("number")))


def copies(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """``row`` (all input columns), size, source_size, target and ``copies`` of each document.

    A null text has size 0. A document whose source has no words, or with a rate
    below 1 and a lost coin, has 0 copies. The coin of a row depends on its key,
    its text's md5 and its number among the rows that agree in source, key and
    text, so that repeated keys and repeated rows (a null key is one key) do not
    fall alike and the counts of reruns agree. An empty table gives no rows.

    Scale: sizes are summed per task before the shuffle; the table of targets
    is written, so the planner broadcasts it by its known size, or else joins
    with the hot source split. Texts are moved only where rows repeat.
    """
    whole = whole_text(F.col(text))
    size = F.regexp_count(whole, F.lit(WORD)).cast("long")
    goals = materialize(targets(docs.select(F.col(source).cast("string").alias("source"), size.alias("size"))), "mix")
    id = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col(source).cast("string").alias("of"), size.alias("size"), id.alias("id"), F.md5(whole.cast("binary")).alias("digest"))
    joined = numbered(rows, ["of", "id", "digest"]).join(goals, F.col("of").eqNullSafe(F.col("source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    seed = F.concat_ws("|", "id", "digest", F.col("number").cast("string"), F.lit(SEED))
    coin = F.conv(F.substring(F.md5(seed.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return joined.select("row", "size", "source_size", "target", (F.floor(rate) + F.when(coin < rate - F.floor(rate), 1).otherwise(0)).cast("long").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents themselves: each input row as often as it has copies."""
    return copies(docs).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
