"""Exact duplicates by distributed radix partitioning, most significant bytes first.

A text is read as its byte length followed by its bytes. Level by level the
groups are split by the next bytes, in slices that grow sixteenfold, until a
group has one member or its texts have ended. Texts of a group are then equal
byte for byte; no digest takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namefold.llm.common import whole_text
from namefold.scratch import materialize

FIRST_SLICE = 64
GROWTH = 16


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: ``row`` (all its columns), ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the largest key stays; a null key is the
    smallest; of repeated rows with that key exactly one stays. A null text
    counts as empty. An empty table gives no rows. Columns of the input cannot
    clash with those added here, since they stay inside ``row``.

    Scale: a level shuffles a group's slice once per map task (counts are
    partial), and a row only where its group is not yet alone. A hot group is
    one row on the counted side of the join, so its rows may be split at will.
    """
    # The bytes are read off the row at each level: no second copy of a text is shuffled or written.
    body = whole_text(F.col("row").getField(text)).cast("binary")
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("id"))
    rows = rows.select("row", "id", F.length(body).alias("n"), F.substring(body, 1, FIRST_SLICE).alias("digit"), F.sha2(body, 256).alias("text_sha256"))
    shared = materialize(
        rows.groupBy("n", "digit").agg(F.count("*").alias("members")).where("members > 1").select("n", "digit", F.monotonically_increasing_id().alias("grp")), "radix",
    )
    # One plan at every size: the counted side grows with the documents, so it is sorted and merged, never broadcast.
    shared = shared.hint("merge")
    alone = rows.join(shared, ["n", "digit"], "left_anti").select("row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    active = materialize(
        rows.join(shared, ["n", "digit"]).select("row", "id", "n", "text_sha256", "grp", F.monotonically_increasing_id().alias("seq")), "radix",
    )
    longest = active.agg(F.max("n")).first()[0]
    parts, at, width = [alone], FIRST_SLICE, FIRST_SLICE * GROWTH
    while longest is not None:
        sliced = active.withColumn("digit", F.substring(body, at + 1, width))
        groups = materialize(
            sliced.groupBy("grp", "digit").agg(F.count("*").alias("members"), F.max(F.struct("id", "seq")).alias("keep"))
            .select(F.col("grp"), "digit", "members", "keep", F.monotonically_increasing_id().alias("sub")), "radix",
        )
        split = sliced.join(groups.hint("merge"), ["grp", "digit"])
        at += width
        ended = (F.col("members") == 1) | (F.col("n") <= at)
        if longest > at:
            split = materialize(split.drop("grp", "digit").withColumnRenamed("sub", "grp"), "radix")
        parts.append(split.where(ended).select(
            "row", F.col("keep.id").alias("keep_id"), F.col("members").alias("group_size"), (F.col("seq") == F.col("keep.seq")).alias("kept"), "text_sha256",
        ))
        if longest <= at:
            break
        active = split.where(~ended).select("row", "id", "n", "text_sha256", "grp", "seq")
        width *= GROWTH
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
