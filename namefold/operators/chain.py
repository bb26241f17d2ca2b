"""The block chain itself: coverage, contiguity, windows and ancestry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namefold.scratch import materialize

MAX_DEPTH = 64
KEEP_BLOCKS = 3000


def coverage(blocks: DataFrame, discovered: DataFrame, received: DataFrame) -> DataFrame:
    """Per block: expected, discovered and received transactions, and why it is incomplete.

    A block is complete if its expected count is a natural number, equals the
    distinct discovered transactions, and each of them was received under it.
    """
    found = discovered.select("hash", "tx_id").distinct()
    got = received.select("hash", "tx_id").distinct().withColumn("__got", F.lit(1))
    per_block = (
        found.join(got, ["hash", "tx_id"], "left")
        .groupBy("hash").agg(F.count("*").alias("discovered"), F.sum(F.coalesce("__got", F.lit(0))).alias("received"))
    )
    count = F.col("tx_count")
    joined = blocks.select("height", "slot", "hash", "tx_count").join(per_block, "hash", "left").fillna(0, ["discovered", "received"])
    status = (
        F.when(count.isNull() | (count < 0) | (count != F.floor(count)), "bad_count")
        .when(F.col("discovered") != count, "discovery_incomplete")
        .when(F.col("received") != F.col("discovered"), "payload_incomplete")
        .otherwise("complete")
    )
    return joined.withColumn("status", status)


def cursor_after(covered: DataFrame) -> DataFrame:
    """The last block before the first incomplete one: height, slot and hash."""
    broken = covered.filter(F.col("status") != "complete").agg(F.min("height").alias("h"))
    limit = F.coalesce(broken.scalar(), F.lit((1 << 63) - 1))
    return covered.filter(F.col("height") < limit).agg(
        F.max_by(F.struct("height", "slot", "hash"), "height").alias("c")
    ).filter("c is not null").select("c.*")


def height_gaps(blocks: DataFrame) -> DataFrame:
    """Blocks without a successor although a later one exists, by anti-join instead of a global sort."""
    heights = blocks.select("height").distinct()
    followed = heights.select((F.col("height") - 1).alias("height"))
    top = heights.agg(F.max("height")).scalar()
    return heights.join(followed, "height", "left_anti").filter(F.col("height") < top).select(
        F.col("height").alias("after_height"), (F.col("height") + 1).alias("missing_height")
    )


def ledger_range(scanned: DataFrame, first: int, last: int) -> DataFrame:
    return scanned.filter(F.col("slot").between(first, last))


def keep_latest(scanned: DataFrame, count: int = KEEP_BLOCKS) -> DataFrame:
    return scanned.orderBy(F.col("slot").desc(), F.col("hash").desc()).limit(count)


def ancestors(blocks: DataFrame, tip_hash: str, *, depth: int = MAX_DEPTH) -> DataFrame:
    """The tip and up to ``depth`` parents, slots strictly falling.

    ``blocks`` has ``height, slot, hash, parent``. Only heights the walk can
    reach are read, and jumps of 1, 2, 4, ... parents reach them in as many
    joins as the depth has binary digits.
    """
    tip_height = blocks.filter(F.col("hash") == tip_hash).agg(F.max("height")).scalar()
    near = materialize(
        blocks.filter(F.col("height").between(tip_height - depth, tip_height)).select("slot", "hash", "parent"), "near"
    )
    upper = near.select(F.col("hash").alias("parent"), F.col("slot").alias("__slot"))
    jumps = near.join(upper, "parent").filter(F.col("__slot") < F.col("slot")).select("hash", F.col("parent").alias("to"))
    stay = near.select("hash", F.col("hash").alias("to"), F.lit(0).alias("n"))
    reached = near.filter(F.col("hash") == tip_hash).select("hash", F.lit(0).alias("depth"))
    span = 1
    while span <= depth:
        jumps = materialize(jumps, "jumps")
        moves = stay.unionByName(jumps.withColumn("n", F.lit(span)))
        reached = reached.join(moves, "hash").select(F.col("to").alias("hash"), (F.col("depth") + F.col("n")).alias("depth"))
        jumps = jumps.join(jumps.select(F.col("hash").alias("to"), F.col("to").alias("further")), "to").select(
            "hash", F.col("further").alias("to"))
        span *= 2
    return reached.filter(F.col("depth") <= depth).join(near, "hash").select("hash", "slot", "parent", "depth")


def common_ancestor(blocks: DataFrame, old_tip: str, new_tip: str, *, depth: int = MAX_DEPTH) -> DataFrame:
    """The newest block both tips descend from; no row if there is none within ``depth``."""
    old = ancestors(blocks, old_tip, depth=depth).select("hash", F.col("depth").alias("old_depth"))
    new = ancestors(blocks, new_tip, depth=depth).select("hash", "slot", F.col("depth").alias("new_depth"))
    shared = new.join(old, "hash")
    return shared.agg(F.min_by(F.struct("hash", "slot", "old_depth", "new_depth"), "new_depth").alias("a")).filter(
        "a is not null"
    ).select("a.*")


def descends_from(walk: DataFrame, point_hash: str, point_slot: int) -> DataFrame:
    """One row telling whether the `ancestors` of a tip hold a point, and how far they reach."""
    hit = (F.col("hash") == point_hash) & (F.col("slot") == point_slot)
    return walk.agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("descends"), F.max("depth").alias("walked"))


def freshness(scanned: DataFrame, tips: DataFrame, tolerance: int) -> DataFrame:
    """Lag per feed; never caught up while the feed or its tip is unknown or 0."""
    seen = scanned.groupBy("feed").agg(F.max("slot").alias("current_slot"))
    joined = tips.join(seen, "feed", "left")
    known = (F.coalesce("tip_slot", F.lit(0)) != 0) & (F.coalesce("current_slot", F.lit(0)) != 0)
    return joined.select(
        "feed", "tip_slot", "current_slot", (F.col("tip_slot") - F.col("current_slot")).alias("lag"),
        (known & F.coalesce(F.col("tip_slot") - F.col("current_slot") < tolerance, F.lit(False))).alias("caught_up"),
    )


def progress(scanned: DataFrame, tips: DataFrame, slot_seconds: int, behind_seconds: int) -> DataFrame:
    """Share of the first..tip range processed, slots left, and whether the newest block is old."""
    seen = scanned.groupBy("feed").agg(F.max("slot").alias("current_slot"))
    joined = tips.join(seen, "feed", "left").withColumn("current_slot", F.coalesce("current_slot", "first_slot"))
    done, span = F.col("current_slot") - F.col("first_slot"), F.col("tip_slot") - F.col("first_slot")
    left = F.col("tip_slot") - F.col("current_slot")
    return joined.select(
        "feed", F.when(span > 0, F.floor(done * 10000 / span)).otherwise(10000).cast("bigint").alias("covered_bp"),
        left.alias("remaining_slots"), (left * slot_seconds > behind_seconds).alias("behind"),
    )


def slot_time(slot: str, genesis_seconds: int):
    return F.timestamp_seconds(F.col(slot) + F.lit(genesis_seconds))
