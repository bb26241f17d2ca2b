"""Event feed to current state, block by block, with Structured Streaming.

Each micro-batch is one `foreachBatch` call that reads the tables the call
before it wrote and writes its own under ``batch=<id>``. A repeated call
overwrites exactly what it wrote before, so a restart after a lost executor or
driver gives the same tables. Nothing is kept in memory between calls.

Tables below the work folder: ``state`` (touched names, ``exists = false`` marks
an ended record), ``mints``, ``blocks`` (every processed block), ``held`` (rows
not released yet), ``undo`` and ``status``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namefold.functions import assets
from namefold.operators import normalize, state
from namefold.scratch import materialize, release, shuffles_dropped
from namefold.sources import landed

STATUS_SCHEMA = "last_height BIGINT, halted BOOLEAN, events BIGINT, blocks BIGINT, names BIGINT"


class GapError(ValueError):
    """The feed skipped a block height."""


class LateRowsError(RuntimeError):
    """The feed holds rows of an applied block that were not applied with it."""


class EndedBeforeTipError(RuntimeError):
    """The feed ended before the block it was to be read up to."""


class UndoneStateError(RuntimeError):
    """Tables hold blocks that the chain has taken back."""


def complete_blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of blocks that have a successor, and the rows of the newest block."""
    top = rows.agg(F.max("height")).scalar()
    return rows.filter(F.col("height") < top), rows.filter(F.col("height") == top)


def before_undo(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that arrived before the first undo, and all from it on."""
    first = rows.filter(F.col("action") == "undo").agg(F.min("seq")).scalar()
    early = F.coalesce(F.col("seq") < first, F.lit(True))
    return rows.filter(early), rows.filter(~early)


def distinct_events(rows: DataFrame) -> DataFrame:
    """One row per asset and transaction of a block: a repeated delivery adds nothing."""
    keys = ["hash", "tx_hash", "idx", "hex", "kind"]
    rest = [c for c in rows.columns if c not in keys]
    # The first delivery counts, so that positions do not depend on the plan.
    first = rows.filter(F.col("action") == "apply").groupBy(*keys).agg(F.min_by(F.struct(*rest), "seq").alias("r"))
    return first.select(*keys, "r.*").select(*rows.columns)


def row_digest() -> Column:
    """What a row says, whenever and in whatever order it was delivered."""
    return F.xxhash64(*[c for c in landed.EVENT_COLUMNS if c not in ("seq", "action")])


def check_contiguous(rows: DataFrame, last_height: int | None) -> tuple[int | None, int]:
    """Newest height and number of the released blocks; a missing height is an error."""
    low, high, count = rows.agg(F.min("height"), F.max("height"), F.count_distinct("height")).first()
    if count == 0:
        return last_height, 0
    expected = low if last_height is None else last_height + 1
    if low != expected or high - low + 1 != count:
        raise GapError(f"feed skipped a height between {expected} and {high}")
    return high, count


def fold_events(rows: DataFrame) -> DataFrame:
    """Feed rows in the form of the fold; rows of kind ``spend`` are inputs, not events."""
    burn = F.col("kind").isin(*state.BURNS)
    rank = F.when(F.col("kind") == "burn", 0).when(F.col("kind") == "label_burn", 1).when(
        F.col("label") == assets.LABEL_OWNER, 2).otherwise(3)
    return rows.filter(F.col("name").isNotNull() & (F.col("kind") != "spend")).select(
        "name", "policy", "label", "hex", assets.owner_hex_of(F.col("hex")).alias("owner_hex"), "kind", "slot", rank.alias("rank"),
        F.col("seq").alias("tx_pos"), "idx", F.when(~burn, F.concat_ws("#", "tx_hash", "idx")).alias("utxo"), "address", "holder",
        "lovelace", "script", "datum", F.coalesce("is_mint", F.lit(False)).alias("is_mint"), "datum_holder", "metadata",
    )


def spent_outputs(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("kind") == "spend").select(F.concat_ws("#", "tx_hash", "idx").alias("utxo"), "slot")


@dataclass
class BlockLedger:
    """Gate of complete blocks below ``work``: what every ingest job needs."""

    spark: SparkSession
    work: str
    until: int | None = field(default=None, kw_only=True)  # newest height to apply; later blocks are held

    def _path(self, table: str, batch: int) -> str:
        return f"{self.work}/{table}/batch={batch}"

    def _write(self, df: DataFrame, table: str, batch: int) -> None:
        with shuffles_dropped(df.sparkSession):
            df.write.mode("overwrite").parquet(self._path(table, batch))

    def _read(self, table: str, batches: list[int]) -> DataFrame | None:
        if not batches:
            return None
        root = f"{self.work}/{table}"
        return self.spark.read.option("basePath", root).parquet(*[self._path(table, i) for i in batches])

    def table(self, name: str, upto: int) -> DataFrame | None:
        """Rows of a table after batch ``upto``."""
        return self._read(name, list(range(upto + 1)))

    def undo_log(self, upto: int) -> DataFrame:
        return self.table("undo", upto).drop("batch").dropDuplicates(["seq"])

    def _status(self, batch: int) -> tuple[int | None, bool]:
        if batch < 0:
            return None, False
        row = self._read("status", [batch]).first()
        return row["last_height"], row["halted"]

    def _resumed(self, batch: int) -> DataFrame | None:
        """Held rows as `resume` left them, if it was called after this batch."""
        try:
            return self._read("resumed", [batch])
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def resume(self, batch: int) -> None:
        """Go on after an undo that ended batch ``batch``: rows of undone blocks are
        dropped from the held ones. If an undone block was applied, the tables
        are wrong from it on; then rebuild or repair into a new work folder."""
        if not self.undo_log(batch).filter("applied").isEmpty():
            raise UndoneStateError("an undone block was already applied")
        held = self._read("held", [batch]).drop("batch")
        undone = held.filter(F.col("action") == "undo").groupBy("hash").agg(F.max("seq").alias("__until"))
        kept = held.filter(F.col("action") == "apply").join(undone, "hash", "left").filter(
            F.coalesce(F.col("seq") > F.col("__until"), F.lit(True))).select(*held.columns)
        self._write(kept, "resumed", batch)

    def process(self, rows: DataFrame, batch: int) -> None:
        """Apply one micro-batch. After an undo nothing more is applied: blocks
        before it are, the rest is held until a repair has compared the state
        with the canonical chain."""
        last_height, halted = self._status(batch - 1)
        rows = rows.select(*landed.EVENT_COLUMNS)
        if batch > 0:
            resumed = self._resumed(batch - 1) if halted else None
            halted = halted and resumed is None
            held = self._read("held", [batch - 1]) if resumed is None else resumed
            rows = rows.unionByName(held.drop("batch"))
        # Read some ten times. Landed it takes less room than cached blocks that spill, and goes when the batch ends.
        rows = materialize(rows, "rows", codec="zstd")
        try:
            early, late = before_undo(rows)
            if halted:
                early, late = rows.filter(F.lit(False)), rows
            early = self._without_applied(early, last_height, batch)
            released, tip = complete_blocks(early)
            if self.until is not None:
                tip = tip.unionByName(released.filter(F.col("height") > self.until))
                released = released.filter(F.col("height") <= self.until)
            height, blocks = check_contiguous(released, last_height)
            undone = rows.filter(F.col("action") == "undo").select(
                "seq", "slot", "height", "hash", (F.col("height") <= F.lit(-1 if height is None else height)).alias("applied"))
            names = self.apply(released, batch)
            self._write(released.select("slot", "height", "hash").distinct(), "blocks", batch)
            self._write(released.select("height", "hash", row_digest().alias("digest")).distinct(), "applied", batch)
            self._write(undone, "undo", batch)
            self._write(late if halted else tip.unionByName(late), "held", batch)
            stopped = F.lit(halted) | (undone.agg(F.count("*")).scalar() > 0)
            status = released.agg(F.count("*").alias("events")).select(
                F.lit(height).cast("bigint").alias("last_height"), stopped.alias("halted"), "events",
                F.lit(blocks).cast("bigint").alias("blocks"), F.lit(names).cast("bigint").alias("names"))
            self._write(status, "status", batch)
        finally:
            release(rows.sparkSession, rows)

    def _without_applied(self, rows: DataFrame, last_height: int | None, batch: int) -> DataFrame:
        """Rows above the applied blocks. A row delivered again is ignored; another block at
        an applied height, and a row that its block was applied without, are errors."""
        again = F.col("height") <= F.lit(-1 if last_height is None else last_height)
        repeated = rows.filter(again).select("height", "hash", row_digest().alias("digest")).distinct()
        low, high = repeated.agg(F.min("height"), F.max("height")).first()
        if low is None:
            return rows
        # Only the heights in question are read of what was applied.
        known = F.col("height").between(low, high)
        other = repeated.join(self.table("blocks", batch - 1).filter(known).select("height", "hash"), ["height", "hash"], "left_anti")
        if not other.isEmpty():
            raise GapError(f"feed holds another block at or below the applied height {last_height}")
        applied = self.table("applied", batch - 1).filter(known).select("height", "hash", "digest")
        late = repeated.join(applied, ["height", "hash", "digest"], "left_anti").agg(F.min("height"), F.count("*")).first()
        if late[1]:
            raise LateRowsError(f"{late[1]} rows of applied blocks came late, the first for height {late[0]}")
        return rows.filter(~again)

    def apply(self, released: DataFrame, batch: int) -> int:
        """What a job makes of the released blocks; returns the names it touched."""
        return 0


@dataclass
class CurrentState(BlockLedger):
    """Keeps the current record of every name."""

    policies: tuple[str, ...] = ()  # tracked ones; all if empty
    compact_every: int = 20
    strict: bool = True  # a name without a mint record stops the job
    og_list: DataFrame | None = None  # as of `state.fold`

    def _newest(self, upto: int) -> DataFrame:
        """Newest row per name: the last full copy and the batches after it."""
        full = upto // self.compact_every * self.compact_every
        if full > 0 and full == upto:
            full -= self.compact_every
        parts = self._read("state", list(range(full + 1, upto + 1)))
        base = self._read("full" if full > 0 else "state", [full])
        every = base if parts is None else base.unionByName(parts)
        columns = [c for c in every.columns if c not in ("name", "batch")]
        return every.groupBy("name").agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("name", "r.*")

    def records(self, upto: int) -> DataFrame | None:
        return self._newest(upto).filter("exists").drop("exists") if upto >= 0 else None

    def apply(self, released: DataFrame, batch: int) -> int:
        # Failed transactions stay in the ledger of blocks; they change nothing.
        once = distinct_events(released.filter(F.coalesce("successful", F.lit(True))))
        if self.policies:
            once = normalize.tracked(once, self.policies)
        once = materialize(once, "once", codec="zstd")
        every = fold_events(once)
        events = materialize(state.prepare(state.net_of_block(every.drop("metadata"), spent_outputs(once))), "events", codec="zstd")
        touched = events.select("name").distinct()
        # Mint history counts every output, also one spent in its own block.
        self._write(every.filter("is_mint").select(
            "name", F.col("slot").alias("created_slot"), F.split_part("utxo", F.lit("#"), F.lit(1)).alias("tx_hash"),
            F.coalesce("metadata", F.lit("{}")).alias("metadata"),
        ).distinct(), "mints", batch)
        release(once.sparkSession, once)
        mints = self.table("mints", batch).drop("batch").join(touched, "name", "left_semi").distinct()
        prior = self.records(batch - 1)
        landed_here = [events]
        if prior is None:
            records = state.fold(events, mints, og_list=self.og_list, strict=self.strict).withColumn("exists", F.lit(True))
        else:
            prior = materialize(prior.join(touched, "name", "left_semi"), "prior")
            landed_here.append(prior)
            records = state.fold(events, mints, prior, og_list=self.og_list, strict=self.strict)
        self._write(records, "state", batch)
        if batch > 0 and batch % self.compact_every == 0:
            self._write(self._newest(batch), "full", batch)
        release(events.sparkSession, *landed_here)
        return self._read("state", [batch]).count()


def run(job: BlockLedger, feed: str, *, files_per_batch: int = 1) -> None:
    """Process all landed files of a feed and stop; run it again to go on.

    With ``job.until`` it is an error if the feed ends before that block is applied;
    a block is applied once the feed shows a later one.
    """
    query = (
        landed.stream_events(job.spark, feed, files_per_batch=files_per_batch)
        .writeStream.foreachBatch(job.process)
        .option("checkpointLocation", f"{job.work}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if job.until is not None:
        height = job.table("status", last_batch(job)).agg(F.max("last_height")).first()[0]
        if height is None or height < job.until:
            raise EndedBeforeTipError(f"feed ended at height {height}, before {job.until}")


def last_batch(job: BlockLedger) -> int:
    """Newest batch whose status is written."""
    statuses = job.spark.read.option("basePath", f"{job.work}/status").schema(STATUS_SCHEMA + ", batch INT").parquet(f"{job.work}/status")
    return statuses.agg(F.max("batch")).first()[0]
