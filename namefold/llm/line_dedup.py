"""Repeated passages of three lines: a window of three consecutive lines seen before is removed with its lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namefold.llm.common import text_key, whole_text
from namefold.scratch import materialize

WINDOW = 3


def line_dedup(docs: DataFrame) -> DataFrame:
    """``row`` (all input columns), n_lines, n_removed, ``kept_text``.

    Lines are split at line feeds. Lines without a word take part in no window
    and stay. The order of occurrences is (doc_id, text hash, position), a null
    doc_id first; the first occurrence of a window stays, the lines of all
    later ones go, overlapping ones merged. Rows equal in doc_id and text are
    one document and get one result. Texts with fewer than three lines lose
    nothing. A null text is empty. An empty table gives no rows.

    Scale: a window is a 16-byte hash in the shuffle, counted per task first;
    positions are collected per document only. A very common window is one row
    on the counted side, so its occurrences can be split over tasks.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_key(F.col("text")).alias("tk"), F.split(whole_text(F.col("text")), "\n", -1).alias("lines"))
    spoken = F.filter(F.transform("lines", lambda line, at: F.struct(line.alias("line"), at.alias("at"))), lambda x: x["line"].rlike(r"[^\x20\x09-\x0D]"))
    worded = rows.select("id", "tk", spoken.alias("spoken")).where(F.size("spoken") >= WINDOW)
    joined = F.transform(
        F.slice("spoken", 1, F.size("spoken") - (WINDOW - 1)),
        lambda x, i: F.struct(
            F.md5(F.concat(x["line"], F.lit("\n"), F.get("spoken", i + 1)["line"], F.lit("\n"), F.get("spoken", i + 2)["line"]).cast("binary")).alias("h"),
            x["at"].alias("a"), F.get("spoken", i + 1)["at"].alias("b"), F.get("spoken", i + 2)["at"].alias("c"),
        ),
    )
    windows = worded.select("id", "tk", F.inline(joined)).select("id", "tk", F.unhex("h").alias("h"), "a", "b", "c")
    place = F.struct("id", "tk", "a")
    repeated = materialize(windows.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("h", "first"), "lines")
    # One plan at every size: what is joined grows with the documents, so it is sorted and merged, never broadcast.
    later = windows.join(repeated.hint("merge"), "h").where(place > F.col("first"))
    gone = later.groupBy("id", "tk").agg(F.array_distinct(F.flatten(F.collect_set(F.array("a", "b", "c")))).alias("gone"))
    gone = materialize(gone.select(F.col("id").alias("gid"), F.col("tk").alias("gtk"), "gone"), "lines")
    out = rows.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("gid")) & (F.col("tk") == F.col("gtk")), "left")
    out = out.select("row", "lines", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    keep = F.when(F.size("gone") == 0, F.col("lines")).otherwise(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda at: F.get("lines", at)),
    )
    return out.select("row", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), F.array_join(keep, "\n").alias("kept_text"))
