"""Benchmark decontamination by winnowing: the least gram hash of each window is kept, shared prints are joined, hits are extended to whole windows.

Of every ``WINDOW`` consecutive grams of ``GRAM`` words the one with the least
hash is kept, the leftmost of equal ones. Equal spans of ``SPAN`` words hold
the same ``WINDOW`` grams, so both texts keep the same one: every shared span
of ``SPAN`` words shares a print. A shared print only names places to look at;
the windows around it are compared word by word.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namefold.llm.common import text_key, whole_text
from namefold.scratch import materialize

#: Words of a window of an item, and of a hashed gram; a window holds ``WINDOW`` grams.
SPAN, GRAM = 10, 5
WINDOW = SPAN - GRAM + 1
#: What lies between words once A-Z are lower case, and a word of the text as it is.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once per row: a lambda variable, which the optimizer can't copy into the loops of the body."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(whole_text(text), ascii_uppercase, ascii_lowercase), BREAK, -1), "")


def grams(w: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words."""
    each = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(w) >= k, each).otherwise(F.array().cast("array<bigint>"))


def _prints(g: Column, length: int, places: Column) -> Column:
    return F.transform(places, lambda p: F.struct(F.lit(length).alias("len"), F.get(g, p).alias("h"), p.alias("p")))


def winnowed(w: Column) -> Column:
    """(len, h, p) of the kept grams of a text of at least ``SPAN`` words; p counts words from 0."""

    def kept(g: Column) -> Column:
        least = F.transform(
            F.sequence(F.lit(1), F.size(g) - (WINDOW - 1)),
            lambda i: let(F.slice(g, i, WINDOW), lambda s: (i + F.array_position(s, F.array_min(s)) - 2).cast("int")),
        )
        return _prints(g, SPAN, F.array_distinct(least))

    return F.when(F.size(w) >= SPAN, let(grams(w, GRAM), kept)).otherwise(F.array().cast("array<struct<len:int,h:bigint,p:int>>"))


def every_gram(w: Column, k: int) -> Column:
    """(len, h, p) of all runs of ``k`` words: a window shorter than a span is a single gram and is kept."""
    return let(grams(w, k), lambda g: _prints(g, k, F.when(F.size(g) > 0, F.sequence(F.lit(0), F.size(g) - 1)).otherwise(F.array().cast("array<int>"))))


def windows_at(w: Column, spots: Column) -> Column:
    """(len, at, window) of all windows that hold one of the gram places (len, p): up to ``WINDOW`` starts around a kept gram."""
    starts = F.flatten(F.transform(spots, lambda s: F.transform(
        F.when(s["len"] == SPAN, F.sequence(F.greatest(s["p"] - (WINDOW - 1), F.lit(0)), F.least(s["p"], F.size(w) - SPAN))).otherwise(F.array(s["p"])),
        lambda at: F.struct(s["len"].alias("len"), at.alias("at")),
    )))
    return F.transform(F.array_distinct(starts), lambda s: F.struct(s["len"].alias("len"), s["at"].alias("at"), F.array_join(F.slice(w, s["at"] + 1, s["len"]), " ").alias("window")))


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, len, window, prints) of every item with a word: its windows and, on the first of them, its prints."""
    short = [F.when(F.size("w") == k, every_gram(F.col("w"), k)) for k in range(1, SPAN)]
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(SPAN))
    every = F.transform(F.sequence(F.lit(0), F.size("w") - length), lambda at: F.array_join(F.slice(F.col("w"), at + 1, length), " "))
    return items.select("item", length.alias("len"), F.coalesce(*short, winnowed(F.col("w"))).alias("prints"), F.array_distinct(every).alias("windows"))


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """``row`` (all input columns), n_words, n_hit, ``spans`` (at, len in words, ascending), ``items`` (ids as strings, sorted).

    A word is hit if it lies in an occurrence of a window of any item: ``SPAN``
    consecutive words, or all words of a shorter item. A null or empty text has
    no words, hits nothing and, as an item, is found nowhere. Items that repeat
    an id are one item; those with a null id are one item with the empty id.
    Rows equal in key and text get one result; a null key is a key. Without
    documents there are no rows, without items no hits. Columns of any other
    name ride along in ``row``.

    Scale: prints are computed where the text lies and only those shared with
    the benchmark go on; texts are shuffled once, to those. Nothing is
    broadcast by order. A frequent passage is one row on the benchmark's side,
    so the documents that hold it can be split over tasks. Only places within
    one document and the items of one document are collected.
    """
    items = materialize(item_windows(benchmark, item), "items")
    of_item = materialize(items.select("item", F.explode("windows").alias("window")).distinct(), "windows")
    known = materialize(items.select(F.inline("prints")).select("len", "h").distinct(), "prints")
    # At most SPAN - 1 lengths of items shorter than a span.
    short = sorted(r["len"] for r in items.where(F.col("len") < SPAN).select("len").distinct().collect())

    rows = docs.select(F.col(key).alias("id"), text_key(F.col(text)).alias("tk"), F.col(text).alias("text"))
    prints = let(words(F.col("text")), lambda w: F.concat(winnowed(w), *[every_gram(w, k) for k in short]))
    shared = rows.select("id", "tk", F.inline(prints)).join(known, ["len", "h"], "left_semi")
    spots = materialize(shared.groupBy(F.col("id").alias("gid"), F.col("tk").alias("gtk")).agg(F.collect_set(F.struct("len", "p")).alias("spots")), "spots")

    # One plan at every size: what is joined grows with the documents, so it is sorted and merged, never broadcast.
    found = rows.join(spots.hint("merge"), F.col("id").eqNullSafe(F.col("gid")) & (F.col("tk") == F.col("gtk")))
    around = found.select("gid", "gtk", F.inline(let(words(F.col("text")), lambda w: windows_at(w, F.col("spots")))))
    hits = materialize(around.join(of_item.select("window").distinct(), "window", "left_semi"), "hits")
    held = hits.select("gid", "gtk", "window").distinct().join(of_item, "window").select("gid", "gtk", "item")
    spans = hits.select("gid", "gtk", F.struct("at", "len").alias("span"), F.lit(None).cast("string").alias("item"))
    both = spans.unionByName(held.select("gid", "gtk", F.lit(None).cast("struct<at:int,len:int>").alias("span"), "item"))
    verdict = both.groupBy("gid", "gtk").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    verdict = materialize(verdict, "verdict")

    every = docs.select(
        F.struct("*").alias("row"), F.col(key).alias("id"), text_key(F.col(text)).alias("tk"),
        F.regexp_count(whole_text(F.col(text)), F.lit(WORD)).cast("long").alias("n_words"),
    )
    out = every.join(verdict.hint("merge"), F.col("id").eqNullSafe(F.col("gid")) & (F.col("tk") == F.col("gtk")), "left")
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(
        F.coalesce("spans", F.array().cast("array<struct<at:int,len:int>>")), none,
        lambda seen, s: F.struct(F.greatest(seen["end"], s["at"] + s["len"]).alias("end"), (seen["n"] + F.greatest(s["at"] + s["len"] - F.greatest(seen["end"], s["at"]), F.lit(0))).alias("n")),
    )
    return out.select(
        "row", "n_words", covered["n"].cast("long").alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<at:int,len:int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
