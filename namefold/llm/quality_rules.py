"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namefold.llm.common import WORD, whole_text

#: Frequent words of the four languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "are", "as", "with", "at", "be", "this", "from", "or", "by",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "est", "que", "qui", "dans", "en", "pour", "par", "pas", "sur", "au", "avec",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "des", "sich", "nicht", "auf", "ein", "eine", "als", "auch", "dem", "im", "für",
    "el", "los", "las", "y", "que", "una", "por", "con", "no", "del", "se", "lo", "su", "al", "es", "a", "para", "mi", "o", "como",
)
MIN_WORDS = 50
#: (name, measure, comparison that keeps, bound). A measure names a column of `measures`.
RULES = (
    ("enough_words", "n_words", ">=", 50.0),
    ("word_length_low", "mean_word_chars", ">=", 2.0),
    ("word_length_high", "mean_word_chars", "<=", 14.0),
    ("few_symbols", "symbols_per_word", "<=", 0.3),
    ("stop_words", "stop_word_ratio", ">=", 0.05),
    ("few_repeated_lines", "dup_line_ratio", "<=", 0.5),
)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all input columns) and the measures of each text; a null text has no words and no lines with words."""
    whole = whole_text(F.col(text))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(
        F.struct("*").alias("row"), F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines"),
        (F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
    )
    window = F.transform(
        F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))),
        lambda w, i: F.concat(w, F.lit(" "), F.get("words", i + 1), F.lit(" "), F.get("words", i + 2)),
    )
    stop = F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))
    counted = base.select(
        "row", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(stop).cast("long").alias("n_stop_words"), window.alias("windows"),
    )
    # Sorted only where an equal pair exists.
    ordered = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))),
    )
    starts = F.array_sort(F.transform(
        F.filter("ordered", lambda x, j: (F.get("ordered", j + 1)["w"] == x["w"]) | (F.get("ordered", j - 1)["w"] == x["w"])), lambda x: x["i"],
    ))
    overlap = F.transform("starts", lambda s, j: F.greatest(F.lit(3) - (s - F.coalesce(F.get("starts", j - 1), F.lit(-3))), F.lit(0)))
    covered = F.size("starts") * 3 - F.aggregate(overlap, F.lit(0), lambda total, x: total + x)
    kept = [c for c in counted.columns if c != "windows"]
    # Starts of windows that sort next to an equal, again in order of position: each covers three words, less what the one before covers.
    return (
        counted.select(*kept, ordered.alias("ordered"))
        .select(*kept, starts.alias("starts"))
        .select(*kept, F.coalesce(F.when(F.col("starts").isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"))
    )


def verdict(rules: tuple[tuple[str, str, str, float], ...] = RULES) -> Column:
    """True where all rules of the table hold; a measure without words holds none of the ratio rules' meaning and counts as 0."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    known = {
        "n_words": F.col("n_words").cast("double"),
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "stop_word_ratio": F.col("n_stop_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
    }
    held = F.lit(True)
    for _, measure, comparison, bound in rules:
        held = held & (known[measure] >= bound if comparison == ">=" else known[measure] <= bound)
    return held


def quality_rules(docs: DataFrame, rules: tuple[tuple[str, str, str, float], ...] = RULES) -> DataFrame:
    """``row`` (all input columns), the measures, ``base_failed`` and ``kept``.

    Works on rows alone: no shuffle. A null or empty text fails the base
    (fewer than 50 words). Repeated rows get equal results; an empty table
    gives no rows.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return measures(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
