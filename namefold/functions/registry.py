"""Label sets: sorted, distinct eight-digit prefixes joined without a separator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = 8


def labels_of(joined: Column) -> Column:
    """Split the joined form back into its sorted array."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(joined), F.lit("([0-9a-f]{8})"), F.lit(1))))


def join_labels(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), "")


def ensure_label(joined: Column, label: Column) -> Column:
    """Add a label; adding it twice changes nothing."""
    return join_labels(F.array_union(labels_of(joined), F.array(F.lower(label))))


def ensure_no_label(joined: Column, label: Column) -> Column:
    return join_labels(F.array_remove(labels_of(joined), F.lower(label)))


def apply_label(joined: Column, label: Column, amount: Column) -> Column:
    """Strict form: adding a present or dropping an absent label is an error."""
    present = F.array_contains(labels_of(joined), F.lower(label))
    fail = lambda text: F.raise_error(F.lit(text)).cast("string")
    return (
        F.when(F.length(label) != WIDTH, fail("LABEL_WIDTH"))
        .when((amount == 1) & present, fail("LABEL_ALREADY_PRESENT"))
        .when((amount == -1) & ~present, fail("LABEL_ABSENT"))
        .when(amount == 1, ensure_label(joined, label))
        .when(amount == -1, ensure_no_label(joined, label))
        .otherwise(fail("INVALID_AMOUNT"))
    )
