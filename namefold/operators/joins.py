"""Left joins whose key is often missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_lookup(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Left join on a text key that may be null in ``rows``.

    A plain left join sends all rows without a key to one task. Here they get
    keys of their own, spread by the row's hash; the leading control character
    keeps those from meeting a real one.
    """
    hashable = [column for column, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    spread = F.concat(F.lit("\x01"), F.xxhash64(*hashable).cast("string"))
    keyed = rows.withColumn("__key", F.coalesce(F.col(key).cast("string"), spread))
    other = side.filter(F.col(key).isNotNull()).withColumn("__key", F.col(key).cast("string")).drop(key)
    return keyed.join(other, "__key", "left").drop("__key")
