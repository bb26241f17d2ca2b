"""Connected components by alternating star steps: each step is a minimum per node and a join, whatever the sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namefold.scratch import materialize


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _step(edges: DataFrame, arcs: DataFrame, larger_only: bool) -> DataFrame:
    """Each neighbour of a node is tied to the least node among them and the node itself.

    The minima are written before the join: a node with very many neighbours
    is then one row on one side, and the other side can be split.
    """
    least = materialize(arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
    tied = arcs.join(least, "u")
    out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if larger_only else tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return materialize(out.where("u <> v").distinct(), "stars")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that occurs in ``edges`` (u, v: bigint); root is the least node of its component.

    Loops are ignored, directions too. No edges give no rows. The number of
    rounds grows with the logarithm of the longest path.
    """
    current = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "stars")
    mark = _mark(current)
    while mark[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _step(current, both, larger_only=True)
        current = _step(large, large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), larger_only=False)
        last, mark = mark, _mark(current)
        if last == mark:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
