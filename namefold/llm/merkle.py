"""Merkle manifest by checkpoint and recompute: every ``STEP``-th level is stored, what lies between is made again from it when a proof asks.

One tree per source over its documents, and one over the sources' roots. A
stored node and the up to ``ARITY ** STEP`` stored nodes ``STEP`` levels below
it are an aligned subtree. Building hashes a subtree up to its top and keeps
only the top. A proof goes from the top down: a subtree gets the path above its
top, makes its missing levels again, gives each of its lowest nodes the path
from there, and forgets them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namefold.scratch import materialize

#: Children of a node, and levels from one stored level to the next.
ARITY, STEP = 16, 2
WIDTH = ARITY**STEP
#: The columns that tell one tree from another; a null source is a tree of its own and comes first.
TREE = ("named", "name")
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(texts: list[str]) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def levels(nodes: list[str], whole: int) -> list[list[str]]:
    """A subtree's levels from its lowest nodes up. ``whole`` is the size of the tree's level that they are a part of.

    A level of one node is a tree's end, but in a larger tree it is a last run
    of one, which is hashed like any other.
    """
    out = [nodes]
    for _ in range(STEP):
        if whole == 1:
            break
        nodes, whole = [digest(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)], -(-whole // ARITY)
        out.append(nodes)
    return out


def leaf(fields: dict[str, Column]) -> Column:
    """The digest of a row: per field ``-`` if null, else its UTF-8 byte count, a colon and its value."""
    parts = []
    for name in LEAF_FIELDS:
        value = fields[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def placed(nodes: DataFrame, order: list[str], label: str) -> DataFrame:
    """Adds ``at``, the place in the tree from 0 by ``order``, and ``whole``, the tree's size.

    Rows are dealt out by ranges of (tree, order), so a tree with a third of all
    rows lies in many ranges. A row's place is its place within the range and
    the sizes of the tree's ranges before; of these there is one row per range.
    """
    dealt = materialize(nodes.repartitionByRange(*TREE, *order).withColumn("part", F.spark_partition_id()), label)
    parts = dealt.groupBy(*TREE, "part").agg(F.count("*").alias("n"))
    tree = Window.partitionBy(*TREE).orderBy("part")
    before = parts.select(
        *TREE, "part", (F.sum("n").over(tree) - F.col("n")).alias("before"),
        F.sum("n").over(tree.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("whole"),
    )
    within = F.row_number().over(Window.partitionBy(*TREE, "part").orderBy(*order))
    return dealt.withColumn("within", within).join(before, [*TREE, "part"]).withColumn("at", F.col("before") + F.col("within") - 1).drop("part", "within", "before")


@dataclass
class Levels:
    """The stored levels of all trees, lowest first: (named, name, at, whole, node); ``roots`` has (named, name, node)."""

    stored: list[DataFrame]
    roots: DataFrame


@dataclass
class Manifest:
    documents: Levels
    sources: Levels


def build(nodes: DataFrame) -> Levels:
    """Stores every ``STEP``-th level above ``nodes`` (named, name, at, whole, node)."""

    def top(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        whole = rows["whole"][0].as_py()
        held = levels(rows.sort_by("at")["node"].to_pylist(), whole)
        size = whole
        for _ in held[1:]:
            size = -(-size // ARITY)
        return pa.table({"named": [key[0].as_py()], "name": [key[1].as_py()], "at": [key[2].as_py()], "whole": [size], "node": [held[-1][0]]}, schema=_NODES)

    stored, roots = [], []
    level = nodes.select(*TREE, "at", "whole", "node")
    most = nodes.agg(F.max("whole")).first()[0] or 0
    while True:
        stored.append(level)
        roots.append(level.where("whole = 1").select(*TREE, "node"))
        if most <= 1:
            break
        grown = level.where("whole > 1").groupBy(*TREE, F.floor(F.col("at") / WIDTH).cast("long").alias("sub")).applyInArrow(top, "named boolean, name string, at long, whole long, node string")
        level = materialize(grown, "level")
        most = -(-most // WIDTH)
    every = roots[0]
    for more in roots[1:]:
        every = every.unionByName(more)
    return Levels(stored, every)


_NODES = pa.schema([("named", pa.bool_()), ("name", pa.string()), ("at", pa.int64()), ("whole", pa.int64()), ("node", pa.string())])
_PATH = "named boolean, name string, at long, node string, lefts array<string>, rights array<string>, subroot string, root string"
_PATHS = pa.schema([
    ("named", pa.bool_()), ("name", pa.string()), ("at", pa.int64()), ("node", pa.string()), ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string())),
    ("subroot", pa.string()), ("root", pa.string()),
])


def paths_below(rows: pa.Table, above: pa.Table) -> Iterator[tuple[int, list[str], list[str]]]:
    """Of each lowest node of a subtree, in order: its row, and level by level the siblings to its left and right, up to the root."""
    order = pc.sort_indices(rows["at"]).to_pylist()
    held = levels(rows["node"].take(pa.array(order)).to_pylist(), rows["whole"][0].as_py())
    lefts_above, rights_above = above["lefts"][0].as_py(), above["rights"][0].as_py()
    for i, row in enumerate(order):
        lefts, rights = [], []
        for level in held[:-1]:
            run = i - i % ARITY
            lefts.append("".join(level[run:i]))
            rights.append("".join(level[i + 1 : run + ARITY]))
            i //= ARITY
        yield row, lefts + lefts_above, rights + rights_above


def folded(node: str, lefts: list[str], rights: list[str]) -> str:
    for left, right in zip(lefts, rights):
        node = digest([left, node, right])
    return node


def _descend(key: tuple[pa.Scalar, ...], rows: pa.Table, above: pa.Table) -> pa.Table:
    found = list(paths_below(rows, above))
    taken = rows.take(pa.array([row for row, _, _ in found], pa.int64()))
    same = {c: pa.array([above[c][0].as_py()] * len(found), pa.string()) for c in ("subroot", "root")}
    return pa.table({
        **{c: taken[c] for c in ("named", "name", "at", "node")}, "lefts": [x for _, x, _ in found], "rights": [x for _, _, x in found], **same,
    }, schema=_PATHS)


def _under(nodes: DataFrame, above: DataFrame, tops: DataFrame):
    """The subtrees of a stored level, grouped with the path above each: that of the node one stored level up, or of its tree's root where a tree is a lone node."""
    alone = nodes.where("whole = 1").select(*TREE).join(tops, [*TREE]).select(*above.columns)
    every = above.unionByName(alone)
    return nodes.groupBy(*TREE, F.floor(F.col("at") / WIDTH).cast("long").alias("sub")).cogroup(every.groupBy(*TREE, F.col("at").alias("sub")))


def paths_above(stored: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Paths of the nodes of ``stored[1]``, from the paths ``tops`` of all trees' roots (named, name, at = 0, node, lefts, rights, subroot, root); from the top down."""
    above = tops.where("false")
    for level in reversed(stored[1:]):
        above = materialize(_under(level, above, tops).applyInArrow(_descend, _PATH), "paths")
    return above


def manifest(docs: DataFrame) -> tuple[DataFrame, Manifest]:
    """The leaves (named, name, doc_id, node, changed, at, whole) and the stored levels of the documents' and the sources' trees.

    A leaf is the digest of a row's doc_id, source, lang, n_chars and text.
    Leaves of a source ascend by doc_id, a null one first, rows that share one
    by digest; equal rows are leaves of their own. ``changed`` is the digest of
    the row with the A-Z of its text in lower case where 5 divides the crc32 of
    the decimal doc_id, else null; a null doc_id is never changed. A tree's
    level of n > 1 nodes has ceil(n / 16) above it, the last run as short as it
    comes, even one node; a lone leaf is its tree's root. Other columns are not read.

    Scale: texts are read once and never shuffled, only digests move. A tree
    is cut into ranges and then into subtrees of ``WIDTH`` nodes, so no task
    holds a source. Stored above the leaves are 1 / 255 as many nodes.
    """
    fields = {name: F.col(name) for name in LEAF_FIELDS}
    lower = {**fields, "text": F.translate(F.col("text").cast("string"), ascii_uppercase, ascii_lowercase)}
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    source = F.col("source").cast("string")
    leaves = docs.select(
        source.isNotNull().alias("named"), F.coalesce(source, F.lit("")).alias("name"), F.col("doc_id").alias("doc_id"), leaf(fields).alias("node"),
        F.when(hit, leaf(lower)).alias("changed"), F.monotonically_increasing_id().alias("tie"),
    )
    leaves = materialize(placed(materialize(leaves, "leaves"), ["doc_id", "node", "tie"], "dealt").drop("tie"), "leaves")
    documents = build(leaves)
    subroots = documents.roots.select(F.lit(True).alias("named"), F.lit("").alias("name"), "node", F.col("named").alias("of_named"), F.col("name").alias("of_name"))
    ranked = materialize(placed(subroots, ["of_named", "of_name"], "subroots"), "subroots")
    sources = build(ranked)
    return leaves, Manifest(documents, Levels([ranked, *sources.stored[1:]], sources.roots))


def proofs(leaves: DataFrame, stored: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, ``proof`` (siblings of all levels, joined), folded_root, verified; one row per leaf.

    The root is folded from the changed leaf where there is one and from the
    siblings as stored. Lost interior nodes are made again subtree by subtree;
    a leaf's proof is made in the task that holds its subtree.
    """
    none = F.array().cast("array<string>")
    empty = [none.alias("lefts"), none.alias("rights")]
    root = materialize(stored.sources.roots.select(*TREE, F.lit(0).cast("long").alias("at"), "node", *empty, F.col("node").alias("subroot"), F.col("node").alias("root")), "root")
    ranked = stored.sources.stored[0]
    reached = _under(ranked, paths_above(stored.sources.stored, root), root).applyInArrow(_descend, _PATH)
    tops = materialize(reached.join(ranked.select(*TREE, "at", "of_named", "of_name"), [*TREE, "at"]).select(
        F.col("of_named").alias("named"), F.col("of_name").alias("name"), F.lit(0).cast("long").alias("at"), "node", "lefts", "rights", F.col("node").alias("subroot"), "root",
    ), "tops")

    def last(key: tuple[pa.Scalar, ...], rows: pa.Table, above: pa.Table) -> pa.Table:
        out = []
        subroot, root = above["subroot"][0].as_py(), above["root"][0].as_py()
        nodes, changed, ids = (rows[c].to_pylist() for c in ("node", "changed", "doc_id"))
        for row, lefts, rights in paths_below(rows, above):
            end = folded(changed[row] or nodes[row], lefts, rights)
            out.append((ids[row], nodes[row], subroot, root, "".join(x for pair in zip(lefts, rights) for x in pair), end, end == root))
        return pa.table(dict(zip(_PROOF, (pa.array(c, t) for c, t in zip(zip(*out), [rows.schema.field("doc_id").type, *[pa.string()] * 5, pa.bool_()])))))

    schema = f"doc_id {leaves.schema['doc_id'].dataType.simpleString()}, leaf string, subroot string, root string, proof string, folded_root string, verified boolean"
    return _under(leaves, paths_above(stored.documents.stored, tops), tops).applyInArrow(last, schema)


_PROOF = ("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified")
