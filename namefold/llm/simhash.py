"""SimHash near-duplicates by covering locality-sensitive hashing.

For radius r every bit of a fingerprint gets a non-zero vector of r + 1 bits,
and every non-zero vector v makes a table whose key keeps the bits with odd
product with v. The at most r bits in which two near fingerprints differ span
a space in which some v is orthogonal to all of them, so they agree on that
whole key: no pair within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namefold.llm.common import whole_text
from namefold.llm.components import components
from namefold.scratch import materialize

BITS = 64
RADIUS = 4
SHINGLE = 4
#: Fingerprints of a bucket are compared in blocks of about this many; larger buckets are dealt out as pairs of blocks.
BLOCK = 2048
_PIECE = 1 << 15


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 2 ** (radius + 1))]


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z are lowered, only the six ASCII spaces split
    if not words:
        return 0
    line = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - shingle + 1, 1)
    first, last = starts[:n].tolist(), (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, _PIECE):
        hashes = np.array([digest(line[a:b], 42) for a, b in zip(first[at : at + _PIECE], last[at : at + _PIECE])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64), pa.int64())


def linked(codes: np.ndarray, block: np.ndarray, left: int, right: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to) that join what lies within the radius between two blocks, or inside one: each found row once.

    Spreads from a start over what is not yet reached, so a dense crowd costs
    little more than its size.
    """
    a, b, waiting = [], [], np.arange(len(codes))
    while len(waiting):
        front, waiting = waiting[:1], waiting[1:]
        while len(front) and len(waiting):
            x, front = front[0], front[1:]
            near = np.bitwise_count(codes[waiting] ^ codes[x]) <= radius
            if left != right:
                near &= block[waiting] != block[x]
            if near.any():
                found = waiting[near]
                a.append(np.full(len(found), codes[x]))
                b.append(codes[found])
                front, waiting = np.concatenate((front, found)), waiting[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        us, vs = [], []
        for left, right, members in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2)):
            codes = members.values.field("fp").to_numpy().view(np.uint64)
            block = members.values.field("block").to_numpy()
            u, v = linked(codes, block, left, right, RADIUS)
            us.append(u)
            vs.append(v)
        u, v = (np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64) for x in (us, vs))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def links(codes: DataFrame) -> DataFrame:
    """(u, v) links that connect all fingerprints of ``codes`` (fp: distinct) within the radius of each other.

    Of the pairs in a bucket only a spanning forest is given out. A bucket
    larger than a block is compared as pairs of blocks, each a row of its own.
    """
    keyed = codes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks()])).alias("table", "key"))
    crowds = materialize(keyed.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    members = keyed.join(crowds, ["table", "key"]).withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    paired = members.select("table", "key", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    groups = paired.groupBy("table", "key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right")).agg(
        F.collect_list(F.struct("fp", "block")).alias("members"),
    )
    return groups.where(F.size("members") > 1).select("left", "right", "members").mapInArrow(_links, "u long, v long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``row`` (all input columns), ``fp`` (bigint bits) and ``component_id``, the least doc_id reachable over links.

    A text without words, also a null one, has fingerprint zero and links like
    any other; fewer than four words are one shingle. A null doc_id is never
    the least; component_id is null only where a component has no other.
    Repeated rows share a component. An empty table gives no rows.

    Scale: equal fingerprints are one node. Nothing is collected; a hot
    fingerprint is one row on the labelled side of the closing join.
    """
    marked = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), fingerprints(whole_text(F.col("text"))).alias("fp"))
    nodes = materialize(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash")
    tied = components(links(nodes.select("fp")))
    labelled = nodes.join(tied, nodes.fp == tied.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    labelled = materialize(labelled, "simhash")
    names = materialize(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "simhash")
    named = materialize(labelled.join(names, "root").select(F.col("fp").alias("code"), "root", "component_id"), "simhash")
    # The labels grow with the documents: sorted and merged at every size.
    return marked.join(named.hint("merge"), F.col("fp") == F.col("code")).select("row", "fp", "root", "component_id")
