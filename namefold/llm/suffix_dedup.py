"""Repeated substrings by a sparse suffix array.

Suffixes start at tokens only: of every 200-byte window the 40-byte string with
the least hash, so that equal windows hold the same token at the same place and
each window belongs to exactly one token. Suffixes whose token occurs again are
dealt out by sampled splitters over their leading token, sorted in their
bucket, and compared: a window is repeated if another suffix agrees with it both
to the right of the token's start and, read backwards, to its left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namefold.llm.common import whole_text
from namefold.scratch import materialize

LENGTH, TOKEN = 200, 40
#: Places in a window where its token may start.
PLACES = LENGTH - TOKEN + 1
#: A token in more texts than this is compared window by window across tasks instead of inside one bucket.
HOT = 100_000
GROUP_BYTES, BUCKET_ROWS = 1 << 22, 1 << 15
#: Windows looked at at a time: what a task holds for each byte is held for so many bytes, however long a text is.
PIECE, PIECE_BITS = 1 << 18, np.uint64(19)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_LETTER = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; the usual length is kept."""
    kept = _powers.get(str(base))
    if kept is None or len(kept) < n:
        factors = np.full(max(n, 1 << 16), base, np.uint64)
        factors[0] = 1
        kept = np.multiply.accumulate(factors)
        if n <= 2 * PIECE:
            _powers[str(base)] = kept
    return kept[:n]


def token_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the TOKEN bytes from each place on: differences of a running sum, scaled back to a common power."""
    n = len(data) - TOKEN + 1
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * _power(_BACK, len(data)), dtype=np.uint64)))
    h = (total[TOKEN:] - total[:-TOKEN]) * _power(_STEP, n)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _pieces(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Per piece: of its windows inside a text the first and number that share a token, the token's place and its hash; places are from the start of ``data``."""
    place = (np.uint64(1) << PIECE_BITS) - np.uint64(1)
    for start in range(0, len(data) - LENGTH + 1, PIECE):
        h = token_hashes(data[start : start + PIECE + LENGTH - 1])
        # Equal windows choose alike wherever they lie, so the bits kept for places do not depend on the piece.
        least = (h >> PIECE_BITS << PIECE_BITS) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= PLACES:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: len(h) - PLACES + 1], least[PLACES - span :])
        window = np.arange(start, start + len(least))
        text = np.searchsorted(ends, window, side="right")
        inside = np.flatnonzero(window + LENGTH <= ends[text])
        if len(inside):
            text, at = text[inside], (least[inside] & place).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]))))
            yield text[first], window[inside[first]], np.diff(np.concatenate((first, [len(at)]))), at[first] + start, h[at[first]].view(np.int64)


def suffixes(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts laid end to end: per token in use its text, the first window it stands for, how many, its place, all from the text's start; and its hash."""
    ends = np.cumsum(lengths)
    pieces = list(_pieces(data, ends))
    if not pieces:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    text, lo, count, at, token = (np.concatenate(column) for column in zip(*pieces))
    # A token in use on both sides of a piece's border is one.
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]))))
    base = (ends - lengths)[text[first]]
    return text[first], lo[first] - base, np.add.reduceat(count, first), at[first] - base, token[first]


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of one amount to about GROUP_BYTES."""
    for batch in batches:
        sizes = np.cumsum(np.diff(np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :][: len(batch) + 1])) if len(batch) else np.empty(0)
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + GROUP_BYTES)))
            yield batch.slice(at, end - at)
            at = end


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _groups(batches, 3):
        texts = batch.column(3).to_pylist()
        data = np.frombuffer(b"".join(texts), np.uint8)
        text, lo, count, at, token = suffixes(data, np.fromiter(map(len, texts), np.int64, len(texts)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(text)), batch.column(1).take(pa.array(text)), batch.column(2).take(pa.array(text)), pa.array(lo, pa.int32()), pa.array(count, pa.int16()), pa.array(at, pa.int32()), pa.array(token)],
            ["id", "tk", "n", "lo", "count", "at", "token"],
        )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tk, n, text, [(lo, count, at)]) to one row per suffix with all bytes of its windows."""
    for batch in batches:
        for tk, n, text, found in zip(*(batch.column(k) for k in range(4))):
            body, found = text.as_py(), found.as_py()
            for at in range(0, len(found), 4096):
                some = found[at : at + 4096]
                lo = [f["lo"] for f in some]
                yield pa.RecordBatch.from_arrays([
                    pa.array([tk.as_py()] * len(some), pa.int64()), pa.array([n.as_py()] * len(some), pa.int32()), pa.array(lo, pa.int32()),
                    pa.array([f["at"] - f["lo"] for f in some], pa.int16()), pa.array([f["count"] for f in some], pa.int16()),
                    pa.array([body[f["at"] : f["at"] + TOKEN] for f in some], pa.binary()), pa.array([body[f["lo"] : f["lo"] + f["count"] - 1 + LENGTH] for f in some], pa.binary()),
                ], ["tk", "n", "lo", "off", "count", "lead", "bytes"])


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """Order of byte rows of equal width, by words of eight bytes: what agrees so far is split by the next word, the rest is left alone."""
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order, group = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    for k in range(words.shape[1]):
        same = np.concatenate(([False], group[1:] == group[:-1]))
        open_ = np.flatnonzero(same | np.concatenate((same[1:], [False])))
        if not len(open_):
            break
        some, key = order[open_], words[order[open_], k]
        o = np.lexsort((key, group[open_]))
        order[open_] = some[o]
        key, part = key[o], group[open_]
        cut = np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
        border = np.ones(len(group), bool)
        border[open_] = cut
        group = np.cumsum(border)
    return order


def _agreement(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order and how many leading bytes each row shares with the one before it."""
    order = multikey_order(rows)
    shared = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 1 << 14):
        end = min(at + (1 << 14), len(order))
        differs = rows[order[at:end]] != rows[order[at - 1 : end - 1]]
        shared[at:end] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return order, shared


def repeated_windows(off: np.ndarray, count: np.ndarray, bytes_: list[bytes]) -> np.ndarray:
    """For each suffix and distance d of a window's start before the token: whether that window occurs again among the suffixes given."""
    g = len(off)
    flat = np.frombuffer(b"".join(bytes_) + bytes(LENGTH), np.uint8)
    sizes = np.fromiter(map(len, bytes_), np.int64, g)
    start = np.concatenate(([0], np.cumsum(sizes)[:-1])) + off
    to_right, to_left = np.arange(LENGTH), np.arange(1, -(-PLACES // 8) * 8 + 1)

    def context(steps: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """The bytes at these steps from each start, 0 beyond ``inside`` of them; a few rows at a time, as places take eight times the room of bytes."""
        rows = np.zeros((g, len(steps)), np.uint8)
        for at in range(0, g, 1 << 12):
            some = slice(at, at + (1 << 12))
            rows[some] = flat[np.clip(start[some, None] + steps, 0, len(flat) - 1)] * (np.arange(len(steps)) < inside[some, None])
        return rows

    sorted_right, sorted_left = _agreement(context(to_right, sizes - off)), _agreement(context(-to_left, off))
    out = np.zeros((g, PLACES), bool)
    kind = [np.empty(g, np.int64), np.empty(g, np.int64)]
    for d in range(PLACES):
        member = np.flatnonzero((off >= d) & (off - count < d))
        if len(member) < 2:
            continue
        for which, (order, shared), need in ((0, sorted_left, d), (1, sorted_right, LENGTH - d)):
            kind[which][order] = np.cumsum(shared < need)
        code = kind[0][member] * (g + 1) + kind[1][member]
        o = np.argsort(code)
        equal = code[o][1:] == code[o][:-1]
        again = np.concatenate(([False], equal)) | np.concatenate((equal, [False]))
        out[member[o[again]], d] = True
    return out


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of `lead`: buckets of whole tokens, each compared; repeated windows come out as byte spans."""

    def compared(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks()
        off, count, lo = (rows.column(k).to_numpy().astype(np.int64) for k in ("off", "count", "lo"))
        again = repeated_windows(off, count, rows.column("bytes").to_pylist())
        edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, near = np.nonzero(edge == 1)
        far = np.nonzero(edge == -1)[1] - 1
        at = lo[row] + off[row]
        index = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [rows.column("tk").take(index).combine_chunks(), rows.column("n").take(index).combine_chunks(), pa.array(at - far, pa.int32()), pa.array(at - near + LENGTH, pa.int32())],
            ["tk", "n", "start", "end"],
        )

    held: list[pa.RecordBatch] = []
    for batch in batches:
        lead = batch.column(5)
        change = [i for i in range(1, len(batch)) if lead[i] != lead[i - 1]] if sum(map(len, held)) + len(batch) >= BUCKET_ROWS else []
        if held and sum(map(len, held)) >= BUCKET_ROWS and len(batch) and held[-1].column(5)[-1] != lead[0]:
            yield compared(held)
            held = []
        if change:
            cut = change[-1]
            yield compared([*held, batch.slice(0, cut)])
            held, batch = [], batch.slice(cut)
        if len(batch):
            held.append(batch)
    if held:
        yield compared(held)


@F.arrow_udf(T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())]))
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    rows = []
    for text, found in zip(texts, spans):
        text, found = text.as_py(), found.as_py()
        removed = runs = last = 0
        kept = []
        for start, end in sorted((s["start"], s["end"]) for s in found):
            if start > last or not runs:
                kept.append(text[last:start])
                runs += 1
                last = start
            if end > last:
                removed += end - last
                last = end
        kept.append(text[last:])
        rows.append((removed, runs, b"".join(kept)))
    n, runs, kept = zip(*rows) if rows else ((), (), ())
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["n_removed", "n_spans", "kept"])


def _by_window(hot: DataFrame) -> DataFrame:
    """Spans of tokens too common for one bucket: their windows one by one, counted per task before the shuffle."""
    windows = hot.select("tk", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("count").cast("int") - 1), lambda j: F.struct(
        (F.col("lo") + j).alias("start"), (F.col("off") - j).alias("d"), F.sha2(F.substring("bytes", j + 1, LENGTH), 256).alias("w"),
    )))).select("tk", "n", "col.start", "col.d", "col.w")
    again = materialize(windows.groupBy("w", "d").agg(F.count("*").alias("times")).where("times > 1").select("w", "d"), "suffix")
    return windows.join(again, ["w", "d"]).select("tk", "n", "start", (F.col("start") + LENGTH).cast("int").alias("end"))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(tk, n, spans) of the texts with repeated bytes; ``texts`` has id, tk, n, body. Spans may overlap.

    Copies of a text are one text here, with its whole length as a span.
    """
    # Found twice rather than written: finding is cheap, the rows are many.
    found = texts.select("id", "tk", "n", "body").mapInArrow(_found, "id long, tk long, n int, lo int, count short, at int, token long")
    again = materialize(found.groupBy("token").agg(F.count("*").alias("times")).where("times > 1").select("token"), "suffix")
    per_text = found.join(again, "token").groupBy("tk", "n").agg(F.min("id").alias("least"), F.collect_set(F.struct("lo", "count", "at")).alias("found"))
    per_text = materialize(per_text.select(F.col("tk").alias("t"), F.col("n").alias("m"), "least", "found"), "suffix")
    one_each = texts.join(per_text, (F.col("tk") == F.col("t")) & (F.col("n") == F.col("m")) & F.col("id").eqNullSafe(F.col("least")))
    rows = materialize(
        one_each.select("tk", "n", "body", "found").mapInArrow(_contexts, "tk long, n int, lo int, off short, count short, lead binary, bytes binary"), "suffix",
    )
    common = materialize(rows.groupBy("lead").agg(F.count("*").alias("times")).where(F.col("times") > HOT).select("lead"), "suffix")
    dealt = rows.join(common, "lead", "left_anti").select("tk", "n", "lo", "off", "count", "lead", "bytes").repartitionByRange("lead").sortWithinPartitions("lead")
    spans = dealt.mapInArrow(_spans, "tk long, n int, start int, end int").unionByName(_by_window(rows.join(common, "lead")))
    copied = texts.groupBy("tk", "n").agg(F.count("*").alias("copies")).where(f"copies > 1 AND n >= {LENGTH}").select("tk", "n", F.lit(0).alias("start"), F.col("n").alias("end"))
    return spans.unionByName(copied).groupBy("tk", "n").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def without_repeats(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """``row`` (all input columns), n_bytes, n_removed, n_spans and ``kept`` (the remaining bytes).

    A byte goes if it lies in a 200-byte string that starts anywhere else too,
    in the same text or another; judged on the input. Texts under 200 bytes,
    also null ones (empty), lose nothing. Equal texts lose all their bytes if
    long enough. An empty table gives no rows. Texts equal in hash (64 bits)
    and length are taken as equal.

    Scale: a suffix is a few numbers until its token is known to recur; bytes
    travel only for recurring ones, once per distinct text. Spans are found per
    bucket of whole tokens; a token in very many texts is split by window.
    """
    body = whole_text(F.col("text") if text is None else text)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(body).alias("tk"), body.cast("binary").alias("body"))
    rows = rows.withColumn("n", F.length("body"))
    spans = materialize(repeated_spans(rows.select("id", "tk", "n", "body")).select(F.col("tk").alias("t"), F.col("n").alias("m"), "spans"), "suffix")
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = rows.join(spans, (F.col("tk") == F.col("t")) & (F.col("n") == F.col("m")), "left")
    out = out.select("row", F.col("n").cast("long").alias("n_bytes"), _cut(F.col("body"), F.coalesce("spans", none)).alias("c"))
    return out.select("row", "n_bytes", "c.n_removed", "c.n_spans", "c.kept")
