"""Cross-tokenizer alignment by an associative monoid of fragments: open prefix, closed groups, open suffix.

Two tokenizers cut the same bytes. Where tokens of both end at one byte a group
ends. A fragment is what a range of bytes knows of that: the tokens that end in
it up to the first common end (a group that may have begun before), the groups
between common ends, and the tokens after the last one. Putting neighbours
together closes the group between them, in any order of putting together, so a
very long text is cut up, its parts go to many tasks, and a tree of tasks joins
their fragments.

A link is a pair of token occurrences that share a byte. Between neighbouring
ends of either tokenizer lies exactly one link, so links are read off the
merged ends.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namefold.llm.bpe import PATTERN, byte_letters
from namefold.llm.common import whole_text
from namefold.scratch import materialize

#: Longer texts are cut at the first safe place after so many characters; their parts are dealt out.
CHUNK = 1 << 16
#: Bytes of the ranges that fragments are made of, and fragments that one step of the tree joins.
RANGE, FAN = 1 << 14, 16
#: Characters of the texts whose results leave a worker together.
GROUP_CHARS = 1 << 20
#: Bytes of the row groups that fragments are stored in. A fragment is up to some MB, and a task that reads a row group holds all of it as arrays, several times as large.
STORED_BYTES = 1 << 21
#: One space between other characters begins a word for both tokenizers: neither has a token with a space after another character.
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_SPACE = "▁"


class Vocabularies:
    """Both tokenizers, the bytes of their tokens and the strings that groups are written with."""

    def __init__(self, bytes_path: str, pieces_path: str) -> None:
        with open(bytes_path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        added = {t["content"] for t in spec["added_tokens"]}
        words = {bytes(letters[c] for c in word): k for word, k in spec["model"]["vocab"].items() if word not in added}
        halves = [pair.split(" ") if isinstance(pair, str) else pair for pair in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][a + b] for a, b in halves]
        split = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or split.get("type") != "ByteLevel" or not split.get("use_regex", True) or split.get("add_prefix_space") or made != sorted(made):
            raise ValueError(f"{bytes_path}: not byte-level merging in the order of the ids without a normalizer")
        self.a = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=words, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.a_bytes = [b""] * (max(words.values()) + 1)
        for word, k in words.items():
            self.a_bytes[k] = word
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
            raise ValueError(f"{pieces_path}: a piece holds a space after another character, so texts can't be cut at spaces")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.size_b = len(pieces)
        self.most = max(len(self.a_bytes), len(pieces))
        digits = [str(k) for k in range(self.most)]
        self.written = [d + end for end in ",|,;" for d in digits]

    def tokens(self, text: str, start: int = 0) -> tuple[bool, Tokens]:
        """Whether both give back the bytes of space + text, and the tokens with the bytes they end at."""
        spaced = " " + text
        a, b = self.a.encode_ordinary(spaced), self.b.encode(text)
        whole = spaced.encode()
        same = b"".join(map(self.a_bytes.__getitem__, a)) == whole and b"".join(map(self.b_bytes.__getitem__, b)) == whole
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return same, Tokens(a, start + np.cumsum(self.a_length[a]), b, start + np.cumsum(self.b_length[b]))

    def write(self, groups: Groups) -> str:
        """``a1,a2|b1;a3|b2,b3``"""
        if not len(groups.a_n):
            return ""
        code = np.empty(len(groups.a) + len(groups.b), np.int64)
        a_last, b_last = np.cumsum(groups.a_n), np.cumsum(groups.b_n)
        a, b = groups.a.copy(), groups.b + 2 * self.most
        a[a_last - 1] += self.most
        b[b_last - 1] += self.most
        code[np.arange(len(a)) + np.repeat(b_last - groups.b_n, groups.a_n)] = a
        code[np.arange(len(b)) + np.repeat(a_last, groups.b_n)] = b
        return "".join(map(self.written.__getitem__, code.tolist()))[:-1]


@lru_cache(maxsize=1)
def load(bytes_path: str, pieces_path: str) -> Vocabularies:
    return Vocabularies(bytes_path, pieces_path)


_NO = np.zeros(0, np.int64)


@dataclass
class Tokens:
    """Ids of both tokenizers and the bytes they end at."""

    a: np.ndarray
    a_end: np.ndarray
    b: np.ndarray
    b_end: np.ndarray

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate(x) for x in zip(self.parts(), other.parts())))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.a, self.a_end, self.b, self.b_end

    def between(self, first: int, last: int) -> Tokens:
        """Those that end after byte ``first`` and not after ``last``."""
        i, j = np.searchsorted(self.a_end, (first, last), "right"), np.searchsorted(self.b_end, (first, last), "right")
        return Tokens(self.a[i[0] : i[1]], self.a_end[i[0] : i[1]], self.b[j[0] : j[1]], self.b_end[j[0] : j[1]])


@dataclass
class Groups:
    """Closed groups: their ids, how many of each belong to each group, and the pair codes of all links."""

    a: np.ndarray
    b: np.ndarray
    a_n: np.ndarray
    b_n: np.ndarray
    links: np.ndarray

    def __add__(self, other: Groups) -> Groups:
        return Groups(*(np.concatenate(x) for x in zip(self.parts(), other.parts())))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.a, self.b, self.a_n, self.b_n, self.links


def merged(tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """All ends of both, each once, and those that are common."""
    every = np.sort(np.concatenate([tokens.a_end, tokens.b_end]), kind="stable")
    again = every[1:] == every[:-1]
    return every[np.concatenate([[True], ~again])] if len(every) else every, every[1:][again]


def closed(tokens: Tokens, every: np.ndarray, ends: np.ndarray, size_b: int) -> Groups:
    """The groups of tokens that begin at a common end and end at each of ``ends``, the last included; ``every`` is all their ends."""
    links = tokens.a[np.searchsorted(tokens.a_end, every)] * size_b + tokens.b[np.searchsorted(tokens.b_end, every)]
    counts = (np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (tokens.a_end, tokens.b_end))
    return Groups(tokens.a, tokens.b, *counts, links)


def one_group(tokens: Tokens, size_b: int) -> Groups:
    return closed(tokens, merged(tokens)[0], tokens.a_end[-1:], size_b)


NOTHING, NO_GROUPS = Tokens(_NO, _NO, _NO, _NO), Groups(_NO, _NO, _NO, _NO, _NO)


@dataclass
class Fragment:
    """``head``: tokens up to the first common end, or all where there is none; ``body``: groups up to the last; ``tail``: tokens after it."""

    head: Tokens
    body: Groups
    tail: Tokens
    cut: bool
    same: bool = True


EMPTY = Fragment(NOTHING, NO_GROUPS, NOTHING, False)


def fragment(tokens: Tokens, same: bool, size_b: int) -> Fragment:
    every, common = merged(tokens)
    if not len(common):
        return Fragment(tokens, NO_GROUPS, NOTHING, False, same)
    first, last = common[0], common[-1]
    inner = every[slice(*np.searchsorted(every, (first, last), "right"))]
    body = closed(tokens.between(first, last), inner, common[1:], size_b) if first < last else NO_GROUPS
    return Fragment(tokens.between(-1, first), body, tokens.between(last, np.iinfo(np.int64).max), True, same)


def join(x: Fragment, y: Fragment, size_b: int) -> Fragment:
    """The fragment of both ranges, y's right after x's. Associative, with `EMPTY` as its unit."""
    same = x.same and y.same
    if not y.cut:
        return Fragment(x.head, x.body, x.tail + y.head, True, same) if x.cut else Fragment(x.head + y.head, NO_GROUPS, NOTHING, False, same)
    if not x.cut:
        return Fragment(x.head + y.head, y.body, y.tail, True, same)
    between = x.tail + y.head
    return Fragment(x.head, x.body + one_group(between, size_b) + y.body, y.tail, True, same)


def fold(parts: list[Fragment], size_b: int) -> Fragment:
    while len(parts) > 1:
        parts = [join(*parts[i : i + 2], size_b) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else EMPTY


def ended(whole: Fragment, size_b: int) -> Groups:
    """All groups of a text from the fragment of its whole range. None where a tokenizer does not give back its bytes."""
    if not whole.same or not whole.cut:
        return NO_GROUPS
    return one_group(whole.head, size_b) + whole.body


def of_range(text: str, start: int, known: Vocabularies, width: int = RANGE) -> Fragment:
    """The fragment of a text or chunk, put together from those of its byte ranges."""
    if not text:
        return Fragment(NOTHING, NO_GROUPS, NOTHING, False, False)
    same, tokens = known.tokens(text, start)
    end = max(tokens.a_end[-1:].max(initial=start), tokens.b_end[-1:].max(initial=start))
    if end - (start - start % width) <= width:
        return fragment(tokens, same, known.size_b)
    borders = [-1, *range(start - start % width + width, end, width), end]
    return fold([fragment(tokens.between(i, j), same, known.size_b) for i, j in zip(borders, borders[1:])], known.size_b)


def chunks(text: str, least: int = CHUNK) -> Iterator[tuple[int, str]]:
    """Parts of a text and the byte of space + text that each begins at. Each part's own space is left out, as the text's is."""
    at = byte = 0
    while at <= len(text):
        cut = _SAFE.search(text, at + least)
        part = text[at : cut.start() if cut else len(text)]
        yield byte, part
        if not cut:
            return
        byte += 1 + len(part.encode())
        at = cut.end()


_RESULT = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>"
_LISTS = ("head_a", "head_a_end", "head_b", "head_b_end", "body_a", "body_b", "body_a_n", "body_b_n", "links", "tail_a", "tail_a_end", "tail_b", "tail_b_end")
_FRAGMENT = "no long, n long, same boolean, cut boolean, " + ", ".join(f"{c} array<long>" for c in _LISTS)
_LONGS = pa.list_(pa.int64())


def _results(ids: dict[str, pa.Array], whole: list[Groups], known: Vocabularies) -> pa.RecordBatch:
    pairs = [np.unique(g.links, return_counts=True) for g in whole]
    columns = {
        **ids, "n_a": [len(g.a) for g in whole], "n_b": [len(g.b) for g in whole], "n_groups": [len(g.a_n) for g in whole],
        "n_links": [len(g.links) for g in whole], "groups": pa.array([known.write(g) for g in whole], pa.string()),
        "pairs": pa.array([x for x, _ in pairs], _LONGS), "times": pa.array([n for _, n in pairs], _LONGS),
    }
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for k, v in columns.items()})


def _packed(ids: dict[str, pa.Array], parts: list[Fragment]) -> dict[str, pa.Array]:
    lists = zip(*((*f.head.parts(), *f.body.parts(), *f.tail.parts()) for f in parts))
    flags = {"same": pa.array([f.same for f in parts], pa.bool_()), "cut": pa.array([f.cut for f in parts], pa.bool_())}
    return {**ids, **flags, **{c: pa.array(list(values), _LONGS) for c, values in zip(_LISTS, lists)}}


def _unpacked(rows: pa.Table | pa.RecordBatch, i: int) -> Fragment:
    v = [np.array(rows.column(c)[i].values.to_numpy(zero_copy_only=False), np.int64) for c in _LISTS]
    return Fragment(Tokens(*v[:4]), Groups(*v[4:9]), Tokens(*v[9:]), rows.column("cut")[i].as_py(), rows.column("same")[i].as_py())


def _grouped(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """Runs of a batch's rows of about `GROUP_CHARS`: the first row and the texts."""
    texts, first, weight = [], 0, 0
    column = batch.column("text")
    for i in range(batch.num_rows):
        texts.append(column[i].as_py())
        weight += len(texts[-1])
        if weight >= GROUP_CHARS:
            yield first, texts
            texts, first, weight = [], i + 1, 0
    if texts:
        yield first, texts


def aligned(docs: DataFrame, bytes_path: str, pieces_path: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, width: int = RANGE) -> DataFrame:
    """Per document: ``rid`` (a number of the row), ``id``, n_a, n_b, n_groups, n_links, ``groups`` (``a1,a2|b1;a3|b2``), and its different links ``pairs`` with ``times``.

    A pair is a's id times the second vocabulary's size plus b's id. Texts that
    are null, empty, or not given back by one of the tokenizers have no tokens:
    zeros and an empty string. Rows are treated alone, repeated rows alike, a
    null key as any. An empty table gives no rows. Columns but key and text are
    not read. Both files must lie on every executor.

    Scale: a text of up to ``chunk`` characters stays where it is. Longer ones
    are cut where both tokenizers begin a word, the chunks are dealt out, and a
    tree of `FAN`-wide steps joins their fragments. A text without such places
    is tokenized in one piece. One text's groups are one row.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(key).alias("id"), whole_text(F.col(text)).alias("text"))
    keyed = f"rid long, id {docs.schema[key].dataType.simpleString()}, "
    long = F.length("text") > chunk

    def whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = load(bytes_path, pieces_path)
        for batch in batches:
            for first, texts in _grouped(batch):
                found = [ended(of_range(t, 0, known, width), known.size_b) for t in texts]
                yield _results({c: batch.column(c).slice(first, len(texts)) for c in ("rid", "id")}, found, known)

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                parts = list(chunks(batch.column("text")[i].as_py(), chunk))
                same = {c: batch.column(c).take(pa.array([i] * len(parts))) for c in ("rid", "id")}
                starts, texts = zip(*parts)
                yield pa.RecordBatch.from_pydict({
                    **same, "no": pa.array(range(len(parts)), pa.int64()), "n": pa.array([len(parts)] * len(parts), pa.int64()),
                    "start": pa.array(starts, pa.int64()), "text": pa.array(texts, pa.string()),
                })

    def chunk_fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = load(bytes_path, pieces_path)
        for batch in batches:
            starts = batch.column("start").to_pylist()
            for first, texts in _grouped(batch):
                parts = [of_range(t, starts[first + k], known, width) for k, t in enumerate(texts)]
                yield pa.RecordBatch.from_pydict(_packed({c: batch.column(c).slice(first, len(texts)) for c in ("rid", "id", "no", "n")}, parts))

    def neighbours(group: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("no").combine_chunks()
        joined = fold([_unpacked(rows, i) for i in range(rows.num_rows)], load(bytes_path, pieces_path).size_b)
        n = -(-rows["n"][0].as_py() // FAN)
        ids = {"rid": rows["rid"].slice(0, 1).combine_chunks(), "id": rows["id"].slice(0, 1).combine_chunks(), "no": pa.array([group[1].as_py()], pa.int64()), "n": pa.array([n], pa.int64())}
        return pa.table(_packed(ids, [joined]))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = load(bytes_path, pieces_path)
        for batch in batches:
            for i in range(batch.num_rows):
                yield _results({c: batch.column(c).slice(i, 1) for c in ("rid", "id")}, [ended(_unpacked(batch, i), known.size_b)], known)

    short = rows.where(~long).mapInArrow(whole_texts, keyed + _RESULT)
    cut = rows.where(long).mapInArrow(cut_up, keyed + "no long, n long, start long, text string").repartition("rid", "no")
    parts = materialize(cut.mapInArrow(chunk_fragments, keyed + _FRAGMENT), "fragments", group_bytes=STORED_BYTES)
    most = parts.agg(F.max("n")).first()[0] or 0
    while most > 1:
        parts = materialize(parts.groupBy("rid", F.floor(F.col("no") / FAN).cast("long").alias("at")).applyInArrow(neighbours, keyed + _FRAGMENT), "fragments", group_bytes=STORED_BYTES)
        most = -(-most // FAN)
    return short.unionByName(parts.mapInArrow(last, keyed + _RESULT))


def linked(found: DataFrame, size_b: int) -> DataFrame:
    """``found`` (rid, pairs, times and more; a stored table) with n_best and count_sum for the last two.

    A pair's count is the number of documents that hold it linked. n_best are
    the links whose count is the highest of all pairs with their first id,
    ties included; count_sum is the sum over links.

    Scale: pairs are counted per task before they are shuffled; the counts are
    stored and, at every size, sorted and merged with the links, hot pairs
    split; a document's links are summed per task before they are shuffled.
    """
    each = found.select("rid", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    counts = each.groupBy("pair").agg(F.count("*").alias("count")).withColumn("a", F.floor(F.col("pair") / size_b).cast("long"))
    counts = materialize(counts, "pairs")
    best = counts.groupBy("a").agg(F.max("count").alias("best"))
    judged = materialize(counts.join(best, "a").select("pair", "count", (F.col("count") == F.col("best")).alias("is_best")), "pairs")
    summed = each.join(judged.hint("merge"), "pair").groupBy("rid").agg(
        F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"),
    )
    out = found.drop("pairs", "times").join(summed.withColumnRenamed("rid", "of"), F.col("rid") == F.col("of"), "left").drop("of")
    return out.withColumn("n_best", F.coalesce("n_best", F.lit(0).cast("long"))).withColumn("count_sum", F.coalesce("count_sum", F.lit(0).cast("long")))
