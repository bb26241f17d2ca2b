"""Byte-level BPE by speculation: greedy longest match proposes, a test of adjacent pairs verifies, only failures are merged.

A sequence of tokens is the BPE result exactly if each token is the result of
its own bytes and no merge crosses a border between neighbours. A merge crosses
a border where a token x on the right edge of the left one and a token y on
the left edge of the right one have a merge that comes before the merges that
consumed x and y. The edges of all tokens are tables, so that many pairs are
tested at once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namefold.llm.common import whole_text

#: The pattern that splits text into words before merging; part of the vocabulary's definition.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = 1 << 30
_NONE = 1 << 62
#: Words, and pieces between spaces, up to this length are remembered, at most so many at a time: some 200 bytes each, 130 MB a worker at most.
REMEMBERED_LENGTH, REMEMBERED_WORDS, REMEMBERED_PIECES = 64, 400_000, 250_000
GROUP_CHARS = 1 << 19
_ADJACENT, _SINGLE = re.compile(r"\s\s"), re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves, the rest from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec["model"].get("ignore_merges"):
            raise ValueError(f"{path}: not byte-level merging of the pattern's words without a normalizer")
        letters = byte_letters()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {bytes(letters[c] for c in word): k for word, k in spec["model"]["vocab"].items() if word not in added}
        self.size = max([*self.ids.values(), *added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for word, k in self.ids.items():
            self.bytes_of[k] = word
        for word, k in added.items():
            self.bytes_of[k] = word.encode()
        self.special = {word: np.array([k], "<u4").tobytes() for word, k in added.items()}
        self.borders = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.words = regex.compile(PATTERN)
        self.single = [self.ids[bytes([b])] for b in range(256)]
        halves: dict[int, tuple[int, int, int]] = {}
        #: rank * size + whole by left * size + right.
        self.packed: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (bytes(letters[c] for c in half) for half in (pair.split(" ") if isinstance(pair, str) else pair))
            a, b, whole = self.ids[left], self.ids[right], self.ids[left + right]
            self.packed.setdefault(a * self.size + b, rank * self.size + whole)
            halves.setdefault(whole, (a, b, rank))
        codes = np.fromiter(self.packed, np.int64, len(self.packed))
        order = np.argsort(codes)
        self.codes, self.ranks = codes[order], (np.fromiter(self.packed.values(), np.int64, len(codes)) // self.size)[order]
        self.right_edge, self.right_until = self._edge(halves, 1)
        self.left_edge, self.left_until = self._edge(halves, 0)
        # Only tokens that merging their own bytes gives back may be proposed.
        proposed = {word: k for word, k in self.ids.items() if len(word) == 1 or self.merge(word) == [k]}
        #: Every beginning of such a token: its own id where it is one, else -1.
        self.starts = {word[:k]: -1 for word in proposed for k in range(1, len(word))} | proposed
        self.memory: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _edge(self, halves: dict[int, tuple[int, int, int]], side: int) -> tuple[np.ndarray, np.ndarray]:
        """Per token the tokens on one edge, itself first, and the rank at which each is consumed; padded with -1."""
        rows = []
        for token in range(self.size):
            row, until = [(token, NEVER)], token
            while until in halves:
                a, b, rank = halves[until]
                until = (a, b)[side]
                row.append((until, rank))
            rows.append(row)
        width = max(map(len, rows))
        edge, until_rank = np.full((self.size, width), -1, np.int32), np.full((self.size, width), -1, np.int32)
        for token, row in enumerate(rows):
            edge[token, : len(row)], until_rank[token, : len(row)] = [x for x, _ in row], [r for _, r in row]
        return edge, until_rank

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: always the lowest rank, the leftmost first. Long words use a heap over a linked list."""
        token = [self.single[b] for b in word]
        n = len(token)
        if n <= REMEMBERED_LENGTH:
            found, size = self.packed.get, self.size
            ranks = [found(a * size + b, _NONE) for a, b in zip(token, token[1:])]
            while ranks and (best := min(ranks)) < _NONE:
                i = ranks.index(best)
                token[i : i + 2] = [best % size]
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = found(token[i] * size + token[i + 1], _NONE)
                if i:
                    ranks[i - 1] = found(token[i - 1] * size + token[i], _NONE)
            return token
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        found, size = self.packed.get, self.size
        heap = [(best, i, token[i], token[i + 1]) for i in range(n - 1) if (best := found(token[i] * size + token[i + 1], _NONE)) < _NONE]
        heapq.heapify(heap)
        while heap:
            best, i, a, b = heapq.heappop(heap)
            j = after[i] if token[i] == a else -1
            if j < 0 or token[j] != b:
                continue
            token[i], token[j] = best % size, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (best := found(token[left] * size + token[right], _NONE)) < _NONE:
                    heapq.heappush(heap, (best, left, token[left], token[right]))
        return [t for t in token if t >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy: at each place the longest token."""
        out, at, n, found = [], 0, len(word), self.starts.get
        while at < n:
            best, end = found(word[at : at + 1]), at + 1
            for stop in range(at + 2, n + 1):
                token = found(word[at:stop])
                if token is None:
                    break
                if token >= 0:
                    best, end = token, stop
            out.append(best)
            at = end
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of tokens whether no merge crosses their border."""
        good = np.ones(len(left), bool)
        for i in range(self.right_edge.shape[1]):
            x, x_until = self.right_edge[left, i], self.right_until[left, i]
            if not (x >= 0).any():
                break
            for j in range(self.left_edge.shape[1]):
                y, y_until = self.left_edge[right, j], self.left_until[right, j]
                live = np.flatnonzero((x >= 0) & (y >= 0) & good)
                if not len(live):
                    break
                code = x[live].astype(np.int64) * self.size + y[live]
                at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                # The border lies right of what consumes x and left of what consumes y; of equal ranks the leftmost merges first.
                crosses = (self.codes[at] == code) & (self.ranks[at] < x_until[live]) & (self.ranks[at] <= y_until[live])
                good[live[crosses]] = False
        return good

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Packed ids of new words: proposed, all borders tested together, failures merged exactly."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        proposals = [self.propose(b) for b in raw]
        counts = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter(chain.from_iterable(proposals), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(proposals)), counts)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        pairs, place = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)
        failed = set(owner[inner[~good[place]]].tolist())
        for i in failed:
            proposals[i] = self.merge(raw[i])
        ends = (4 * np.cumsum(np.fromiter(map(len, proposals), np.int64, len(proposals)))).tolist()
        packed = np.fromiter(chain.from_iterable(proposals), "<u4").tobytes()
        return {w: packed[i:j] for w, i, j in zip(words, [0, *ends], ends)}

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers; strings of added tokens become those tokens.

        Texts are taken in groups, so that the new words of a group are proposed and tested together.
        """
        group, weight = [], 0
        for text in texts:
            group.append(text)
            weight += len(text)
            if weight >= GROUP_CHARS:
                yield from self._encode_group(group)
                group, weight = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> Iterator[bytes]:
        memory, pieces = self.memory, self.pieces
        for known, most in ((memory, REMEMBERED_WORDS), (pieces, REMEMBERED_PIECES)):
            if len(known) > most:  # the older half goes; what is frequent soon comes back
                for old in list(islice(known, len(known) - most // 2)):
                    del known[old]
        cut = [self._cut(text) for text in texts]
        new = {p for parts in cut for part in parts for p in part[1:] if p not in pieces}
        heads = {part[0] for parts in cut for part in parts if part[0] not in self.special}
        words = {p: self.words.findall(f" {p}") for p in new}
        first = {p: self.words.findall(p) for p in heads}
        unknown = {w for found in (words, first) for several in found.values() for w in several if w not in memory}
        memory.update(self.learn(list(unknown)))
        pieces.update((p, b"".join([memory[w] for w in found])) for p, found in words.items())
        starts = self.special | {p: b"".join([memory[w] for w in found]) for p, found in first.items()}
        del words, first
        for parts in cut:
            yield b"".join([starts[part[0]] + b"".join([pieces[p] for p in part[1:]]) for part in parts])
        for known, fresh in ((memory, unknown), (pieces, new)):
            for w in fresh:
                if len(w) > REMEMBERED_LENGTH:
                    del known[w]

    def _cut(self, text: str) -> list[list[str]]:
        """Parts between added tokens, and these tokens; each part in pieces cut at single spaces between other characters.

        Such a space always begins a word of the pattern, so pieces have words of their own. It is left out of all pieces but a part's first.
        """
        parts = self.borders.split(text) if self.borders and any(word in text for word in self.special) else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append([part])
            elif part:
                plain = not (part[0].isspace() or part[-1].isspace() or _ADJACENT.search(part))
                out.append(part.split(" ") if plain else _SINGLE.split(part))
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def encoder(path: str):
    """A column function: text to struct<ids: binary, decoded: string>."""

    @F.arrow_udf("ids binary, decoded string")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        for texts in batches:
            ids = list(bpe.encode(t.as_py() for t in texts))
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], ["ids", "decoded"])

    return encode


def digests(path: str):
    """A column function: text to the number of ids and the digests of ids and decoded text, so that neither leaves the worker."""

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        for texts in batches:
            rows = []
            for ids in bpe.encode(t.as_py() for t in texts):
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
            del texts
            pa.default_memory_pool().release_unused()
            n, ids_sha, decoded_sha = zip(*rows) if rows else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def tokenized(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``row`` (all input columns), ``ids`` (packed) and ``decoded`` of each whole text.

    A null text counts as empty: no ids. Rows are treated alone, repeated rows
    alike; an empty table gives no rows. No shuffle. ``path`` names the
    vocabulary file, which every executor must have.
    """
    out: Column = encoder(path)(whole_text(F.col(text)))
    return docs.select(F.struct("*").alias("row"), out.alias("bpe")).select("row", "bpe.ids", "bpe.decoded")


def token_digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``row``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``: what `tokenized` gives, as digests."""
    return docs.select(F.struct("*").alias("row"), digests(path)(whole_text(F.col(text))).alias("bpe")).select("row", "bpe.*")
