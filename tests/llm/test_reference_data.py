"""Decontamination, alignment and the Merkle manifest against plain versions, on small rows with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from namefold.llm import align, bpe, decontaminate, merkle, queries
from namefold.llm.queries import PIECES, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id string, items string, at long, score double"
rng = random.Random(11)
VOCAB = [f"w{i}" for i in range(30)] + ["École", "ünder", "x²", "漢字"]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None if i is None else "en", s, None if t is None else len(t), "r", "i", "k", 3, 0.5) for i, t, s in rows], SCHEMA)


# ---- decontamination

def passage(n):
    return [rng.choice(VOCAB) for _ in range(n)]


ITEMS = [(1, " ".join(passage(40))), (2, " ".join(passage(10))), (2, " ".join(passage(12))), (10, "Short Item here"), (3, "one"), (4, None), (5, " .,; "), (None, " ".join(passage(11))), (6, "w1 " * 25)]
ITEMS.append((7, ITEMS[0][1]))


def contaminated_documents():
    item = lambda k: re.findall(r"\S+", ITEMS[k][1])
    rows = [(i, " ".join(passage(rng.randrange(0, 60))), "a") for i in range(30)]
    rows += [
        (100, " ".join(passage(5) + item(0)[3:20] + passage(4)), "a"), (101, "A. " + ITEMS[0][1].upper().replace(" ", ", ") + "!", None),
        (102, " ".join(item(0)[5:14]), "a"), (103, " ".join(item(0)[5:15]), "a"), (104, ITEMS[1][1], "a"), (105, "a short\titem--HERE b", "a"), (106, "one", "a"),
        (107, None, "a"), (108, "", "a"), (109, ITEMS[7][1] + " " + ITEMS[7][1], "a"), (110, "w1 " * 500, "a"), (111, "w1 " * 9 + "q", "a"),
        (112, " ".join(passage(4000) + item(2) + passage(3000)), "a"), (None, ITEMS[0][1], "a"), (103, " ".join(item(0)[5:15]), "a"), (103, "other text", "a"),
    ]
    return rows


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(text, items):
    w, hit, found = plain_words(text), set(), set()
    for item, body in items:
        v = plain_words(body)
        n = min(len(v), 10)
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


def test_contamination_equals_a_plain_search(spark):
    rows = contaminated_documents()
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, window string")
    found = decontaminate.contamination(documents(spark, rows), items)
    got = Counter((r["i"], r["t"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in found.select(F.col("row.doc_id").alias("i"), F.col("row.text").alias("t"), "n_words", "n_hit", "items").collect())
    want = Counter()
    for i, t, _ in rows:
        n, hit, names = plain_contamination(t, ITEMS)
        want[i, t, n, hit, tuple(names)] += 1
    assert got == want and sum(1 for k in want if k[3]) >= 9


def test_every_shared_span_shares_a_print(spark):
    texts = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(10, 30)))) for i in range(60)]
    prints = {r["i"]: [(p["h"], p["p"]) for p in r["p"]] for r in spark.createDataFrame(texts, "i int, t string").select("i", decontaminate.winnowed(decontaminate.words(F.col("t"))).alias("p")).collect()}
    words = {i: t.split() for i, t in texts}
    for i, a in words.items():
        for j, b in words.items():
            for x in range(len(a) - 9):
                for y in range(len(b) - 9):
                    if a[x : x + 10] == b[y : y + 10]:
                        inside = lambda k, at: {(h, p - at) for h, p in prints[k] if at <= p <= at + 5}
                        assert inside(i, x) & inside(j, y)


def test_contamination_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    some = documents(spark, [(1, "x a b c y", "a")])
    assert decontaminate.contamination(documents(spark, []), items).count() == 0
    assert decontaminate.contamination(some, items).first()["n_hit"] == 3 and decontaminate.contamination(some, items.where("false")).first()["n_hit"] == 0


# ---- alignment

ALIGNED = [
    (1, "the cat sat, on the  mat.\n\nAnd it's 12,345 o'clock"), (2, "É漢字 — naïve\tword end "), (3, None), (4, ""), (5, " "), (6, "a▁b"), (7, "<|endoftext|> <s> <0x41> \x00"),
    (8, "z" * 5000), (9, " ".join(["supercalifragilistic", "été"] * 900)), (1, "the cat sat, on the  mat.\n\nAnd it's 12,345 o'clock"), (None, "emoji 😀😀 x"), (11, "\n" * 700 + "x y" * 400),
]


def plain_alignment(texts):
    a_side, b_side = Tokenizer.from_file(vocabulary()), sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    a_side.encode_special_tokens = True
    letters, names = bpe.byte_letters(), {k: w for w, k in a_side.get_vocab().items()}
    rows = []
    for text in texts:
        a, b = (a_side.encode(" " + text, add_special_tokens=False).ids, b_side.encode(text)) if text else ([], [])
        a_bytes = [bytes(letters[c] for c in names[k]) for k in a]
        b_bytes = [bytes([int(b_side.id_to_piece(k)[3:5], 16)]) if b_side.is_byte(k) else b_side.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            rows.append(None)
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes)]
        starts = [[0, *e[:-1]] for e in ends]
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(np.searchsorted(ends[1], starts[0][i], "right"), len(b)) if starts[1][j] < ends[0][i]] if len(text) < 3000 else None
        if links is None:
            links, j = [], 0
            for i in range(len(a)):
                while ends[1][j] <= starts[0][i]:
                    j += 1
                k = j
                while k < len(b) and starts[1][k] < ends[0][i]:
                    links.append((a[i], b[k]))
                    k += 1
        both, groups, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
        for end in both:
            i2, j2 = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        rows.append((len(a), len(b), len(both), links, ";".join(groups)))
    count = Counter(pair for row in rows if row for pair in set(row[3]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [
        (*row[:3], len(row[3]), sum(count[p] == best[p[0]] for p in row[3]), sum(count[p] for p in row[3]), row[4]) if row else (0, 0, 0, 0, 0, 0, "") for row in rows
    ]


@pytest.mark.parametrize("chunk, width", [(align.CHUNK, align.RANGE), (40, 7), (300, 64)])
def test_alignment_equals_a_plain_one_however_texts_are_cut(spark, tmp_path, chunk, width):
    from namefold.scratch import materialize

    docs = documents(spark, [(i, t, "a") for i, t in ALIGNED])
    found = materialize(align.aligned(docs, vocabulary(), vocabulary(PIECES), chunk=chunk, width=width), "aligned")
    rows = align.linked(found, align.load(vocabulary(), vocabulary(PIECES)).size_b).collect()
    got = Counter((r["id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in rows)
    assert got == Counter((i, *row) for (i, _), row in zip(ALIGNED, plain_alignment([t for _, t in ALIGNED])))


def test_fragments_join_in_any_order():
    known = align.load(vocabulary(), vocabulary(PIECES))
    text = "naïve 漢字 tokenizers, unbelievable; " * 5
    _, tokens = known.tokens(text)
    end = int(tokens.a_end[-1])
    whole = align.ended(align.fragment(tokens, True, known.size_b), known.size_b)
    for _ in range(200):
        borders = [-1, *sorted(rng.sample(range(end), rng.randrange(1, 30))), end]
        parts = [align.fragment(tokens.between(i, j), True, known.size_b) for i, j in zip(borders, borders[1:])]
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [align.join(align.join(parts[k], align.EMPTY, known.size_b), align.join(align.EMPTY, parts[k + 1], known.size_b), known.size_b)]
        made = align.ended(parts[0], known.size_b)
        assert known.write(made) == known.write(whole) and sorted(made.links.tolist()) == sorted(whole.links.tolist())


def test_merging_by_rank_equals_the_listed_merges():
    """Two tokens whose bytes together are a token, but not by a listed merge, never lie side by side."""
    known = bpe.load(vocabulary())
    pairs = [(known.ids[w[:c]], known.ids[w[c:]]) for w in known.ids for c in range(1, len(w)) if w[:c] in known.ids and w[c:] in known.ids]
    left, right = np.array([p for p in pairs if p[0] * known.size + p[1] not in known.packed]).T
    assert len(left) > 1000 and not known.compatible(left, right).any()
    assert all(len(w) == 1 or known.merge(w) == [k] for w, k in known.ids.items())


def test_alignment_of_an_empty_table(spark):
    assert align.aligned(documents(spark, []), vocabulary(), vocabulary(PIECES)).count() == 0


# ---- Merkle manifest

def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def plain_tree(nodes):
    """The root, and of each node its siblings level by level as (left, right)."""
    paths, level, places = [[] for _ in nodes], nodes, list(range(len(nodes)))
    while len(level) > 1:
        for path, at in zip(paths, places):
            run = at - at % 16
            path.append(("".join(level[run:at]), "".join(level[at + 1 : run + 16])))
        level = [h(*level[i : i + 16]) for i in range(0, len(level), 16)]
        places = [at // 16 for at in places]
    return level[0], paths


def plain_manifest(rows):
    def leaf(values):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    sources = defaultdict(list)
    for i, text, lang, source, n in rows:
        lower = None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)
        own = leaf((i, source, lang, n, text))
        changed = leaf((i, source, lang, n, lower)) if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else own
        sources[source].append((i is not None, i or 0, own, changed, i))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(sources[s]), *plain_tree([x[2] for x in sorted(sources[s])])) for s in order}
    root, above = plain_tree([trees[s][1] for s in order])
    out = []
    for place, s in enumerate(order):
        leaves, subroot, paths = trees[s]
        for (_, _, own, changed, i), path in zip(leaves, paths):
            whole, node = path + above[place], changed
            for left, right in whole:
                node = h(left, node, right)
            out.append((i, own, subroot, root, h(*(x for pair in whole for x in pair)), node, node == root))
    return Counter(out)


def manifest_rows():
    rows = [(i, f"Text {i}" if i % 7 else f"text {i}", "en", "big", i) for i in range(1200)]
    rows += [(5000 + i, f"T{i}", None, f"s{i:03d}", None) for i in range(40)] + [(6000 + i, f"Q{i}", "de", "seventeen", 1) for i in range(17)]
    rows += [(7000, None, None, None, None), (7001, "", "en", None, 0), (7002, "É Z", "en", "", 3), (None, "A", "en", "big", 1), (None, "A", "en", "big", 1), (3, "Text 3", "en", "big", 3), (3, "other", "en", "big", 5)]
    return rows + [(-5, "NEG", "en", "seventeen 2", 2)]


def test_manifest_equals_a_plain_one(spark):
    rows = manifest_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, at long")
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars", "node", "at", F.lit(1).alias("part")).repartition(7)
    found = merkle.proofs(*merkle.manifest(docs)).withColumn("proof", F.sha2(F.col("proof").cast("binary"), 256)).collect()
    assert Counter(map(tuple, found)) == plain_manifest(rows)


@pytest.mark.parametrize("n", [0, 1, 16, 17, 256, 257])
def test_manifest_of_one_source(spark, n):
    rows = [(i, "X", "en", "a", 1) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = merkle.proofs(*merkle.manifest(docs)).withColumn("proof", F.sha2(F.col("proof").cast("binary"), 256)).collect()
    assert Counter(map(tuple, found)) == (plain_manifest(rows) if n else Counter())


# ---- what the queries return

def test_queries_have_the_agreed_columns(spark):
    columns = {
        "op11_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op12_align": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
        "op13_merkle": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    }
    for key, wanted in columns.items():
        assert queries.QUERIES[key](spark, "/root/testdata/sf0.001").columns == wanted
