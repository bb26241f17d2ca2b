"""Text operators against plain versions on small rows: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from namefold.llm import align, bpe, components, exact_dedup, html_blocks, line_dedup, mixing, quality_net, quality_rules, simhash, suffix_dedup, toxicity
from namefold.llm.common import training_rows
from namefold.llm.queries import PIECES, vocabulary
from templates import FRESH, TEMPLATES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, fp string, component_id string, size string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(3)
SENTENCE = ["the cat sat on the mat and it was good for all", "le chat est sur la table et il dort dans la maison", "x", "ab\tcd\x0bef", "É à  b"]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, None, None if i is None or i % 5 == 0 else f"s{i % 3}", None, "k", "f", "c", "z") for i, t in texts], SCHEMA)


def messy():
    texts = [(i, " ".join(rng.choice(SENTENCE) for _ in range(rng.randint(0, 12)))) for i in range(40)]
    texts += [(50, None), (51, ""), (52, None), (53, "\n \t"), (54, texts[3][1]), (55, texts[3][1]), (None, texts[3][1]), (54, texts[3][1])]
    texts += [(60, "a b c\nd e f\ng h i\nj"), (61, "a b c\nd e f\ng h i\nk"), (62, "word " * 30_000), (63, "z" * 60_000), (64, "same line here\n" * 50)]
    return texts


@pytest.fixture(scope="module")
def texts():
    return messy()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return documents(spark, texts)


@pytest.mark.parametrize("apply", [
    quality_rules.quality_rules, simhash.near_duplicates, exact_dedup.exact_dedup, line_dedup.line_dedup, mixing.copies, mixing.mix,
    suffix_dedup.without_repeats, lambda d: bpe.token_digests(d, vocabulary()),
], ids=["rules", "simhash", "exact", "lines", "copies", "mix", "suffix", "bpe"])
def test_an_empty_table_gives_no_rows(spark, apply):
    assert apply(documents(spark, [])).count() == 0


def test_quality_measures(docs, texts):
    found = quality_rules.quality_rules(docs).select("row.doc_id", "row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert len(found) == len(texts)
    for row in found:
        text = row["text"] or ""
        words = WORD.findall(text)
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert tuple(row)[2:7] == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert row["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_exact_dedup(docs, texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    found = exact_dedup.exact_dedup(docs).select("row.doc_id", "row.text", "row.kept", "keep_id", "group_size", "kept", "text_sha256").toDF("i", "text", "own", "keep", "n", "kept", "sha").collect()
    assert Counter(r["i"] for r in found) == Counter(i for i, _ in texts)
    for row in found:
        ids = groups[row["text"] or ""]
        assert row["keep"] == max(i for i in ids if i is not None) and row["n"] == len(ids) and row["own"] == "k"
        assert row["sha"] == hashlib.sha256((row["text"] or "").encode()).hexdigest()
    assert Counter(r["text"] or "" for r in found if r["kept"]) == Counter(list(groups))


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_every_pair_within_the_radius_shares_a_table():
    masks = simhash.masks()
    assert len(masks) == 31
    for _ in range(3000):
        differing = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(not differing & m for m in masks)


@pytest.mark.parametrize("block", [2048, 3])
def test_simhash_components(spark, texts, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    more = [(100 + i, " ".join(["tale"] * 3 + [f"w{j}" for j in range(80)] + [f"v{i}"])) for i in range(12)]
    rows = texts + more
    codes = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (codes[a] ^ codes[b]).bit_count() <= 4 and find(a) != find(b):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    want = Counter((i, codes[k] - (1 << 64) if codes[k] >> 63 else codes[k], min(x for x in least[find(k)] if x is not None)) for k, (i, _) in enumerate(rows))
    got = simhash.near_duplicates(documents(spark, rows)).select(F.col("row.doc_id"), F.col("fp"), F.col("component_id")).collect()
    assert Counter(map(tuple, got)) == want


def test_components_of_a_path_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (300, 299)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 299: 299, 300: 299}


def test_lines(docs, texts):
    rows = {r["i"]: r for r in line_dedup.line_dedup(docs).where("row.doc_id >= 60").select(F.col("row.doc_id").alias("i"), "n_lines", "n_removed", "kept_text").collect()}
    assert tuple(rows[60])[1:] == (4, 0, "a b c\nd e f\ng h i\nj") and tuple(rows[61])[1:] == (4, 3, "k")
    assert (rows[64]["n_lines"], rows[64]["n_removed"], rows[64]["kept_text"]) == (51, 49, "same line here\n")


def test_mixing_targets_and_copies(spark, docs):
    sized = spark.createDataFrame([("a", 10), ("a", 90), ("b", 10), ("c", 400), (None, 0)], "source string, size long")
    goals = {r["source"]: (r["source_size"], r["target"]) for r in mixing.targets(sized).collect()}
    assert goals["b"] == (10, 30.0) and goals[None] == (0, 0.0)
    assert goals["a"][1] == 300.0 and goals["c"][1] == pytest.approx(510 - 330)
    rows = mixing.copies(docs).select("row.text", "size", "source_size", "target", "copies").collect()
    assert all(r["size"] == len(WORD.findall(r["text"] or "")) and r["copies"] <= 3 for r in rows)
    assert sum(r["copies"] for r in rows) == mixing.mix(docs).count()
    assert mixing.mix(docs).columns == docs.columns


def test_tokens_equal_the_library(docs):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(vocabulary()), bpe.load(vocabulary())
    parts = ["a", "aa", " ", "\n", "é", "1", "'s", "<|endoftext|>", "<|endof", "!!", " the", "你好", "😀", "ing", "\t", "²", "\x85", "\x1c", "​"]
    some = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(2000)] + ["", "a" * 3000, " " * 2000, "<|endoftext|>" * 3]
    for text, ids in zip(some, own.encode(some)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and own.decode(ids) == library.decode(want, skip_special_tokens=False)
    for row in bpe.token_digests(docs, vocabulary()).select("row.text", "n_tokens", "decoded_sha256").collect():
        assert row["decoded_sha256"] == hashlib.sha256((row["text"] or "").encode()).hexdigest()
    again = bpe.tokenized(docs, vocabulary()).select("row.text", "decoded").collect()
    assert all(r["decoded"] == (r["text"] or "") for r in again)


@pytest.mark.parametrize("hot", [100_000, 3])
def test_repeated_strings(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    draw = random.Random(5)
    base = ["".join(draw.choices("abcdé ", k=draw.randint(150, 600))) for _ in range(8)]
    rows = []
    for i in range(60):
        text = "".join(draw.choices("abcdé ", k=draw.randint(0, 150)))
        for _ in range(draw.randint(0, 3)):
            s = draw.choice(base)
            text += s[(at := draw.randint(0, len(s) // 2)) : at + draw.randint(100, 400)] + "".join(draw.choices("xyz", k=draw.randint(0, 5)))
        rows.append((i, text))
    rows += [(200, "a" * 700), (201, "ab" * 300), (202, None), (203, ""), (204, "a" * 199), (205, rows[3][1]), (206, rows[3][1]), (None, "q" * 200)]
    windows = Counter(b[p : p + 200] for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - 199))
    want = {}
    for i, t in rows:
        b = (t or "").encode()
        keep = np.ones(len(b), bool)
        for p in range(len(b) - 199):
            if windows[b[p : p + 200]] > 1:
                keep[p : p + 200] = False
        want[i] = (len(b), int((~keep).sum()), int((~keep & np.concatenate(([True], keep[:-1]))).sum()) if len(b) else 0, np.frombuffer(b, np.uint8)[keep].tobytes())
    got = suffix_dedup.without_repeats(documents(spark, rows)).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert {r[0]: (*r[1:4], bytes(r[4])) for r in got} == want


def test_suffix_tokens_by_pieces(monkeypatch):
    draw = np.random.default_rng(3)
    lengths = np.concatenate((draw.integers(0, 900, 300), [30_000, 0, 199, 200, 201]))
    data = draw.integers(97, 100, lengths.sum()).astype(np.uint8)
    data[40_000:50_000] = 97
    whole = suffix_dedup.suffixes(data, lengths)
    for piece in (161, 5_000):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        assert all(np.array_equal(a, b) for a, b in zip(whole, suffix_dedup.suffixes(data, lengths)))


def test_repeats_need_little_memory():
    draw = np.random.default_rng(4)
    text = draw.integers(97, 123, 1 << 22).astype(np.uint8)
    off, count = np.full(1 << 15, 80), np.full(1 << 15, 60)
    rows = [text[i : i + 280].tobytes() for i in draw.integers(0, 1 << 21, 1 << 15)]
    for work in (lambda: suffix_dedup.suffixes(text, np.array([len(text)])), lambda: suffix_dedup.repeated_windows(off, count, rows)):
        work()
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 64e6


def labelled(spark):
    good = [" ".join(rng.choices(["river", "stone", "walks", "over", "green", "field"], k=60)) + "." for _ in range(60)]
    bad = [" ".join(w + "###" for w in rng.choices(["BUY", "NOW", "CHEAP"], k=60)) for _ in range(60)]
    texts = list(enumerate(x for pair in zip(good, bad) for x in pair))
    texts += [(900, None), (901, ""), (None, good[0])]
    marks = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(120)] + [(0, 1, 0), (None, 1, 1), (901, None, None)], "doc_id long, quality int, toxic int")
    return documents(spark, texts), marks


def test_classifiers_tell_held_out_rows_apart(spark):
    docs, marks = labelled(spark)
    for apply, folds, held, good in ((quality_net.classified, 3, 1, 0), (toxicity.toxic, 4, 2, 1)):
        rows = apply(docs, marks).select("row.doc_id", "held_out", "score", "predicted").collect()
        assert len(rows) == 123 and all(0 <= r["score"] <= 1 for r in rows)
        told = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 120]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held) for r in told)
        assert np.mean([r["predicted"] == (r["doc_id"] + 1 + good) % 2 for r in told if r["held_out"]]) > 0.9
        assert apply(docs, marks.limit(0)).count() == 123 and apply(docs.limit(0), marks).count() == 0


def test_repeated_keys_and_rows_do_not_share_a_coin(spark):
    # A third of all rows with one key: half of them equal rows, the rest with texts of their own; another third without a key.
    texts = [(7, "a b c")] * 500 + [(7, f"t{k} b c") for k in range(500)] + [(None, "a b c")] * 500 + [(None, f"n{k} b c") for k in range(500)] + [(k, f"u{k} b c") for k in range(100, 1100)]
    docs = spark.createDataFrame([(i, t, f"s{k % 3}") for k, (i, t) in enumerate(texts)], "doc_id long, text string, source string").repartition(7)
    # With target = 1.875, 0.75 and 0.375 times the size, each source's part of a copy is a coin.
    rows = mixing.copies(docs).select("row.doc_id", "row.text", "row.source", "size", "target", "copies").collect()
    assert len(rows) == 3000
    for source in ("s0", "s1", "s2"):
        some = [r for r in rows if r["source"] == source]
        target = some[0]["target"]
        # 1,000 coins: five standard deviations are 79 documents of 3 words.
        assert abs(sum(r["size"] * r["copies"] for r in some) - target) < 79 * 3
        # Equal rows fall apart like the others: both outcomes are seen.
        assert len({r["copies"] for r in some if r["doc_id"] == 7 and r["text"] == "a b c"}) == 2
    again = mixing.copies(docs.repartition(3)).select("row.doc_id", "row.text", "row.source", "size", "target", "copies").collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))


def test_toxicity_scores_against_a_plain_sum(spark):
    docs, marks = labelled(spark)
    weights, bias = toxicity.fit(docs, marks)
    plain = " ".join(f"Lorem{k % 700} ipsum{k % 13} dolor." for k in range(7000))
    extra = documents(spark, [(1000, plain), (1001, "Buy buys buying. BUY buy\nnow, cheap! river"), (1002, plain + " BUY NOW CHEAP."), (1003, None), (1004, "...")])
    rows = {r[0]: r[1:] for r in docs.unionByName(extra).select(F.struct("*").alias("row"), toxicity.scorer(weights, bias)(F.coalesce("text", F.lit(""))).alias("s"))
            .select("row.doc_id", "row.text", "s.score", "s.offending").collect()}
    for key, (text, score, offending) in rows.items():
        hazard, spans = toxicity.LEAK, []
        for found in re.finditer(r"[^.!?\n]+", text or ""):
            ids = set().union(*(toxicity.buckets(w) for w in re.findall(r"[^\W\d_]+", found[0].lower())))
            more = np.logaddexp(0, bias + sum(weights[k] for k in ids)) - np.logaddexp(0, bias)
            hazard += max(more, 0)
            if 1 - np.exp(-more) >= 0.5:
                spans.append((found.start(), found.end()))
        assert score == pytest.approx(1 - np.exp(-hazard), abs=1e-9) and [(o["start"], o["end"]) for o in offending] == spans, key
    # However many neutral sentences, they add nothing; one offending sentence among them is found.
    assert rows[1000][1] == rows[1003][1] == rows[1004][1] == pytest.approx(0.001, abs=1e-4) and not rows[1000][2]
    assert rows[1002][1] > 0.3 and [plain[o["start"]:] for o in rows[1002][2]] == [""]


PAGE = ("<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav>"
        "<div class=ad>Buy</div><article><h1>Title {0}</h1><p>First &amp; long  paragraph {0} of the text,\n with more.<br>Broken <b>tail<p>Second one.</article>"
        "<footer>&copy; us</footer></body></html>")


def test_blocks_and_main_text(spark):
    assert [b.text for b in html_blocks.blocks(PAGE.format(1))] == ["Home", "Buy", "Title 1", "First & long paragraph 1 of the text, with more. Broken tail", "Second one.", "© us"]
    assert html_blocks.blocks("") == [] and html_blocks.blocks("plain <not closed")[0].text == "plain"
    pages = spark.createDataFrame([(i, "u", PAGE.format(i), "x") for i in range(40)] + [(90, None, None, "x"), (91, "u", "", "x"), (None, "u", "<p>", "x")], "page_id long, url string, html string, main_text string")
    rows = {r[0]: r[1] for r in html_blocks.main_text(pages).select("row.page_id", "main_text").collect()}
    assert rows[7] == "Title 7\nFirst & long paragraph 7 of the text, with more. Broken tail\nSecond one."
    assert rows[90] == rows[91] == rows[None] == "" and html_blocks.main_text(pages.limit(0)).count() == 0


def test_broken_pages_are_read_in_one_pass():
    pages = ["<a " * 350_000, '<a b="' * 170_000, '<a b="' * 170_000 + "x>", "<a b='" * 170_000 + '" >', "<div>x" * 170_000, "<div>" * 100_000 + "</b>" * 100_000, "<script></script " * 60_000, "<svg><g>" * 120_000, "<" * 1_000_000]
    begun = time.process_time()
    assert [len(html_blocks.blocks(page)) for page in pages] == [1, 1, 0, 1, 170_000, 0, 0, 0, 1]
    assert time.process_time() - begun < 2.5 * len(pages)
    # Quotes hold >, a tag without an end is text, the next whole tag is read again.
    assert [(b.path, b.text) for b in html_blocks.blocks("<p title='a > b'>x<div class=\"c d\">y</div><i z=\"q</p>w")] == [(("p",), "x"), (("p", "div", ".c", ".d"), "y"), (("p",), '<i z="q'), ((), "w")]
    block = html_blocks.blocks("<html><body class=home><div><a href=x>one")[0]
    assert html_blocks.block_features(block) == (tuple(html_blocks.path_marks(block.path)), *html_blocks.features(block.path, block.text)[1:])


def test_unseen_templates_keep_their_content():
    """At least 0.95 of each template's content is found. Precision is 0.95 over the ten templates, in some of them only 0.93; of the fresh ones, a heading in div.masthead is still taken."""
    all_kept = all_right = 0
    read = lambda name, column: [v for v in pq.read_table(f"/root/testdata/sf0.01/{name}.parquet", columns=[column])[column].to_pylist() if v]
    model = html_blocks.train(sorted(read("pages", "html"))[: html_blocks.SAMPLE_PAGES])
    words, draw = re.findall(r"[^\s<>&]+", " ".join(read("documents", "text")[:300])), random.Random(4)

    def some(least, most):
        at = draw.randrange(len(words) - most)
        return " ".join(words[at : at + draw.randint(least, most)])

    for name, template in {**TEMPLATES, **FRESH}.items():
        kept, wanted, right = 0, 0, 0
        for _ in range(20):
            parts = {f"c{k}": some(3, 60) for k in range(10)} | {f"o{k}": some(1, 25) for k in range(10)}
            found = html_blocks.blocks(template.format(**parts))
            takes = model.probabilities([list(map(html_blocks.block_features, found))])[0] >= html_blocks.THRESHOLD
            content = {v for k, v in parts.items() if k[0] == "c"}
            kept += takes.sum()
            wanted += sum(b.text in content for b in found)
            right += sum(b.text in content and t for b, t in zip(found, takes))
        assert right >= 0.95 * wanted, (name, right, wanted)
        if name in TEMPLATES:
            assert right >= 0.9 * kept, (name, right, kept)
            all_kept, all_right = all_kept + kept, all_right + right
    assert all_right >= 0.95 * all_kept


def test_labeller_gradients():
    page = [html_blocks.features(b.path, b.text) for b in html_blocks.blocks(PAGE.format(1))]
    labels = [0, 0, 1, 1, 1, 0]
    model = html_blocks.Labeller()
    grads = model.gradients([page, page[:3]], [labels, labels[:3]])

    def loss():
        both = model.probabilities([page, page[:3]])
        return -np.concatenate([np.where(np.array(y) == 1, np.log(p), np.log(1 - p)) for p, y in zip(both, (labels, labels[:3]))]).mean()

    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = model.params[name][at]
        model.params[name][at] = old + 1e-5
        up = loss()
        model.params[name][at] = old - 1e-5
        down = loss()
        model.params[name][at] = old
        assert g[at] == pytest.approx((up - down) / 2e-5, rel=1e-3)


def test_every_word_of_a_block_is_read():
    words = [f"w{k}" for k in range(1200)]
    plain = html_blocks.features(("html", "body", "p"), " ".join(words))
    for at in (0, 1, 600, 1199):
        told = html_blocks.features(("html", "body", "p"), " ".join(words[:at] + ["cookie"] + words[at:]))
        assert html_blocks.word_id("cookie") in told[1] and dict(zip(told[1], told[3])) != dict(zip(plain[1], plain[3]))
    counts = Counter(zlib.crc32(w.encode()) % html_blocks.WORD_DIMS for w in words)
    assert dict(zip(plain[1], plain[3])) == {k: pytest.approx(n / 1200) for k, n in counts.items()}


def test_word_vectors_in_pieces(monkeypatch):
    model = html_blocks.Labeller()
    page = [html_blocks.features(("html", "body", "p"), " ".join(f"w{k}" for k in range(n))) for n in (0, 700, 3, 0, 40, 2)] + [html_blocks.features(("p",), "!")]
    want = [np.sum([model.params["word"][i] * share for i, share in zip(b[1], b[3])], axis=0) for b in page]
    whole = model.inputs([page])[0]
    monkeypatch.setattr(html_blocks, "PIECE", 5)
    assert np.array_equal(whole, model.inputs([page])[0])
    for got, row in zip(whole[:, 0, html_blocks.PATH_SIZE : html_blocks.PATH_SIZE + html_blocks.WORD_SIZE], want):
        assert got == pytest.approx(row)
    assert html_blocks.word_counts("one two, three two") == Counter(map(html_blocks.word_id, ("one", "two", "three", "two")))


def test_pages_without_html_and_body_tags(spark):
    marks = html_blocks.path_marks
    assert marks(("article", "p")) == marks(("html", "body", "article", "p")) == marks(("body", "article", "p")) != marks(("footer", "p"))
    assert marks(("html", ".js", "body", ".home", "p")) == marks((".js", ".home", "p"))
    bare = lambda i: "<nav><a href=x>Home</a></nav>" + "".join(f"<{tag}><p>Some words {k} of page {i}, told here.</p></{tag}>" for k, tag in enumerate(("article", "footer")))
    pages = spark.createDataFrame([(i, PAGE.format(i)) for i in range(40)] + [(90, bare(90)), (91, f"<html><body>{bare(91)}</body></html>"), (92, f"<body>{bare(92)}")], "page_id long, html string")
    rows = {r[0]: r[1] for r in html_blocks.main_text(pages).where("row.page_id >= 90").select("row.page_id", "main_text").collect()}
    assert rows == {i: f"Some words 0 of page {i}, told here." for i in (90, 91, 92)}


def test_an_svg_takes_only_its_own_text():
    texts = lambda page: [b.text for b in html_blocks.blocks(page)]
    article = "<article><p>First.</p><p>Second.</p></article>"
    told = ["Top", "First.", "Second."]
    assert texts(f'<header>Top<svg class="icon" viewBox="0 0 1 1"/></header>{article}') == told
    assert texts(f"<header>Top<svg/></header>{article}<svg><text>no</text></svg>") == told
    assert texts(f"<header>Top<svg><svg><text>no</text></svg><svg/><text>no</text></svg></header>{article}") == told
    assert texts(f"<header>Top<svg><title>no</title><foreignObject><p>no</p></foreignObject><!-- <svg> --></svg></header>{article}") == told
    # Without an end tag it ends where html goes on.
    assert texts(f"<header>Top<svg><svg></svg></header>{article}") == told == texts(f"<header>Top<svg></header>{article}")
    assert texts(f"{article}<script/>no</script><svg><text>no") == told[1:]


def test_a_repeated_doc_id_is_one_training_row(spark):
    docs = documents(spark, [(1, f"text {k}") for k in range(9)] + [(2, "two"), (2, None), (3, "three"), (None, "x")])
    marks = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (None, 1)], "doc_id long, quality int")
    found = training_rows(docs, marks, "quality", 3, 99, 5).collect()
    assert sorted(map(tuple, found)) == [(1, "text 0", 1), (2, "", 0), (3, "three", 1)]


def test_a_text_scores_the_same_alone_and_beside_others():
    net = quality_net.Net()

    def logits(texts):
        data, counts = quality_net.cells_of(texts)
        first, last, owner = quality_net.chunks_of(counts)
        return net.combine(quality_net.pool(quality_net.cell_maxima(net.tables(), data), first, last).astype(float), owner, counts)[0]

    texts = [bytes(rng.choices(range(1, 256), k=n)) for n in (64, 3, 0, 59, 60, 123, 128, 700, 1)]
    alone = [logits([t])[0] for t in texts]
    assert logits(texts) == pytest.approx(alone, abs=1e-12) and logits(texts[::-1]) == pytest.approx(alone[::-1], abs=1e-12)


def test_fragments_of_many_long_texts_are_read_a_few_at_a_time(spark, monkeypatch):
    """A reader holds a row group at once, as arrays: 40 fragments of 60,000 characters must not lie in one."""
    stored, store = [], align.materialize
    monkeypatch.setattr(align, "materialize", lambda df, label, **options: stored.append(store(df, label, **options)) or stored[-1])
    words = [w for t in SENTENCE for w in t.split()]
    texts = [(i, " ".join(rng.choice(words) for _ in range(30_000))) for i in range(20)]
    files = vocabulary(), vocabulary(PIECES)
    found = align.aligned(documents(spark, texts), *files).collect()
    for row in found:
        whole = align.ended(align.of_range(texts[row["id"]][1], 0, align.load(*files)), align.load(*files).size_b)
        assert (row["n_a"], row["n_links"], row["groups"]) == (len(whole.a), len(whole.links), align.load(*files).write(whole))
    assert len(found) == 20 and len(stored) == 2
    for table in stored:
        for path in table.inputFiles():
            groups = pq.ParquetFile(path.removeprefix("file://")).metadata
            values = [sum(g.column(c).num_values for c in range(g.num_columns)) for g in map(groups.row_group, range(groups.num_row_groups))]
            assert 8 * max(values) <= 16 << 20, values
