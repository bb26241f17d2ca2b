"""The pipeline's rows against plain versions of its stages, and the text queries against their SQL."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from compare import connect, difference

import corpus_pipeline
from namefold.llm import queries
from namefold.llm.simhash import fingerprint
from namefold.llm.sql import MIXING_SQL

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, key):
    assert difference(queries.QUERIES[key](spark, SF_DIR), connect(SF_DIR), queries.ORACLES[key]) is None


def test_pipeline(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary())
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, SF_DIR)
    assert good.columns == docs.columns
    texts = defaultdict(list)
    for row in good.collect():
        texts[row["text"] or ""].append(row)
    rows = sorted((max(same, key=lambda r: r["doc_id"]) for same in texts.values()), key=lambda r: r["doc_id"])
    codes = [fingerprint(r["text"] or "") for r in rows]
    kept = []
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (codes[a] ^ codes[b]).bit_count() <= 4 and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    kept = [r for k, r in enumerate(rows) if group[k] == k]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r["doc_id"], r["text"], r["source"]) for r in kept])
    taken = {i: (size, n) for i, size, n in con.sql(f"SELECT doc_id, size, taken FROM ({MIXING_SQL})").fetchall()}
    want = Counter()
    for row in kept:
        ids = np.array(library.encode(row["text"] or "", add_special_tokens=False).ids, "<u4")
        size, n = taken[row["doc_id"]]
        digest = (row["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((row["text"] or "").encode()).hexdigest())
        if size:
            want[digest] += n // size
    got = Counter(map(tuple, corpus_pipeline.run(spark, SF_DIR).collect()))
    assert got == +want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] and 4 <= len(corpus_pipeline.STAGES) <= 5
