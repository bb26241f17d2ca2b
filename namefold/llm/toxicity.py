"""Toxicity by multiple-instance learning: sentence scores, joined by noisy-or, learnt from document labels.

A sentence's hazard, -log(1 - its probability), is the softplus of bias and its
hashed words' weights, less that of the bias alone: a sentence without a learnt
word adds nothing, however many there are. A document is toxic unless no
sentence is, but for a small leak. Training sees only the documents' labels, yet
the sentence scores it leaves behind tell which sentences offend. Training and
scoring take the same sum, over the set of a sentence's buckets.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namefold.llm.common import crc_fold, text_groups, training_rows, whole_text

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Bound of the training sample: at most so many labelled documents of each class are read by the driver.
SAMPLE_PER_CLASS = 1200
DIMS = 1 << 17
ROUNDS, RATE, SPARSITY, BIAS = 150, 0.1, 3e-4, -7.0
#: Hazard of a document of which no sentence has a learnt word.
LEAK = 1e-3
LEAST_DOCUMENTS = 5
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 500_000


def buckets(word: str) -> set[int]:
    """A word, and its first four and five letters: inflected forms share what they have learnt."""
    return {zlib.crc32(part.encode("utf-8", "replace")) % DIMS for part in (word, f"^{word[:4]}", f"^{word[:5]}")}


def train(rows: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """Weights and the fixed bias: Adam on the log loss of the noisy-or, with a soft threshold that keeps few words.

    A bias that learns as well rises with the threshold until plain sentences carry the labels.
    """
    weights, bias = np.zeros(DIMS), BIAS
    if len({y for _, y in rows}) < 2:
        return weights, bias
    words, sentence_of, document_of = [], [], []
    for k, (text, _) in enumerate(rows):
        for sentence in _SENTENCE.findall(text.lower()):
            found = set().union(*map(buckets, _WORD.findall(sentence)))
            if found:
                words += found
                sentence_of += [len(document_of)] * len(found)
                document_of.append(k)
    word, sentence, document = (np.array(x, np.int64) for x in (words, sentence_of, document_of))
    y = np.array([y for _, y in rows], np.float64)
    # A word of very few sampled documents tells nothing about others.
    documents_with = np.bincount(np.unique(word * len(rows) + document[sentence]) // len(rows), minlength=DIMS)
    usual = documents_with >= LEAST_DOCUMENTS
    sentence, word = sentence[usual[word]], word[usual[word]]
    m, v = np.zeros(DIMS), np.zeros(DIMS)
    for step in range(1, ROUNDS + 1):
        z = bias + np.bincount(sentence, weights[word], len(document))
        hazard = np.maximum(np.logaddexp(0, z) - np.logaddexp(0, bias), 0)
        total = LEAK + np.bincount(document, hazard, len(y))
        slope = np.where(y > 0, -1 / np.expm1(np.minimum(total, 500)), 1.0) / len(y)
        # Sentences below the bias go on learning, though their hazard is cut at zero.
        dz = slope[document] / (1 + np.exp(-z))
        g = np.bincount(word, dz[sentence], DIMS)
        m, v = m + 0.1 * (g - m), v + 0.001 * (g * g - v)
        rate = RATE * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        scale = rate / (np.sqrt(v) + 1e-6)
        weights = weights - scale * m
        weights = np.sign(weights) * np.maximum(np.abs(weights) - scale * SPARSITY, 0)
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    rows = training_rows(docs, labels, "toxic", FOLDS, HELD_OUT, SAMPLE_PER_CLASS).collect()
    return train(sorted((r["text"], r["y"]) for r in rows))


def scorer(weights: np.ndarray, bias: float):
    """A column function: text to its score and the spans (characters) and scores of its offending sentences."""
    index = np.flatnonzero(weights)
    sparse = dict(zip(index.tolist(), weights[index].tolist()))

    @F.arrow_udf("score double, offending array<struct<start:int,end:int,score:double>>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memory: dict[str, tuple[int, ...]] = {}
        kind = pa.struct([("score", pa.float64()), ("offending", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])
        base = math.log1p(math.exp(bias))
        for texts in batches:
            rows = []
            for text in (t for group in text_groups(texts) for t in group):
                hazard, spans = LEAK, []
                if len(memory) > REMEMBERED:
                    memory.clear()
                for found in _SENTENCE.finditer(text):
                    learnt: set[int] = set()
                    for word in _WORD.findall(found[0].lower()):
                        known = memory.get(word)
                        if known is None:
                            known = memory[word] = tuple(k for k in buckets(word) if k in sparse)
                        learnt.update(known)
                    if not learnt:
                        continue
                    z = bias + math.fsum(sparse[k] for k in learnt)
                    more = (z if z > 30 else math.log1p(math.exp(z))) - base
                    if more <= 0:
                        continue
                    hazard += more
                    p = -math.expm1(-more)
                    if p >= 0.5:
                        spans.append({"start": found.start(), "end": found.end(), "score": p})
                rows.append({"score": -math.expm1(-hazard), "offending": spans})
            yield pa.array(rows, kind)

    return score


def toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``row`` (all input columns), ``held_out``, ``score``, ``predicted`` and ``offending`` sentences (score 0.5 or more).

    A null, empty or neutral text of any length has the leak's score, 0.001;
    without labels of both classes every text has. Repeated rows score
    alike; an empty table gives no rows. Scale: the model is a bounded number
    of weights; scoring has no shuffle.
    """
    score = scorer(*fit(docs, labels))
    out = docs.select(F.struct("*").alias("row"), (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), score(whole_text(F.col("text"))).alias("s"))
    return out.select("row", "held_out", F.col("s.score").alias("score"), (F.col("s.score") >= THRESHOLD).cast("int").alias("predicted"), F.col("s.offending").alias("offending"))
