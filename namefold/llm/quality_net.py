"""Quality classifier: a byte-level convolutional network in numpy.

Filters over six bytes slide over the whole text. Their outputs are max-pooled
in overlapping chunks that together cover every byte; the mean and the maximum
of the chunks' vectors give one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namefold.llm.common import crc_fold, text_groups, training_rows, whole_text

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.5
#: Bound of the training sample: at most so many labelled documents of each class are read by the driver.
SAMPLE_PER_CLASS = 700
WIDTH, EMBED, FILTERS = 6, 8, 16
#: Positions are pooled in cells; a chunk is CHUNK cells and the next starts STRIDE cells later.
CELL, CHUNK, STRIDE = 64, 8, 4
EPOCHS, BATCH, RATE, DECAY, SEED = 14, 25, 0.02, 1e-4, 7
_PIECE_CELLS = 1 << 10


def cells_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each after WIDTH - 1 zeros and padded with zeros to whole cells; and cells per text. A window over the end of a text meets the zeros before the next one, never its bytes."""
    lead = b"\0" * (WIDTH - 1)
    counts = np.array([max(1, -(-(len(t) + WIDTH - 1) // CELL)) for t in texts], np.int64)
    data = b"".join((lead + t).ljust(int(n) * CELL, b"\0") for t, n in zip(texts, counts))
    return np.frombuffer(data + b"\0" * (WIDTH - 1), np.uint8), counts


def chunks_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last cell of each chunk, and the text it belongs to; the last chunk of a text ends at its last cell."""
    per = np.maximum(1, -(-(counts - CHUNK) // STRIDE) + 1)
    owner = np.repeat(np.arange(len(counts)), per)
    base = np.concatenate(([0], np.cumsum(counts)[:-1]))
    nth = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(per)[:-1])), per)
    first = base[owner] + nth * STRIDE
    return first, np.minimum(first + CHUNK, base[owner] + counts[owner]), owner


class Net:
    """Parameters and their gradients; `tables` fuses embedding and filters so that scoring only looks up pairs of bytes."""

    def __init__(self) -> None:
        draw = np.random.default_rng(SEED)
        self.params = {
            "embed": draw.normal(0, 0.5, (256, EMBED)), "conv": draw.normal(0, (WIDTH * EMBED) ** -0.5 * 2, (WIDTH, EMBED, FILTERS)),
            "bias": np.zeros(FILTERS), "mean": draw.normal(0, 0.1, FILTERS), "top": draw.normal(0, 0.1, FILTERS), "out": np.zeros(1),
            "empty": np.zeros(2), "short": np.zeros(FILTERS),
        }

    def weights(self) -> np.ndarray:
        return np.einsum("be,kef->kbf", self.params["embed"], self.params["conv"])

    def bytewise(self) -> np.ndarray:
        """Embedding, filters and bias as one table per position of the filter: cheap to build, for training."""
        w = self.weights().astype(np.float32)
        w[0] += self.params["bias"].astype(np.float32)
        return w

    def tables(self) -> list[np.ndarray]:
        w = self.bytewise()
        return [(w[k][:, None, :] + w[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]

    def combine(self, pooled: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Logit per text from the chunks' vectors; mean and maximum per text, and how much of its first chunk is empty."""
        n = len(counts)
        empty = np.maximum(0, 1 - counts / CHUNK)
        empty = np.stack((empty, empty**4), axis=1)
        bounds = np.searchsorted(owner, np.arange(n))
        mean = np.add.reduceat(pooled, bounds) / np.bincount(owner, minlength=n)[:, None]
        top = np.maximum.reduceat(pooled, bounds)
        return mean @ self.params["mean"] + top @ self.params["top"] + empty @ self.params["empty"] + (empty[:, :1] * mean) @ self.params["short"] + self.params["out"][0], mean, top, empty


def cell_maxima(tables: list[np.ndarray] | np.ndarray, data: np.ndarray) -> np.ndarray:
    """Filter maxima per cell, in pieces of bounded size; the tables are for single bytes or for pairs."""
    span = WIDTH // len(tables)
    n = (len(data) - WIDTH + 1) // CELL
    out = np.empty((n, FILTERS), np.float32)
    for at in range(0, n, _PIECE_CELLS):
        end = min(at + _PIECE_CELLS, n)
        piece = data[at * CELL : end * CELL + WIDTH - 1].astype(np.int32)
        code = piece if span == 1 else piece[:-1] * 256 + piece[1:]
        m = (end - at) * CELL
        total = tables[0].take(code[:m], axis=0)
        for k in range(1, len(tables)):
            total += tables[k].take(code[span * k : span * k + m], axis=0)
        total.reshape(end - at, CELL, FILTERS).max(axis=1, out=out[at:end])
    return out


def winners(weights: np.ndarray, data: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Position of each filter's maximum in the cells given per chunk and filter."""
    out = np.empty_like(cell)
    for lane in range(FILTERS):
        span = data[cell[:, lane, None] * CELL + np.arange(CELL + WIDTH - 1)]
        total = sum(weights[k, :, lane].take(span[:, k : k + CELL]) for k in range(WIDTH))
        out[:, lane] = cell[:, lane] * CELL + total.argmax(axis=1)
    return out


def pool(maxima: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Rectified maximum over each chunk's cells."""
    best = maxima[first]
    for k in range(1, CHUNK):
        best = np.maximum(best, maxima[np.minimum(first + k, last - 1)])
    return np.maximum(best, 0)


def train(rows: list[tuple[bytes, int]]) -> Net:
    """Adam on the log loss. Without rows of both classes the untrained output stays at even odds."""
    net = Net()
    if len({y for _, y in rows}) < 2:
        net.params["mean"][:] = net.params["top"][:] = 0
        return net
    draw = np.random.default_rng(SEED)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.params.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = draw.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            some = [rows[i] for i in order[at : at + BATCH]]
            step += 1
            grads = gradients(net, [t for t, _ in some], np.array([y for _, y in some], np.float64))
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grads.items():
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.params[k] -= rate * (m / (np.sqrt(v) + 1e-8) + DECAY * net.params[k])
    return net


def gradients(net: Net, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
    data, counts = cells_of(texts)
    first, last, owner = chunks_of(counts)
    weights = net.bytewise()
    maxima = cell_maxima(weights, data)
    at = np.minimum(first[:, None] + np.arange(CHUNK), last[:, None] - 1)
    best = maxima[at].argmax(axis=1)
    cell = np.take_along_axis(at, best, axis=1)
    lanes = np.arange(FILTERS)
    pooled, place = np.maximum(maxima[cell, lanes], 0).astype(np.float64), winners(np.asfortranarray(weights), data, cell)
    logit, mean, top, empty = net.combine(pooled, owner, counts)
    d = (1 / (1 + np.exp(-logit)) - y) / len(texts)
    grads = {"mean": mean.T @ d, "top": top.T @ d, "out": np.array([d.sum()]), "empty": empty.T @ d, "short": (empty[:, :1] * mean).T @ d}
    held = pooled == top[owner]
    d_mean = net.params["mean"] + empty[owner, :1] * net.params["short"]
    d_pooled = d[owner, None] * (d_mean / np.bincount(owner)[owner, None] + held * net.params["top"])
    d_pooled *= pooled > 0
    grads["bias"] = d_pooled.sum(axis=0)
    d_weights = np.zeros((WIDTH, 256, FILTERS))
    for k in range(WIDTH):
        slot = data[place + k].astype(np.int64) * FILTERS + lanes
        d_weights[k] = np.bincount(slot.ravel(), d_pooled.ravel(), 256 * FILTERS).reshape(256, FILTERS)
    grads["conv"] = np.einsum("be,kbf->kef", net.params["embed"], d_weights)
    grads["embed"] = np.einsum("kbf,kef->be", d_weights, net.params["conv"])
    return grads


def fit(docs: DataFrame, labels: DataFrame) -> Net:
    """Learns from at most SAMPLE_PER_CLASS labelled documents of each class outside the held-out fold, whole texts."""
    rows = training_rows(docs, labels, "quality", FOLDS, HELD_OUT, SAMPLE_PER_CLASS).collect()
    return train(sorted((r["text"].encode("utf-8", "replace"), r["y"]) for r in rows))


def scorer(net: Net):
    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = net.tables()
        for texts in batches:
            out = []
            for group in text_groups(texts):
                data, counts = cells_of([t.encode("utf-8", "replace") for t in group])
                first, last, owner = chunks_of(counts)
                maxima = cell_maxima(tables, data)
                logit = net.combine(pool(maxima, first, last).astype(np.float64), owner, counts)[0]
                out.append(1 / (1 + np.exp(-np.clip(logit, -500, 500))))
            yield pa.array(np.concatenate(out) if out else np.empty(0))

    return score


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``row`` (all input columns), ``held_out``, ``score`` and ``predicted``.

    A null text is scored as the empty one. Without labels of both classes all
    scores are 0.5. Repeated rows score alike; an empty table gives no rows.
    Scale: one small model goes to the executors; scoring has no shuffle.
    """
    score = scorer(fit(docs, labels))
    out = docs.select(F.struct("*").alias("row"), (crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), score(whole_text(F.col("text"))).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
