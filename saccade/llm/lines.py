"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features describe it and its neighbours; transitions tie neighbouring labels. The chance
that a line is good (a forward-backward marginal), weighted by length, gives a document's share of good text, from which a
logistic curve fitted on the learning rows gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccade.llm.common import bounded, fit_on_sample, fold, id_and_text, joined, logistic, platt, utf8

#: Labelled rows of either label, and their characters in all, that the model is fitted on at most (expected figures).
SAMPLE, SAMPLE_CHARACTERS = 2500, 12_000_000

# Byte classes: upper, lower (with all bytes of other scripts), digit, blank, sentence marks, bars, other signs.
_CLASS = np.full(256, 6, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 0, 1, 1, 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[[44, 46, 39, 45, 58, 59, 40, 41, 34, 63]] = 4
_CLASS[[124, 9]] = 5
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_MIX = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
#: An odd number and its inverse modulo 2^64: a byte weighs by its place.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes of a long text whose lines are described at once, or one line.
PIECE = 1 << 20
#: Features of a line before its neighbours' are added.
WIDTH = 16


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def line_features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes, and each document's first line (and the number of lines).

    A line ends after a line feed or with its document; an empty document has one empty line. The lines of a long text are
    described piece by piece; no feature but that of repeated lines looks beyond its line."""
    if len(ends) == 2 and len(data) > 2 * PIECE:
        breaks = np.flatnonzero(data == 10) + 1
        cuts = breaks[np.minimum(np.searchsorted(breaks, np.arange(PIECE, len(data), PIECE)), len(breaks) - 1)] if len(breaks) else breaks
        cuts = np.unique(np.concatenate([[0], cuts, [len(data)]]))
        parts = [_describe(data[a:b], np.array([0, b - a])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        x, size, doc, mark = (np.concatenate(p) for p in zip(*parts, strict=True))
    else:
        x, size, doc, mark = _describe(data, ends)
    # Lines of a document that occur in it more than once.
    key = mark ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    x[:, 10] = (times[where] > 1) & (size > 1)
    return x, size, np.append(np.searchsorted(doc, np.arange(len(ends) - 1)), len(x))


def _describe(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (but for that of repeated lines), their lengths, documents and marks."""
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.unique(np.concatenate([breaks, ends[:-1]]))
    starts = starts[starts < len(data)] if len(data) else starts[:0]
    # Empty documents have no byte: they get a line of their own, in document order.
    empty = np.flatnonzero(np.diff(ends) == 0)
    begin = np.concatenate([starts, ends[empty]])
    doc = np.concatenate([np.searchsorted(ends, starts, side="right") - 1, empty])
    order = np.argsort(doc, kind="stable")
    begin, doc = begin[order], doc[order]
    is_empty = np.isin(doc, empty)
    stop = np.where(is_empty, begin, np.append(starts[1:], len(data))[np.searchsorted(starts, begin).clip(0, max(0, len(starts) - 1))] if len(starts) else begin)
    n = len(begin)
    kind = _CLASS[data]
    shares = np.empty((n, 7))
    size = (stop - begin).astype(float)
    for c in range(7):
        total = np.concatenate([[0], np.cumsum(kind == c)])
        shares[:, c] = total[stop] - total[begin]
    letters = shares[:, 0] + shares[:, 1]
    # Words: runs of bytes that are not blank. Marks of words and lines are sums of their bytes' numbers, weighed by place.
    blank = _BLANK[data]
    edge = np.zeros(len(data), bool)
    edge[starts] = True
    word_at = np.flatnonzero(~blank & (np.concatenate([[True], blank[:-1]]) | edge)) if len(data) else np.zeros(0, np.int64)
    inked = np.where(blank, np.uint64(0), _MIX[data]) * _powers(_BASE, len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(inked, dtype=np.uint64)])
    back = _powers(_BACK, len(data) + 1)
    mark = (total[np.append(word_at[1:], len(data))] - total[word_at]) * back[word_at]
    line_of = np.searchsorted(starts, word_at, side="right")
    count = np.concatenate([[0], np.cumsum(np.bincount(word_at, minlength=len(data)))]) if len(data) else np.zeros(1, np.int64)
    words = (count[stop] - count[begin]).astype(float)
    again = np.zeros(len(data) + 1)
    if len(word_at) > 1:
        same = np.flatnonzero((mark[1:] == mark[:-1]) & (line_of[1:] == line_of[:-1])) + 1
        again[word_at[same]] = 1
    again = np.concatenate([[0], np.cumsum(again)])
    repeats = again[stop] - again[begin]
    line_mark = (total[stop] - total[begin]) * back[begin]
    x = np.zeros((n, WIDTH))
    x[:, 0] = 1
    x[:, 1] = np.log1p(size) / 5
    x[:, 2] = shares[:, 0] / np.maximum(letters, 1)
    full = np.maximum(size, 1)
    for column, c in zip(range(3, 8), (2, 3, 4, 5, 6), strict=True):
        x[:, column] = shares[:, c] / full
    x[:, 8] = np.minimum((size - shares[:, 3]) / np.maximum(words, 1) / 10, 2)
    x[:, 9] = repeats / np.maximum(words, 1)
    x[:, 11] = shares[:, 6] / np.maximum(words, 1)
    x[:, 12] = shares[:, 5] / np.maximum(words, 1)
    x[:, 13] = size <= 1
    x[:, 14] = shares[:, 0] > 0.6 * np.maximum(letters, 1)
    x[:, 15] = np.minimum(words / 10, 3)
    return x, size, doc, line_mark


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A line's features, the previous line's and the next line's; zeros beyond a document's ends."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first[:-1][first[:-1] < len(x)]] = 0
    after[first[1:] - 1] = 0
    return np.concatenate([x, before, after], axis=1)


class Chain:
    """A chain with the labels bad (0) and good (1): weights of a good line and a table of transitions."""

    def __init__(self, weights: np.ndarray, change: np.ndarray):
        self.weights, self.change = weights, change

    def marginals(self, x: np.ndarray, first: np.ndarray, pairs: bool = False):
        """The chance of good of every line; with ``pairs`` also the expected transitions. Documents go step by step together."""
        n, length = len(x), np.diff(first)
        emit = np.zeros((n, 2))
        emit[:, 1] = x @ self.weights
        order = np.argsort(-length, kind="stable")
        start, size = first[:-1][order], length[order]
        ahead, back = np.zeros((n, 2)), np.zeros((n, 2))
        ahead[start] = emit[start]
        most = int(size[0]) if len(size) else 0
        using = [int(np.searchsorted(-size, -t, side="left")) for t in range(most + 1)]  # documents of over t lines
        for t in range(1, most):
            at = start[:using[t]] + t
            ahead[at] = emit[at] + np.logaddexp(ahead[at - 1][:, :1] + self.change[0], ahead[at - 1][:, 1:] + self.change[1])
        for t in range(most - 1, 0, -1):
            at = start[:using[t]] + t
            onward = emit[at] + back[at]
            back[at - 1] = np.logaddexp(onward[:, :1] + self.change[:, 0], onward[:, 1:] + self.change[:, 1])
        both = ahead + back
        norm = np.logaddexp(both[:, 0], both[:, 1])
        good = np.exp(both[:, 1] - norm)
        if not pairs:
            return good
        inner = np.ones(n, bool)
        inner[first[:-1]] = False
        at = np.flatnonzero(inner)
        joint = ahead[at - 1][:, :, None] + self.change[None] + (emit[at] + back[at])[:, None, :] - norm[at][:, None, None]
        return good, np.exp(joint).sum(axis=0), at

    @staticmethod
    def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 150) -> Chain:
        """Maximises the conditional likelihood of line labels, by gradient steps with moments; labels weigh alike."""
        chain = Chain(np.zeros(x.shape[1]), np.zeros((2, 2)))
        inner = np.ones(len(x), bool)
        inner[first[:-1]] = False
        at = np.flatnonzero(inner)
        seen = np.zeros((2, 2))
        np.add.at(seen, (label[at - 1], label[at]), 1)
        m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
        for step in range(1, rounds + 1):
            good, expected, _ = chain.marginals(x, first, pairs=True)
            slope = np.concatenate([x.T @ (label - good), (seen - expected).ravel()]) / len(x)
            slope -= 1e-4 * np.concatenate([chain.weights, chain.change.ravel()])
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            chain.weights += move[:-4]
            chain.change += move[-4:].reshape(2, 2)
        return chain


class QualityModel:
    def __init__(self, chain: Chain, slope: float, offset: float):
        self.chain, self.slope, self.offset = chain, slope, offset

    def good_share(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        x, size, first = line_features(data, ends)
        good = self.chain.marginals(with_neighbours(x, first), first)
        weight = np.maximum(size, 1)
        share = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
        share = share.clip(1e-4, 1 - 1e-4)
        return np.log(share / (1 - share))

    def score(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return logistic(self.slope * self.good_share(data, ends) + self.offset)


def fit(sample: list[tuple[str, int]]) -> QualityModel:
    """Lines take their document's label; then the curve is fitted on documents. No rows, or one label, give 0.5 for all."""
    labels = np.array([y for _, y in sample], np.int64)
    if not len(labels) or labels.min() == labels.max():
        return QualityModel(Chain(np.zeros(3 * WIDTH), np.zeros((2, 2))), 0.0, float(np.log(3) * (2 * labels.mean() - 1)) if len(labels) else 0.0)
    parts, sizes = [], []
    for data, ends, _ in joined(sample):
        x, _, first = line_features(data, ends)
        parts.append(with_neighbours(x, first))
        sizes.append(np.diff(first))
    lengths = np.concatenate(sizes)
    chain = Chain.fit(np.concatenate(parts), np.concatenate([[0], np.cumsum(lengths)]), np.repeat(labels, lengths))
    model = QualityModel(chain, 1.0, 0.0)
    model.slope, model.offset = platt(np.concatenate([model.good_share(data, ends) for data, ends, _ in joined(sample)]), labels)
    return model


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every whole text; a null text is empty and is scored as one empty line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            score = model.score(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                             ["doc_id", "score", "predicted"])
    rows = id_and_text(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def document_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the rows whose fold of four is not 2 and scores all. An empty table gives no rows."""
    model = fit_on_sample(docs, labels, "quality", fold(F.col("doc_id"), 4) != 2, SAMPLE, SAMPLE_CHARACTERS, fit)
    scored = score_quality(docs, model)
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
