"""Toxicity by a support vector machine over gapped subsequences.

The kernel of two short windows of text is the weighted number of three-letter subsequences they share; a subsequence with
gaps weighs less, so inserted or missing characters lower the likeness but do not end it. Nyström landmarks stand for the
kernel space: a machine trained on windows of labelled sentences in that space is a weight for each landmark, and as the
kernel is a product of explicit subsequence counts, these fold into one weight for each subsequence. A sentence scores as
its best window, a document as its best sentence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccade.llm.common import bounded, fit_on_sample, fold, id_and_text, joined, logistic, platt, utf8

#: Labelled rows of either label, and their characters in all, that the model is fitted on at most (expected figures).
SAMPLE, SAMPLE_CHARACTERS = 2500, 12_000_000
LANDMARKS = 400
#: Turns of training, and the best and the random windows of clean sentences that each turn adds.
TURNS, HARD, RANDOM = 7, 6000, 3000
#: Start places of subsequences in a window, and the gaps of a subsequence: next letter, and the one after.
WINDOW = 7
GAPS = [(1, 1), (1, 2), (2, 1), (2, 2), (1, 3), (3, 1)]
DECAY = 0.8
#: Bytes of text that are scored at once.
SLICE = 1 << 19
#: Bytes that a window reaches.
REACH = WINDOW + 4

# Letters: a-z in either case, blank, digits and signs, bytes of other scripts by their low six bits in pairs.
_SIGNS = 60
_LETTER = np.full(256, 27, np.int64)
_LETTER[[9, 10, 11, 12, 13, 32]] = 0
_LETTER[97:123] = np.arange(1, 27)
_LETTER[65:91] = np.arange(1, 27)
_LETTER[128:] = 28 + np.arange(128) % 32
#: Subsequences count that have one blank at most: others say nothing of a word.
_COUNTS = ((np.indices((_SIGNS,) * 3) == 0).sum(axis=0) <= 1).ravel().astype(float)


def subsequences(data: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each kind of gap the code of the subsequence that starts at every byte, and the weight of that kind."""
    letter = np.concatenate([_LETTER[data].astype(np.int32), np.zeros(8, np.int32)])
    n = len(data)
    for a, b in GAPS:
        yield letter[:n] * (_SIGNS * _SIGNS) + letter[a:n + a] * _SIGNS + letter[a + b:n + a + b], DECAY ** (a + b - 2)


def window_scores(data: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The score of the window that starts at every byte of ``spaced`` documents; windows in the blanks behind one don't count."""
    at = np.zeros(len(data))
    for code, weight in subsequences(data):
        at += weight * table[code]
    total = np.concatenate([[0.0], np.cumsum(at), np.full(WINDOW, at.sum())])
    return _within(total[WINDOW:WINDOW + len(data)] - total[:len(data)], ends)


def _within(value: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Without the places from which a window would reach into the next document."""
    value[(ends[1:, None] - 1 - np.arange(REACH)).ravel()] = -1e3
    return value


def spaced(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same documents without digits and signs inside words, each after a blank and with as many blanks behind as a
    window reaches."""
    letter = _LETTER[data]
    word = (letter > 0) & (letter != 27)
    inner = np.zeros(len(data), bool)
    inner[1:-1] = (letter[1:-1] == 27) & word[:-2] & word[2:]
    kept = np.concatenate([[0], np.cumsum(~inner)])
    data, ends = data[~inner], kept[ends]
    size = np.diff(ends)
    new = np.concatenate([[0], np.cumsum(size + REACH + 1)])
    out = np.full(int(new[-1]), 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(new[:-1] + 1 - ends[:-1], size)] = data
    return out, new


def explicit(windows: np.ndarray) -> np.ndarray:
    """Codes and weights of the subsequences of each window (a row of bytes): (windows, subsequences, 2)."""
    n, width = windows.shape
    flat = np.concatenate([windows, np.full((n, 8), 32, np.uint8)], axis=1)
    letter = _LETTER[flat]
    codes, weights = [], []
    for a, b in GAPS:
        codes.append(letter[:, :WINDOW] * _SIGNS * _SIGNS + letter[:, a:WINDOW + a] * _SIGNS + letter[:, a + b:WINDOW + a + b])
        weights.append(_COUNTS[codes[-1]] * DECAY ** (a + b - 2))
    return np.concatenate(codes, axis=1), np.concatenate(weights, axis=1)


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Shared subsequences of every window of ``x`` with every one of ``y``, by the weight in both."""
    cx, wx = explicit(x)
    cy, wy = explicit(y)
    out = np.zeros((len(x), len(y)), np.float32)
    for j in range(len(y)):
        table = np.zeros(_SIGNS**3)
        np.add.at(table, cy[j], wy[j])
        out[:, j] = (table[cx] * wx).sum(axis=1)
    return out


def sentences(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where sentences begin: at documents and after full stops, question or exclamation marks and line feeds."""
    return np.unique(np.concatenate([ends[:-1], np.flatnonzero(np.isin(data, [10, 33, 46, 63])) + 1]))


class ToxicModel:
    def __init__(self, table: np.ndarray, slope: float, offset: float, empty: float):
        self.table, self.slope, self.offset, self.empty = table, slope, offset, empty

    def best(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The best window of each document: the best of its best sentences. A long document is scored slice by slice."""
        if len(ends) == 2 and len(data) > 2 * SLICE:
            return np.array([max(self._best_from(data[a:c], b - a) for a, b, c in _slices(data))])
        data, ends = spaced(data, ends)
        return np.maximum.reduceat(window_scores(data, ends, self.table), ends[:-1])

    def _best_from(self, data: np.ndarray, before: int) -> float:
        """The best window that starts before the given byte."""
        _, part = spaced(data[:before], np.array([0, before]))
        text, ends = spaced(data, np.array([0, len(data)]))
        last = len(text) if before == len(data) else part[-1] - REACH
        return float(window_scores(text, ends, self.table)[:last].max())

    def score(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.where(np.diff(ends) == 0, self.empty, logistic(self.slope * self.best(data, ends) + self.offset))


def _slices(data: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(a, b, c): windows from a up to b, which see the text up to c. Slices begin and end at blanks where there are any."""
    blank, a = np.flatnonzero(_LETTER[data] == 0), 0

    def cut(at: int) -> int:
        k = np.searchsorted(blank, at)
        return int(blank[k]) if k < len(blank) and blank[k] < at + SLICE else min(at, len(data))

    while a < len(data):
        b = cut(a + SLICE) if a + SLICE < len(data) else len(data)
        yield a, b, cut(b + 4 * REACH) if b + 4 * REACH < len(data) else len(data)
        a = b


def _windows(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    padded = np.concatenate([data, np.full(REACH, 32, np.uint8)])
    return np.lib.stride_tricks.sliding_window_view(padded, REACH)[at]


_TELLING = 1 << 22


def _fours(data: np.ndarray) -> np.ndarray:
    """A class for the four letters that start at each byte."""
    letter = np.concatenate([_LETTER[data], np.zeros(3, np.int64)])
    n = len(data)
    code = ((letter[:n] * _SIGNS + letter[1:n + 1]) * _SIGNS + letter[2:n + 2]) * _SIGNS + letter[3:n + 3]
    return code * 2654435761 % 4294967296 >> 10


def _telling(chunks: list[tuple], labels: np.ndarray) -> np.ndarray:
    """By class of four letters, how much oftener toxic than other documents have them (log of the ratio)."""
    counts = np.zeros((2, _TELLING), np.float32)
    for data, ends, known in chunks:
        of = np.repeat(np.arange(len(known)), np.diff(ends))
        pairs = np.unique(_fours(data) * len(known) + of)
        for label in (0, 1):
            counts[label] += np.bincount(pairs[known[pairs % len(known)] == label] // len(known), minlength=_TELLING)
    n1 = labels.sum()
    ratio = np.log((counts[1] + 0.2) / (n1 + 1)) - np.log((counts[0] + 0.2) / (len(labels) - n1 + 1))
    return np.where(counts[1] >= 2, ratio, np.float32(-1))


def _train(k: np.ndarray, y: np.ndarray, rounds: int = 300) -> np.ndarray:
    """A linear machine with squared hinge loss by damped Newton steps; the last column of ``k`` is the bias."""
    w = np.zeros(k.shape[1])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    ridge = 1e-4 * np.eye(k.shape[1])
    ridge[-1, -1] = 1e-8
    for _ in range(min(rounds, 30)):
        miss = np.maximum(0, 1 - y * (k @ w.astype(k.dtype)))
        active = np.flatnonzero(miss > 0)
        slope, bend = ridge @ w, ridge + 1e-9 * np.eye(len(w))
        for a in range(0, len(active), 8192):
            part = active[a:a + 8192]
            rows = k[part].astype(np.float64)
            slope -= rows.T @ (weight * y * miss)[part]
            bend += (rows * weight[part, None]).T @ rows
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(sample: list[tuple[str, int]]) -> ToxicModel:
    """Trains on windows of labelled sentences. No rows, or one label, give a constant score.

    A toxic document's label goes to its most telling sentence, at first the one whose letters are oftenest in toxic
    documents, later the one the machine scores highest; every sentence of other documents is an example of label 0, by its
    best window."""
    labels = np.array([y for _, y in sample], np.int64)
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return ToxicModel(np.zeros(_SIGNS**3), 0.0, 2.0 * (share > 0.5) - 1.0, 0.25)
    chunks = [(*spaced(data, ends), known) for data, ends, known in joined(sample)]
    telling = _telling(chunks, labels)
    rng = np.random.default_rng(7)
    table, negatives = None, None
    for _ in range(TURNS):
        windows, hard, worth, some = [], [], [], []
        for data, ends, known in chunks:
            if table is None:
                value = np.convolve(telling[_fours(data)], np.ones(WINDOW - 3), "full")[WINDOW - 4:][:len(data)].copy()
                value = _within(value, ends)
            else:
                value = window_scores(data, ends, table)
            windows.append(_windows(data, _argmax(value, ends)[known == 1]))
            first = sentences(data, ends)
            clean = known[np.searchsorted(ends, first, side="right") - 1] == 0
            best = _argmax(value, np.append(first, len(data)))[clean]
            hard.append(_windows(data, best))
            worth.append(value[best])
            if (known == 0).any():
                drawn = rng.integers(0, len(data), max(1, RANDOM // len(chunks)))
                some.append(_windows(data, drawn[known[np.searchsorted(ends, drawn, side="right") - 1] == 0]))
        windows, hard, worth = np.concatenate(windows), np.concatenate(hard), np.concatenate(worth)
        new = np.concatenate([hard[np.argsort(-worth, kind="stable")[:HARD]], *some])
        negatives = np.unique(new if negatives is None else np.concatenate([negatives, new]), axis=0)
        kinds, times = np.unique(windows, axis=0, return_counts=True)
        kinds = kinds[np.argsort(-times, kind="stable")]
        marks = np.concatenate([kinds[:LANDMARKS * 3 // 4], negatives[rng.permutation(len(negatives))[:LANDMARKS // 4]]])
        size, axes = np.linalg.eigh(kernel(marks, marks))
        use = size > 1e-6 * size.max()
        into = axes[:, use] / np.sqrt(size[use])
        x = np.concatenate([windows, negatives])
        y = np.concatenate([np.ones(len(windows)), -np.ones(len(negatives))])
        mapped = np.ones((len(x), into.shape[1] + 1), np.float32)
        for k in range(0, len(x), 8192):
            mapped[k:k + 8192, :-1] = kernel(x[k:k + 8192], marks) @ into
        scale = np.sqrt(np.einsum("ij,ij->", mapped[:, :-1], mapped[:, :-1], dtype=np.float64) / len(x))
        mapped[:, :-1] /= scale
        w = _train(mapped, y)
        beta = into @ (w[:-1] / scale)
        table = np.zeros(_SIGNS**3)
        codes, weights = explicit(marks)
        np.add.at(table, codes, weights * beta[:, None])
    best = np.concatenate([np.maximum.reduceat(window_scores(data, ends, table), ends[:-1]) for data, ends, _ in chunks])
    slope, offset = platt(best, labels)
    empty = float(logistic(np.array([slope * best[labels == 0].min() + offset]))[0])
    return ToxicModel(table, slope, offset, min(empty, 0.25))


def _argmax(value: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first place of the largest value between any two ends."""
    top = np.maximum.reduceat(value, ends[:-1])
    size = np.diff(ends)
    hit = np.flatnonzero(value == np.repeat(top, size))
    return hit[np.searchsorted(hit, ends[:-1])]


def score_toxicity(docs: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and predicted of every whole text; a null text is empty, which is scored as not toxic."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, limit=SLICE):
            score = model.score(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                             ["doc_id", "score", "predicted"])
    rows = id_and_text(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Fits on the rows whose fold of five is not 0."""
    return fit_on_sample(docs, labels, "toxic", fold(F.col("doc_id"), 5) != 0, SAMPLE, SAMPLE_CHARACTERS, fit)


def document_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all rows, with held_out for those of fold 0. An empty table gives no rows."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            batch = pa.RecordBatch.from_arrays([pa.array(series, pa.string())], ["text"])
            yield pd.Series(np.concatenate([np.zeros(0), *(model.score(*utf8(b.column("text"))) for b in bounded([batch], limit=SLICE))]))
    score = F.pandas_udf(run, "double")
    return docs.where(score(F.coalesce(docs["text"].cast("string"), F.lit(""))) < threshold)
