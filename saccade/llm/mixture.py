"""Language identification by a mixture of languages in every document.

Byte trigrams are counted by language over all rows to learn from. A document is cut into short spans whose likelihood in
every language is the product of its trigrams'. Expectation-maximisation finds the shares of the languages; languages join
the set one by one as long as they raise the likelihood by more than a penalty. The language with the largest share wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccade.llm.common import bounded, fold, id_and_text, utf8

#: Trigram classes: trigrams of folded bytes are hashed into so many, which bounds the model.
CLASSES = 1 << 15
#: Bytes of a span. A text of more than ``SPANS`` spans is cut into so many longer ones.
SPAN = 32
SPANS = 1 << 16
#: Bytes whose trigrams are looked up at once.
PIECE = 1 << 20
ROUNDS = 20
#: Languages of a model at most; more are an error.
LANGUAGES = 256

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[:65] = 32
_FOLD[91:97] = 32
_FOLD[123:128] = 32
_LETTER = regex.compile(r"\p{L}")


def trigrams(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of the trigram that ends at each byte; ASCII letters are folded and other ASCII counts as space, as does what
    lies before a document."""
    byte = _FOLD[data]
    starts = ends[:-1][np.diff(ends) > 0]
    before, code = np.full((2, len(byte)), 32, np.uint32)
    before[1:] = byte[:-1]
    before[starts] = 32
    code[1:] = before[:-1]
    code[starts] = 32
    code = (code << np.uint32(16)) | (before << np.uint32(8)) | byte
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int32)


def span_scores(data: np.ndarray, ends: np.ndarray, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log-likelihood of every span in every language, and each document's first span; no document may be empty.

    Trigrams are looked up by pieces of about ``PIECE`` bytes, so that memory goes by spans and languages, not by bytes."""
    size = np.diff(ends)
    width = np.maximum(SPAN, -(-size // SPANS))
    spans = -(-size // width)
    first = np.cumsum(spans) - spans
    begin = np.repeat(ends[:-1], spans) + (np.arange(spans.sum()) - np.repeat(first, spans)) * np.repeat(width, spans)
    score = np.empty((len(begin), model.shape[1]))
    edges = np.unique(np.searchsorted(begin, np.arange(0, len(data) + PIECE, PIECE)))
    edges = np.unique(np.append(edges, [0, len(begin)]))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        at, upto = begin[a], begin[b] if b < len(begin) else len(data)
        early = max(0, at - 2)
        inner = ends[(ends > early) & (ends < upto)]
        codes = trigrams(data[early:upto], np.concatenate([[0], inner - early, [upto - early]]))[at - early:]
        for k in range(model.shape[1]):
            score[a:b, k] = np.add.reduceat(model[codes, k], begin[a:b] - at, dtype=np.float64)
    return score, first


def count_trigrams(docs: DataFrame, learn) -> DataFrame:
    """lang, class, n over all rows of ``docs`` to learn from. Every task adds up its own rows before anything is shuffled."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in bounded(batches):
            data, ends = utf8(batch.column("text"))
            codes = trigrams(data, ends)
            names = batch.column("lang").to_pylist()
            of = np.repeat(pd.factorize(np.array(names, object))[0], np.diff(ends))
            kinds = list(dict.fromkeys(names))
            counts = np.bincount(of * CLASSES + codes, minlength=len(kinds) * CLASSES).reshape(len(kinds), CLASSES)
            for name, row in zip(kinds, counts, strict=True):
                held[name] = held.get(name, 0) + row
        for name, row in held.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(at), "class": pa.array(at), "n": pa.array(row[at])})

    return rows.mapInArrow(run, "lang string, class long, n long").groupBy("lang", "class").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, learn) -> tuple[list[str], np.ndarray]:
    """The learned languages and the log-likelihood of every trigram class in each (classes by languages).

    What reaches the driver is at most ``LANGUAGES`` times ``CLASSES`` counts, however large the input; more languages are an
    error, as none may be left out."""
    counted = count_trigrams(docs, learn)
    known = counted.select("lang").distinct().limit(LANGUAGES + 1)
    if known.count() > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages to learn; fold variants of lang first")
    found = counted.toPandas()
    names = sorted(found["lang"].unique().tolist())
    counts = np.zeros((CLASSES, max(1, len(names))))
    counts[found["class"].to_numpy(np.int64), np.searchsorted(names, found["lang"].to_numpy(str)) if names else []] = found["n"]
    counts += 0.2
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def _maximise(score: np.ndarray, first: np.ndarray, of: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the ``allowed`` languages of each document, and the log-likelihood under them.

    ``score``: spans by languages; ``first``: each document's first span; ``of``: each span's document."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    top = score.max(axis=1)
    odds = np.exp(score - top[:, None])
    count = np.diff(np.append(first, len(score)))[:, None]
    for _ in range(ROUNDS):
        part = odds * share[of]
        total = np.maximum(part.sum(axis=1), 1e-300)
        share = np.add.reduceat(part / total[:, None], first, axis=0) / count
    mixed = np.log(np.maximum((odds * share[of]).sum(axis=1), 1e-300)) + top
    return share, np.add.reduceat(mixed, first)


def mixtures(score: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Shares of the selected languages of each document.

    Starts from the likeliest single language; the language that helps most joins if the log-likelihood grows by more than
    half the logarithm of the document's number of spans, plus 2."""
    n, k = len(first), score.shape[1]
    of = np.repeat(np.arange(n), np.diff(np.append(first, len(score))))
    alone = np.add.reduceat(score, first, axis=0)
    best = alone.argmax(axis=1)
    chosen = np.zeros((n, k), bool)
    chosen[np.arange(n), best] = True
    share, value = chosen.astype(float), alone[np.arange(n), best]
    active = np.arange(n)
    while len(active) and k > 1 and chosen[active].sum(axis=1).max() < k:
        inside = np.isin(of, active)
        sub_score, sub_of = score[inside], np.searchsorted(active, of[inside])
        sub_first = np.searchsorted(sub_of, np.arange(len(active)))
        # What each language would add if it took the spans that it explains best.
        now = np.where(chosen[active][sub_of], sub_score, -np.inf).max(axis=1)
        gain = np.add.reduceat(np.maximum(sub_score - now[:, None], 0), sub_first, axis=0)
        gain[chosen[active]] = -1
        joins = gain.argmax(axis=1)
        penalty = 2 + 0.5 * np.log(np.diff(np.append(sub_first, len(sub_score))))
        hopeful = gain[np.arange(len(active)), joins] > penalty
        active, joins, penalty = active[hopeful], joins[hopeful], penalty[hopeful]
        if not len(active):
            break
        inside = np.isin(of, active)
        sub_score, sub_of = score[inside], np.searchsorted(active, of[inside])
        sub_first = np.searchsorted(sub_of, np.arange(len(active)))
        wider = chosen[active].copy()
        wider[np.arange(len(active)), joins] = True
        new_share, new_value = _maximise(sub_score, sub_first, sub_of, wider.astype(float))
        better = new_value - value[active] > penalty
        active = active[better]
        chosen[active], share[active], value[active] = wider[better], new_share[better], new_value[better]
    return share


def predict(docs: DataFrame, names: list[str], model: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score (the language's share of the text) and n_languages of every whole text.

    A text that is null or has no letter, and every text if nothing was learned, is ``und`` with score 0. A row's result does not
    depend on the rows it is dealt with; a very long text is read in pieces and has at most ``SPANS`` spans."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            data, ends = utf8(batch.column("text"))
            lettered = np.array([bool(_LETTER.search(t)) for t in batch.column("text").to_pylist()]) & bool(names)
            label = np.full(batch.num_rows, "und", object)
            score, many = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            if lettered.any():
                rows_with, size = np.flatnonzero(lettered), np.diff(ends)
                data = data if lettered.all() else data[np.repeat(lettered, size)]
                share = mixtures(*span_scores(data, np.concatenate([[0], np.cumsum(size[rows_with])]), model))
                label[rows_with] = np.array(names, object)[share.argmax(axis=1)]
                score[rows_with], many[rows_with] = share.max(axis=1).clip(0, 1), (share > 0).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(label, pa.string()), pa.array(score), pa.array(many)],
                                             ["doc_id", "lang_pred", "score", "n_languages"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_languages long")


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows whose fold of three is not 1 and predicts all. An empty table gives no rows."""
    names, model = fit(docs, fold(F.col("doc_id"), 3) != 1)
    found = predict(docs, names, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "n_languages")
