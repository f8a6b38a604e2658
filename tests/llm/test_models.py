"""Classifiers on small made-up tables: what they learn, and nulls, empty texts and extra columns."""

import random

import pytest
from pyspark.sql import functions as F

from saccade.llm import lines, mixture, toxicity


def tables(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for k in range(240):
        toxic, good, lang = k % 3 == 0, k % 4 > 0, "ab"[k % 2]
        words = ["".join(rng.choice("rstlne" if lang == "a" else "oiumpq") for _ in range(5)) for _ in range(40)]
        if toxic:
            words[7] = "zykgob"
        line = " ".join(words)
        docs.append((k, line if good else line.upper().replace(" ", "!! "), lang, "x"))
        labels.append((k, int(good), int(toxic)))
    docs += [(900, None, "a", "x"), (901, "", None, "x"), (902, "12 34", "b", "x")]
    return (spark.createDataFrame(docs, "doc_id long, text string, lang string, score string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_models(spark):
    docs, labels = tables(spark)
    truth = {r.doc_id: r for r in labels.collect()}
    found = toxicity.document_toxicity(docs, labels).collect()
    assert len(found) == 243 and all(0 <= r.score <= 1 for r in found)
    assert sum(r.predicted == truth[r.doc_id].toxic for r in found if r.doc_id < 900) > 225
    found = lines.document_quality(docs, labels).collect()
    assert len(found) == 243 and sum(r.predicted == truth[r.doc_id].quality for r in found if r.doc_id < 900) > 225
    known = {r.doc_id: r.lang for r in docs.collect()}
    found = mixture.identify(docs).collect()
    assert sum(r.lang_pred == known[r.doc_id] for r in found if r.doc_id < 900) > 225
    assert {r.lang_pred for r in found if r.doc_id >= 900} == {"und"}


def test_more_languages_than_a_model_holds_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixture, "LANGUAGES", 2)
    docs = spark.createDataFrame([(k, "some words", f"l{k % 3}") for k in range(6)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="over 2 languages"):
        mixture.fit(docs, F.lit(True))
