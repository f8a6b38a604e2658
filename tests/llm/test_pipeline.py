"""The stages of the pipeline against plain versions, on small planted tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from saccade.llm import simhash


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def shingles(text, size=5):
    w = text.lower().split()
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def alike(a, b):
    return not (a or b) or 5 * len(a & b) >= 4 * len(a | b)


def plain_groups(rows):
    """The smallest id that each id reaches over pairs of similar texts, all pairs compared."""
    sets, least = [(k, shingles(t or "")) for k, t in rows], {k: k for k, _ in rows}
    changed = True
    links = [(a, b) for a, s in sets for b, t in sets if a < b and alike(s, t)]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return least


def near_rows():
    rng, rows = random.Random(11), []
    for group in range(24):
        base = words(rng, rng.choice([60, 150, 400]))
        rows.append((100 * group, " ".join(base)))
        for copy in range(1, 6):
            own = list(base)
            for _ in range(rng.randint(1, max(1, len(base) // 45))):
                own[rng.randrange(len(own))] = words(rng, 1)[0]
            rows.append((100 * group + copy, " ".join(own)))
    return [*rows, (9001, None), (9002, ""), (9003, "one two"), (9004, "One  two"), (9005, "one three")]


@pytest.mark.parametrize("group_size", [256, 2])
def test_near_stage_equals_all_pairs(spark, group_size):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit("x"))
    expected = plain_groups(rows)
    assert len(set(expected.values())) < len(rows) - 60
    found = {r.doc_id: r.component_id for r in simhash.similar_groups(docs, group_size=group_size).collect()}
    assert found == expected
    if group_size == 256:
        kept = corpus_pipeline.drop_near(spark, docs, "")
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values()))


def test_repeats_stage_cuts_a_passage_of_51_words(spark):
    rng = random.Random(12)
    passage = " ".join(words(rng, 51))
    assert len(passage) < 400
    rows = [(k, " ".join(words(rng, 80)) + f" {k}\n{passage}\n{k} " + " ".join(words(rng, 40))) for k in range(3)]
    rows += [(8, " ".join(words(rng, 200))), (9, None), (10, "")]
    docs = spark.createDataFrame([(k, t, None if t is None else len(t)) for k, t in rows], "doc_id long, text string, n_chars int")
    cut = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    for k, t in rows:
        assert cut[k].text == (t.replace("\n" + passage + "\n", "") if t else t)
        assert cut[k].n_chars == (None if t is None else len(cut[k].text))
