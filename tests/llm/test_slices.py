"""Anchors of repeats are searched in small pieces, whatever the batches and texts."""

import numpy as np
import pyarrow as pa

from saccade.llm import substrings


def letters(n, seed):
    return "".join(map(chr, np.random.default_rng(seed).integers(97, 123, n)))


class Rows:
    """Stands for a table: keeps the function that goes over its batches."""

    class Type:
        class dataType:
            simpleString = staticmethod(lambda: "bigint")

    schema = {"doc_id": Type}

    def mapInArrow(self, function, schema):
        return function


def test_pieces_are_small(monkeypatch):
    sizes, search = [], substrings.anchors
    monkeypatch.setattr(substrings, "keyed", lambda docs: docs)
    monkeypatch.setattr(substrings, "anchors", lambda data, ends, *rest: sizes.append(len(data)) or search(data, ends, *rest))
    texts = [letters(20_000, i) for i in range(60)] + [letters(1_100_000, 99)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(range(len(texts)))], ["doc_id", "text", "text_key"])
    found = pa.Table.from_batches(substrings.segments(Rows(), 200)(iter([batch])))
    assert max(sizes) <= (1 << 19) + 199
    strings = found.group_by("doc_id").aggregate([("strings", "sum")]).to_pydict()
    assert dict(zip(strings["doc_id"], strings["strings_sum"])) == {i: len(t) - 199 for i, t in enumerate(texts)}


def test_passage_over_the_edge_of_a_piece(spark):
    passage, edge = letters(3000, 1), 1 << 19
    long = letters(edge - 1234, 2) + passage + letters(700_000, 3)
    docs = spark.createDataFrame([(1, long), (2, "x" + letters(500, 4) + passage + letters(400, 5))], "doc_id long, text string")
    left = {r.doc_id: r.text for r in substrings.remove_repeats(docs, 200).collect()}
    assert left == {1: long.replace(passage, ""), 2: "x" + letters(500, 4) + letters(400, 5)}
