"""Whole results of the text operators against plain versions, and nulls, empty tables, odd ids, clashing names and long texts."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from test_models import tables
from tokenizers import Tokenizer

from saccade.llm import exact, lines, merges, mixture, packing, simhash, sketches, streams, substrings, toxicity


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(4)) for _ in range(150)]
    out = []
    for k in range(120):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 60, 300])))
        out.append((k * 3 + 1, text))
        if k % 4 == 0:  # a near copy
            out.append((k * 3 + 2, text.replace(" ", "\n", 1) + rng.choice(["", " end"])))
    return [*out, (900, None), (901, ""), (902, " \t\n"), (903, "don't stop<|endoftext|> here 12"), (904, "Grüße 你好\r\n")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def plain_sketch(text):
    words = [signed(xxhash.xxh64(w.encode(), seed=42).intdigest()) for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    if not words:
        return []
    if len(words) < 5:
        return [signed(xxhash.xxh64(" ".join(map(str, words)).encode(), seed=42).intdigest())]
    out = set()
    for k in range(len(words) - 4):
        seed = 42
        for h in words[k:k + 5]:
            seed = xxhash.xxh64(struct.pack("<q", h), seed=seed).intdigest()
        out.add(signed(seed))
    return sorted(out)[:128]


def likeness(a, b):
    union = sorted({*a, *b})[:128]
    return len([h for h in union if h in set(a) & set(b)]) / len(union) if union else 1.0


def test_fingerprints_equal_plain_sketches(rows, docs):
    found = {r.doc_id: r for r in sketches.document_fingerprints(docs).collect()}
    order = sorted(((k, t or "") for k, t in rows), reverse=True)
    assert len(found) == len(rows)
    for (k, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        own, r = plain_sketch(text), found[k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(likeness(own, plain_sketch(edited)))
        assert r.near_next == pytest.approx(likeness(own, plain_sketch(after)))
    assert len({r.fingerprint for r in found.values()}) == len({tuple(plain_sketch(t)) for _, t in order})


def test_sketches_of_parts_merge_into_the_sketch_of_the_whole(spark):
    rng = random.Random(4)
    shingles = [f"s{rng.randrange(10**9)}" for _ in range(900)]
    cut = [shingles[:400], shingles[300:700], shingles[700:], []]
    parts = spark.createDataFrame([("a", p) for p in cut] + [("b", [])], "key string, s array<string>").select(
        "key", sketches.bottom(F.transform("s", lambda s: F.xxhash64(s))).alias("h"))
    found = {r.key: r.h for r in sketches.merge_sketches(parts, "key", "h").collect()}
    assert found["a"] == sorted({signed(xxhash.xxh64(s.encode(), seed=42).intdigest()) for s in shingles})[:128]
    assert [h for h in found["b"] if h is not None] == []


def test_near_groups_equal_all_pairs(rows, docs):
    prints = {}
    for k, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        hashes = [xxhash.xxh64(" ".join(words[i:i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))] if words else []
        prints[k] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    least = {k: k for k in prints}
    for _ in range(len(prints)):
        new = {k: min(least[j] for j in prints if (prints[k] ^ prints[j]).bit_count() <= 4) for k in prints}
        if new == least:
            break
        least = new
    found = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_groups(docs).collect()}
    assert found == {k: (prints[k], least[k]) for k in prints}
    assert sum(k != least[k] for k in least) > 10


def encoded(text):
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_equal_the_library(rows, docs):
    placed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 64).collect()
    by = {}
    for r in sorted(placed, key=lambda r: (r.doc_id, r.piece)):
        by.setdefault(r.doc_id, []).append(r)
    assert len(by) == len(rows)
    for k, text in rows:
        ids, at = [*encoded(text), 0], 0
        assert [r.piece for r in by[k]] == list(range(-(-len(ids) // 64)))
        for r in by[k]:
            assert (r.start, r.ids_crc32) == (at, crc(ids[at:at + r.length])) and r.length <= 64
            at += r.length
        assert at == len(ids) and all(r.length == 64 for r in by[k][1:])
    used = {}
    for r in sorted(placed, key=lambda r: r.offset):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 64


@pytest.mark.parametrize("kind", ["long", "string"])
def test_streams_equal_the_library(rows, docs, tmp_path, kind):
    folder = str(tmp_path / kind)
    table = docs.withColumn("doc_id", F.col("doc_id").cast(kind)).withColumn("order", F.lit(1)).withColumn("start", F.lit("x"))
    manifest = streams.write_streams(table, folder, public_tokenizers.path("byte_bpe_50k.json"), width=16)
    found = {r.doc_id: r for r in streams.read_documents(manifest, folder, kind if kind == "string" else "bigint").collect()}
    own = sorted(((str(k) if kind == "string" else k), t) for k, t in rows if t is not None)
    own = sorted([*own, (("900" if kind == "string" else 900), "")])
    at = 0
    for k, text in own:
        ids = [*encoded(text), 2]
        assert (found[k].start, found[k].n_tokens, found[k].ids_crc32) == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(found) == len(own)
    for part in manifest.collect():
        whole = [np.concatenate(x) for x in zip(*streams.read_sequences(folder, part.ids_file), strict=True)]
        many = len(whole[0])
        for k in {0, many // 2, many - 1, min(many - 1, streams.ROWS), min(many - 1, streams.ROWS - 1)}:
            ids, mask = streams.sequence_at(folder, part.ids_file, k)
            assert (ids == whole[0][k]).all() and (mask == whole[1][k]).all()
        for k in (-1, many, many + streams.ROWS, 10**9):
            with pytest.raises(IndexError):
                streams.sequence_at(folder, part.ids_file, k)


def test_held_out_rows(spark):
    table, labels = tables(spark)
    truth, known = {r.doc_id: r for r in labels.collect()}, {r.doc_id: r.lang for r in table.collect()}
    toxic = [r for r in toxicity.document_toxicity(table, labels).collect() if r.held_out and r.doc_id < 900]
    good = [r for r in lines.document_quality(table, labels).collect() if r.held_out and r.doc_id < 900]
    lang = [r for r in mixture.identify(table).collect() if r.held_out and r.doc_id < 900]
    assert min(map(len, (toxic, good, lang))) > 30
    assert sum(r.predicted == truth[r.doc_id].toxic for r in toxic) > 0.9 * len(toxic)
    assert sum(r.predicted == truth[r.doc_id].quality for r in good) > 0.9 * len(good)
    assert sum(r.lang_pred == known[r.doc_id] for r in lang) > 0.9 * len(lang)


def test_labels_of_held_out_rows_are_not_learned(spark):
    table, labels = tables(spark)
    for score, fold, left, column in ((toxicity.document_toxicity, 5, 0, "toxic"), (lines.document_quality, 4, 2, "quality")):
        held = F.crc32(F.col("doc_id").cast("string")) % fold == left
        other = labels.withColumn(column, F.when(held, 1 - F.col(column)).otherwise(F.col(column)))
        assert sorted(score(table, labels).collect()) == sorted(score(table, other).collect())
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    other = table.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang")))
    assert sorted(mixture.identify(table).collect()) == sorted(mixture.identify(other).collect())


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    for found in (packing.pack_documents(none, public_tokenizers.path("byte_bpe_50k.json")), toxicity.document_toxicity(none, labels),
                  merges.decode(merges.encode(none, path), path), mixture.identify(none), lines.document_quality(none, labels),
                  exact.drop_exact_copies(none), simhash.drop_similar(none), substrings.remove_repeats(none, 200),
                  toxicity.drop_toxic(none, toxicity.fit_toxicity(none, labels))):
        assert found.count() == 0


def test_empty_streams(spark, tmp_path):
    none, folder = spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none")
    manifest = streams.write_streams(none, folder, public_tokenizers.path("byte_bpe_50k.json"))
    assert streams.read_documents(manifest, folder).count() == 0


def test_columns_with_the_names_that_stages_use(spark):
    names = ["_text_key", "_span_id", "_span_key", "_spans", "_kept", "_row_sha", "_stay_id", "_stay_sha", "_stay_key", "_stay", "_stay_rows"]
    passage = " ".join(f"w{k}" for k in range(80))
    texts = [passage + " one two three", "four five six " + passage, "alone here", "alone   here", None]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").select(
        "*", *[F.concat(F.lit(f"{n}-"), F.col("doc_id")).alias(n) for n in names])
    for kept, ids in ((exact.drop_exact_copies(table), [0, 1, 2, 4]), (simhash.drop_similar(table), [0, 2, 4]),
                      (substrings.remove_repeats(table, 200), [0, 1, 2, 3, 4])):
        got = sorted(kept.collect())
        assert kept.columns == table.columns and [r.doc_id for r in got] == ids
        assert all(r[n] == f"{n}-{r.doc_id}" for r in got for n in names)
    cut = {r.doc_id: r.text for r in substrings.remove_repeats(table, 200).collect()}
    assert cut[0] == " one two three" and cut[1] == "four five six " and cut[4] is None


def joined(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def test_lines_are_described_alike_in_pieces_and_together(monkeypatch):
    rng = random.Random(6)
    texts = ["\n".join(" ".join(rng.choice(["ab", "ba", "Cd", "12", "x|y", "é"]) for _ in range(rng.randrange(6)))
                       for _ in range(rng.randrange(1, 60))) for _ in range(30)] + ["", "\n", "a" * 900]
    x, size, first = lines.line_features(*joined(texts))
    monkeypatch.setattr(lines, "PIECE", 40)
    for k, text in enumerate(texts):
        alone = lines.line_features(*joined([text]))
        assert np.allclose(alone[0], x[first[k]:first[k + 1]]) and (alone[1] == size[first[k]:first[k + 1]]).all()
        split = text.split("\n")
        split = split[:-1] if text and not split[-1] else split
        assert len(split) == len(alone[1])
        for row, line in zip(alone[0], split, strict=True):
            words = line.split()
            assert row[9] == pytest.approx(sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, len(words)))


def test_anagrams_are_not_repeats():
    x, _, _ = lines.line_features(*joined(["abc cab bca\ncab abc bca\nabc cab bca\n"]))
    assert x[:, 9].tolist() == [0, 0, 0] and x[:, 10].tolist() == [1, 0, 1]


def test_spans_score_alike_in_pieces_and_together(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcé  \n1") for _ in range(rng.choice([1, 5, 40, 900]))) for _ in range(40)]
    model = np.random.default_rng(3).normal(size=(mixture.CLASSES, 3)).astype(np.float32)
    score, first = mixture.span_scores(*joined(texts), model)
    assert len(first) == 40
    for piece in (50, 333):
        monkeypatch.setattr(mixture, "PIECE", piece)
        assert np.allclose(mixture.span_scores(*joined(texts), model)[0], score)
    for k, text in enumerate(texts):
        data, ends = joined([text])
        codes = mixture.trigrams(data, ends)
        own = score[first[k]:first[k + 1] if k + 1 < len(first) else None]
        assert np.allclose(own, [model[codes[a:a + mixture.SPAN]].sum(axis=0) for a in range(0, len(data), mixture.SPAN)], atol=1e-4)
    monkeypatch.setattr(mixture, "SPANS", 4)
    few, first = mixture.span_scores(*joined(texts), model)
    assert max(np.diff(np.append(first, len(few)))) <= 4 and np.allclose(few.sum(axis=0), score.sum(axis=0))
