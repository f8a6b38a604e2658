"""The text operators against plain versions, on small tables with nulls, empty texts, repeats and extra columns."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from saccade.llm import exact, merges, packing, simhash, sketches, streams, substrings, words
from saccade.llm.induced import repeats, suffix_array


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"word{i % 97} of{i % 13}" for i in range(400))
    rows = [(1, "a  b\tc", "x"), (2, "a b c", "y"), (3, None, None), (4, "", "z"), (5, long, "x"), (6, long + " end", "x"),
            (7, "Ünïcode ñ 你好 text's 12²", "x"), (7, "Ünïcode ñ 你好 text's 12²", "x"), (9, long, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_suffix_arrays():
    random.seed(3)
    for _ in range(200):
        s = [random.randint(0, random.choice([1, 3, 9])) for _ in range(random.randint(1, 50))]
        assert suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    assert [m.tolist() for m in repeats([b"abcab", b"cab"], 3)] == [[False, False, True, False, False], [True, False, False]]


@pytest.mark.parametrize("kinds", [1024, 1])
def test_repeated_strings(spark, kinds):
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdé") for _ in range(300))
    rows = [(k, "".join(rng.choice("abcd") for _ in range(200)) + shared + "".join(rng.choice("abcd") for _ in range(k * 7))) for k in range(9)]
    table = spark.createDataFrame([*rows, (20, None), (21, "")], "doc_id long, text string")
    count = {}
    for _, t in rows:
        b = t.encode()
        for i in range(len(b) - 199):
            count[b[i:i + 200]] = count.get(b[i:i + 200], 0) + 1
    found = {}
    for r in substrings.repeated_strings(table, 200, 32, kinds).collect():
        found.setdefault(r.doc_id, set()).update(range(r.a, r.b))
    for k, t in rows:
        b = t.encode()
        assert found.get(k, set()) == {i for i in range(len(b) - 199) if count[b[i:i + 200]] > 1}
    whole = {r.doc_id: r for r in substrings.repeated_spans(table).collect()}
    assert len(whole) == 11 and whole[20].n_bytes == 0


def test_exact_groups(docs):
    rows = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(docs).collect()}
    assert {(1, 1, 2, True), (2, 1, 2, False), (5, 5, 2, True), (9, 5, 2, False), (7, 7, 2, True), (7, 7, 2, False)} <= rows
    kept = exact.drop_exact_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6, 7]


def test_trie_join_equals_all_pairs():
    rng = np.random.default_rng(1)
    codes = []
    for base in rng.integers(0, 2**63, 60, dtype=np.uint64):
        for _ in range(6):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            codes.append(int(base) ^ sum(1 << int(k) for k in flips))
    codes = np.unique(np.array(codes, np.uint64))
    walked, paired = simhash.Forest(len(codes)), simhash.Forest(len(codes))
    simhash.walk(codes, np.array([[0, len(codes), 0, len(codes)]]), 4, walked)
    paired.add(*np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None]) <= 4))
    assert (walked.root == paired.root).all()


def planted_codes(seed, bases, copies):
    rng = np.random.default_rng(seed)
    codes = [0, 1, 2**64 - 1]
    for base in rng.integers(0, 2**63, bases, dtype=np.uint64):
        for _ in range(copies):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            codes.append(int(base) ^ sum(1 << int(k) for k in flips))
    return np.unique(np.array(codes, np.uint64))


@pytest.mark.parametrize("agree", [None, 1, 2, 3, 4])
def test_tries_of_longer_keys_give_the_same_components(spark, agree):
    codes = planted_codes(5, 60, 6)
    paired = simhash.Forest(len(codes))
    paired.add(*np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None]) <= 4))
    place = {int(c): k for k, c in enumerate(codes.view(np.int64))}
    found = simhash.Forest(len(codes))
    links = simhash.linked(spark.createDataFrame([(k,) for k in place], "fp long"), trie_size=4 if agree == 1 else 2048, agree=agree).collect()
    found.add(np.array([place[r.u] for r in links]), np.array([place[r.v] for r in links]))
    assert (found.root == paired.root).all()


def test_keys_grow_with_the_number_of_fingerprints():
    sizes = [0, 1000, 10**7, 10**9, 10**11, 10**13]
    agree = [simhash.blocks_to_agree(n) for n in sizes]
    assert agree == sorted(agree) and agree[0] == agree[2] == 1 and agree[3] == 2 and agree[4] == 3
    for budget in (2, 4, 6):
        for blocks in range(1, 5):
            cut = simhash._blocks(budget, blocks)
            assert len(cut) == budget + blocks and sum(w for _, w in cut) == 64
            assert [s for s, _ in cut] == [sum(w for _, w in cut[:k]) for k in range(len(cut))]


def test_near_groups(docs):
    groups = {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()}
    assert groups[9] == 5 and groups[3] == 3 and groups[4] == 3
    assert simhash.drop_near_copies(docs).columns == docs.columns


def test_merges_equal_library(docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r.doc_id: r for r in merges.decode(merges.encode(docs, path), path).collect()}
    for k, t in texts(docs):
        ids = np.array(library.encode_ordinary(t), "<u4")
        assert found[k].ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and found[k].decoded == t.encode()


def test_packing_and_streams(spark, docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    placed = packing.pack_documents(docs, path, 64).toPandas()
    for _, rows in placed.sort_values("offset").groupby("sequence_id"):
        assert rows.length.sum() <= 64 and (rows.offset.to_numpy() == np.cumsum(rows.length) - rows.length).all()
    folder = str(tmp_path / "streams")
    read = streams.read_documents(streams.write_streams(docs, folder, path, width=16), folder).toPandas().sort_values("start")
    assert read.doc_id.is_monotonic_increasing and (read.start.to_numpy() == np.cumsum(read.n_tokens) - read.n_tokens).all()
    assert read[read.doc_id == 4].ids_crc32.tolist() == [zlib.crc32(np.array([2], "<u4").tobytes())]


def test_sketches(docs):
    rows = sketches.document_fingerprints(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 9 and by[5].fingerprint == by[9].fingerprint and by[5].near_next == 0 and 0.3 < by[6].near_edited <= 1
    assert by[4].near_next == 1.0  # both empty


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    for run in (exact.exact_groups, simhash.near_groups, sketches.document_fingerprints, substrings.repeated_spans):
        assert run(none).count() == 0


def test_words_equal_tokenizers_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, coder = Tokenizer.from_file(path), words.library_coder(path)
    own = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>  \n y ", "<|endoftext> <|endoftext|", "", "  two  blanks \t\n",
           "a  <|endoftext|>　\xa0 b  ", "Ünï ñ 你好<|endoftext|>text's 12² Привет שלום 🙂", "don't<|endoftext|>'s"]
    ids, upto = coder.encode(own)
    for k, text in enumerate(own):
        assert ids[upto[k]:upto[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text
