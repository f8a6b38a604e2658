"""The conversation trie, the permutation index and the source divergence against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from saccade.llm import divergence, permutations, tries


def plain_trie(rows):
    """(conv_id, turn, role, text) rows to {(conv_id, depth): the other columns}."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), tie, (role, text)))
    own = {c: [t for _, _, t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - int(np.fmod(c, 5)), [])[:h] + own[c][h:])
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children = Counter(path[:-1] for path in nodes if path)
    leaves, saved = Counter(), Counter()
    for path, convs in nodes.items():
        weight = (len(convs) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += weight
    return {(min(convs), len(path)): (
        min(nodes[path[:-1]]) if path else None, len(convs), children[path], leaves[path], saved[path],
        hashlib.sha256(",".join(str(c) for c in sorted(convs) if rebuilt[c] == path).encode()).hexdigest()) for path, convs in nodes.items()}


def found_trie(table, **more):
    rows = tries.conversation_trie(table, **more).collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def conversations(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in range(-7, n):
        for turn in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([turn, turn, turn, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "long text"])))
    rows += [(n + 3, t, "user", f"turn {t % 3}") for t in range(400)]  # one conversation with most turns
    rows += [(c, t, "user", "the same") for c in range(n + 10, n + 60) for t in range(12)]  # copies
    rows += [(None, 1, "user", "nobody's"), (n + 3, 5, "user", "twice"), (n + 3, 5, "user", "twice")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_conversation_trie(spark, seed, monkeypatch):
    monkeypatch.setattr(tries, "STRETCH", 7)
    monkeypatch.setattr(tries, "PIECE", 5)
    rows = conversations(seed)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, digest string, part int").repartition(6)
    assert found_trie(table) == plain_trie(rows)


def test_conversation_trie_starts_anew_on_equal_fingerprints(spark, monkeypatch):
    rows = conversations(3, 20)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    good = tries.bases
    monkeypatch.setattr(tries, "bases", lambda seed: good(seed) if seed else ([1, 1], [1, 1]))  # base 1 forgets the order of turns
    rows += [(100, 0, "u", "p"), (100, 1, "u", "q"), (105, 0, "u", "q"), (105, 1, "u", "p")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found_trie(table) == plain_trie(rows)


def test_products_modulo_the_prime():
    rng = random.Random(4)
    a, b = ([rng.randrange(tries.PRIME) for _ in range(500)] + [0, tries.PRIME - 1] for _ in range(2))
    assert tries.times(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % tries.PRIME for x, y in zip(a, b)]
    assert tries.powers(a[0], np.array([0, 1, 77, 10**12])).tolist() == [pow(a[0], e, tries.PRIME) for e in (0, 1, 77, 10**12)]
    assert tries.running(np.array(a, np.uint64))[-1] == sum(a) % tries.PRIME


def plain_nearest(rows, k, every):
    vec = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            vec.setdefault((i, tuple(x + 0.0 for x in v)))
    width = Counter(len(v) for _, v in vec)
    width = min(width, key=lambda w: (-width[w], w))
    vec = [(i, np.array(v)) for i, v in vec if len(v) == width]
    out = []
    for q, x in vec:
        if q % every == 0:
            scored = sorted((-float((v * x).sum()), i) for i, v in vec if not (i == q and (v == x).all()))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_nearest_vectors_whole_on_small_tables(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(300)]
    rows += [(1000 + k, [0.5] * 8) for k in range(60)]  # a group of copies, queries among them
    rows += [(400, None), (420, [0.0] * 8), (440, [float("nan")] + [1.0] * 7), (460, [None] + [1.0] * 7), (480, []), (500, [1.0, 2.0]), (None, [1.0] * 8),
             (40, rows[40][1]), (60, [9.0] * 8), (520, [-0.0] * 7 + [3.0]), (540, [0.0] * 7 + [3.0])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, query int, body string")
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in permutations.nearest_vectors(table, 10, 20).collect())
    assert found == plain_nearest(rows, 10, 20)


def test_recall_of_the_index(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    x = (centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 24)) * 0.8) * rng.uniform(0.5, 2, 6000)[:, None]
    x = x.astype(np.float32).astype(float)
    table = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    found = {}
    for r in permutations.nearest_vectors(table).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 6000, 20):
        s = (x * x[q]).sum(axis=1)
        got = sorted(found[q])
        assert [r for r, _, _ in got] == list(range(1, 21)) and all(s[i] == v for _, i, v in got)
        s[q] = -np.inf
        hits += len({i for _, i, _ in got} & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.9 * 20 * 300


def test_footrule_order():
    rng = np.random.default_rng(6)
    orders = np.stack([rng.permutation(30)[:8] for _ in range(200)])
    files = permutations.InvertedFiles(orders, 30)
    place = np.full((200, 30), 8)
    place[np.arange(200)[:, None], orders] = np.arange(8)
    for q in range(20):
        distance = np.abs(place - place[q]).sum(axis=1)
        assert sorted(distance[files.nearest(orders[q], 25)]) == sorted(distance)[:25]


def plain_divergence(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    split = [(lang, source, Counter(re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in split}:
        df = Counter(t for a, _, c in split if a == lang for t in c)
        kept = [t for t in df if df[t] >= least]
        n = {}
        for a, s, c in split:
            if a == lang:
                n.setdefault(s, Counter()).update({t: c[t] for t in kept})
        n[None] = sum((n[s] for s in list(n)), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in n.items()}
        for s in set(n) - {None}:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in set(n) - {None, s})
            terms = sorted((p[None][t] - p[s][t], t.encode()) for t in kept if n[s][t] and p[s][t] > p[None][t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, k.decode(), -v, r + 1) for r, (v, k) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_source_divergence(spark, small, monkeypatch):
    if small:
        for name, value in {"TERMS": 4, "SOURCES": 3, "COLUMNS": 5, "SLOT": 2, "HELD": 20, "SLICE": 16}.items():
            monkeypatch.setattr(divergence, name, value)
    rng = random.Random(7)
    words = ["The", "the", "Ünï", "ÜNÏ", "a", "b2c", "x_y", "don't", "你好", "é", "zebra", "Q"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 40))), rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s2", "s3", "Ü", "zz", None, "s4", "s5", "s6"])) for _ in range(300)]
    rows += [(None, "en", "silent"), ("", "fr", "one"), (None, "fr", None), ("rare words", "it", "only"), ("the " * 5000, "en", "s1")]
    table = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "text string, lang string, source string, doc_id long, term string")
    found = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.source_divergence(table, 5, 7).collect())
    assert found == plain_divergence(rows, 5, 7)


def test_empty_tables_of_the_new_operators(spark):
    assert tries.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert permutations.nearest_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert divergence.source_divergence(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_words_of_every_code_point_equal_both_libraries():
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    from saccade.llm import merges, words
    texts = []
    for first in range(0, 0x110000, 64):
        marks = [chr(c) for c in range(first, first + 64) if not 0xD800 <= c < 0xE000]
        if marks:
            texts.append("".join(f"x{c}'ll {c}1{c}! {c}{c}\n{c} \xe9{c}" for c in marks))
    rng = random.Random(3)
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x250, 0xD800), rng.randrange(0x10000, 0x110000), 32, 10])) for _ in range(40)) for _ in range(2000)]
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, coder = Tokenizer.from_file(path), words.library_coder(path)
    for k in range(0, len(texts), 500):
        ids, upto = coder.encode(texts[k:k + 500])
        for row, found in enumerate(library.encode_batch(texts[k:k + 500], add_special_tokens=False)):
            assert ids[upto[row]:upto[row + 1]].tolist() == found.ids
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    assert words.PATTERN == public_tokenizers.PATTERN
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder = words.WordCoder(merges.Merges.read(path).replay)
    for k in range(0, len(texts), 500):
        ids, upto = coder.encode(texts[k:k + 500])
        for row, found in enumerate(library.encode_ordinary_batch(texts[k:k + 500])):
            assert ids[upto[row]:upto[row + 1]].tolist() == found


def test_long_texts_score_as_in_one_piece(monkeypatch):
    from saccade.llm import toxicity
    rng = np.random.default_rng(2)
    model = toxicity.ToxicModel(rng.normal(size=60**3) * (rng.random(60**3) < 0.05), 1.0, 0.0, 0.25)
    for seed in range(6):
        draw = random.Random(seed)
        text = "".join(draw.choice("abcdefg  \n.1!é") for _ in range(6000)).encode()
        data, ends = np.frombuffer(text, np.uint8), np.array([0, len(text)])
        monkeypatch.setattr(toxicity, "SLICE", 1 << 19)
        whole = model.best(data, ends)
        monkeypatch.setattr(toxicity, "SLICE", 300)
        assert np.allclose(model.best(data, ends), whole)
