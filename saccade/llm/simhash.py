"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints within ``budget`` bits agree on one of ``budget + 1`` blocks of bits, on two of ``budget + 2``, and so on. Each
distinct fingerprint goes to one trie per choice of blocks; their number follows from the number of fingerprints, so that
tries stay small. A trie is joined with itself by walking pairs of its nodes together: differing bits add up and a pair is
left as soon as they exceed the budget. Tries of over ``TRIE_SIZE`` fingerprints are split into parts that are joined part
by part. A task keeps the links it finds as a forest, so a dense group yields as many links as members, not pairs.

Where a similarity of shingle sets decides (``similar_groups``), the budget is too wide for blocks of the fingerprint's own
bits. Each set then goes to one trie per band of smallest hashes, the tries' links only name candidates, and the members of a
candidate group are compared by their whole sets until all that are apart have met.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccade.llm.common import bounded, id_and_text, parallelism, unused, written
from saccade.llm.links import components
from saccade.session import cut_lineage

BUDGET = 4
SHINGLE = 4
#: Words of a shingle and the share of common shingles where sets decide.
SET_SHINGLE = 5
SIMILARITY = (4, 5)
#: Bits by which fingerprints of candidates may differ: at a similarity of 0.8 they differ by 9.7 on average, by more than 20 once in 2,000.
SET_BUDGET = 20
#: Bands of smallest hashes and hashes in a band: at a similarity of 0.8 no band is shared once in 2,900.
BANDS, BAND = 20, 5
#: Sets of a candidate group that are compared with each other part of the group at once.
GROUP_SIZE = 256
#: Fingerprints of one part of a trie.
TRIE_SIZE = 2048
#: Node pairs that are walked at once; more are put aside, which bounds memory.
FRONT = 400_000
#: Rows of several tries that are walked together.
TOGETHER = 60_000

_TURNS = np.random.default_rng(7).integers(1, 2**63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words, repeats included; of all words where there are fewer."""
    words = _WORD.findall(text.encode().translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    line, length = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(length + 1) - 1
    starts, width = ends - length, min(size, len(words))
    digest = xxhash.xxh64_intdigest
    hashed = [digest(line[a:b], 42) for a, b in
              zip(starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist(), strict=True)]
    return np.array(hashed, np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Each bit is set if over half of the hashes have it; no hashes give zero."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.unpackbits(hashes[k:k + (1 << 16), None].view(np.uint8), axis=1, bitorder="little")
        votes += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a hash of the text and its signed 64-bit fingerprint ``fp``; null counts as empty, whose fingerprint is 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            found = [fingerprint(shingle_hashes(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(
                np.array(found, np.uint64).view(np.int64))], ["doc_id", "text_key", "fp"])
    rows = id_and_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, fp long")


class Forest:
    """Links among numbered items, kept as the smallest item known to be reachable."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def walk(codes: np.ndarray, nodes: np.ndarray, budget: int, forest: Forest, bits: int = 64) -> None:
    """Joins tries by walking node pairs together.

    ``codes`` (uint64) is sorted within every trie. A row of ``nodes`` is a pair to start from: (first, end) of the one trie's
    codes, (first, end) of the other's; the same range twice joins a trie with itself. Links go to ``forest``."""
    waiting = [(nodes.astype(np.int64), np.zeros(len(nodes), np.int64), bits)]
    while waiting:
        pairs, differing, bit = waiting.pop()
        while len(pairs):
            few = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= 16
            if bit == 0:
                few[:] = True
            _leaves(codes, pairs[few], budget, forest)
            pairs, differing = pairs[~few], differing[~few]
            if len(pairs) > FRONT:
                half = len(pairs) // 2
                waiting.append((pairs[half:], differing[half:], bit))
                pairs, differing = pairs[:half], differing[:half]
            if not len(pairs):
                break
            bit -= 1
            pairs, differing = _children(codes, pairs, differing, np.uint64(bit), budget)


def _cut(codes: np.ndarray, first: np.ndarray, end: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where a node's codes begin to have ``bit`` set, by bisection in all nodes at once."""
    low, high = first.copy(), end.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        is_set = (codes[np.minimum(middle, len(codes) - 1)] >> bit) & np.uint64(1) == 1
        high = np.where(open_ & is_set, middle, high)
        low = np.where(open_ & ~is_set, middle + 1, low)
    return low


def _children(codes, pairs, differing, bit, budget):
    a, b, c, d = pairs.T
    left, right = _cut(codes, a, b, bit), _cut(codes, c, d, bit)
    itself = (a == c) & (b == d)
    grown = [
        (np.stack([a, left, c, right], 1), differing, np.ones(len(a), bool)),
        (np.stack([left, b, right, d], 1), differing, np.ones(len(a), bool)),
        (np.stack([a, left, right, d], 1), differing + 1, np.ones(len(a), bool)),
        (np.stack([left, b, c, right], 1), differing + 1, ~itself),
    ]
    kept, bits = [], []
    for nodes, n, use in grown:
        use = use & (n <= budget) & (nodes[:, 0] < nodes[:, 1]) & (nodes[:, 2] < nodes[:, 3])
        kept.append(nodes[use])
        bits.append(n[use])
    return np.concatenate(kept), np.concatenate(bits)


def _leaves(codes, pairs, budget, forest):
    """Compares the codes below small node pairs."""
    if not len(pairs):
        return
    for k in range(0, len(pairs), FRONT):
        a, b, c, d = pairs[k:k + FRONT].T
        wide = d - c
        size = (b - a) * wide
        of = np.repeat(np.arange(len(a)), size)
        step = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        x, y = a[of] + step // wide[of], c[of] + step % wide[of]
        link = (x != y) & (np.bitwise_count(codes[x] ^ codes[y]) <= budget)
        forest.add(x[link], y[link])


def _blocks(budget: int, agree: int) -> list[tuple[int, int]]:
    """(shift, width) of ``budget + agree`` blocks of bits: fingerprints within ``budget`` bits are equal in ``agree`` of them."""
    count = budget + agree
    widths = [64 // count + (k < 64 % count) for k in range(count)]
    return list(zip(np.cumsum([0, *widths[:-1]]).tolist(), widths, strict=True))


def blocks_to_agree(n: int, budget: int = BUDGET, trie_size: int = TRIE_SIZE) -> int:
    """In how many blocks fingerprints of one trie agree, so that the fewest copies of ``n`` distinct ones are sent.

    A fingerprint goes to one trie for each choice of blocks, and there once to every part of the trie. One block of five
    serves up to about 50 million fingerprints of a budget of 4; longer keys keep the parts few beyond that."""
    def copies(agree: int) -> int:
        bits = agree * (64 // (budget + agree))
        return math.comb(budget + agree, agree) * max(1, math.ceil(n / (trie_size << bits)))
    return min(range(1, 5), key=lambda agree: (copies(agree), agree))


def linked(prints: DataFrame, budget: int = BUDGET, trie_size: int = TRIE_SIZE, agree: int | None = None) -> DataFrame:
    """Links (u, v) that join exactly the distinct fingerprints ``fp`` which chains of at most ``budget`` bits reach.

    ``agree`` is the number of equal blocks that a trie stands for; if not given, it follows from the number of fingerprints.
    Any number gives the same components."""
    if agree is None:
        agree = blocks_to_agree(prints.count(), budget, trie_size)
    keys = []
    for number, chosen in enumerate(itertools.combinations(_blocks(budget, agree), agree)):
        key = F.lit(number).cast("long")
        for shift, width in chosen:
            key = F.shiftleft(key, width) + F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        keys.append(F.struct(F.lit(sum(w for _, w in chosen)).alias("bits"), key.alias("key")))
    # Keys of unlike widths may be equal as numbers; such tries would only be joined needlessly, so the width tells them apart.
    tries = F.transform(F.array(*keys), lambda k: k["key"] * 64 + k["bits"])
    return linked_in(prints.select("fp", F.explode(tries).alias("trie")), budget, trie_size)


def linked_in(blocks: DataFrame, budget: int, trie_size: int = TRIE_SIZE) -> DataFrame:
    """Links (u, v) among fingerprints ``fp`` that are in one ``trie`` and differ by at most ``budget`` bits, as forests."""
    sizes = blocks.groupBy("trie").agg(F.count("*").alias("n"))
    # Of a large trie each part meets each other part once: a part's rows go to every pair of parts that it is in.
    large = sizes.where(F.col("n") > trie_size).select("trie", F.ceil(F.col("n") / trie_size).cast("int").alias("parts"))
    sized = blocks.join(large, "trie", "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
    others = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = sized.withColumn("own", own).select(
        "trie", "own", "fp", F.explode(others).alias("other")).select(
        "trie", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    n = parallelism(blocks.sparkSession)
    dealt = rows.repartition(n, "trie", "i", "j").sortWithinPartitions("trie", "i", "j", "own", "fp")
    return dealt.mapInArrow(lambda batches: _join_tries(batches, budget), "u long, v long")


def _join_tries(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    rest = None
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("trie", "i", "j", "own", "fp")], 1)
        rest = rows if rest is None else np.concatenate([rest, rows])
        if len(rest) < TOGETHER:
            continue
        change = np.flatnonzero((rest[1:, :3] != rest[:-1, :3]).any(axis=1)) + 1
        if len(change):
            yield from _join_together(rest[:change[-1]], budget)
            rest = rest[change[-1]:]
    if rest is not None and len(rest):
        yield from _join_together(rest, budget)


def _join_together(rows: np.ndarray, budget: int) -> Iterator[pa.RecordBatch]:
    rows = rows[np.lexsort((rows[:, 4].view(np.uint64), rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    codes = rows[:, 4].view(np.uint64) if rows[:, 4].flags.c_contiguous else np.ascontiguousarray(rows[:, 4]).view(np.uint64)
    change = (rows[1:, :4] != rows[:-1, :4]).any(axis=1)
    first = np.concatenate([[0], np.flatnonzero(change) + 1])
    end = np.append(first[1:], len(rows))
    head = rows[first]
    inside = head[:, 1] == head[:, 2]
    across = np.flatnonzero((head[1:, :3] == head[:-1, :3]).all(axis=1))
    nodes = np.concatenate([
        np.stack([first, end, first, end], 1)[inside],
        np.stack([first[across], end[across], first[across + 1], end[across + 1]], 1)])
    forest = Forest(len(rows))
    walk(codes, nodes, budget, forest)
    away = np.flatnonzero(forest.root != np.arange(len(rows)))
    if len(away):
        fps = np.ascontiguousarray(rows[:, 4])
        yield pa.RecordBatch.from_arrays([pa.array(fps[away]), pa.array(fps[forest.root[away]])], ["u", "v"])


def near_groups(docs: DataFrame, budget: int = BUDGET, agree: int | None = None) -> DataFrame:
    """doc_id, text_key (a hash of the text), fp, root (a group's smallest fingerprint) and component_id: the smallest
    doc_id reachable over links of at most ``budget`` bits, itself included.

    Texts without words have fingerprint 0 and link like any other. A null doc_id counts in a group but only names one
    of nulls. Repeated rows stay repeated. An empty table gives no rows."""
    prints = cut_lineage(fingerprints(docs))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(linked(distinct.select("fp"), budget, agree=agree)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = _named(rooted).select("fp", "root", "component_id")
    return prints.join(names, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def _named(rooted: DataFrame) -> DataFrame:
    """Adds component_id, the smallest ``least`` of all members of a root. Both sides are written first: a join of two plain
    tables lets adaptive execution split a large group."""
    rooted = written(rooted, "rooted")
    named = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    return rooted.join(named, "root")


def shingle_set(text: str, size: int = SET_SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(shingle_hashes(text, size))


def band_hashes(hashes: np.ndarray) -> list[int]:
    """One number for each band of smallest hashes; two sets share a band with the ``BAND``-th power of their similarity."""
    if not len(hashes):
        return []
    least = np.full(len(_TURNS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 1 << 12):
        np.minimum(least, (hashes[k:k + (1 << 12), None] * _TURNS).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(least.reshape(BANDS, BAND))]


def set_prints(docs: DataFrame, size: int = SET_SHINGLE) -> DataFrame:
    """doc_id, text_key, ``node`` (a hash of the text's shingle set), the set's fingerprint ``fp`` and its ``bands``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            sets = [shingle_set(t, size) for t in batch.column("text").to_pylist()]
            node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            fp = np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_key"), pa.array(node), pa.array(fp),
                pa.array([band_hashes(s) for s in sets], pa.list_(pa.int64()))], ["doc_id", "text_key", "node", "fp", "bands"])
    rows = id_and_text(docs).withColumn("text_key", F.xxhash64("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, node long, fp long, bands array<long>")


def similar_pairs(sets: list[np.ndarray], similarity: tuple[int, int] = SIMILARITY, linked: np.ndarray | None = None) -> np.ndarray:
    """The forest's roots of all ``sets`` whose common share is at least ``similarity`` (a fraction).

    Sets already linked (those with equal numbers in ``linked``, and those linked here) are not compared, so a dense group costs
    about one comparison a member."""
    over, under = similarity
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    of = np.repeat(np.arange(len(sets)), size)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(codes, kind="stable")
    holders, ends = of[order], np.concatenate([[0], np.cumsum(np.bincount(codes))])
    starts, forest = np.cumsum(size) - size, Forest(len(sets))
    if linked is not None:
        forest.add(np.arange(len(sets)), np.unique(linked, return_index=True)[1][np.unique(linked, return_inverse=True)[1]])
    for k in range(len(sets)):
        other = (forest.root != forest.root[k]) & (under * size >= over * size[k]) & (over * size <= under * size[k])
        if not other.any():
            continue
        own = codes[starts[k]:starts[k] + size[k]]
        count = ends[own + 1] - ends[own]
        place = np.repeat(ends[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
        common = np.bincount(holders[place], minlength=len(sets))
        link = np.flatnonzero(other & (under * common >= over * (size + size[k] - common)))
        forest.add(np.full(len(link), k), link)
    return forest.root


def _member_sets(docs: DataFrame, members: DataFrame, size: int, group_size: int) -> DataFrame:
    """root, node, n (members of the candidate group) and ``body``, the shingle set, of every member that is not alone."""
    groups = members.groupBy("root").agg(F.count("*").alias("n")).where("n > 1")
    wanted = members.join(groups, "root").select(
        "root", "node", "n", F.col("pick.doc_id").alias("w_id"), F.col("pick.text_key").alias("w_key"))
    rows = id_and_text(docs).withColumn("text_key", F.xxhash64("text"))
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_key") == F.col("w_key"))).select(
        "root", "node", "n", "text")

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            body = pa.array([shingle_set(t, size).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("root", "node", "n")), body], ["root", "node", "n", "body"])

    return texts.mapInArrow(as_sets, "root long, node long, n long, body binary")


def _cell_links(cells: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links (u, v) among the sets of each cell (root, i, j); sets with equal ``linked`` are so already."""
    columns = ("root", "i", "j", "node", "linked", "body")
    dealt = cells.select(*columns).repartition(parallelism(cells.sparkSession), "root", "i", "j").sortWithinPartitions("root", "i", "j", "node")

    def solve(nodes: list[int], linked: list[int], bodies: list[bytes]) -> pa.RecordBatch:
        root = similar_pairs([np.frombuffer(b, np.uint64) for b in bodies], similarity, np.array(linked, np.int64))
        away = np.flatnonzero(root != np.arange(len(root)))
        known = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(known[away]), pa.array(known[root[away]])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [], [])
        for batch in batches:
            for *key, node, linked, body in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if key != at:
                    if len(held[0]) > 1:
                        yield solve(*held)
                    at, held = key, ([], [], [])
                if not held[0] or node != held[0][-1]:  # else a repeated row
                    for values, value in zip(held, (node, linked, body), strict=True):
                        values.append(value)
        if len(held[0]) > 1:
            yield solve(*held)

    return dealt.mapInArrow(run, "u long, v long")


def _parts(rows: DataFrame, key: list[str], group_size: int) -> DataFrame:
    """Adds ``own``, the number of a part of about ``group_size`` rows of the key, and ``parts``, their number."""
    parts = rows.groupBy(*key).agg(F.ceil(F.count("*") / group_size).cast("int").alias("parts"))
    return rows.join(parts, key).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))


def similar_links(docs: DataFrame, members: DataFrame, size: int, similarity: tuple[int, int], group_size: int) -> DataFrame:
    """Links (u, v) that join exactly the ``members`` (root, node, pick of doc_id and text_key) of a candidate group which
    chains of similar sets reach.

    The parts of a group are first compared within themselves; the representatives of what that links are then compared
    with each other, part by part. What is still apart is compared member by member, but no two members that are already
    linked: sets of a dense group are sent a few times each, whatever its size."""
    sets = written(_member_sets(docs, members, size, group_size), "sets")
    inside = written(_cell_links(_parts(sets, ["root"], group_size).select(
        "root", F.col("own").alias("i"), F.col("own").alias("j"), "node", F.col("node").alias("linked"), "body"), similarity), "links")
    large = sets.where(F.col("n") > group_size)
    if large.isEmpty():
        return inside
    first = _parts(large.join(inside.select(F.col("u").alias("node")).distinct(), "node", "left_anti"), ["root"], group_size)
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    between = written(_cell_links(first.withColumn("other", others).select(
        "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", F.col("node").alias("linked"), "body"), similarity), "links")
    found = inside.unionByName(between)
    known = components(found)
    labelled = large.join(known.select("node", F.col("root").alias("linked")), "node", "left").withColumn("linked", F.coalesce("linked", "node"))
    apart = labelled.groupBy("root").agg(F.min("linked").alias("a"), F.max("linked").alias("b")).where("a < b").select("root")
    left = written(labelled.join(apart, "root"), "apart")
    if left.isEmpty():
        return found
    # Parts are of one linked cluster, or of several small ones; two parts of one cluster need not meet.
    clusters = left.groupBy("root", "linked").agg(F.count("*").alias("of_cluster"))
    tagged = left.join(clusters, ["root", "linked"]).withColumn("cluster", F.when(F.col("of_cluster") >= group_size, F.col("linked")))
    sized = tagged.groupBy("root", "cluster").agg(F.ceil(F.count("*") / group_size).cast("int").alias("parts"))
    listed = sized.groupBy("root").agg(F.collect_list(F.struct("cluster", "parts")).alias("all"))
    placed = tagged.join(sized.withColumnRenamed("root", "s_root").withColumnRenamed("cluster", "s_cluster"),
                         (F.col("root") == F.col("s_root")) & F.col("cluster").eqNullSafe(F.col("s_cluster"))).join(listed, "root")
    name = lambda cluster, part: F.struct(cluster.isNull().alias("mixed"), F.coalesce(cluster, F.lit(0)).alias("cluster"), part.alias("part"))
    own = name(F.col("cluster"), F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    every = F.flatten(F.transform("all", lambda c: F.transform(F.sequence(F.lit(0), c["parts"] - 1), lambda p: name(c["cluster"], p))))
    met = placed.withColumn("own", own).withColumn("other", F.explode(every)).where(
        (F.col("own.mixed") & F.col("other.mixed")) | (F.col("own.mixed") != F.col("other.mixed")) | (F.col("own.cluster") != F.col("other.cluster")))
    across = _cell_links(met.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "linked", "body"), similarity)
    return found.unionByName(written(across, "links"))


def similar_groups(docs: DataFrame, size: int = SET_SHINGLE, similarity: tuple[int, int] = SIMILARITY,
                   group_size: int = GROUP_SIZE) -> DataFrame:
    """doc_id, text_key, root (a group's smallest set hash) and component_id: the smallest doc_id reachable over links of
    texts that share at least ``similarity`` of their distinct shingles of ``size`` words, itself included.

    Links are checked on the whole sets; which pairs are checked is settled by tries and bands that were chosen for 0.8.
    Nulls, repeats and empty tables are as in ``near_groups``; texts without words are alike."""
    prints = cut_lineage(set_prints(docs, size))
    distinct = cut_lineage(prints.groupBy("node").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_key")).alias("pick"),
        F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    blocks = distinct.select("fp", F.explode("bands").alias("trie"))
    shared = blocks.groupBy("trie").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("trie")
    met = components(linked_in(blocks.join(shared, "trie"), SET_BUDGET)).select(F.col("node").alias("fp"), "root")
    members = distinct.join(met, "fp", "left").select(F.coalesce("root", "fp").alias("root"), "node", "pick")
    roots = components(similar_links(docs, members, size, similarity, group_size))
    rooted = distinct.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = _named(rooted).select("node", "root", "component_id")
    return prints.select("doc_id", "text_key", "node").join(names, "node").select("doc_id", "text_key", "root", "component_id")


def drop_near_copies(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of each group of near fingerprints one row with the smallest doc_id."""
    return _one_of_each(docs, near_groups(docs, budget))


def drop_similar(docs: DataFrame, size: int = SET_SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns: of each group of similar texts one row with the smallest doc_id."""
    return _one_of_each(docs, similar_groups(docs, size, similarity))


def _one_of_each(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """Of each group one row with the smallest doc_id.

    Of rows that repeat that id, the one with the smallest hash of its text stays, and of equal rows one."""
    groups = grouped.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    rows_of = groups.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
    key, stay_id, stay_key, n = unused(docs, "_text_key", "_stay_id", "_stay_key", "_stay_rows")
    stay = rows_of.groupBy("root").agg(F.min(F.struct("text_key", "doc_id", "n")).alias("s")).select(
        F.col("s.doc_id").alias(stay_id), F.col("s.text_key").alias(stay_key), F.col("s.n").alias(n))
    rows = docs.withColumn(key, F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))).join(
        stay, F.col("doc_id").eqNullSafe(F.col(stay_id)) & (F.col(key) == F.col(stay_key)))
    repeated = rows.where(F.col(n) > 1).dropDuplicates([stay_id, stay_key])
    return rows.where(F.col(n) == 1).unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
