"""The trie of rebuilt conversations, from products of turn fingerprints.

A sequence of turns has the fingerprint sum(x_i B^i) modulo a prime, in two lanes; with the number of turns it forms a monoid, so
the fingerprint of a base's head followed by a conversation's own suffix comes from three stored prefix products, and no rebuilt
text is ever put together. The same law carries products across the parts of a conversation that several tasks hold. Members of a
node are the rows with its depth and fingerprint; that they are equal is verified by the stored digest of their last turn and the
fingerprint of what precedes it, and a mismatch anywhere starts anew with other bases.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from saccade.llm.common import parallelism, written

#: Conversations that share a base, and the most turns that they take from it (and skip of their own), plus one.
FAMILY, HEAD = 5, 9
#: The prime of the fingerprints.
PRIME = (1 << 61) - 1
#: Ids in a piece of a node's list.
PIECE = 4096
#: Depths of one conversation that are summed in one task.
STRETCH = 4096

_P = np.uint64(PRIME)
_NODE = ["depth", "f1", "f2"]


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b modulo the prime, for uint64 below it."""
    a1, a0 = a >> np.uint64(31), a & np.uint64((1 << 31) - 1)
    b1, b0 = b >> np.uint64(31), b & np.uint64((1 << 31) - 1)
    mid = a1 * b0 + a0 * b1
    total = a1 * b1 * np.uint64(2) + (mid >> np.uint64(30)) + ((mid & np.uint64((1 << 30) - 1)) << np.uint64(31)) + a0 * b0
    return _fold(total)


def _fold(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base to each exponent (not negative), modulo the prime."""
    out, square, e = np.ones(len(exponents), np.uint64), base, exponents.astype(np.uint64)
    while e.any():
        out = np.where(e & np.uint64(1) == 1, times(out, np.uint64(square)), out)
        square, e = square * square % PRIME, e >> np.uint64(1)
    return out


def running(values: np.ndarray) -> np.ndarray:
    """Sums of all values so far modulo the prime; halves are summed apart, as 2^31 of them fit."""
    high, low = np.cumsum(values >> np.uint64(32)), np.cumsum(values & np.uint64((1 << 32) - 1))
    return _fold(times(_fold(high), np.uint64(1 << 32)) + _fold(low))


def bases(seed: int) -> tuple[list[int], list[int]]:
    """The base of each lane and its inverse."""
    found = [int.from_bytes(hashlib.sha256(f"lane {lane} of {seed}".encode()).digest()[:8], "big") % (PRIME - 1000) + 500 for lane in (1, 2)]
    return found, [pow(b, -1, PRIME) for b in found]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, the digest of (role, text) and the bytes of the text. Rows without a conv_id are left out."""
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text)), 256))
    conv = conversations["conv_id"].cast("long")
    return conversations.select(conv.alias("conv_id"), conversations["turn"].alias("turn"), digest.alias("digest"),
                                F.octet_length(text).cast("long").alias("n_bytes")).where("conv_id IS NOT NULL")


def _prefixes(conversations: DataFrame, seed: int) -> DataFrame:
    """Every turn with its place and prefix fingerprint inside its part: a stretch of the table in the order of the turns.

    Turns of one place in the order (same turn number) follow by digest. A part's last rows tell the product of what it holds."""
    n = parallelism(conversations.sparkSession)
    rows = turns(conversations).withColumn("tie", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "digest", "tie"]
    dealt = rows.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(
        *[F.col(c).asc_nulls_first() for c in order]).select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "digest", "n_bytes")
    lanes, _ = bases(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, ends = None, 0, [np.uint64(0), np.uint64(0)]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id").to_numpy()
            first = np.concatenate([[True], ids[1:] != ids[:-1]])
            starts = np.flatnonzero(first)
            run_of = np.cumsum(first) - 1
            goes_on = ids[0] == conv
            at = np.arange(1, len(ids) + 1) - starts[run_of] + (place if goes_on else 0) * (run_of == 0)
            words = np.frombuffer(b"".join(d[:16] for d in batch.column("digest").to_pylist()), "<u8").reshape(-1, 2)
            found = []
            for lane in range(2):
                value = times(_fold(words[:, lane] & _P) + np.uint64(0), powers(lanes[lane], at))
                total = running(value)
                before = np.concatenate([[np.uint64(0)], total])[starts]
                carried = np.where(np.arange(len(starts)) == 0, ends[lane] if goes_on else np.uint64(0), np.uint64(0))
                shift = _fold(_P - before + carried)[run_of]
                after = _fold(total + shift)
                found += [after, _fold(after + (_P - value))]
                ends[lane] = after[-1]
            conv, place = ids[-1], int(at[-1])
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in ("part", "conv_id", "digest", "n_bytes")), pa.array(at),
                *(pa.array(f.view(np.int64)) for f in found)],
                ["part", "conv_id", "digest", "n_bytes", "at", "f1", "p1", "f2", "p2"])

    return dealt.mapInArrow(run, "part long, conv_id long, digest binary, n_bytes long, at long, f1 long, p1 long, f2 long, p2 long")


def _carried(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Adds to each row the product of its conversation's earlier parts: ``skip`` turns with fingerprint ``c1``, ``c2``."""
    lanes, _ = bases(seed)
    for batch in batches:
        skip = batch.column("skip").to_numpy()
        columns = {c: batch.column(c) for c in ("conv_id", "digest", "n_bytes")} | {"at": pa.array(batch.column("at").to_numpy() + skip)}
        for k, lane in enumerate("12"):
            power, carry = powers(lanes[k], skip), batch.column(f"c{lane}").to_numpy().view(np.uint64)
            for kind in "fp":
                own = batch.column(f"{kind}{lane}").to_numpy().view(np.uint64)
                columns[kind + lane] = pa.array(_fold(times(own, power) + carry).view(np.int64))
        yield pa.RecordBatch.from_pydict(columns)


def prefix_products(conversations: DataFrame, seed: int = 0) -> DataFrame:
    """conv_id, at (the place from 1), digest, n_bytes, and the fingerprints of the turns up to this one (f1, f2) and before it
    (p1, p2). A conversation may lie in any number of parts."""
    stored = written(_prefixes(conversations, seed), "turns")
    parts = stored.groupBy("conv_id", "part").agg(F.max("at").alias("n"), F.max_by("f1", "at").alias("f1"), F.max_by("f2", "at").alias("f2"))
    several = parts.groupBy("conv_id").agg(F.count("*").alias("parts")).where("parts > 1")
    lanes, _ = bases(seed)
    kinds = "conv_id long, part long, skip long, c1 long, c2 long"

    def scan(pdf):
        pdf = pdf.sort_values("part")
        skip, sums, out = 0, [0, 0], []
        for part, n, *f in zip(pdf["part"], pdf["n"], pdf["f1"], pdf["f2"], strict=True):
            out.append((int(pdf["conv_id"].iloc[0]), int(part), skip, *sums))
            sums = [(s + int(v) * pow(b, skip, PRIME)) % PRIME for s, v, b in zip(sums, f, lanes, strict=True)]
            skip += int(n)
        return type(pdf)(out, columns=["conv_id", "part", "skip", "c1", "c2"])

    # Only conversations on the border of two parts are in several: at most two rows a part.
    carry = parts.join(several.select("conv_id"), "conv_id").groupBy("conv_id").applyInPandas(scan, kinds)
    joined = stored.join(F.broadcast(written(carry, "carry")), ["conv_id", "part"], "left").fillna(0, ["skip", "c1", "c2"])
    return joined.mapInArrow(lambda batches: _carried(batches, seed),
                             "conv_id long, digest binary, n_bytes long, at long, f1 long, p1 long, f2 long, p2 long")


def head_length(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string")) % HEAD).cast("long")


def _spliced(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Own turns behind the head: base product, then the own product without its first turns, moved by ``kept`` - ``skip`` places."""
    _, inverse = bases(seed)
    for batch in batches:
        skip, kept, at = (batch.column(c).to_numpy() for c in ("skip", "kept", "at"))
        columns = {c: batch.column(c) for c in ("conv_id", "digest", "n_bytes", "turns")} | {"depth": pa.array(at - skip + kept)}
        for k, lane in enumerate("12"):
            head, own = (batch.column(f"{c}{lane}").to_numpy().view(np.uint64) for c in "hs")
            back = powers(inverse[k], skip - kept)
            for kind in "fp":
                value = batch.column(f"{kind}{lane}").to_numpy().view(np.uint64)
                columns[kind + lane] = pa.array(_fold(times(_fold(value + (_P - own)), back) + head).view(np.int64))
        yield pa.RecordBatch.from_pydict(columns)


def members(products: DataFrame, seed: int = 0) -> DataFrame:
    """conv_id, depth, fingerprint (f1, f2), the one before (p1, p2), digest and n_bytes of the last turn, and ``turns`` of the
    rebuilt conversation, for every prefix of every rebuilt conversation, the empty one included."""
    few = products.where(F.col("at") < HEAD).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("at", "f1", "f2", "p1", "p2", "digest", "n_bytes"))).alias("head"))
    lengths = products.groupBy("conv_id").agg(F.max("at").alias("own_turns"))
    own = lengths.join(few, "conv_id").withColumn("skip", head_length(F.col("conv_id"))).withColumn(
        "base_id", F.col("conv_id") - F.col("conv_id") % FAMILY)
    base = few.select(F.col("conv_id").alias("base_id"), F.col("head").alias("base"))
    none = F.lit(0).cast("long")
    taken = F.when(F.col("skip") > 0, F.slice("base", F.lit(1), F.greatest("skip", F.lit(1))))
    plans = own.join(base, "base_id", "left").withColumn("taken", taken).select(
        "conv_id", "skip", "taken", F.coalesce(F.size(F.coalesce("taken", F.array())), F.lit(0)).cast("long").alias("kept"),
        F.greatest(F.col("own_turns") - F.col("skip"), none).alias("left_over"),
        *[F.coalesce(F.element_at("taken", -1)[f"f{k}"], none).alias(f"h{k}") for k in (1, 2)],
        *[F.coalesce(F.when(F.col("skip") > 0, F.get("head", F.col("skip").cast("int") - 1)[f"f{k}"]), none).alias(f"s{k}") for k in (1, 2)]
    ).withColumn("turns", F.col("kept") + F.col("left_over"))
    plans = written(plans, "plans")
    root = plans.select("conv_id", none.alias("depth"), none.alias("f1"), none.alias("f2"), none.alias("p1"), none.alias("p2"),
                        F.unhex(F.lit("")).alias("digest"), none.alias("n_bytes"), "turns")
    heads = plans.select("conv_id", "turns", F.explode("taken").alias("t")).select(
        "conv_id", F.col("t.at").alias("depth"), *[F.col(f"t.{c}").alias(c) for c in ("f1", "f2", "p1", "p2", "digest", "n_bytes")], "turns")
    behind = products.join(plans.where("left_over > 0").drop("taken"), "conv_id").where("at > skip").mapInArrow(
        lambda batches: _spliced(batches, seed),
        "conv_id long, digest binary, n_bytes long, turns long, depth long, f1 long, p1 long, f2 long, p2 long")
    return root.unionByName(heads).unionByName(behind)


def end_hashes(ends: DataFrame) -> DataFrame:
    """depth, f1, f2 and the SHA-256 of the ids (conv_id) that end there, ascending and joined by commas.

    Ids are sorted over all tasks and put together in pieces, so that the one task that must read all of a node's list reads
    few rows; it holds one piece at a time."""
    n = parallelism(ends.sparkSession)
    names = [*_NODE, "least", "piece"]
    kinds = "depth long, f1 long, f2 long, least long, piece string"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[int]] = []

        def send(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)] + [
                pa.array([",".join(map(str, r[4])) for r in rows], pa.string())], names)

        for batch in batches:
            for *node, conv in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "conv_id")), strict=True):
                if held and held[-1][:3] == node and len(held[-1][4]) < PIECE:
                    held[-1][4].append(conv)
                else:
                    held.append([*node, conv, [conv]])
            if len(held) > 1:
                yield send(held[:-1])
                held = held[-1:]
        if held:
            yield send(held)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, rows = None, None, []

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)] + [
                pa.array([r[3] for r in rows], pa.string())], [*_NODE, "ends_sha256"])
            rows.clear()
            return out

        for batch in batches:
            for *at, piece in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "piece")), strict=True):
                if at == node:
                    state.update(b"," + piece.encode())
                    continue
                if state is not None:
                    rows.append((*node, state.hexdigest()))
                node, state = at, hashlib.sha256(piece.encode())
            if rows:
                yield send()
        if state is not None:
            rows.append((*node, state.hexdigest()))
            yield send()

    listed = ends.select(*_NODE, "conv_id").repartitionByRange(n, *_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id").mapInArrow(pieces, kinds)
    return listed.repartition(n, *_NODE).sortWithinPartitions(*_NODE, "least").select(*_NODE, "piece").mapInArrow(
        hashes, "depth long, f1 long, f2 long, ends_sha256 string")


def _below(nodes: DataFrame) -> DataFrame:
    """conv_id, depth and ``tail``: the weights of the conversation's own nodes from this depth on. Long paths are cut into stretches."""
    cut = nodes.select("conv_id", "depth", "weight", F.floor(F.col("depth") / STRETCH).alias("stretch"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("conv_id", "stretch").agg(F.sum("weight").alias("sum")).select(
        "conv_id", "stretch", F.coalesce(F.sum("sum").over(later), F.lit(0)).alias("after"))
    inside = Window.partitionBy("conv_id", "stretch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("inside", F.sum("weight").over(inside)).join(sums, ["conv_id", "stretch"]).select(
        "conv_id", "depth", (F.col("inside") + F.col("after")).alias("tail"))


def conversation_trie(conversations: DataFrame, seed: int = 0) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty; null turns come first, turns of one number follow by the SHA-256 of role and text; repeated
    rows are turns of their own; rows without a conv_id belong to no conversation. The base of a negative id is found by the
    remainder towards zero. Any conversation may hold any share of the turns, and any node any share of the conversations. Other
    columns are not read. An empty table gives no rows."""
    while True:
        rows = written(members(written(prefix_products(conversations, seed), "products"), seed), "members")
        before = F.struct("p1", "p2", "digest")
        nodes = written(rows.groupBy(*_NODE).agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min(before).alias("low"), F.max(before).alias("high"),
            F.max("n_bytes").alias("n_bytes")).withColumn("weight", (F.col("n_convs") - 1) * F.col("n_bytes")), "nodes")
        if not nodes.where("low <> high").limit(1).collect():
            break
        seed += 1
    up = (F.col("depth") - 1).alias("depth"), F.col("low.p1").alias("f1"), F.col("low.p2").alias("f2")
    children = nodes.where("depth > 0").select(*up).groupBy(*_NODE).agg(F.count("*").alias("n_children"))
    sized = written(nodes.drop("high").join(children, _NODE, "left").fillna(0, ["n_children"]), "sized")
    # A conversation is the smallest member of its nodes from some depth on. A node's subtree has the nodes of all its members'
    # own stretches, of which only the smallest member's begins above the node.
    own = sized.groupBy("conv_id").agg(F.sum("weight").alias("own"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    sums = rows.join(own.where("own > 0 OR leaf > 0"), "conv_id").groupBy(*_NODE).agg(F.sum("own").alias("all_own"), F.sum("leaf").alias("n_leaves"))
    ends = end_hashes(rows.where("depth = turns"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("u1"), F.col("f2").alias("u2"), F.col("conv_id").alias("parent_conv_id"))
    above = _below(sized).join(own.select("conv_id", "own"), "conv_id")
    found = (sized.join(sums, _NODE, "left").join(ends, _NODE, "left")
             .join(above, ["conv_id", "depth"])
             .withColumn("u1", F.col("low.p1")).withColumn("u2", F.col("low.p2"))
             .join(parents, ["depth", "u1", "u2"], "left"))
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
        (F.coalesce("all_own", F.lit(0)) - F.col("own") + F.col("tail")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
