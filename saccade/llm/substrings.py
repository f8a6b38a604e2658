"""Removal of long repeated strings with suffix arrays of shards.

Every string of ``length`` bytes has one anchor: the byte gram in it with the smallest hash, the leftmost of equal ones. Equal
strings have equal anchors, so strings whose anchor occurs once are settled by a count. Strings in a row with one anchor form
a segment; equal segments are folded. The distinct segments of an anchor go to one shard, whose suffix array and permuted
common prefixes tell which strings occur again. Anchors of over ``SHARD_KINDS`` distinct segments would not fit a shard: their
strings are counted one by one by digest, which gives the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saccade.llm.common import bounded, id_and_text, parallelism, unused, utf8, written
from saccade.llm.induced import repeats

LENGTH = 400
#: Bytes of a gram. Shorter grams meet by chance, longer ones make more anchors.
GRAM = 64
#: Distinct segments of one anchor that are sorted in one shard.
SHARD_KINDS = 1024
#: Bytes that are sorted together.
SHARD_BYTES = 1 << 20
#: Bytes that anchors are searched in at once, which takes about 100 times as much memory. Longer texts are cut into slices that
#: overlap by ``length`` - 1 bytes.
SLICE = 1 << 19

_PLACE = np.uint64((1 << 24) - 1)
_NUMBERS = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = np.random.default_rng(6).integers(1, 2**63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` (a power of two) bytes from each place; the last places' are of no use."""
    h, k, step = _NUMBERS[data], 1, 0
    while k < gram:
        ahead = np.zeros_like(h)
        ahead[:-k] = h[k:]
        h = h * _STEPS[step] + ahead
        k, step = 2 * k, step + 1
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, number of strings, gram hash) of every run of strings with one anchor; no string crosses ``ends``."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty.view(np.uint64)
    room = np.repeat(ends[1:], np.diff(ends)) - np.arange(n) >= length
    h = gram_hashes(data, gram)
    key = (h & ~_PLACE) | np.arange(n, dtype=np.uint64)
    width = length - gram + 1
    padded = np.full(-(-(n + width) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    from_left = np.minimum.accumulate(blocks, axis=1).ravel()
    from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(from_right[:n], from_left[width - 1:n + width - 1]) & _PLACE).astype(np.int64)
    new = room.copy()
    new[1:] &= ~room[:-1] | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    over = np.flatnonzero(room[:-1] & ~room[1:]) + 1
    stops = np.union1d(first, np.append(over, n))
    count = stops[np.searchsorted(stops, first, side="right")] - first
    return first, count, h[place[first]]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text: rows equal in both are alike in every result."""
    return id_and_text(docs).withColumn("text_key", F.xxhash64("text"))


def segments(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key, start, strings, anchor and a digest of every segment."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, limit=SLICE):
            data, ends = utf8(batch.column("text"))
            if len(data) > SLICE:  # one long text
                cuts = [(a, min(a + SLICE + length - 1, len(data))) for a in range(0, max(1, len(data) - length + 1), SLICE)]
            else:
                cuts = [(0, len(data))]
            for a, b in cuts:
                part = data[a:b]
                first, count, h = anchors(part, ends if len(cuts) == 1 else np.array([0, b - a]), length, gram)
                if not len(first):
                    continue
                view = memoryview(part)
                digest = [xxhash.xxh3_64_intdigest(view[i:i + c + length - 1]) for i, c in zip(first.tolist(), count.tolist(), strict=True)]
                row = np.searchsorted(ends, first + a, side="right") - 1
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(row)), batch.column("text_key").take(pa.array(row)),
                    pa.array(first + a - ends[row]), pa.array(count), pa.array(h.view(np.int64)),
                    pa.array(np.array(digest, np.uint64).view(np.int64))],
                    ["doc_id", "text_key", "start", "strings", "anchor", "digest"])
    rows = keyed(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, start long, strings long, anchor long, digest long")


def _bodies(docs: DataFrame, picks: DataFrame, length: int) -> DataFrame:
    """anchor, digest, strings, hot and the bytes of the picked segments, cut from their documents."""
    wanted = picks.groupBy(F.col("pick.doc_id").alias("w_id"), F.col("pick.text_key").alias("w_key")).agg(
        F.collect_list(F.struct("pick.start", "strings", "anchor", "digest", "hot")).alias("wanted"))
    rows = keyed(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_key") == F.col("w_key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            data, ends = utf8(batch.column("text"))
            raw = data.tobytes()
            found = {k: [] for k in ("anchor", "digest", "strings", "hot", "body")}
            for row, wanted in enumerate(batch.column("wanted").to_pylist()):
                for w in wanted:
                    at = int(ends[row]) + w["start"]
                    found["body"].append(raw[at:at + w["strings"] + length - 1])
                    for k in ("anchor", "digest", "strings", "hot"):
                        found[k].append(w[k])
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "body" else pa.bool_() if k == "hot" else pa.int64())
                                              for k, v in found.items()})
    return rows.select("text", "wanted").mapInArrow(run, "anchor long, digest long, strings long, hot boolean, body binary")


_MARKS = "anchor long, digest long, strings long, spans array<struct<a:long,b:long>>"


def _runs(found: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], found, [False]]).astype(np.int8)))
    return [{"a": a, "b": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


def _sort_shards(bodies: DataFrame, length: int) -> DataFrame:
    """Which strings of the segments occur again among those of their anchor. Anchors are sorted together up to ``SHARD_BYTES``."""
    dealt = bodies.select("anchor", "digest", "strings", "body").repartition(
        parallelism(bodies.sparkSession), "anchor").sortWithinPartitions("anchor", "digest")

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = repeats([r[3] for r in rows], length, length)
        spans = [_runs(f[:r[2]]) for f, r in zip(found, rows, strict=True)]
        kept = [k for k, s in enumerate(spans) if s]
        columns = [pa.array([rows[k][c] for k in kept], pa.int64()) for c in range(3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([spans[k] for k in kept], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))],
                                          ["anchor", "digest", "strings", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "strings", "body")), strict=True):
                if size >= SHARD_BYTES and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield solve(held)

    return dealt.mapInArrow(run, _MARKS)


def _count_strings(bodies: DataFrame, length: int) -> DataFrame:
    """The same for anchors with more segments than a shard takes: every string's digest is counted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "body", 1 << 16):
            bodies, strings = batch.column("body").to_pylist(), batch.column("strings").to_pylist()
            row = np.repeat(np.arange(len(bodies)), strings)
            marks = [xxhash.xxh3_128_digest(memoryview(b)[k:k + length]) for b, s in zip(bodies, strings, strict=True) for k in range(s)]
            at = np.concatenate([np.arange(s) for s in strings])
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(row)) for c in ("anchor", "digest", "strings")] + [
                pa.array(at), pa.array(marks, pa.binary())], ["anchor", "digest", "strings", "at", "mark"])
    each = bodies.select("anchor", "digest", "strings", "body").mapInArrow(
        run, "anchor long, digest long, strings long, at long, mark binary")
    again = each.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
    return each.join(again, "mark").groupBy("anchor", "digest", "strings").agg(
        F.collect_set(F.struct(F.col("at").alias("a"), (F.col("at") + 1).alias("b"))).alias("spans"))


def repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, kinds: int = SHARD_KINDS) -> DataFrame:
    """doc_id, text_key and the places [a, b) from which strings start that also start elsewhere in ``docs``."""
    found = written(segments(docs, length, gram), "segments")
    pick = F.min(F.struct("doc_id", "text_key", "start")).alias("pick")
    folded = found.groupBy("anchor", "digest", "strings").agg(F.count("*").alias("n"), pick)
    met = folded.groupBy("anchor").agg(F.sum("n").alias("rows"), F.count("*").alias("kinds")).where("rows > 1")
    live = written(folded.join(met, "anchor"), "anchors")
    whole = live.where("n > 1").select("anchor", "digest", "strings", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("strings").alias("b"))).alias("spans"))
    bodies = written(_bodies(docs, live.where("kinds > 1").withColumn("hot", F.col("kinds") > kinds), length), "bodies")
    apart = _sort_shards(bodies.where("not hot"), length).unionByName(_count_strings(bodies.where("hot"), length))
    marks = whole.unionByName(apart).groupBy("anchor", "digest", "strings").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    # Written first: a join of two plain tables lets adaptive execution split the rows of an anchor that is very common.
    placed = found.join(written(marks, "marks"), ["anchor", "digest", "strings"]).select("doc_id", "text_key", "start", F.explode("spans").alias("s"))
    return placed.select("doc_id", "text_key", (F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b")).alias("b"))


def merged(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """The byte ranges that strings starting in ``spans`` cover, joined where they meet or overlap."""
    out: list[list[int]] = []
    for s in sorted([] if spans is None else list(spans), key=lambda s: (s["a"], s["b"])):
        a, b = s["a"], s["b"] + length - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _with_spans(rows: DataFrame, docs: DataFrame, length: int, text: Column, name: str) -> DataFrame:
    """``rows`` (with the given text) and as ``name`` the list of their repeated strings, null where there are none."""
    key, span_id, span_key = unused(rows, "_text_key", "_span_id", "_span_key")
    spans = repeated_strings(docs, length).groupBy(F.col("doc_id").alias(span_id), F.col("text_key").alias(span_key)).agg(
        F.collect_set(F.struct("a", "b")).alias(name))
    marked = rows.withColumn(key, F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))))
    return marked.join(spans, F.col("doc_id").eqNullSafe(F.col(span_id)) & (F.col(key) == F.col(span_key)), "left").drop(
        span_id, span_key, key)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256, ``spans``, the maximal byte ranges that repeat, and ``text``, what is
    left (null where a cut leaves a part of a character).

    A null text is empty, and texts shorter than ``length`` have no spans. Repeated rows repeat each other. An empty table
    gives no rows."""
    rows = _with_spans(id_and_text(docs), docs, length, F.col("text"), "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            data, ends = utf8(batch.column("text"))
            raw, figures = data.tobytes(), []
            for row, spans in enumerate(batch.column("_spans").to_pylist()):
                text, cut = raw[ends[row]:ends[row + 1]], merged(spans, length)
                kept = _without(text, cut)
                figures.append((len(text), len(text) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(),
                                [{"a": a, "b": b} for a, b in cut], _whole(kept)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(zip(*figures, strict=True), kinds, strict=True))],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "_spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<a:long,b:long>>, text string")


def _whole(kept: bytes) -> str | None:
    try:
        return kept.decode()
    except UnicodeDecodeError:
        return None


def _without(text: bytes, cut: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in cut:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text`` (and ``n_chars`` counted anew where it is there and they were).

    All rows and columns stay. A character of which a cut leaves a part goes wholly; a null text stays null."""
    found, left = unused(docs, "_spans", "_kept")
    rows = _with_spans(docs, docs, length, docs["text"], found)

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else _without(t.encode(), merged(s, length)).decode("utf-8", "ignore")
                          for t, s in zip(text, spans, strict=True)], dtype=object)

    changed = F.col(found).isNotNull()
    fresh = rows.withColumn(left, F.when(changed, cut(F.col("text").cast("string"), F.col(found))).otherwise(F.col("text")))
    named = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": F.col(left).alias("text")}
    if "n_chars" in named:
        kind = dict(docs.dtypes)["n_chars"]
        named["n_chars"] = F.when(changed, F.length(left).cast(kind)).otherwise(F.col("n_chars")).alias("n_chars")
    return fresh.select(*[named[c] for c in docs.columns])
