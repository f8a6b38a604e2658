"""How sources of a language differ in their words, by joint tables from products of one-hot matrices.

A term's price in a group follows from its count there alone, so the sum of price differences of two groups is their joint
table of count levels, priced. A block of terms becomes a 0/1 matrix with a column for each (group, level); the product of
its transpose with itself holds the joint tables of all pairs of groups. Products are exact: a block has at most ``TERMS``
terms or so, far below what a 32-bit float counts. Blocks hold terms of alike frequency, which have few levels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from saccade.llm.common import bounded, parallelism, written

#: Documents of a language that a kept term is in at least.
LEAST_DOCS = 30
#: Ranks of the part ``term``.
TOP = 50
#: Terms of a block (on average), sources of a block and columns of a product.
TERMS, SOURCES, COLUMNS = 256, 32, 1024
#: Blocks of terms (on average) of a pair of source blocks that one key holds; a lang with more terms has more keys.
SLOT = 2
#: Different terms of a task's groups that are held before they are sent on.
HELD = 500_000
#: Bytes of a text that are split at once; longer texts are cut between terms.
SLICE = 4 << 20

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def text_terms(text: str) -> Counter:
    """How often each term (lower-cased, as UTF-8) is in a text."""
    raw = text.encode().translate(_LOWER)
    if len(raw) <= SLICE:
        return Counter(_TERM.findall(raw))
    found, at = Counter(), 0
    while at < len(raw):
        gap = _GAP.search(raw, min(at + SLICE, len(raw)))
        end = gap.start() if gap else len(raw)
        found.update(_TERM.findall(raw, at, end))
        at = end
    return found


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and df (documents); sums over a task's rows, several for one term."""
    empty = F.lit("")
    rows = docs.select(*[F.coalesce(docs[c].cast("string"), empty).alias(c) for c in ("lang", "source", "text")])
    names = ["lang", "source", "term", "n", "df"]

    def send(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (df, more) in held.items():
            if df:
                terms = [t.decode("utf-8", "replace") for t in df]
                once = np.fromiter(df.values(), np.int64, len(df))
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(df), pa.string()), pa.array([source] * len(df), pa.string()), pa.array(terms, pa.string()),
                    pa.array(once + np.fromiter((more[t] for t in df), np.int64, len(df))), pa.array(once)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}  # documents with a term, and its occurrences beyond those
        size = 0
        for batch in bounded(batches):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                df, more = held.setdefault((lang, source), (Counter(), Counter()))
                before, found = len(df), text_terms(text)
                df.update(found.keys())
                for term, n in found.items():
                    if n > 1:
                        more[term] += n - 1
                size += len(df) - before
                if size >= HELD or len(held) >= HELD:
                    yield from send(held)
                    held, size = {}, 0
        yield from send(held)

    return rows.mapInArrow(run, "lang string, source string, term string, n long, df long")


def price(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kinds)) in whole numbers: three steps of a long division by thousands."""
    under = total + kinds * 5
    rest, value = count + 5, F.lit(0).cast("long")
    for _ in range(3):
        value = value * 1000 + _div(rest * 1000, under)
        rest = (rest * 1000) % under
    return value + 1


def _div(a: Column, b: Column) -> Column:
    """The whole part of a / b for whole numbers that are not negative."""
    return F.call_function("div", a, b)


def _solve(prices: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Summed price differences over a block's terms, for the groups ``left`` x ``right`` (columns of ``prices``)."""
    terms = np.arange(len(prices))
    levels = [np.unique(prices[:, g], return_inverse=True) for g in range(prices.shape[1])]
    out = np.zeros((len(left), len(right)), np.int64)

    def one_hot(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(levels[g][0]) for g in groups])
        first = np.cumsum(sizes) - sizes
        matrix = np.zeros((len(prices), int(sizes.sum())), np.float32)
        for g, at in zip(groups, first, strict=True):
            matrix[terms, at + levels[g][1]] = 1
        return matrix, first, np.concatenate([levels[g][0] for g in groups])

    def cuts(groups: np.ndarray) -> Iterator[slice]:
        start, held = 0, 0
        for k, g in enumerate(groups):
            if held and held + len(levels[g][0]) > COLUMNS:
                yield slice(start, k)
                start, held = k, 0
            held += len(levels[g][0])
        yield slice(start, len(groups))

    for a in cuts(left):
        ma, fa, pa_ = one_hot(left[a])
        for b in cuts(right):
            mb, fb, pb = one_hot(right[b])
            joint = (ma.T @ mb).astype(np.int64)
            joint *= np.abs(pa_[:, None] - pb[None, :])
            out[a, b] = np.add.reduceat(np.add.reduceat(joint, fa, axis=0), fb, axis=1)
    return out


class _Cell:
    """The pairs of two blocks of sources, summed over the blocks of terms that come one after the other."""

    def __init__(self, key: tuple):
        self.key, self.sources, self.own, self.none, self.place = key, [], [], [], {}
        self.value = None

    def add_group(self, own: int, source: str, none: int) -> None:
        self.place[source] = len(self.sources)
        self.sources.append(source)
        self.own.append(own)
        self.none.append(none)

    def add_block(self, terms: pa.Array, sources: list[str], prices: np.ndarray) -> None:
        own, none = np.array(self.own), np.array(self.none, np.int64)
        if self.value is None:
            self.left, self.right = np.flatnonzero(own == self.key[1]), np.flatnonzero(own == self.key[2])
            self.value, self.seen = np.zeros((len(self.left), len(self.right)), np.int64), 0
        coded = terms.dictionary_encode()
        table = np.tile(none, (len(coded.dictionary), 1))
        table[coded.indices.to_numpy(), [self.place[s] for s in sources]] = prices
        self.value += _solve(table, self.left, self.right)
        self.seen += len(table)

    def rows(self) -> pa.RecordBatch | None:
        if self.value is None:
            return None
        of, to = (x.ravel() for x in np.meshgrid(self.left, self.right, indexing="ij"))
        value, apart = self.value.ravel(), of != to
        of, to, value = of[apart], to[apart], value[apart]
        if self.key[1] != self.key[2]:
            of, to, value = np.concatenate([of, to]), np.concatenate([to, of]), np.tile(value, 2)
        names = pa.array(self.sources, pa.string())
        return pa.RecordBatch.from_arrays([
            pa.array([self.key[0]] * len(of), pa.string()), names.take(pa.array(of)), names.take(pa.array(to)),
            pa.array(value), pa.array(np.full(len(of), self.seen))], ["lang", "source", "item", "value", "seen"])


def _price_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of (lang, i, j, slot, block); block -1 lists a cell's sources."""
    cell, block, held = None, None, ([], [], [])

    def settle() -> None:
        if held[0]:
            cell.add_block(pa.array(held[0], pa.string()), held[1], np.array(held[2], np.int64))
            for h in held:
                h.clear()

    for batch in batches:
        for lang, i, j, slot, at, own, source, term, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = (lang, i, j, slot)
            if cell is None or key != cell.key:
                settle()
                if cell is not None and (rows := cell.rows()) is not None:
                    yield rows
                cell, block = _Cell(key), None
            if at == -1:
                cell.add_group(own, source, p)
                continue
            if at != block:
                settle()
                block = at
            held[0].append(term)
            held[1].append(source)
            held[2].append(p)
    settle()
    if cell is not None and (rows := cell.rows()) is not None:
        yield rows


def source_pairs(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (each other source of the lang) and value, the summed differences of their prices of all kept terms.

    ``priced``: lang, source, term, p, total (occurrences in the lang), first (one row of a term). ``groups``: lang, source, kinds
    (kept terms of the lang), none (the price of a count of 0)."""
    band = F.floor(F.log2(F.col("total").cast("double")) * 4).cast("int")
    banded = priced.withColumn("band", band)
    parts = banded.groupBy("lang", "band").agg(F.ceil(F.sum(F.col("first").cast("long")) / TERMS).alias("parts"))
    blocks = banded.join(parts, ["lang", "band"]).withColumn(
        "block", F.col("band").cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64("term"), "parts"))
    by_name = Window.partitionBy("lang")
    slots = F.greatest(F.ceil(F.col("kinds") / (SLOT * TERMS)), F.lit(1)).cast("int")
    placed = groups.withColumn("slots", slots).withColumn("own", F.floor((F.row_number().over(by_name.orderBy("source")) - 1) / SOURCES).cast("int")).withColumn(
        "others", F.sequence(F.lit(0), F.max("own").over(by_name)))
    cell = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")]
    heads = placed.select("lang", "own", "source", "none", "slots", F.explode("others").alias("other")).select(
        "lang", *cell, F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(-1).cast("long").alias("block"),
        "own", "source", F.lit(None).cast("string").alias("term"), F.col("none").alias("p"))
    body = blocks.join(placed.select("lang", "source", "own", "others", "slots"), ["lang", "source"]).select(
        "lang", "block", "own", "source", "term", "p", "slots", F.explode("others").alias("other")).select(
        "lang", *cell, F.pmod(F.xxhash64("block"), F.col("slots")).cast("int").alias("slot"), "block", "own", "source", "term", "p")
    dealt = heads.unionByName(body).repartition(parallelism(priced.sparkSession), "lang", "i", "j", "slot").sortWithinPartitions(
        "lang", "i", "j", "slot", "block")
    sums = dealt.mapInArrow(_price_cells, "lang string, source string, item string, value long, seen long").groupBy(
        "lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    # Terms that neither source has differ by the prices of 0; a lang whose terms are nowhere has pairs but no sums.
    each = groups.join(groups.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none")), "lang").where(
        "source <> item").join(sums, ["lang", "source", "item"], "left")
    rest = (F.col("kinds") - F.coalesce("seen", F.lit(0))) * F.abs(F.col("none") - F.col("item_none"))
    return each.select("lang", "source", "item", (F.coalesce("value", F.lit(0)) + rest).alias("value"))


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: how far each source lies from the others of its lang, and by which terms.

    A null text, lang or source is ''. A term is kept in a lang if ``least_docs`` rows of it have it; repeated rows count each.
    Its price in a group is 1 + floor(10^9 (n + 5) / (N + 5 V)), with n its occurrences there, N those of all V kept terms.
    Part ``pair``: every other source of the lang with the summed differences of prices. Part ``term``: the ``top`` terms that
    the source has and prices above the lang, by the difference. Ranks go by value descending, then item in UTF-8 order. A
    group without terms has pairs; a lang with one source has none. Other columns are not read. An empty table gives no rows."""
    counts = term_counts(docs).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    one = Window.partitionBy("lang", "term")
    kept = written(counts.withColumn("all_df", F.sum("df").over(one)).withColumn("total", F.sum("n").over(one)).withColumn(
        "first", F.row_number().over(one.orderBy("source")) == 1).where(F.col("all_df") >= least_docs).drop("df", "all_df"), "terms")
    langs = kept.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("kinds"), F.sum("n").alias("lang_sum"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("sum"))
    empty = F.lit("")
    found = docs.select(*[F.coalesce(docs[c].cast("string"), empty).alias(c) for c in ("lang", "source")]).distinct()
    zero = F.lit(0).cast("long")
    sized = found.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").select(
        "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("kinds", "lang_sum", "sum")])
    groups = written(sized.withColumn("none", F.when(F.col("kinds") > 0, price(zero, F.col("sum"), F.col("kinds"))).otherwise(zero)), "groups")
    priced = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "total", "first", price(F.col("n"), F.col("sum"), F.col("kinds")).alias("p"),
        price(F.col("total"), F.col("lang_sum"), F.col("kinds")).alias("q"))
    terms = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    pairs = source_pairs(priced, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (pairs, terms)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))
