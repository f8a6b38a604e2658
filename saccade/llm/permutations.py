"""Nearest neighbours by a permutation index.

Every vector is represented by the order of its ``PREFIX`` nearest pivots. A block of vectors posts its members in one inverted
file per pivot, with the pivot's place in their order. A query walks the files of its own nearest pivots and adds up the footrule
distance (the differences of places; a pivot that one of both lacks counts as behind all); the share ``RERANK`` of the block that
is nearest by it is ranked again by the inner product. Blocks are dealt by a hash, so any number of vectors near one pivot spreads
over all of them, and each returns a short list per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from saccade.llm.common import parallelism, written

#: Results per query, and which ids are queries.
NEAREST, EVERY = 20, 20
#: Pivots at most (the bounded sample the index is fitted on: rows drawn by a hash), and rows for each pivot at least.
PIVOTS, PER_PIVOT = 512, 4
#: Nearest pivots that represent a vector.
PREFIX = 20
#: Share of a block that is ranked by the inner product, and rows of it at least.
RERANK, LEAST_RERANK = 0.4, 512
#: Vectors of a block at most on average, and at least before there are more blocks than one.
BLOCK, SMALL_BLOCK = 1 << 17, 1 << 10
#: Queries that are compared with a block at once.
TOGETHER = 256


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and ``body``, the components as little-endian doubles, of every vector that takes part."""
    values = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), values.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # -0 is 0
            bad, some = ~np.isfinite(flat), flat != 0
            count = lambda x: np.concatenate([[0], np.cumsum(x)])[ends]
            use = np.flatnonzero((np.diff(count(bad)) == 0) & (np.diff(count(some)) > 0))
            raw = memoryview(flat.tobytes())
            bodies = [raw[8 * a:8 * b] for a, b in zip(ends[use].tolist(), ends[use + 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(use)), pa.array([bytes(b) for b in bodies], pa.binary())], ["id", "body"])

    found = rows.mapInArrow(run, "id long, body binary")
    return found


def matrix(bodies: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(bodies.to_pylist()), "<f8").reshape(len(bodies), width)


class Pivots:
    """Unit vectors of the pivots, with one component more that evens out the norms of what is searched.

    With it the largest inner product is the smallest angle: a vector x becomes (x, sqrt(M^2 - |x|^2)) for the largest norm M, a
    query gets 0."""

    def __init__(self, sample: np.ndarray, norm: float):
        self.norm, self.table = norm, self._even(sample, norm)

    @staticmethod
    def _even(x: np.ndarray, norm: float) -> np.ndarray:
        unit = x / norm
        return np.concatenate([unit, np.sqrt(np.maximum(0, 1 - (unit**2).sum(axis=1)))[:, None]], axis=1)

    def nearest(self, x: np.ndarray, query: bool, count: int) -> np.ndarray:
        """The pivots of each vector, nearest first."""
        if query:
            rows = np.concatenate([x / self.norm, np.zeros((len(x), 1))], axis=1)
        else:
            rows = self._even(x, self.norm)
        likeness = rows @ self.table.T
        count = min(count, likeness.shape[1])
        some = np.argpartition(-likeness, count - 1, axis=1)[:, :count]
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(likeness, some, 1), axis=1, kind="stable"), 1)


class InvertedFiles:
    """The postings of a block: for each pivot the vectors that have it among their nearest, and at which place."""

    def __init__(self, orders: np.ndarray, pivots: int):
        self.size, self.prefix = orders.shape
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.starts = np.searchsorted(flat[by_pivot], np.arange(pivots + 1))
        self.rows, self.places = by_pivot // self.prefix, by_pivot % self.prefix
        places = np.arange(self.prefix)
        # Footrule distance is a constant less twice what common pivots are before the end.
        self.gain = (self.prefix - np.maximum(places[:, None], places[None, :])).astype(np.float32)

    def nearest(self, order: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` rows with the smallest footrule distance to ``order``."""
        rows = [self.rows[self.starts[p]:self.starts[p + 1]] for p in order]
        gains = [self.gain[k][self.places[self.starts[p]:self.starts[p + 1]]] for k, p in enumerate(order)]
        total = np.bincount(np.concatenate(rows), np.concatenate(gains), minlength=self.size)
        if count >= self.size:
            return np.arange(self.size)
        return np.argpartition(-total, count - 1)[:count]


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of ``a`` with ``b``: the same sum, in the same order, however many rows there are."""
    return (a * b).sum(axis=1)


def _search(batches: Iterator[pa.RecordBatch], pivots: Pivots, width: int, wanted: int, rerank: float) -> Iterator[pa.RecordBatch]:
    """Rows of one block after the other, its vectors first: (block, query, class, body)."""
    names = ["query", "found", "score"]
    block, keys, bodies, held = None, [], [], None

    def close() -> tuple:
        data = matrix(pa.chunked_array(bodies), width)
        files = InvertedFiles(pivots.nearest(data, False, PREFIX), len(pivots.table))
        return data, files, np.concatenate(keys)

    for batch in batches:
        blocks, is_query = batch.column("block").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
        change = np.flatnonzero((blocks[1:] != blocks[:-1]) | (is_query[1:] != is_query[:-1])) + 1
        for a, b in zip(np.concatenate([[0], change]), np.append(change, len(blocks)), strict=True):
            if a == b:
                continue
            if blocks[a] != block:
                block, keys, bodies, held = blocks[a], [], [], None
            part, key = batch.column("body").slice(a, b - a), batch.column("key").slice(a, b - a).to_numpy()
            if not is_query[a]:
                bodies.append(part)
                keys.append(key)
                continue
            if not keys:
                continue
            if held is None:
                held = close()
            data, files, known = held
            budget = max(LEAST_RERANK, wanted, int(np.ceil(rerank * len(data))))
            for k in range(0, len(part), TOGETHER):
                x, of, to, scores = matrix(part.slice(k, TOGETHER), width), [], [], []
                products = x @ data.T
                for row, order in enumerate(pivots.nearest(x, True, PREFIX)):
                    near = files.nearest(order, budget)
                    if len(near) > 2 * wanted:
                        value = products[row, near]
                        # Of equal products at the border all go on; the exact sums decide.
                        least = np.partition(value, len(value) - wanted)[len(value) - wanted]
                        near = near[value >= least - 1e-9 * max(1.0, abs(least))]
                    score = inner_products(data[near], x[row])
                    of.append(np.full(len(near), key[k + row]))
                    to.append(known[near])
                    scores.append(score)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (of, to, scores)], names)


def nearest_vectors(table: DataFrame, nearest: int = NEAREST, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding",
                    pivots: int = PIVOTS, rerank: float = RERANK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for every id divisible by ``every``, the ``nearest`` other rows found by inner
    product in double precision, ties to the smaller vec_id.

    Rows without an id, and vectors null, zero or with null or non-finite components, take no part; nor do vectors of another
    length than the most frequent one (of equally frequent ones the shortest). Equal rows count once. Rows of one id with
    different vectors are queries and candidates of their own. Equal vectors are searched once and shared out by id. An empty
    table gives no rows. Other columns are not read."""
    spark = table.sparkSession
    rows = written(vectors(table, id_col, vector_col), "vectors")
    schema = "query_id long, rank int, vec_id long, score double"
    common = rows.groupBy(F.octet_length("body").alias("bytes")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bytes").first()
    if common is None:
        return spark.createDataFrame([], schema)
    width = common["bytes"] // 8
    used = rows.where(F.octet_length("body") == common["bytes"]).select("id", "body", F.unhex(F.sha2("body", 256)).alias("digest")).dropDuplicates(["id", "digest"])
    # A query finds at most ``nearest`` rows of one vector besides its own: the smallest ids, which the windows keep map-side.
    place = Window.partitionBy("digest").orderBy("id")
    few = used.withColumn("place", F.row_number().over(place)).where(F.col("place") <= nearest + 1)
    classes = written(few.where("place = 1").select("id", "body", "digest"), "classes")
    # A class goes by its smallest id; of several classes with one smallest id, by a number behind it.
    names = classes.groupBy("id").agg(F.array_sort(F.collect_list("digest")).alias("of_id"))
    numbered = written(classes.join(names, "id").select(
        "id", "digest", "body", (F.array_position("of_id", F.col("digest")) - 1).alias("number")).withColumn(
        "key", F.xxhash64("id", "number")), "numbered")
    asks = used.where(F.col("id") % every == 0).select("id", "digest")
    asked = asks.select("digest").distinct().join(numbered, "digest").select("key", "body")
    figures = numbered.agg(F.count("*").alias("n")).first()
    total = figures["n"]
    drawn = [np.frombuffer(r["body"], "<f8") for r in numbered.orderBy(F.xxhash64("digest"), "digest").limit(max(1, min(pivots, total // PER_PIVOT))).select("body").collect()]

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((matrix(batch.column("body"), width)**2).sum(axis=1)).max())])], ["norm"])

    norm = numbered.select("body").mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0]
    known = Pivots(np.stack(drawn), norm)
    blocks = max(-(-total // BLOCK), min(parallelism(spark), -(-total // SMALL_BLOCK)))
    dealt = numbered.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("query"), "key", "body").unionByName(
        asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("query"), "key", "body"))
    placed = dealt.repartition(blocks, "block").sortWithinPartitions("block", "query")
    found = written(placed.mapInArrow(lambda b: _search(b, known, width, nearest + 1, rerank), "query long, found long, score double"), "found")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "found_id")
    ids = few.join(numbered.select("digest", "key"), "digest").select(F.col("key").alias("found"), F.col("id").alias("found_id"))
    # Of one class all its smallest ids compete, so classes beyond the first ``nearest`` + 1 cannot win.
    by_class = Window.partitionBy("query").orderBy(F.desc("score"), "least_id")
    short = found.join(numbered.select(F.col("key").alias("found"), F.col("id").alias("least_id")), "found").withColumn(
        "place", F.row_number().over(by_class)).where(F.col("place") <= nearest + 1).select("query", "found", "score")
    lists = short.join(ids, "found").withColumn("place", F.row_number().over(best)).where(F.col("place") <= nearest + 1).groupBy("query").agg(
        F.array_sort(F.collect_list(F.struct("place", "found", "found_id", "score"))).alias("list"))
    own = asks.join(numbered.select("digest", F.col("key").alias("query")), "digest")
    others = F.filter("list", lambda r: ~((r["found"] == F.col("query")) & (r["found_id"] == F.col("id"))))
    return own.join(lists, "query").select("id", F.posexplode(F.slice(others, 1, nearest)).alias("rank", "r")).select(
        F.col("id").alias("query_id"), (F.col("rank") + 1).cast("int").alias("rank"), F.col("r.found_id").alias("vec_id"), F.col("r.score").alias("score"))
