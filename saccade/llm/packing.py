"""Best-fit packing of token pieces into sequences, with a bounded number of open bins.

Texts become ids where they lie and are cut into pieces; only the pieces' figures (or also their ids) are shuffled. Every
partition packs its own pieces, longest first, so sequences never wait for other tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saccade.llm.common import bounded, id_and_text
from saccade.llm.words import library_coder

CAPACITY = 2048
#: Bins that a partition keeps open.
OPEN_BINS = 4096


class OpenBins:
    """A fixed number of open bins, found by their free space in a bitset."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit, self.open, self.made = capacity, limit, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.free = 0

    def put(self, length: int) -> tuple[int, int]:
        """The bin with the least free space that fits, or a new one: its number and the place in it."""
        fitting = self.free >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            free, number = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.free &= ~(1 << free)
        self.open -= 1
        return number


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a shorter first one."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    starts = [0] * bool(first) + list(range(first, length, capacity))
    return [(a, b - a) for a, b in zip(starts, starts[1:] + [length], strict=True)]


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (unsigned 32-bit, little endian).

    A null or empty text is one piece of ``end_id`` alone. Repeated rows are documents of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_coder(tokenizer)
        for batch in bounded(batches):
            ids, upto = coder.encode(batch.column("text").to_pylist())
            found, of = [], []
            for row in range(batch.num_rows):
                own = np.append(ids[upto[row]:upto[row + 1]], end_id).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(own), capacity)):
                    raw = own[start:start + length].tobytes()
                    found.append((piece, start, length, zlib.crc32(raw), raw if keep_ids else None))
                    of.append(row)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(of)), *columns], names).select(
                names if keep_ids else names[:-1])
    rows = id_and_text(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """``pieces`` with sequence_id and offset. Pieces are dealt out evenly by hash and packed longest first.

    A full piece is a sequence of its own. Order within equal lengths follows the other columns, so a task that is run
    again packs alike."""
    keys = ["doc_id", "piece", "ids_crc32"]
    # No number of partitions: adaptive execution joins small ones, so that few bins are left half empty.
    dealt = pieces.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(F.desc("length"), *keys)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, base = OpenBins(capacity, open_bins), TaskContext.get().partitionId() << 40
        for pdf in pdfs:
            placed = [bins.put(n) for n in pdf["length"].tolist()]
            yield pdf.assign(sequence_id=[base + k for k, _ in placed], offset=[at for _, at in placed])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return dealt.mapInPandas(run, fields + ", sequence_id long, offset long")


def assemble(placed: DataFrame) -> DataFrame:
    """The ids of every sequence in order (pieces need their ids): sequence_id, n_ids, ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), parts.alias("p")).select(
        "sequence_id", "n_ids", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places. An empty table gives no rows."""
    return best_fit(token_pieces(docs, tokenizer, capacity), capacity)
