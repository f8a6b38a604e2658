"""Token streams in Arrow stream files of equal-length sequences.

A part of the corpus (a range of ids) is one file of record batches. A row is a sequence: ``ids``, a fixed-size list of
unsigned 16- or 32-bit ids, and ``mask``, a fixed-size list of bits, set for ids and not for the fill of the last row. As all
rows have one width, any sequence is a slice of the mapped file without a copy. A second file of the part lists its
documents: doc_id, start (ids of the part before it) and n_tokens. A manifest table names the files of finished tasks;
files of lost attempts are in no manifest.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from saccade.llm.common import bounded, id_and_text, parallelism
from saccade.llm.words import library_coder

SEQUENCE = 2048
#: Sequences of a record batch.
ROWS = 512


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


class SequenceWriter:
    """Writes ids as rows of ``width`` and their masks."""

    def __init__(self, sink, width: int, kind: np.dtype):
        self.width, self.kind, self.rest, self.rows = width, kind, np.zeros(0, kind), 0
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), width)), ("mask", pa.list_(pa.bool_(), width))],
                                metadata={"sequence": str(width)})
        self.file = pa.ipc.new_stream(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.rest = np.concatenate([self.rest, ids.astype(self.kind)])
        step = self.width * ROWS
        upto = len(self.rest) // step * step
        for k in range(0, upto, step):
            self._rows(self.rest[k:k + step], step)
        self.rest = self.rest[upto:]

    def _rows(self, ids: np.ndarray, used: int) -> None:
        mask = np.arange(len(ids)) < used
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.width) for x in (ids, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.rows += len(ids) // self.width

    def close(self) -> None:
        if used := len(self.rest):
            self._rows(np.concatenate([self.rest, np.zeros(-used % self.width, self.kind)]), used)
        self.file.close()


def write_streams(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, width: int = SEQUENCE, small_ids: bool = True) -> DataFrame:
    """Writes the ids of all texts, ``end_id`` after each, in ascending order of (doc_id, hash of the text), null ids first.

    Returns the manifest, written as a table in ``folder``: part, ids_file, index_file, n_docs, n_ids. ``folder`` must be
    seen by all executors. ``small_ids`` says that every id is below 65,536. Document ids may be of any type that can be
    ordered. An empty table gives an empty manifest."""
    rows = id_and_text(docs).withColumn("order", F.xxhash64("text"))
    n = parallelism(docs.sparkSession)
    dealt = rows.repartitionByRange(n, F.asc_nulls_first("doc_id"), "order").sortWithinPartitions(
        F.asc_nulls_first("doc_id"), "order", "text").select("doc_id", "text")
    kind = np.dtype(np.uint16 if small_ids else np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        part = TaskContext.get().partitionId()
        names = [f"{base}/{what}-{part:06d}-{uuid.uuid4().hex}.arrows" for what in ("ids", "docs")]
        coder, files, n_docs, total = library_coder(tokenizer), None, 0, 0
        for batch in bounded(batches):
            if files is None:
                index = pa.schema([("doc_id", batch.column("doc_id").type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                sinks = [store.open_output_stream(x) for x in names]
                files = SequenceWriter(sinks[0], width, kind), pa.ipc.new_stream(sinks[1], index)
            ids, upto = coder.encode(batch.column("text").to_pylist())
            with_end = np.insert(ids, upto[1:], end_id)
            size = np.diff(upto) + 1
            starts = total + np.cumsum(size) - size
            files[0].add(with_end)
            files[1].write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(starts), pa.array(size)], schema=index))
            n_docs, total = n_docs + batch.num_rows, total + len(with_end)
        if files is not None:
            for x in (*files, *sinks):
                x.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "ids_file": [names[0]], "index_file": [names[1]],
                                              "n_docs": [n_docs], "n_ids": [total]})

    made = dealt.mapInArrow(run, "part int, ids_file string, index_file string, n_docs long, n_ids long")
    if folder.startswith("/") or folder.startswith("file:"):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
    made.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def read_sequences(folder: str, ids_file: str, first: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, mask) of the batches of a file, as matrices over the file's own bytes; a local file is mapped into memory."""
    store, _ = _store(folder)
    source = pa.memory_map(ids_file) if isinstance(store, fs.LocalFileSystem) else store.open_input_stream(ids_file)
    with source, pa.ipc.open_stream(source) as batches:
        seen = 0
        for batch in batches:
            if seen + batch.num_rows > first:
                ids = batch.column(0).values.to_numpy().reshape(batch.num_rows, -1)
                mask = batch.column(1).values.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield ids[max(0, first - seen):], mask[max(0, first - seen):]
            seen += batch.num_rows


def sequence_at(folder: str, ids_file: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of sequence ``k`` of a file, without reading those before it: all batches but the last have the same
    number of rows of one width, and so the same length in the file. An index that the file does not have is an error."""
    if k < 0:
        raise IndexError(f"no sequence {k} in {ids_file}")
    store, _ = _store(folder)
    with pa.memory_map(ids_file) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(ids_file) as source:
        schema = pa.ipc.read_schema(source)
        begin = source.tell()
        head = pa.ipc.read_message(source)
        source.seek(min(begin + k // ROWS * (source.tell() - begin), source.size()))
        try:
            message = head if k < ROWS else pa.ipc.read_message(source)
        except EOFError:
            message = None
        batch = None if message is None or message.type != "record batch" else pa.ipc.read_record_batch(message, schema)
        if batch is None or k % ROWS >= batch.num_rows:
            raise IndexError(f"no sequence {k} in {ids_file}")
        row = batch.slice(k % ROWS, 1)
        return row.column(0).flatten().to_numpy(), row.column(1).flatten().to_numpy(zero_copy_only=False)


def read_documents(manifest: DataFrame, folder: str, id_type: str = "long") -> DataFrame:
    """Every document as the files have it: doc_id, start (over all parts), n_tokens, ids_crc32 of its unsigned 32-bit ids.

    ``id_type`` is the type of the written document ids. A task reads the files of some parts, batch by batch; a part's first id is a sum over the manifest alone."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.select("part", "ids_file", "index_file", before.alias("base"))
    n = parallelism(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for files in batches:
            for row in files.to_pylist():
                ids = _Reader(read_sequences(folder, row["ids_file"]))
                with store.open_input_stream(row["index_file"]) as source, pa.ipc.open_stream(source) as index:
                    for batch in index:
                        size = batch.column("n_tokens").to_pylist()
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id"), pa.array(batch.column("start").to_numpy() + row["base"]), pa.array(size, pa.int64()),
                             pa.array([ids.crc32(k) for k in size], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return parts.repartition(n, "part").mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long")


class _Reader:
    """Takes the ids that the mask keeps, some at a time."""

    def __init__(self, batches: Iterator[tuple[np.ndarray, np.ndarray]]):
        self.batches, self.held, self.at = batches, np.zeros(0, np.uint32), 0

    def crc32(self, count: int) -> int:
        found = 0
        while count:
            if self.at == len(self.held):
                ids, mask = next(self.batches)
                self.held, self.at = ids[mask].astype("<u4"), 0
            taken = self.held[self.at:self.at + count]
            found = zlib.crc32(taken.tobytes(), found)
            self.at, count = self.at + len(taken), count - len(taken)
        return found
