"""Helpers the text operators share: input columns, bounded byte batches, label folds and samples."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task works on at once. A longer text is a batch of its own.
BATCH_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads; a null text counts as empty."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores behind each until ``docs`` has no such column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offset in them, without a copy."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, width, len(column) + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def bounded(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of ``column``, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = utf8(batch.column(column))
        row = 0
        while row < batch.num_rows:
            upto = int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1
            upto = min(max(upto, row + 1), batch.num_rows)
            yield batch.slice(row, upto - row)
            row = upto


#: Characters of a text that may be in a sample; longer ones are not drawn (but scored like any other).
LONGEST_SAMPLED = 1_000_000

Sample = list[tuple[str, int]]


def fit_on_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_label: int, characters: int,
                  fit: Callable[[Sample], object]) -> object:
    """``fit`` of the sample of :func:`label_sample`, run in one task; only the model comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "label")), strict=True)]
        rows.sort(key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([(text, y) for _, text, y in rows]))], pa.binary())], ["model"])

    drawn = label_sample(docs, labels, label, learn, per_label, characters)
    found = drawn.repartition(1).mapInArrow(run, "model binary").first()
    return fit([]) if found is None else pickle.loads(found["model"])


def label_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_label: int, characters: int) -> DataFrame:
    """doc_id, text and label of about ``per_label`` rows of each label, and ``characters`` in all, of the rows to learn from, drawn
    by a hash of the id.

    This is the bounded sample a classifier is fitted on: its expected size does not grow with the input, and no text of it is
    longer than ``LONGEST_SAMPLED``. Of several labels of one document the larger holds. Only ids and sizes are joined with the
    labels; the drawn ids, as few as the sample, are then broadcast to fetch their texts."""
    known = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    texts = id_and_text(docs).where(learn).where(F.length("text") <= LONGEST_SAMPLED)
    rows = texts.select("doc_id", F.length("text").alias("size")).join(known, "doc_id")
    counts = {r["label"]: (r["n"], r["size"]) for r in
              rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
    share = {k: min(1.0, per_label / n, characters / max(1, len(counts) * (size or 0))) for k, (n, size) in counts.items()}
    draw = (F.xxhash64(F.col("doc_id"), F.lit("sample")).bitwiseAND(F.lit((1 << 32) - 1)) / float(1 << 32))
    rate = F.lit(0.0)
    for value, part in share.items():
        rate = F.when(F.col("label") == value, F.lit(part)).otherwise(rate)
    drawn = rows.where(draw < rate).select("doc_id", "label").distinct()
    return texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "label")


def joined(sample: list[tuple[str, int]], limit: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The bytes, ends and labels of the sample's texts, about ``limit`` bytes or one text at a time."""
    raw: list[bytes] = []
    labels: list[int] = []
    for k, (text, label) in enumerate(sample):
        raw.append(text.encode())
        labels.append(label)
        if sum(map(len, raw)) >= limit or k == len(sample) - 1:
            yield np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), np.array(labels)
            raw, labels = [], []


def platt(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope (at least slightly positive) and offset of the logistic curve that fits 0/1 ``y`` over ``x``."""
    if len(x) == 0 or y.min() == y.max():
        return 1.0, 0.0
    centre, scale = float(x.mean()), float(x.std()) or 1.0
    z, a, b = (x - centre) / scale, 1.0, 0.0
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -35, 35)))
        w, g = np.maximum(p * (1 - p), 1e-9), p - target
        h = np.array([[np.sum(w * z * z) + 1e-3, np.sum(w * z)], [np.sum(w * z), np.sum(w) + 1e-6]])
        step = np.linalg.solve(h, np.array([np.sum(g * z) + 1e-3 * a, np.sum(g)]))
        size = np.abs(step).max()
        a, b = a - step[0] * min(1, 2 / max(size, 1e-9)), b - step[1] * min(1, 2 / max(size, 1e-9))
        if size < 1e-6:
            break
    a = max(a, 1e-3) / scale
    return float(a), float(b - a * centre)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later reads neither replay its plan nor need the executors that made it."""
    from saccade.session import scratch_path

    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
