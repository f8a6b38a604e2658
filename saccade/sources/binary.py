"""Mask archives and frame images; the only places where bytes are decoded in Python."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

ARCHIVE_MASKS = "participant_id string, frame int, label_ord int, label string, h int, w int, counts array<int>"


def _run_lengths(mask: np.ndarray) -> list[int]:
    flat = np.asarray(mask, dtype=bool).ravel(order="F")
    edges = np.flatnonzero(np.diff(flat)) + 1
    lengths = np.diff(np.concatenate([[0], edges, [flat.size]])).tolist()
    return [0, *lengths] if flat.size and flat[0] else lengths


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["participant_id", "frame", "label_ord", "label", "h", "w", "counts"]
    for batch in batches:
        rows = []
        for who, frame, content in zip(batch["participant_id"], batch["frame"], batch["content"]):
            with np.load(io.BytesIO(content)) as archive:
                for place, label in enumerate(archive.files):
                    mask = archive[label]
                    mask = mask.reshape(mask.shape[-2:])
                    rows.append((who, frame, place, label, *mask.shape, _run_lengths(mask)))
        yield pd.DataFrame(rows, columns=columns)


def archive_masks(archives: DataFrame) -> DataFrame:
    """Mask rows from archives (participant_id, frame, content); labels keep their order in the archive."""
    return archives.select("participant_id", "frame", "content").mapInPandas(_decode, ARCHIVE_MASKS)


def read_mask_archives(spark: SparkSession, path: str, participants: Sequence[str] | None = None,
                       frames: tuple[int, int] | None = None) -> DataFrame:
    """Archives stored as <participant>/<name>_<frame>.npz, read in executors in groups of files of about a split's size.

    Folders of other than the given ``participants`` are not listed; archives of frames outside ``frames`` (first, last) are
    not decoded."""
    folders = path if participants is None else [f"{path.rstrip('/')}/{p}" for p in participants]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option(
        "recursiveFileLookup", True).load(folders)
    name = F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)
    frame = F.regexp_extract("path", r"_([0-9]+)\.[^/]*$", 1).cast("int")
    found = files.select(name.alias("participant_id"), frame.alias("frame"), "content")
    return archive_masks(found if frames is None else found.filter(F.col("frame").between(*frames)))


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes each row's ``content`` under ``folder`` as its ``name`` (which may have folders); returns the names written.

    ``folder`` must be seen by all executors. A file appears under its name when it is whole, so a task that is run again
    leaves one of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        made = set()
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                target = f"{base}/{name}"
                parent = target.rsplit("/", 1)[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                part = f"{parent}/.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, target)
            yield batch.select(["name"])

    names = files.select("name", "content").mapInArrow(run, "name string")
    path = f"{folder.rstrip('/')}-names"
    names.write.parquet(path)
    return files.sparkSession.read.parquet(path)


def write_mask_archives(masks: DataFrame, folder: str) -> DataFrame:
    """One archive per frame as <participant>/mask_<frame>.npz; returns the names written."""
    packed = mask_archives(masks)
    return write_files(packed.select(F.format_string("%s/mask_%d.npz", "participant_id", "frame").alias("name"), "content"), folder)


def _pack(key, group: pd.DataFrame) -> pd.DataFrame:
    arrays = {}
    for row in group.sort_values("label_ord").itertuples():
        flat = np.repeat(np.arange(len(row.counts)) % 2 == 1, row.counts)
        arrays[row.label] = flat.reshape(row.w, row.h).T
    buffer = io.BytesIO()
    np.savez_compressed(buffer, **arrays)
    return pd.DataFrame({"participant_id": [key[0]], "frame": [key[1]], "content": [buffer.getvalue()]})


def mask_archives(masks: DataFrame) -> DataFrame:
    """One archive per frame, holding that frame's labelled masks."""
    return masks.select("participant_id", "frame", "label_ord", "label", "h", "w", "counts").groupBy(
        "participant_id", "frame").applyInPandas(_pack, "participant_id string, frame int, content binary")


@F.pandas_udf(T.DoubleType())
def _mean_gray(data: pd.Series, channels: pd.Series) -> pd.Series:
    def mean(content: bytes, n: int) -> float | None:
        if not content or n < 1:
            return None
        values = np.frombuffer(content, dtype=np.uint8).reshape(-1, n).astype(np.int64)
        if n == 1:
            return float(values.mean())
        blue, green, red = values[:, 0], values[:, 1], values[:, 2]
        return float(((red * 299 + green * 587 + blue * 114 + 500) // 1000).mean())

    return pd.Series([mean(c, n) for c, n in zip(data, channels)], dtype=float)


def frame_brightness(data: Column, channels: Column) -> Column:
    """Mean gray of raw image bytes (1 channel, or blue, green, red and further ones)."""
    return _mean_gray(data, channels)


def read_frame_brightness(spark: SparkSession, path: str) -> DataFrame:
    """origin and brightness of each image file; an image that can't be read has a null brightness."""
    image = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)
    return image.select("image.origin", frame_brightness(F.col("image.data"), F.col("image.nChannels")).alias("brightness"))
