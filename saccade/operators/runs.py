"""Fixation runs: maximal stretches of frames with one label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from saccade.functions.numeric import check_fps, frames_to_ms, frames_to_seconds
from saccade.operators.ordered import FRAMES_PER_CHUNK, frame_chunk

END_MODES = ("inclusive", "half_open", "reference")


def label_runs(codes: DataFrame, chunk_frames: int = FRAMES_PER_CHUNK) -> DataFrame:
    """Collapses one row per frame into runs with inclusive ends.

    In:  participant_id, frame, code (one row per frame).
    Out: participant_id, code, start_frame, end_frame, n_frames, is_last.

    Runs are first found inside frame chunks. Only the first and last run of a chunk can continue in a
    neighbour, so only those are joined across chunks.
    """
    chunk = Window.partitionBy("participant_id", "chunk").orderBy("frame")
    pieces = (
        codes.select("participant_id", "frame", "code", frame_chunk(F.col("frame"), chunk_frames).alias("chunk"))
        .withColumn("starts", F.when(F.col("code").eqNullSafe(F.lag("code").over(chunk))
                                     & (F.row_number().over(chunk) > 1), 0).otherwise(1))
        .withColumn("piece", F.sum("starts").over(chunk.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("participant_id", "chunk", "piece")
        .agg(F.min("code").alias("code"), F.min("frame").alias("start_frame"),
             F.max("frame").alias("end_frame"), F.count(F.lit(1)).alias("n_frames"))
        .withColumn("pieces", F.max("piece").over(Window.partitionBy("participant_id", "chunk")))
        .withColumn("opens", F.col("piece") == 1)
        .withColumn("closes", F.col("piece") == F.col("pieces"))
    )
    columns = ["participant_id", "code", "start_frame", "end_frame", "n_frames"]
    inner = pieces.filter(~F.col("opens") & ~F.col("closes")).select(*columns, F.lit(False).alias("is_last"))

    along = Window.partitionBy("participant_id").orderBy("start_frame")
    joined = (
        pieces.filter(F.col("opens") | F.col("closes"))
        .withColumn("continues", F.col("opens") & F.coalesce(
            F.col("code").eqNullSafe(F.lag("code").over(along)) & (F.row_number().over(along) > 1), F.lit(False)))
        .withColumn("run", F.sum(F.when(F.col("continues"), 0).otherwise(1)).over(
            along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("participant_id", "run")
        .agg(F.min("code").alias("code"), F.min("start_frame").alias("start_frame"),
             F.max("end_frame").alias("end_frame"), F.sum("n_frames").alias("n_frames"))
        .withColumn("is_last", F.col("run") == F.max("run").over(Window.partitionBy("participant_id")))
        .select(*columns, "is_last")
    )
    return inner.unionByName(joined)


def with_rate(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds each participant's own rate from ``rates`` (participant_id, fps, one row each) as ``_fps``."""
    return rows.join(rates.select("participant_id", F.col("fps").cast("double").alias("_fps")), "participant_id", "left")


def collapse_runs(codes: DataFrame, fps: float | None, end_mode: str = "inclusive", include_none: bool = False,
                  none_label: str = "None", chunk_frames: int = FRAMES_PER_CHUNK, rates: DataFrame | None = None) -> DataFrame:
    """Fixation events from one label per frame.

    ``inclusive`` ends at the run's last frame and drops ``none_label`` unless ``include_none`` is set.
    ``half_open`` ends one frame later. ``reference`` is ``half_open`` with the last run of each
    participant moved one frame back, as the run files of the reference have it. The two open forms keep
    every label and carry seconds rounded to two places. ``rates`` (participant_id, fps) takes the place of ``fps`` where
    recordings have rates of their own.
    """
    if rates is not None:
        fps = F.col("_fps")
    check_fps(fps)
    if end_mode not in END_MODES:
        raise ValueError(f"end_mode must be one of {END_MODES}")
    runs = label_runs(codes, chunk_frames)
    if rates is not None:
        runs = with_rate(runs, rates)
    own = ["_fps"] if rates is not None else []
    if end_mode == "inclusive":
        kept = runs if include_none else runs.filter(F.col("code") != none_label)
        return fixation_events(kept.select(
            "participant_id", F.col("code").alias("aoi_name"), F.col("n_frames").cast("int").alias("duration_frames"),
            "start_frame", "end_frame", *own), fps)
    shift = F.when(F.col("is_last"), 1).otherwise(0) if end_mode == "reference" else F.lit(0)
    return run_seconds(runs.select(
        "participant_id", F.col("code").alias("name"), F.col("n_frames").cast("int").alias("frame_duration"),
        (F.col("start_frame") - shift).cast("int").alias("start_frame"),
        (F.col("end_frame") + 1 - shift).cast("int").alias("end_frame"), *own), fps).drop("_fps")


def file_events(runs: DataFrame, fps: float | None, rates: DataFrame | None = None) -> DataFrame:
    """Fixation events from runs in file form, as a reader of the file has them: ends stay as the file gives them."""
    named = runs.select("participant_id", F.col("name").alias("aoi_name"), F.col("frame_duration").alias("duration_frames"), "start_frame", "end_frame")
    if rates is None:
        return fixation_events(named, fps)
    return fixation_events(with_rate(named, rates), F.col("_fps"))


def run_seconds(runs: DataFrame, fps: float) -> DataFrame:
    """Adds durations and bounds in seconds to runs in file form."""
    return runs.select(
        "*",
        frames_to_seconds(F.col("frame_duration"), fps).alias("duration_s"),
        frames_to_seconds(F.col("start_frame"), fps).alias("start_s"),
        frames_to_seconds(F.col("end_frame"), fps).alias("end_s"),
    )


def fixation_events(runs: DataFrame, fps: float) -> DataFrame:
    """Adds milliseconds to runs given in frames."""
    return runs.select(
        "participant_id", "aoi_name",
        frames_to_ms(F.col("duration_frames"), fps).alias("duration_ms"), "duration_frames",
        frames_to_ms(F.col("start_frame"), fps).alias("timestamp_ms"), "start_frame", "end_frame",
    )


def expand_runs(runs: DataFrame, end: Column | None = None) -> DataFrame:
    """One row per frame again; the inverse of :func:`label_runs`."""
    last = F.col("end_frame") if end is None else end
    return runs.select("participant_id", F.explode(F.sequence(F.col("start_frame"), last)).alias("frame"), "code")


def drop_labels(df: DataFrame, column: str, labels: list[str]) -> DataFrame:
    return df.filter(~F.col(column).isin(labels))
