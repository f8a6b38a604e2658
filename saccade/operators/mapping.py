"""Gaze samples onto frames and masks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from saccade.functions import geometry as G
from saccade.operators.masks import column_segments
from saccade.operators.ordered import frame_chunk, ranked

NO_LABEL = "none"
BAND_COLUMNS = 16


def frame_range(sessions: DataFrame) -> DataFrame:
    """One row per processed frame of each session, from start_frame up to but without end_frame.

    The size of a session's images is carried along where ``sessions`` has it (width, height)."""
    sizes = [c for c in ("width", "height") if c in sessions.columns]
    frames = sessions.filter(F.col("end_frame") > F.col("start_frame")).select(
        "participant_id", "start_frame", *sizes,
        F.explode(F.sequence(F.col("start_frame"), F.col("end_frame") - 1)).alias("frame"))
    return frames.select("participant_id", "frame", (F.col("frame") - F.col("start_frame") + 1).alias("framenum"), *sizes)


def first_sample_per_frame(gaze: DataFrame) -> DataFrame:
    return gaze.groupBy("participant_id", F.col("world_index").alias("frame")).agg(
        F.min_by(F.struct("norm_x", "norm_y"), "sample_seq").alias("sample")
    ).select("participant_id", "frame", "sample.norm_x", "sample.norm_y")


def first_gaze_per_frame(frames: DataFrame, gaze: DataFrame) -> DataFrame:
    """All frames, with the first gaze sample of each where there is one."""
    return frames.join(first_sample_per_frame(gaze), ["participant_id", "frame"], "left")


def gaze_pixels(samples: DataFrame, width: Column | int, height: Column | int) -> DataFrame:
    """Adds pixel positions px, py and the flag is_valid."""
    placed = samples.select(
        "*", G.gaze_pixel_x(F.col("norm_x"), width).alias("px"), G.gaze_pixel_y(F.col("norm_y"), height).alias("py"))
    return placed.select("*", G.gaze_is_valid(
        F.col("norm_x"), F.col("norm_y"), F.col("px"), F.col("py"), width, height).alias("is_valid"))


def hit_test(points: DataFrame, masks: DataFrame, keys: Sequence[str] = ("participant_id", "frame"),
             radius: int = 0, none_label: str = NO_LABEL, out: str = "code") -> DataFrame:
    """Adds the first label, in label order, with a pixel within ``radius`` of the point.

    Masks are indexed by key and column band, a band also holding the ``radius`` columns on either side, so
    each point meets exactly one index row: one shuffle of the points, no row is multiplied, and the test
    runs as an expression. An index row is bounded by the height of the image and its labels.
    """
    return hit_index(points, mask_index(masks, keys, radius), keys, radius, none_label, out)


def _band_width(radius: int) -> int:
    if radius < 0:
        raise ValueError("radius must not be negative")
    return max(BAND_COLUMNS, 2 * radius + 1)


def mask_index(masks: DataFrame, keys: Sequence[str] = ("participant_id", "frame"), radius: int = 0) -> DataFrame:
    """The pieces of all masks of a key by column band: keys, _band, _segments; for searches within ``radius``."""
    keys, band = list(keys), _band_width(radius)
    return (
        column_segments(masks, [*keys, "label_ord", "label"])
        .select(*keys, F.struct("label_ord", "label", "x", "y0", "y1").alias("segment"),
                F.explode_outer(F.sequence(F.floor((F.col("x") - radius) / band),
                                     F.floor((F.col("x") + radius) / band))).alias("_band"))
        .groupBy(*keys, "_band").agg(F.sort_array(F.collect_list("segment")).alias("_segments"))
    )


def write_mask_index(masks: DataFrame, path: str, keys: Sequence[str] = ("participant_id", "frame"), radius: int = 0,
                     buckets: int = 64) -> DataFrame:
    """``mask_index`` kept under ``path`` as a table bucketed by key and band, so that searches shuffle only their points.

    Distinct masks are decoded once, when the index is written; any number of recordings may then look at them."""
    spark, name = masks.sparkSession, f"mask_index_{uuid.uuid4().hex}"
    index = mask_index(masks, keys, radius)
    index.write.option("path", path).bucketBy(buckets, *keys, "_band").sortBy(*keys, "_band").format("parquet").saveAsTable(name)
    return spark.table(name)


def hit_index(points: DataFrame, index: DataFrame, keys: Sequence[str] = ("participant_id", "frame"),
              radius: int = 0, none_label: str = NO_LABEL, out: str = "code") -> DataFrame:
    """``hit_test`` against an index made for the same ``radius``."""
    keys, band = list(keys), _band_width(radius)

    def touches(segment: Column) -> Column:
        dx = segment["x"] - F.col("px")
        dy = F.greatest(segment["y0"] - F.col("py"), F.col("py") - segment["y1"], F.lit(0))
        return dx * dx + dy * dy <= radius * radius

    hit = F.get(F.filter("_segments", touches), F.lit(0))["label"]
    return (
        points.withColumn("_band", F.when(F.col("is_valid"), F.floor(F.col("px") / band)))
        .join(index, [*keys, "_band"], "left")
        .withColumn(out, F.coalesce(hit, F.lit(none_label)))
        .drop("_band", "_segments")
    )


def mask_positions(masks: DataFrame) -> DataFrame:
    """0-based position of each mask frame of a participant, from masks or their index."""
    frames = masks.select("participant_id", "frame").distinct()
    placed = ranked(frames, ["participant_id"], ["frame"], frame_chunk(F.col("frame")), "place")
    return placed.select("participant_id", "frame", (F.col("place") - 1).alias("position"))


def attach_masks(frames: DataFrame, masks: DataFrame, align: str = "frame", owner: str = "participant_id") -> DataFrame:
    """Adds mask_frame, the frame number under which a frame's masks are stored.

    ``frame`` takes equal numbers, ``position`` the n-th mask set for the n-th frame of the participant. ``owner`` names the
    column of ``frames`` that tells whose masks they are.
    """
    if align == "frame":
        known = masks.select(F.col("participant_id").alias(owner), "frame", F.col("frame").alias("mask_frame")).distinct()
        return frames.join(known, [owner, "frame"], "left")
    if align != "position":
        raise ValueError("align must be 'frame' or 'position'")
    placed = ranked(frames, ["participant_id"], ["frame"], frame_chunk(F.col("frame")), "place")
    known = mask_positions(masks).select(F.col("participant_id").alias(owner), F.col("frame").alias("mask_frame"),
                                         (F.col("position") + 1).alias("place"))
    return placed.join(known, [owner, "place"], "left").drop("place")


def map_gaze(sessions: DataFrame, gaze: DataFrame, masks: DataFrame | None, width: int | Column | None = None,
             height: int | Column | None = None, radius: int = 0, align: str = "frame", index: DataFrame | None = None,
             mask_owner: Column | None = None, mask_frame: Column | None = None) -> DataFrame:
    """One label per processed frame: participant_id, frame, framenum, code.

    Without ``width`` and ``height`` the sizes are columns of ``sessions``, so each recording has its own. ``index`` is a kept
    index of the masks for the same radius (``write_mask_index``) and takes the place of ``masks``. Where recordings share
    masks, ``mask_owner`` tells whose masks a frame looks at and, aligned by frame, ``mask_frame`` which; both are
    expressions over participant_id and frame.
    """
    seen = gaze_pixels(first_gaze_per_frame(frame_range(sessions), gaze),
                       F.col("width") if width is None else width, F.col("height") if height is None else height)
    known = mask_index(masks, radius=radius) if index is None else index
    owned = seen.withColumn("_owner", F.col("participant_id") if mask_owner is None else mask_owner)
    if align == "frame":
        placed = owned.withColumn("mask_frame", F.col("frame") if mask_frame is None else mask_frame)
    else:
        placed = attach_masks(owned, masks if masks is not None else known, align, "_owner")
    named = known.select(F.col("participant_id").alias("_owner"), F.col("frame").alias("mask_frame"), "_band", "_segments")
    return hit_index(placed, named, ["_owner", "mask_frame"], radius).select("participant_id", "frame", "framenum", "code")
