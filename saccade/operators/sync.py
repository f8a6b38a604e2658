"""Recordings aligned by the moment the room lights come back on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from saccade.functions.numeric import round_half_even
from saccade.functions.timecode import seconds_to_frame, shift_to_target

# Defaults of the light search.
DARK_BELOW = 50.0
SEARCH_FROM_SECONDS = 2.0

# Notes of the result table.
NOTE_UNREADABLE = "Cannot open video: "
NOTE_NO_REFERENCE = "Lights-on not detected in reference video"
NOTE_NO_TARGET = "Lights-on not detected in target video"


def gray_level(red: Column, green: Column, blue: Column) -> Column:
    """Luma of a pixel, 0.299 R + 0.587 G + 0.114 B rounded to a whole level."""
    return F.floor((red * 299 + green * 587 + blue * 114 + 500) / F.lit(1000)).cast("int")


def pixel_brightness(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Mean gray of each frame from pixel rows with columns red, green, blue."""
    level = gray_level(F.col("red"), F.col("green"), F.col("blue"))
    return pixels.groupBy(*keys).agg((F.sum(level) / F.count(F.lit(1))).alias("brightness"))


def is_dark(brightness: Column, threshold: float = DARK_BELOW) -> Column:
    return brightness < threshold


def scan_window(fps: float | Column, start_sec: float = 0.0, end_sec: float | None = None) -> Column:
    """Frames inside the search window; the end is compared with the position after the frame."""
    def position(seconds: float) -> Column:
        return F.floor(F.lit(seconds) * fps) if isinstance(fps, Column) else F.lit(int(seconds * fps))

    window = F.col("frame") >= position(start_sec)
    if end_sec is not None:
        window = window & (F.col("frame") + 1 <= position(end_sec))
    return window


def lights_on(brightness: DataFrame, fps: float | Column, start_sec: float = 0.0, end_sec: float | None = None,
              threshold: float = DARK_BELOW) -> DataFrame:
    """First bright frame after the first dark one: recording_id, lights_on_frame, lights_on_sec.

    Two combining aggregates, so only one row per recording and map task is shuffled. The frame number
    counts from 1, as the position after reading the frame. Recordings without the event are left out.
    ``fps`` may be a column of ``brightness`` where recordings have their own rates.
    """
    seen = brightness.filter(scan_window(fps, start_sec, end_sec)).select(
        "recording_id", "frame", "ts_sec", is_dark(F.col("brightness"), threshold).alias("dark"))
    first_dark = seen.filter("dark").groupBy("recording_id").agg(F.min("frame").alias("first_dark"))
    return (
        seen.filter(~F.col("dark")).join(first_dark, "recording_id").filter(F.col("frame") > F.col("first_dark"))
        .groupBy("recording_id").agg(F.min(F.struct("frame", "ts_sec")).alias("first"))
        .select("recording_id", (F.col("first.frame") + 1).alias("lights_on_frame"), F.col("first.ts_sec").alias("lights_on_sec"))
    )


def sync_offsets(pairs: DataFrame, anchors: DataFrame, readable: DataFrame | None = None) -> DataFrame:
    """Offset from reference to target time of each pair, with a note where there is none.

    ``readable`` lists the recordings that could be opened; without it all are taken as readable.
    """
    seconds = anchors.select("recording_id", "lights_on_sec")
    if readable is not None:
        opened = readable.select("recording_id").distinct().withColumn("opened", F.lit(True))
        seconds = opened.join(seconds, "recording_id", "left")
    else:
        seconds = seconds.withColumn("opened", F.lit(True))

    def side(name: str) -> DataFrame:
        return seconds.select(F.col("recording_id").alias(f"{name}_video"), F.col("lights_on_sec").alias(f"{name}_sec"),
                              F.col("opened").alias(f"{name}_opened"))

    both = pairs.join(side("reference"), "reference_video", "left").join(side("target"), "target_video", "left")

    def unreadable(name: str) -> Column:
        return F.lit(False) if readable is None else F.col(f"{name}_opened").isNull()

    notes = (
        F.when(unreadable("reference"), F.concat(F.lit(NOTE_UNREADABLE), "reference_video"))
        .when(F.col("reference_sec").isNull(), NOTE_NO_REFERENCE)
        .when(unreadable("target"), F.concat(F.lit(NOTE_UNREADABLE), "target_video"))
        .when(F.col("target_sec").isNull(), NOTE_NO_TARGET)
        .otherwise("")
    )
    found = F.col("reference_sec").isNotNull()
    return both.select(
        "participant_id",
        round_half_even(F.col("reference_sec"), 4).alias("reference_lights_on_sec"),
        F.when(found, round_half_even(F.col("target_sec"), 4)).alias("target_lights_on_sec"),
        F.when(found, round_half_even(F.col("target_sec") - F.col("reference_sec"), 4)).alias("offset_sec"),
        notes.alias("notes"))


def align_events(events: DataFrame, anchors: DataFrame, fps: float) -> DataFrame:
    """Adds target_sec and target_frame to events with participant_id and t_sec."""
    return events.join(anchors, "participant_id").select(
        *events.columns,
        shift_to_target(F.col("t_sec"), F.col("source_sec"), F.col("anchor_sec")).alias("target_sec"),
        seconds_to_frame(shift_to_target(F.col("t_sec"), F.col("source_sec"), F.col("anchor_sec")), fps).alias("target_frame"))
