"""Time strings, anchors and frame numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _parts(text: Column) -> Column:
    return F.transform(F.split(F.trim(text), ":"), lambda part: F.trim(part).try_cast("int"))


def hms_to_seconds(text: Column) -> Column:
    """``HH:MM:SS`` or ``MM:SS``; null where a part is not a number."""
    part = _parts(text)
    short = part[0] * 60 + part[1]
    long = part[0] * 3600 + part[1] * 60 + F.try_element_at(part, F.lit(3))
    return F.when(F.size(part) == 2, short).when(F.size(part) > 2, long).cast("double")


def msm_to_seconds(text: Column) -> Column:
    """``MM:SS`` or ``MM:SS:mmm``; null where a part is not a number."""
    part = _parts(text)
    whole = (part[0] * 60 + part[1]).cast("double")
    milli = F.try_element_at(part, F.lit(3)) / F.lit(1000.0)
    return F.when(F.size(part) == 2, whole).when(F.size(part) > 2, whole + milli)


def seconds_to_frame(seconds: Column, fps: Column | float) -> Column:
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    return (seconds * rate).cast("long")


def shift_to_target(seconds: Column, source_anchor: Column, target_anchor: Column) -> Column:
    return seconds + (target_anchor - source_anchor)


def shift_all(seconds: Column, source_anchor: Column, target_anchor: Column) -> Column:
    """Array form of :func:`shift_to_target`."""
    return F.transform(seconds, lambda t: shift_to_target(t, source_anchor, target_anchor))


def all_to_frames(seconds: Column, fps: float) -> Column:
    """Array form of :func:`seconds_to_frame`."""
    return F.transform(seconds, lambda t: seconds_to_frame(t, fps))
