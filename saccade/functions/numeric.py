"""Column functions for counts, rates and times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def check_fps(fps: float | Column) -> float | Column:
    """The rate as a number, or the column of rates as it is."""
    if isinstance(fps, Column):
        return fps
    if fps <= 0:
        raise ValueError("fps must be > 0")
    return float(fps)


def safe_div(numerator: Column, denominator: Column) -> Column:
    """Ratio that is 0.0 where the denominator is zero or missing."""
    return F.when(denominator != 0, numerator / F.nullif(denominator, F.lit(0))).otherwise(F.lit(0.0))


def frames_to_ms(frames: Column, fps: float | Column) -> Column:
    return frames * (F.lit(1000.0) / fps if isinstance(fps, Column) else F.lit(1000.0 / check_fps(fps)))


def round_half_even(value: Column, digits: int = 2) -> Column:
    """Round the exact binary value of a double; exact ties go to the even digit.

    Spark's ``round`` works on the shortest decimal text of the double, so 0.145 (stored a little below)
    becomes 0.15 there. The comparison with the midpoint is done on two exact halves of the value instead.
    """
    scale = 10 ** digits
    low = F.floor(value * F.lit(float(scale)))
    head = F.floor(value * F.lit(1024.0)) / F.lit(1024.0)
    tail = value - head
    gap = (head * F.lit(2.0 * scale) - (low * 2 + 1)) + tail * F.lit(2.0 * scale)
    up = F.when(gap > 0, 1).when(gap < 0, 0).otherwise(F.pmod(low, F.lit(2)))
    return (low + up) / F.lit(float(scale))


def frames_to_seconds(frames: Column, fps: float | Column, digits: int = 2) -> Column:
    return round_half_even(frames / F.lit(check_fps(fps)), digits)


def zero_padded_id(number: Column, width: int = 3) -> Column:
    """Pads short ids and leaves longer ones whole."""
    return F.format_string(f"%0{width}d", number)


def fill_template(template: str, participant_id: Column) -> Column:
    return F.replace(F.lit(template), F.lit("{id}"), participant_id)


def label_list(text: Column) -> Column:
    """Comma-separated labels as an array, trimmed and without empty entries."""
    parts = F.transform(F.split(text, ","), lambda part: F.regexp_replace(part, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda part: part != "")


def click_sign(mode: Column) -> Column:
    return F.when(mode == "Positive", 1).otherwise(0)
