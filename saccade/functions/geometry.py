"""Points, displays, boxes and crops."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Size of the annotation display in pixels.
DISPLAY_WIDTH = 1280
DISPLAY_HEIGHT = 720

# Labels that mark the two corners of a box prompt.
BOX_CORNER_LABELS = (2, 3)


def gaze_pixel_x(norm_x: Column, width: Column | int) -> Column:
    """Truncates toward zero, so a value within one pixel left of the image lands on column 0."""
    return (norm_x * width).try_cast("int")


def gaze_pixel_y(norm_y: Column, height: Column | int) -> Column:
    """The vertical axis of gaze samples points up."""
    return ((1 - norm_y) * height).try_cast("int")


def gaze_is_valid(norm_x: Column, norm_y: Column, px: Column, py: Column,
                  width: Column | int, height: Column | int) -> Column:
    """Present, a number, and inside the image; never null."""
    present = norm_x.isNotNull() & norm_y.isNotNull() & ~F.isnan(norm_x) & ~F.isnan(norm_y)
    inside = (px >= 0) & (px < width) & (py >= 0) & (py < height)
    return F.coalesce(present & inside, F.lit(False))


def display_size(width: Column, height: Column) -> tuple[Column, Column]:
    """Size of an image fitted into the display with its aspect kept."""
    scale = F.least(F.lit(float(DISPLAY_WIDTH)) / width, F.lit(float(DISPLAY_HEIGHT)) / height)
    return (width * scale).cast("int"), (height * scale).cast("int")


def display_to_image(click: Column, size: Column, shown: Column) -> Column:
    """A click on the display in image pixels, held inside the image."""
    pixel = (click * size / shown).cast("int")
    return F.greatest(F.lit(0), F.least(size - 1, pixel))


def image_to_display(pixel: Column, size: Column, shown: Column) -> Column:
    return (pixel * (shown / size)).cast("int")


def model_coordinate(value: Column, size: Column | int, resolution: int, normalize: bool = True) -> Column:
    scaled = value / size if normalize else value
    return scaled * F.lit(resolution)


def box_width_height(x0: Column, y0: Column, x1: Column, y1: Column) -> list[Column]:
    return [x0, y0, x1 - x0, y1 - y0]


def uncrop_point(x: Column, y: Column, crop_x0: Column, crop_y0: Column) -> list[Column]:
    return [x + crop_x0, y + crop_y0]


def uncrop_box(box: list[Column], crop_x0: Column, crop_y0: Column) -> list[Column]:
    x0, y0, x1, y1 = box
    return [x0 + crop_x0, y0 + crop_y0, x1 + crop_x0, y1 + crop_y0]


def near_crop_edge(box: list[Column], crop: list[Column], image: list[Column], atol: float = 20.0) -> Column:
    """True where a side of the uncropped box lies at the crop's side but not at the image's side."""
    sides = [
        (F.abs(side - edge) <= atol) & ~(F.abs(side - border) <= atol)
        for side, edge, border in zip(uncrop_box(box, crop[0], crop[1]), crop, image)
    ]
    return sides[0] | sides[1] | sides[2] | sides[3]


def box_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (x1 - x0) * (y1 - y0)


def box_intersection(a: list[Column], b: list[Column]) -> Column:
    wide = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0))
    high = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))
    return wide * high


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union; null for two empty boxes."""
    both = box_intersection(a, b)
    union = box_area(*a) + box_area(*b) - both
    return both / F.nullif(union, F.lit(0))


def prompt_error(points: Column, labels: Column, box: Column, clear_old_points: Column) -> Column:
    """Reason why a prompt is not usable, or null."""
    return (
        F.when(points.isNull() != labels.isNull(), "points need as many labels, and labels need points")
        .when(points.isNull() & box.isNull(), "the prompt has neither points nor a box")
        .when(box.isNotNull() & ~clear_old_points, "a box replaces earlier points")
    )


def with_box_corners(points: Column, box: Column) -> Column:
    """Puts the corners of ``box`` (x0, y0, x1, y1) before the (x, y, label) points."""
    first, second = BOX_CORNER_LABELS
    corners = F.array(
        F.struct(box[0].alias("x"), box[1].alias("y"), F.lit(first).alias("label")),
        F.struct(box[2].alias("x"), box[3].alias("y"), F.lit(second).alias("label")),
    )
    return F.when(box.isNotNull(), F.concat(corners, points)).otherwise(points)
