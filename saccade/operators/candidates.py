"""Mask candidates: scoring, filtering, de-duplication and cleaning.

A candidate row has image_id, candidate_id, logits (row-major scores of a crop of size h, w), predicted_iou,
point (x, y in the crop), crop_x0, crop_y0, crop_x1, crop_y1 and the image size image_h, image_w.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from saccade.functions.geometry import box_area, box_width_height, near_crop_edge, uncrop_box
from saccade.operators.components import clean_regions
from saccade.operators.masks import mask_box, rle_area, rle_encode, stability, uncrop_masks
from saccade.operators.suppression import nms
from saccade.session import cut_lineage

CANDIDATE_KEYS = ("image_id", "candidate_id")
CROP = ("crop_x0", "crop_y0", "crop_x1", "crop_y1")


@dataclass(frozen=True)
class QualityOptions:
    """The usual thresholds of the candidate flow."""

    pred_iou: float = 0.8
    stability: float = 0.95
    stability_offset: float = 1.0
    mask_threshold: float = 0.0
    box_nms: float = 0.7
    crop_nms: float = 0.7
    edge_tolerance: float = 20.0
    min_region_area: int = 0


def quality_filter(candidates: DataFrame, options: QualityOptions) -> DataFrame:
    """Keeps confident and stable candidates; a threshold of 0 switches its test off."""
    kept = candidates
    if options.pred_iou > 0:
        kept = kept.filter(F.col("predicted_iou") > options.pred_iou)
    scored = kept.withColumn("stability_score", stability(
        F.col("logits"), options.mask_threshold, options.stability_offset))
    if options.stability > 0:
        # Spark sorts NaN above all numbers; an empty mask has no score and must not pass.
        scored = scored.filter(~F.isnan("stability_score") & (F.col("stability_score") >= options.stability))
    return scored


def best_candidate(candidates: DataFrame, keys: Sequence[str], delta: float, min_stability: float) -> DataFrame:
    """Candidate 0 if it is stable enough, else the one with the best predicted IoU among the others."""
    scored = candidates.withColumn("stability_score", stability(F.col("logits"), 0.0, delta, guarded=True))
    entry = F.struct("candidate_id", "predicted_iou")
    single = F.col("candidate_id") == 0
    chosen = scored.groupBy(*keys).agg(
        F.max(F.when(single, F.col("stability_score"))).alias("stability_score"),
        F.max_by(F.when(single, entry), F.when(single, 1)).alias("single"),
        F.max_by(F.when(~single, entry), F.when(~single, F.struct("predicted_iou", -F.col("candidate_id")))).alias("multi"))
    pick = F.when(F.col("stability_score") >= min_stability, F.col("single")).otherwise(F.col("multi"))
    return chosen.withColumn("pick", pick).select(*keys, "stability_score", "pick.candidate_id", "pick.predicted_iou")


def _crop_columns() -> list[Column]:
    return [F.col(c) for c in CROP]


def drop_edge_boxes(boxed: DataFrame, tolerance: float) -> DataFrame:
    """Drops boxes cut off by their crop; x0..y1 are still crop coordinates."""
    image = [F.lit(0), F.lit(0), F.col("image_w"), F.col("image_h")]
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    return boxed.filter(~near_crop_edge(box, _crop_columns(), image, tolerance))


def crop_dedupe(records: DataFrame, threshold: float, crops: DataFrame | None = None) -> DataFrame:
    """Drops near copies from overlapping crops and prefers the smaller crop.

    Images with one crop stay as they are. ``crops`` (image_id and the crop's bounds, by default the records themselves)
    tells which crops an image was cut into, also those of which no record is left.
    """
    # Kept once: three plans read the records, and what made them would run for each.
    records = cut_lineage(records)
    crop = F.struct(*CROP)
    several = (records if crops is None else crops).groupBy("image_id").agg(
        F.min(crop).alias("_least"), F.max(crop).alias("_most")).filter("_least <> _most").select("image_id")
    scored = records.join(several, "image_id", "left_semi").withColumn("_score", F.lit(1.0) / box_area(*_crop_columns()))
    kept = nms(scored, ["image_id"], threshold, "_score", "candidate_id").drop("_score")
    return records.join(several, "image_id", "left_anti").unionByName(kept)


def candidate_records(boxed: DataFrame) -> DataFrame:
    """Nested output record of each candidate."""
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    return boxed.select(
        "image_id", "candidate_id",
        F.struct(F.array("h", "w").alias("size"), "counts").alias("segmentation"),
        rle_area(F.col("counts")).alias("area"),
        F.array(*box_width_height(*box)).alias("bbox"),
        "predicted_iou",
        F.array(F.array("point_x", "point_y")).alias("point_coords"),
        "stability_score",
        F.array(*box_width_height(*_crop_columns())).alias("crop_box"))


def clean_candidates(records: DataFrame, min_area: int, threshold: float) -> DataFrame:
    """Repairs small holes and islands, then de-duplicates again and prefers masks that needed no repair.

    Repaired candidates get their new mask and box.
    """
    keys = list(CANDIDATE_KEYS)
    records = cut_lineage(records)
    base = records.select(*keys, "h", "w", "counts")
    cleaned = cut_lineage(mask_box(cut_lineage(clean_regions(base, min_area, keys))).select(
        *keys, "x0", "y0", "x1", "y1", F.when(F.col("changed"), 0.0).otherwise(1.0).alias("score"),
        F.col("counts").alias("_counts")))
    kept = nms(cleaned, ["image_id"], threshold, "score", "candidate_id")
    renamed = kept.select(*keys, "score", "_counts", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    joined = records.join(renamed, keys)
    changed = F.col("score") == 0.0
    for column in ("counts", "x0", "y0", "x1", "y1"):
        joined = joined.withColumn(column, F.when(changed, F.col(f"_{column}")).otherwise(F.col(column)))
    return joined.drop("score", "_counts", "_x0", "_y0", "_x1", "_y1")


def candidate_masks(candidates: DataFrame, options: QualityOptions) -> DataFrame:
    """Filters, boxes and encodes candidates, de-duplicates inside each crop, and moves all into the image."""
    keys = list(CANDIDATE_KEYS)
    scored = quality_filter(candidates, options)
    encoded = rle_encode(scored, "logits", lambda v: v.cast("double") > options.mask_threshold)
    # Kept in compressed form before its columns are filtered on: scores are encoded once, not per use.
    inside = drop_edge_boxes(cut_lineage(mask_box(encoded)), options.edge_tolerance)
    kept = nms(inside, ["image_id", *CROP], options.box_nms, "predicted_iou", "candidate_id")
    full = uncrop_masks(kept.select(*keys, "h", "w", "counts", "crop_x0", "crop_y0", "image_h", "image_w"),
                        ("crop_x0", "crop_y0"), F.col("image_h"), F.col("image_w"), keys)
    box = uncrop_box([F.col(c) for c in ("x0", "y0", "x1", "y1")], F.col("crop_x0"), F.col("crop_y0"))
    moved = kept.drop("h", "w", "counts").select(
        *keys, "predicted_iou", "stability_score", *CROP, "image_h", "image_w",
        *[side.alias(name) for side, name in zip(box, ("x0", "y0", "x1", "y1"))],
        (F.col("point_x") + F.col("crop_x0")).alias("point_x"), (F.col("point_y") + F.col("crop_y0")).alias("point_y"))
    return moved.join(full, keys)


def mask_quality(candidates: DataFrame, options: QualityOptions = QualityOptions()) -> DataFrame:
    """The whole candidate flow, from scores to nested records."""
    records = crop_dedupe(candidate_masks(candidates, options), options.crop_nms, candidates)
    if options.min_region_area > 0:
        records = clean_candidates(records, options.min_region_area, max(options.box_nms, options.crop_nms))
    return candidate_records(records)
