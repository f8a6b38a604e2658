"""Sampling points and overlapping crops for a table of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def sample_points(images: DataFrame, per_side: int | Column) -> DataFrame:
    """Even grid over the unit square for each input row: point (row by row), x, y."""
    n = per_side if isinstance(per_side, Column) else F.lit(per_side)
    numbered = images.withColumn("_n", n).filter(F.col("_n") > 0)
    cells = numbered.select("*", F.explode(F.sequence(F.lit(0), F.col("_n") * F.col("_n") - 1)).alias("point"))
    side = F.floor(F.col("point") / F.col("_n"))
    return cells.select(
        *images.columns, "point",
        (((F.col("point") % F.col("_n")) * 2 + 1) / (F.col("_n") * 2)).alias("x"),
        ((side * 2 + 1) / (F.col("_n") * 2)).alias("y"))


def layer_points(images: DataFrame, per_side: int, layers: int, scale: int) -> DataFrame:
    """The grid of each crop layer, thinned by ``scale`` from layer to layer."""
    layered = images.select("*", F.explode(F.sequence(F.lit(0), F.lit(layers))).alias("layer"))
    n = F.floor(F.lit(per_side) / F.pow(F.lit(scale), F.col("layer"))).cast("int")
    return sample_points(layered, n)


def tiles(images: DataFrame, layers: int, overlap_ratio: float) -> DataFrame:
    """Crops of each image (columns h, w): the whole image and 2^i by 2^i tiles on layer i."""
    layered = images.select("*", F.explode(F.sequence(F.lit(0), F.lit(layers))).alias("layer"))
    side = F.pow(F.lit(2), F.col("layer")).cast("int")
    sized = layered.withColumn("_side", side).withColumn(
        "_overlap", F.when(F.col("layer") == 0, 0).otherwise(
            (F.lit(overlap_ratio) * F.least("h", "w") * (F.lit(2.0) / F.col("_side"))).cast("int")))

    def length(size: str) -> Column:
        return F.ceil((F.col("_overlap") * (F.col("_side") - 1) + F.col(size)) / F.col("_side")).cast("int")

    cut = sized.withColumn("_tw", length("w")).withColumn("_th", length("h")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("_side") - 1)).alias("_ix")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("_side") - 1)).alias("_iy"))
    x0 = (F.col("_tw") - F.col("_overlap")) * F.col("_ix")
    y0 = (F.col("_th") - F.col("_overlap")) * F.col("_iy")
    return cut.select(
        *images.columns, "layer", x0.alias("x0"), y0.alias("y0"),
        F.least(x0 + F.col("_tw"), F.col("w")).alias("x1"), F.least(y0 + F.col("_th"), F.col("h")).alias("y1"))
