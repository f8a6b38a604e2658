"""Ordered operators over keys of any size.

A plain window sorts all rows of one key in one task. These operators cut each key into chunks along the
order (a frame range, a minute of time), work inside the chunks, and carry a short summary per chunk
across them, so one key may hold any share of the table. ``chunk`` must not decrease along ``order``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from saccade.session import cut_lineage

FRAMES_PER_CHUNK = 16384


def frame_chunk(frame: Column, frames: int = FRAMES_PER_CHUNK) -> Column:
    return F.floor(frame / F.lit(frames)).cast("long")


def minute_chunk(ts: Column) -> Column:
    """Minutes of a time stamp, without regard to time zones."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
    return days.cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, out: str) -> DataFrame:
    """Adds the 1-based position of each row within its key."""
    keys = list(keys)
    cut = df.withColumn("_chunk", chunk)
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        cut.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        cut.withColumn("_place", F.row_number().over(inside))
        .join(before, [*keys, "_chunk"])
        .withColumn(out, F.col("_before") + F.col("_place"))
        .drop("_chunk", "_before", "_place")
    )


def numbered(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Adds the 1-based position of each row of the whole table along ``order``.

    Rows are dealt out by ranges of the order and numbered in their range; only the ranges' sizes, one row each, meet. The
    ranges are kept as a table first, as another reading could cut them elsewhere."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    held = cut_lineage(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_place", place))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return held.join(F.broadcast(sizes), "_range").withColumn(out, F.col("_before") + F.col("_place") + 1).drop("_range", "_place", "_before")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
                value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over this row and all earlier rows of the key."""
    keys = list(keys)
    cut = df.withColumn("_chunk", chunk)
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        cut.groupBy(*keys, "_chunk").agg(F.sum(value).alias("_n"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    )
    inside = (
        Window.partitionBy(*keys, "_chunk").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        cut.withColumn("_inside", F.sum(value).over(inside))
        .join(before, [*keys, "_chunk"])
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_chunk", "_before", "_inside")
    )


def with_next(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column,
              value: str, out: str) -> DataFrame:
    """Adds ``value`` of the following row of the key, null on the last row."""
    keys = list(keys)
    cut = df.withColumn("_chunk", chunk)
    heads = (
        cut.groupBy(*keys, "_chunk")
        .agg(F.min_by(F.struct(value), F.struct(*order)).alias("_head"))
        .select(*keys, "_chunk",
                F.lead("_head").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_head"))
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        cut.withColumn("_next", F.lead(F.struct(value)).over(inside))
        .join(heads, [*keys, "_chunk"])
        .withColumn(out, F.coalesce(F.col("_next"), F.col("_head"))[value])
        .drop("_chunk", "_next", "_head")
    )
