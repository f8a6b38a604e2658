"""Overlapping boxes: greedy suppression, pair overlaps and their summary, tile by tile.

A group is cut into tiles of about ``TILE`` boxes; a box is in every tile that it touches. A group with no more boxes than that
is one tile. Boxes that overlap by more than a threshold t have widths, and heights, within a factor 1/t of each other: boxes too
large for the tiles of their group go on grids of their own size class and the next larger one, so any two that can exceed t
share a tile. One procedure works on a tile, whatever the size of its group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from saccade.functions.geometry import box_iou
from saccade.operators.batches import whole_groups
from saccade.session import cut_lineage

BOX = ("x0", "y0", "x1", "y1")
OPEN, CLEAR, DROPPED = 0, 1, 2

#: Boxes of a tile: a group of up to as many is one tile, and of a fuller tile the best ones are settled first.
TILE = 4096
CELL = ("level_w", "level_h", "cell_x", "cell_y")
WHOLE = -(2 ** 31)


def _check(threshold: float) -> None:
    if not 0 <= threshold <= 1:
        raise ValueError("threshold must be from 0 to 1")


def _ratio(threshold: float) -> float:
    return max(2.0, (1.0 + 1e-6) / threshold) if threshold > 0 else 2.0


def _has_area() -> Column:
    return (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))


def _tiled(boxes: DataFrame, group: list[str], threshold: float, tile: int) -> DataFrame:
    """Adds ``cells``, the tiles of each box (which has an area), and its own size class (own_w, own_h)."""
    ratio = F.lit(_ratio(threshold))
    n, side = F.col("_n"), [F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")]
    sizes = boxes.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), (F.max("x1") - F.min("x0")).cast("double").alias("_wide"), (F.max("y1") - F.min("y0")).cast("double").alias("_high"),
        F.greatest(F.max(side[0]), F.max(side[1])).cast("double").alias("_longest"))

    def size_class(length: Column) -> Column:
        return F.floor(F.log(length.cast("double")) / F.log(ratio)).cast("int")

    # Tiles of a quarter of the boxes on average, square, or slices where the group is narrower than that.
    square = F.sqrt(F.col("_wide") * F.col("_high") * F.lit(tile / 4) / n)
    slices = F.greatest("_wide", "_high") * F.lit(tile / 4) / n
    least = size_class(F.when(square > F.least("_wide", "_high"), slices).otherwise(square))
    if threshold == 0:
        least = F.greatest(least, size_class(F.col("_longest")))
    sizes = sizes.select(*group, (n <= tile).alias("_whole"), least.alias("_least"))

    def strip(low: Column, high: Column, level: Column) -> Column:
        size = F.pow(ratio, level + 1)
        return F.sequence(F.floor(low / size), F.floor(high / size))

    def grid(level_w: Column, level_h: Column) -> Column:
        rows = strip(F.col("y0"), F.col("y1"), level_h)
        return F.flatten(F.transform(strip(F.col("x0"), F.col("x1"), level_w), lambda cx: F.transform(
            rows, lambda cy: F.struct(level_w.alias("level_w"), level_h.alias("level_h"), cx.alias("cell_x"), cy.alias("cell_y")))))

    def levels(own: Column) -> Column:
        return F.array_distinct(F.array(F.greatest(own, F.col("_least")), F.greatest(own + 1, F.col("_least"))))

    whole = F.array(F.struct(*[F.lit(WHOLE).cast(kind).alias(name) for name, kind in zip(CELL, ("int", "int", "long", "long"))]))
    spread = F.flatten(F.transform(levels(F.col("_class_w")), lambda lw: F.flatten(F.transform(
        levels(F.col("_class_h")), lambda lh: grid(lw, lh)))))
    placed = boxes.join(sizes, group).withColumn("_class_w", size_class(side[0])).withColumn("_class_h", size_class(side[1]))
    return placed.withColumn("cells", F.when(F.col("_whole"), whole).otherwise(spread)).withColumn(
        "own_w", F.when(F.col("_whole"), WHOLE).otherwise(F.greatest("_class_w", "_least"))).withColumn(
        "own_h", F.when(F.col("_whole"), WHOLE).otherwise(F.greatest("_class_h", "_least"))).drop("_whole", "_least", "_class_w", "_class_h")


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of two equally long lists of boxes (columns x0, y0, x1, y1); not a number without a union."""
    wide = np.maximum(np.minimum(a[2], b[2]) - np.maximum(a[0], b[0]), 0)
    high = np.maximum(np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]), 0)
    both = wide * high
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(union == 0, np.nan, both / union)


def settle(tiles: np.ndarray, boxes: np.ndarray, border: np.ndarray, threshold: float) -> np.ndarray:
    """Goes through the boxes of all tiles at once, best first (as they are given, tile by tile).

    The best box left in a tile is CLEAR: nothing better in the tile drops it. If it lies in this tile alone it stays for sure and
    drops what it overlaps; a box on a border may yet fall to a box of another tile, so what it overlaps stays OPEN, and so
    does what those overlap."""
    verdict = np.full(len(tiles), OPEN, np.int8)
    doubtful = np.zeros(len(tiles), bool)
    left = np.arange(len(tiles))
    while len(left):
        leads = np.concatenate([[True], tiles[left[1:]] != tiles[left[:-1]]])
        lead = left[leads]
        verdict[lead] = np.where(doubtful[lead], OPEN, CLEAR)
        sure = ~doubtful[lead] & ~border[lead]
        of = (np.cumsum(leads) - 1)[~leads]
        left = left[~leads]
        over = _overlap(boxes[:, lead[of]], boxes[:, left]) > threshold
        falls = over & sure[of]
        verdict[left[falls]] = DROPPED
        doubtful[left[over & ~falls]] = True
        left = left[~falls]
    return verdict


def _numbers(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(side).to_numpy() for side in BOX])


def nms(boxes: DataFrame, group: Sequence[str], threshold: float, score: str = "score", box_id: str = "id",
        small_group: int = TILE) -> DataFrame:
    """Greedy suppression: best score first (lowest id on ties), dropping boxes with a larger overlap.

    Works in rounds over tiles of about ``small_group`` boxes. A round settles every box that depends on its own tile alone;
    boxes on borders wait until all their tiles agree, and what they decide is settled in the next round, with larger tiles as
    fewer boxes are open. Groups that are one tile are done at once. The result is that of the sequential procedure; the best
    open box of a group is settled in every round. A long row of boxes, each overlapping the next, takes about one round per
    ``small_group`` boxes of it. Boxes without area overlap nothing and are kept; the threshold may be 0 to 1.
    """
    _check(threshold)
    if threshold == 1:  # no overlap is larger
        return boxes
    group, tile = list(group), max(1, small_group)
    rank = F.struct((-F.col(score)).alias("behind"), F.col(box_id).alias("id"))
    held = cut_lineage(boxes)
    large = held.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > tile).select(*group)
    large = cut_lineage(large)
    columns = held.columns

    def keep(table: pa.Table, tiles: np.ndarray) -> pa.Table:
        verdict = settle(tiles, _numbers(table), np.zeros(len(tiles), bool), threshold)
        return table.filter(pa.array(verdict == CLEAR)).select(columns)

    if large.isEmpty():
        ranked = held.withColumn("_rank", rank)
    else:
        ranked = held.join(large, group, "left_anti").withColumn("_rank", rank)
    kept = ranked.repartition(*group).sortWithinPartitions(*group, "_rank").drop("_rank").mapInArrow(whole_groups(group, keep), held.schema)
    if large.isEmpty():
        return kept
    crowd = held.join(large, group, "left_semi")
    slim = crowd.select(*group, F.col(box_id), *BOX, rank.alias("rank"))
    return kept.unionByName(crowd.join(_in_rounds(slim, group, box_id, threshold, tile), [*group, box_id], "left_semi"))


def _in_rounds(boxes: DataFrame, group: list[str], box_id: str, threshold: float, tile: int) -> DataFrame:
    """Kept keys of groups of several tiles."""
    key, place = [*group, box_id], [*group, *CELL]
    kept = boxes.filter(~F.coalesce(_has_area(), F.lit(False))).select(*key)
    left = cut_lineage(boxes.filter(_has_area()))

    def judge(table: pa.Table, tiles: np.ndarray) -> pa.Table:
        border = table.column("n_cells").to_numpy() > 1
        verdict = settle(tiles, _numbers(table), border, threshold)
        return table.select([*key, "n_cells"]).append_column("verdict", pa.array(verdict.astype(np.int32)))

    while not left.isEmpty():
        spread = cut_lineage(_tiled(left, group, threshold, tile).select(
            *key, *BOX, "rank", F.size("cells").alias("n_cells"), F.explode("cells").alias("cell")).select(
            *key, *BOX, "rank", "n_cells", "cell.*"))
        # Of a tile that is still too full only the best boxes are judged; the others wait, or fall to those.
        best = spread.withColumn("_place", F.row_number().over(Window.partitionBy(*place).orderBy("rank"))).filter(F.col("_place") <= tile)
        kinds = ", ".join(f"`{c}` {spread.schema[c].dataType.simpleString()}" for c in key)
        judged = best.repartition(*place).sortWithinPartitions(*place, "rank").drop("rank").mapInArrow(
            whole_groups(place, judge), f"{kinds}, n_cells int, verdict int")
        settled = cut_lineage(judged.groupBy(*key).agg(
            F.max("verdict").alias("worst"), F.sum(F.when(F.col("verdict") == CLEAR, 1).otherwise(0)).alias("clear"), F.first("n_cells").alias("n_cells")
        ).filter((F.col("worst") == DROPPED) | (F.col("clear") == F.col("n_cells"))))
        stays = settled.filter(F.col("worst") != DROPPED).select(*key)
        winners = spread.join(stays, key, "left_semi").groupBy(*place).agg(F.collect_list(F.struct(*BOX)).alias("winners"))
        mine = [F.col(side) for side in BOX]
        falls = spread.join(settled, key, "left_anti").join(winners, place).filter(F.exists("winners", lambda w: F.coalesce(
            box_iou([w[side] for side in BOX], mine) > threshold, F.lit(False)))).select(*key).distinct()
        kept = kept.unionByName(stays)
        left = cut_lineage(left.join(settled, key, "left_anti").join(falls, key, "left_anti"))
    return kept


def _sweep(tiles: np.ndarray, boxes: np.ndarray, own: np.ndarray, apart: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places whose boxes share columns of a tile, boxes being in order of x0; where ``apart``, only of different parts."""
    left, step = np.arange(len(tiles)), 0
    while len(left):
        step += 1
        left = left[left + step < len(tiles)]
        left = left[(tiles[left + step] == tiles[left]) & (boxes[0, left + step] < boxes[2, left])]
        use = left[~apart[left] | (own[left] != own[left + step])]
        yield use, use + step


def _found(boxes: DataFrame, group: list[str], threshold: float, tile: int, schema: str,
           report: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.Table]) -> DataFrame:
    """Runs ``report`` on the pairs that overlap by more than ``threshold`` of some tiles: (rows, first, second, overlap).

    Equal boxes are folded into one row with its number of ``copies``. Parts of a tile that is too full meet pair by pair."""
    folded = boxes.filter(_has_area()).groupBy(*group, *BOX).agg(F.count(F.lit(1)).alias("copies"))
    folded = cut_lineage(folded)
    spread = _tiled(folded, group, threshold, tile).select(
        *group, *BOX, "copies", "own_w", "own_h", F.explode("cells").alias("cell")).select(*group, *BOX, "copies", "own_w", "own_h", "cell.*")
    place = [*group, *CELL]
    full = spread.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > tile).select(
        *place, F.ceil(F.col("_n") / tile).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    cut = spread.join(full, place, "left").withColumn("_own", F.pmod(F.xxhash64(*BOX), parts).cast("int")).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    ratio = F.lit(_ratio(threshold))
    dealt = cut.select(*place, F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", *BOX, "copies", "own_w", "own_h",
                       F.pow(ratio, F.col("level_w") + 1).alias("_size_x"), F.pow(ratio, F.col("level_h") + 1).alias("_size_y"))
    where = [*place, "_i", "_j"]

    def work(table: pa.Table, tiles: np.ndarray) -> pa.Table:
        rows = _numbers(table)
        column = {c: table.column(c).to_numpy() for c in (*CELL, "_i", "_j", "_own", "own_w", "own_h", "_size_x", "_size_y")}
        apart, first, second, value = column["_i"] != column["_j"], [], [], []
        for a, b in _sweep(tiles, rows, column["_own"], apart):
            overlap = _overlap(rows[:, a], rows[:, b])
            near = overlap > threshold
            a, b, overlap = a[near], b[near], overlap[near]
            # Reported once: on the grid of the larger box, in the tile of the overlap's first corner.
            once = column["level_w"][a] == WHOLE
            once |= ((np.maximum(column["own_w"][a], column["own_w"][b]) == column["level_w"][a]) & (np.maximum(column["own_h"][a], column["own_h"][b]) == column["level_h"][a])
                     & (np.floor(np.maximum(rows[0, a], rows[0, b]) / column["_size_x"][a]) == column["cell_x"][a])
                     & (np.floor(np.maximum(rows[1, a], rows[1, b]) / column["_size_y"][a]) == column["cell_y"][a]))
            first.append(a[once])
            second.append(b[once])
            value.append(overlap[once])
        none = [np.zeros(0, np.int64)]
        return report(table, np.concatenate(none + first), np.concatenate(none + second), np.concatenate([np.zeros(0)] + value))

    return dealt.repartition(*where).sortWithinPartitions(*where, *BOX).mapInArrow(whole_groups(where, work), schema)


def _kinds(df: DataFrame, columns: Sequence[str], prefix: str = "") -> str:
    return ", ".join(f"`{prefix}{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def box_overlaps(boxes: DataFrame, group: Sequence[str], threshold: float, small_group: int = TILE) -> DataFrame:
    """Pairs of different boxes of a group that overlap by more than ``threshold``, by a sweep over the boxes of a tile.

    Equal boxes are first folded into one row with its number of copies, so copies do not multiply pairs.
    Out: group, a_x0.., b_x0.., a_copies, b_copies, iou, with a before b in coordinate order.
    """
    _check(threshold)
    group = list(group)

    def report(table: pa.Table, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.Table:
        columns = {c: table.column(c).take(pa.array(a)) for c in group}
        for side, rows in (("a", a), ("b", b)):
            columns |= {f"{side}_{c}": table.column(c).take(pa.array(rows)) for c in (*BOX, "copies")}
        return pa.table(columns | {"iou": pa.array(value)})

    head = f"{_kinds(boxes, group)}, " if group else ""
    sides = ", ".join(f"{_kinds(boxes, BOX, f'{side}_')}, {side}_copies long" for side in "ab")
    return _found(boxes, group, threshold, max(1, small_group), f"{head}{sides}, iou double", report)


def overlap_summary(boxes: DataFrame, group: Sequence[str], threshold: float, small_group: int = TILE) -> DataFrame:
    """Per different box with an area: its copies, the number of other boxes (their copies and its own among them) that overlap it
    by more than ``threshold``, and the largest overlap (null where there is none; 1 where the box has a copy).

    Overlaps are counted where they are found, so dense groups give no pair rows."""
    _check(threshold)
    group = list(group)

    def report(table: pa.Table, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.Table:
        copies = table.column("copies").to_numpy()
        n, best = np.zeros(len(copies), np.int64), np.full(len(copies), -1.0)
        for mine, theirs in ((a, b), (b, a)):
            np.add.at(n, mine, copies[theirs])
            np.maximum.at(best, mine, value)
        met = np.flatnonzero(n)
        return table.select([*group, *BOX]).take(pa.array(met)).append_column("n", pa.array(n[met])).append_column("best", pa.array(best[met]))

    head = f"{_kinds(boxes, group)}, " if group else ""
    met = _found(boxes, group, threshold, max(1, small_group), f"{head}{_kinds(boxes, BOX)}, n long, best double", report)
    alone = boxes.filter(_has_area()).select(*group, *BOX, F.lit(1).alias("one"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("best"))
    every = alone.unionByName(met.withColumn("one", F.lit(0)).select(alone.columns))
    summed = every.groupBy(*group, *BOX).agg(F.sum("one").alias("copies"), F.sum("n").alias("n"), F.max("best").alias("best"))
    twice = (F.col("copies") > 1) & F.lit(threshold < 1)
    return summed.select(*group, *BOX, "copies", (F.col("n") + F.when(twice, F.col("copies") - 1).otherwise(0)).alias("n_overlaps"),
                         F.when(twice, 1.0).otherwise(F.col("best")).alias("best_iou"))
