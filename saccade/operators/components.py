"""Connected regions of masks, and repairs that depend on their size.

A mask lies in one row, so its regions are found in that row: its run lengths are cut into column pieces, sorted as they come;
touching pieces of neighbouring columns are found by bisection and joined by a union-find over all masks of a batch at once. There
is no shuffle, and cost is linear in pixels or pieces but for the logarithm of the bisection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from saccade.operators.masks import MASK_KEYS, rle_encode

HOLE_SCORE = 0.1
REPAIR_STEP = 10.0

#: Run lengths or scores of several masks that are worked on together; a larger mask is worked on alone.
TOGETHER = 1 << 21


class Runs:
    """Stretches [start, end) of set pixels, column by column, of several masks of sizes ``h``, ``w``; disjoint, not touching, sorted."""

    def __init__(self, of: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, w: np.ndarray):
        if len(of):
            new = np.concatenate([[True], (of[1:] != of[:-1]) | (start[1:] != end[:-1])])
            last = np.append(new[1:], True)
            of, start, end = of[new], start[new], end[last]
        self.of, self.start, self.end, self.h, self.w = of, start, end, h, w

    @classmethod
    def from_counts(cls, counts: pa.ListArray, h: np.ndarray, w: np.ndarray, background: bool = False) -> Runs:
        ends = counts.offsets.to_numpy().astype(np.int64)
        lengths, ends = counts.flatten().to_numpy().astype(np.int64), ends - ends[0]
        of = np.repeat(np.arange(len(counts)), np.diff(ends))
        total = np.concatenate([[0], np.cumsum(lengths)])
        end = total[1:] - total[ends[:-1]][of]
        use = (((np.arange(len(of)) - ends[of]) % 2 == 1) ^ background) & (lengths > 0)
        return cls(of[use], (end - lengths)[use], end[use], h, w)

    @classmethod
    def from_pixels(cls, is_set: np.ndarray, ends: np.ndarray, h: np.ndarray, w: np.ndarray) -> Runs:
        """From flags of all pixels, row by row, of masks that end at ``ends``."""
        flat, first = np.zeros(len(is_set), bool), np.zeros(len(is_set) + 1, bool)
        flat[column_places(ends, h, w)] = is_set
        first[ends] = True
        opens, closes = flat.copy(), flat.copy()
        opens[1:] &= ~flat[:-1] | first[1:-1]
        closes[:-1] &= ~flat[1:] | first[1:-1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        of = np.searchsorted(ends, start, side="right") - 1
        return cls(of, start - ends[of], end - ends[of], h, w)

    def counts(self) -> pa.ListArray:
        """Run lengths of each mask, background first."""
        n = np.bincount(self.of, minlength=len(self.h))
        size = self.h * self.w
        first = np.cumsum(n) - n
        before = np.where(np.arange(len(self.of)) == first[self.of], 0, np.concatenate([[0], self.end])[:-1]) if len(self.of) else self.of
        pairs = np.stack([self.start - before, self.end - self.start], 1).ravel()
        last = np.zeros(len(n), np.int64)
        last[n > 0] = self.end[(first + n - 1)[n > 0]]
        rest = size - last
        ends = np.concatenate([[0], np.cumsum(2 * n + (rest > 0))])
        out = np.zeros(ends[-1], np.int32)
        tails = rest > 0
        spot = np.ones(len(out), bool)
        spot[(ends[1:] - 1)[tails]] = False
        out[spot], out[~spot] = pairs, rest[tails]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out))

    def select(self, use: np.ndarray, pieces: Pieces) -> Runs:
        """The stretches that the chosen ``pieces`` cover."""
        base = pieces.x[use] * self.h[pieces.of[use]]
        return Runs(pieces.of[use], base + pieces.y0[use], base + pieces.y1[use] + 1, self.h, self.w)

    def union(self, other: Runs) -> Runs:
        """Both together, where they have no pixel in common."""
        of, start, end = (np.concatenate([a, b]) for a, b in ((self.of, other.of), (self.start, other.start), (self.end, other.end)))
        order = np.lexsort((start, of))
        return Runs(of[order], start[order], end[order], self.h, self.w)


def column_places(ends: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Where each pixel, given row by row, lies when all masks are laid out column by column."""
    of = np.repeat(np.arange(len(h)), np.diff(ends))
    place = np.arange(len(of)) - ends[of]
    return ends[of] + place % w[of] * h[of] + place // w[of]


class Pieces:
    """Runs cut at column borders, with the 8-connected region of each: its first piece, area and first pixel in reading order."""

    def __init__(self, runs: Runs):
        h = runs.h[runs.of]
        first, last = runs.start // h, (runs.end - 1) // h
        n = last - first + 1
        run = np.repeat(np.arange(len(n)), n)
        self.of = runs.of[run]
        self.x = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        base = self.x * h[run]
        self.y0 = np.maximum(runs.start[run] - base, 0)
        self.y1 = np.minimum(runs.end[run] - base, h[run]) - 1
        self.node = base + self.y0
        self.region = _least_reachable(len(run), *self._touching(runs))
        self.heads = np.flatnonzero(self.region == np.arange(len(run)))
        number = np.searchsorted(self.heads, self.region)
        self.area = np.bincount(number, (self.y1 - self.y0 + 1), len(self.heads)).astype(np.int64)[number]
        order = np.lexsort((self.x, self.y0, self.region))
        opens = np.concatenate([[True], self.region[order][1:] != self.region[order][:-1]]) if len(run) else np.zeros(0, bool)
        self.first = order[opens][number]

    def _touching(self, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of pieces in neighbouring columns that share a side or a corner."""
        high = int(runs.h.max(initial=0)) + 3
        columns = np.cumsum(runs.w + 1) - (runs.w + 1)  # a free column behind each mask
        column = (columns[self.of] + self.x) * high
        low = np.searchsorted(column + self.y1, column + high + self.y0 - 1, side="left")
        up = np.searchsorted(column + self.y0, column + high + self.y1 + 1, side="right")
        n = np.maximum(up - low, 0)
        a = np.repeat(np.arange(len(n)), n)
        return a, low[a] + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)


def _least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of ``n`` numbers reaches over the links ``a``, ``b``."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not (root[root] == root).all():
            root = root[root]


def _sliced(column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """``work`` over slices of the batches whose lists of ``column`` hold about ``TOGETHER`` values, or one list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, row = batch.column(column).offsets.to_numpy(), 0
            while row < batch.num_rows:
                upto = max(row + 1, int(np.searchsorted(ends, ends[row] + TOGETHER, side="right")) - 1)
                yield work(batch.slice(row, upto - row))
                row = min(upto, batch.num_rows)
    return run


def _sizes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(c).to_numpy().astype(np.int64) for c in ("h", "w"))


def components(masks: DataFrame, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """Labels the 8-connected foreground regions of each mask.

    Out: keys, h, x, y0, y1, node, component, area, first_y, first_x, a row per column piece; the component is the smallest
    column-major offset in it, first_y and first_x its first pixel in reading order.
    """
    keys = list(keys)
    slim = masks.select(*keys, F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), F.col("counts").cast("array<int>").alias("counts"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        pieces = Pieces(Runs.from_counts(batch.column("counts"), *_sizes(batch)))
        rows = pa.array(pieces.of)
        figures = {"x": pieces.x, "y0": pieces.y0, "y1": pieces.y1, "node": pieces.node, "component": pieces.node[pieces.region],
                   "first_y": pieces.y0[pieces.first], "first_x": pieces.x[pieces.first]}
        return pa.RecordBatch.from_pydict(
            {c: batch.column(c).take(rows) for c in (*keys, "h")} | {c: pa.array(v.astype(np.int32)) for c, v in figures.items()}
            | {"area": pa.array(pieces.area)})

    kinds = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keys)
    return slim.mapInArrow(_sliced("counts", work), f"{kinds}, h int, x int, y0 int, y1 int, node int, component int, first_y int, first_x int, area long")


def component_areas(labelled: DataFrame, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """Area of each region, with the region's first pixel in reading order."""
    return labelled.filter(F.col("node") == F.col("component")).select(
        *keys, "component", "area", F.struct(F.col("first_y").alias("y"), F.col("first_x").alias("x")).alias("first_pixel"))


def component_pixels(labelled: DataFrame, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """One row per pixel: keys, x, y, component, area."""
    return labelled.select(*keys, "x", F.explode_outer(F.sequence("y0", "y1")).alias("y"), "component", "area")


def logits_to_masks(logits: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Score arrays to mask rows."""
    return rle_encode(logits, "logits", lambda v: v.cast("double") > threshold)


def _painted(logits: DataFrame, paint: Callable[[np.ndarray, np.ndarray, Callable], None]) -> DataFrame:
    """Rewrites scores in their row. ``paint`` gets the scores, a copy to write to and a function that lists the places of regions."""
    kind = logits.schema["logits"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("logits")
        ends = lists.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        h, w = _sizes(batch)
        scores = lists.flatten().to_numpy(zero_copy_only=False)
        out = scores.copy()
        back = np.empty(len(out), np.int64)
        back[column_places(ends, h, w)] = np.arange(len(out))

        def small(is_set: np.ndarray, max_area: int) -> np.ndarray:
            """Places of the pixels of regions of at most ``max_area`` pixels."""
            pieces = Pieces(Runs.from_pixels(is_set, ends, h, w))
            use = np.flatnonzero(pieces.area <= max_area)
            size = pieces.y1[use] - pieces.y0[use] + 1
            start = ends[pieces.of[use]] + pieces.node[use]
            return back[np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]

        paint(scores, out, small)
        column = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(out), mask=lists.is_null() if lists.null_count else None)
        return batch.set_column(batch.schema.get_field_index("logits"), "logits", column)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in logits.schema)
    assert kind in ("array<float>", "array<double>"), kind
    return logits.mapInArrow(_sliced("logits", work), fields)


def fill_holes(logits: DataFrame, max_area: int, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """Raises background regions of at most ``max_area`` pixels to a small positive score."""
    if max_area <= 0:
        raise ValueError("max_area must be positive")

    def paint(scores: np.ndarray, out: np.ndarray, small: Callable) -> None:
        out[small(~(scores > 0), max_area)] = HOLE_SCORE

    return _painted(logits, paint)


def repair_scores(logits: DataFrame, max_hole_area: int = 0, max_sprinkle_area: int = 0, threshold: float = 0.0,
                  keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """Fills small holes and wipes small islands, both found in the scores as given."""
    def paint(scores: np.ndarray, out: np.ndarray, small: Callable) -> None:
        is_set = scores.astype(np.float64) > threshold
        if max_hole_area > 0:
            out[small(~is_set, max_hole_area)] = threshold + REPAIR_STEP
        if max_sprinkle_area > 0:
            out[small(is_set, max_sprinkle_area)] = threshold - REPAIR_STEP

    return _painted(logits, paint)


def remove_small_regions(masks: DataFrame, area_threshold: int, mode: str,
                         keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """Fills ``holes`` or drops ``islands`` smaller than ``area_threshold``; adds the flag changed.

    Where every island is small the largest stays, on ties the first in reading order.
    """
    if mode not in ("holes", "islands"):
        raise ValueError("mode must be 'holes' or 'islands'")
    others = [f for f in masks.schema if f.name not in ("counts", "changed")]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, w = _sizes(batch)
        own = Runs.from_counts(batch.column("counts"), h, w)
        judged = Runs.from_counts(batch.column("counts"), h, w, background=True) if mode == "holes" else own
        pieces = Pieces(judged)
        small = pieces.area < area_threshold
        changed = np.zeros(len(h), bool)
        changed[pieces.of[small]] = True
        if mode == "holes":
            new = own.union(judged.select(small, pieces))
        else:
            spared = np.ones(len(h), bool)  # masks with small islands only
            spared[pieces.of[~small]] = False
            heads = pieces.heads
            order = heads[np.lexsort((pieces.x[pieces.first[heads]], pieces.y0[pieces.first[heads]], -pieces.area[heads], pieces.of[heads]))]
            largest = order[np.concatenate([[True], pieces.of[order][1:] != pieces.of[order][:-1]])] if len(order) else order
            new = own.select(~small | spared[pieces.of] & np.isin(pieces.region, largest), pieces)
        return pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in others} | {"changed": pa.array(changed), "counts": new.counts()})

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others)
    ready = masks.withColumn("counts", F.col("counts").cast("array<int>"))
    return ready.mapInArrow(_sliced("counts", work), f"{kinds}changed boolean, counts array<int>")


def clean_regions(masks: DataFrame, min_area: int, keys: Sequence[str] = MASK_KEYS) -> DataFrame:
    """Fills small holes, then drops small islands; changed tells whether either did something."""
    no_holes = remove_small_regions(masks, min_area, "holes", keys).withColumnRenamed("changed", "filled")
    done = remove_small_regions(no_holes, min_area, "islands", keys)
    return done.withColumn("changed", F.col("changed") | F.col("filled")).drop("filled")
