import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from saccade.operators import candidates as K
from saccade.operators import components as C
from saccade.operators import masks as M
from saccade.operators.suppression import box_overlaps, nms, overlap_summary


def mask_frame(spark, arrays):
    rows = [("p", 0, i, f"m{i}", a.shape[0], a.shape[1], [float(v) for v in np.where(a, 1.0, -1.0).ravel()]) for i, a in enumerate(arrays)]
    return spark.createDataFrame(
        rows, "participant_id string, frame int, label_ord int, label string, h int, w int, logits array<float>")


def some_masks():
    rng = np.random.default_rng(3)
    arrays = [rng.random((7, 9)) < p for p in (0.2, 0.5, 0.8)]
    snake = np.zeros((9, 11), bool)
    snake[::2, :] = True
    snake[1::4, -1] = True
    snake[3::4, 0] = True
    return arrays + [np.zeros((4, 3), bool), np.ones((4, 3), bool), snake]


def flood(mask):
    labels, at = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if labels[y, x]:
            continue
        at += 1
        stack = [(y, x)]
        labels[y, x] = at
        while stack:
            cy, cx = stack.pop()
            for ny in range(max(cy - 1, 0), min(cy + 2, mask.shape[0])):
                for nx in range(max(cx - 1, 0), min(cx + 2, mask.shape[1])):
                    if mask[ny, nx] and not labels[ny, nx]:
                        labels[ny, nx] = at
                        stack.append((ny, nx))
    return labels, at


def decode(counts, h, w):
    return np.repeat(np.arange(len(counts)) % 2 == 1, counts).reshape(w, h).T


def test_encode_decode(spark):
    arrays = some_masks()
    masks = C.logits_to_masks(mask_frame(spark, arrays)).cache()
    rows = {r.label_ord: r for r in masks.collect()}
    for i, a in enumerate(arrays):
        assert (decode(rows[i].counts, *a.shape) == a).all()
        assert (rows[i].counts[0] == 0) == bool(a[0, 0])
    pixels = {(r.label_ord, r.x, r.y) for r in M.rle_decode(masks).collect()}
    assert pixels == {(i, x, y) for i, a in enumerate(arrays) for y, x in zip(*np.nonzero(a))}
    again = M.rle_from_pixels(masks.drop("counts"), M.rle_decode(masks))
    assert {(r.label_ord, tuple(r.counts)) for r in again.collect()} == {(i, tuple(r.counts)) for i, r in rows.items()}
    back = {r.label_ord: r.counts for r in M.complement(M.complement(masks)).collect()}
    assert back == {i: r.counts for i, r in rows.items()}


def test_long_counts_cross_blocks(spark):
    rng = np.random.default_rng(1)
    a = rng.random((30, 40)) < 0.5
    masks = C.logits_to_masks(mask_frame(spark, [a]))
    assert {(r.x, r.y) for r in M.rle_decode(masks).collect()} == {(x, y) for y, x in zip(*np.nonzero(a))}


def test_area_and_box(spark):
    arrays = some_masks()
    masks = C.logits_to_masks(mask_frame(spark, arrays))
    for empty, bare in (("zero", (0, 0, 0, 0)), ("inverted", (3, 4, -1, -1))):
        for r in M.mask_stats(masks, empty).collect():
            y, x = np.nonzero(arrays[r.label_ord])
            want = (x.min(), y.min(), x.max(), y.max()) if len(x) else bare
            assert (r.x0, r.y0, r.x1, r.y1) == want and r.area == len(x)


def test_components_match_flood_fill(spark):
    arrays = some_masks()
    labelled = C.components(C.logits_to_masks(mask_frame(spark, arrays)))
    rows = C.component_pixels(labelled).collect()
    for i, a in enumerate(arrays):
        labels, n = flood(a)
        mine = {(r.y, r.x): r for r in rows if r.label_ord == i}
        assert set(mine) == set(zip(*np.nonzero(a)))
        assert len({r.component for r in mine.values()}) == n
        for at, r in mine.items():
            assert r.area == (labels == labels[at]).sum()


def test_components_of_a_large_mask(spark):
    rng = np.random.default_rng(8)
    a = rng.random((1000, 1000)) < 0.38
    a[500] = True  # joins much of it
    labels, n = flood(a)
    rows = C.component_areas(C.components(C.logits_to_masks(mask_frame(spark, [a])))).collect()
    assert sorted(r.area for r in rows) == sorted(np.bincount(labels.ravel())[1:].tolist()) and len(rows) == n


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scores_painted_in_the_row(spark, seed):
    rng = np.random.default_rng(seed)
    arrays = [rng.random((int(rng.integers(1, 12)), int(rng.integers(1, 12)))) < 0.5 for _ in range(30)]
    frame = mask_frame(spark, arrays)
    filled = {r.label_ord: np.array(r.logits).reshape(r.h, r.w) for r in C.fill_holes(frame, 3).collect()}
    fixed = {r.label_ord: np.array(r.logits).reshape(r.h, r.w) for r in C.repair_scores(frame, 3, 2).collect()}
    for i, a in enumerate(arrays):
        holes, spots = (flood(x)[0] for x in (~a, a))
        hole, spot = (np.isin(x, [k for k in range(1, x.max() + 1) if (x == k).sum() <= area]) for x, area in ((holes, 3), (spots, 2)))
        assert np.allclose(filled[i], np.where(hole, 0.1, np.where(a, 1.0, -1.0)))
        assert np.allclose(fixed[i], np.where(spot, -10.0, np.where(hole, 10.0, np.where(a, 1.0, -1.0))))


def test_regions_of_odd_run_lengths(spark):
    rows = [("p", 0, 0, 3, 4, [2, 2, 0, 3, 5]), ("p", 0, 1, 3, 4, [12]), ("p", 0, 2, 0, 4, []), ("p", 0, 3, 3, 4, [0, 12])]
    masks = spark.createDataFrame(rows, "participant_id string, frame int, label_ord int, h int, w int, counts array<int>")
    areas = {(r.label_ord, r.component, r.area) for r in C.component_areas(C.components(masks)).collect()}
    assert areas == {(0, 2, 5), (3, 0, 12)}  # touching runs are one
    kept = {r.label_ord: (r.counts, r.changed) for r in C.remove_small_regions(masks, 6, "islands").collect()}
    assert kept == {0: ([2, 5, 5], True), 1: ([12], False), 2: ([], False), 3: ([0, 12], False)}


def remove_small(mask, area, holes):
    labels, n = flood(mask ^ holes)
    sizes = [(labels == i).sum() for i in range(1, n + 1)]
    small = [i + 1 for i, s in enumerate(sizes) if s < area]
    if not small:
        return mask, False
    if holes:
        return mask | np.isin(labels, small), True
    keep = [i for i in range(1, n + 1) if i not in small] or [int(np.argmax(sizes)) + 1]
    return np.isin(labels, keep), True


@pytest.mark.parametrize("mode", ["holes", "islands"])
def test_small_regions(spark, mode):
    arrays = some_masks()
    got = C.remove_small_regions(C.logits_to_masks(mask_frame(spark, arrays)), 5, mode).collect()
    assert len(got) == len(arrays)
    for r in got:
        want, changed = remove_small(arrays[r.label_ord], 5, mode == "holes")
        assert r.changed == changed
        assert (decode(r.counts, r.h, r.w) == want).all()


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union else 0.0


def greedy(boxes, threshold):
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[5], b[4])):
        if all(iou(k, b) <= threshold for k in kept):
            kept.append(b)
    return {b[4] for b in kept}


def random_boxes(n, rng, copies):
    out = []
    for i in range(n):
        x, y = rng.randint(0, 60), rng.randint(0, 60)
        box = (x, y, x + rng.randint(0, 40), y + rng.randint(1, 40))
        out += [(*box, len(out) + j, round(rng.random(), 1)) for j in range(rng.choice(copies))]
    return out


@pytest.mark.parametrize("threshold", [0.1, 0.6])
@pytest.mark.parametrize("small_group", [0, 64])
def test_nms_is_greedy(spark, threshold, small_group):
    rng = random.Random(7)
    groups = {"hot": random_boxes(90, rng, [1, 1, 5]), "cool": random_boxes(6, rng, [1])}
    rows = [(g, *b) for g, boxes in groups.items() for b in boxes]
    df = spark.createDataFrame(rows, "g string, x0 int, y0 int, x1 int, y1 int, id int, score double")
    got = nms(df, ["g"], threshold, small_group=small_group).collect()
    for g, boxes in groups.items():
        assert {r.id for r in got if r.g == g} == greedy(boxes, threshold)


def test_box_overlaps_match_all_pairs(spark):
    rng = random.Random(2)
    boxes = random_boxes(120, rng, [1, 3])
    df = spark.createDataFrame([("g", *b) for b in boxes], "g string, x0 int, y0 int, x1 int, y1 int, id int, score double")
    distinct = sorted({b[:4] for b in boxes if b[2] > b[0]})
    want = {(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1:] if iou(a, b) > 0.2}
    for small_group in (0, 1000):
        got = box_overlaps(df, ["g"], 0.2, small_group).collect()
        pairs = [((r.a_x0, r.a_y0, r.a_x1, r.a_y1), (r.b_x0, r.b_y0, r.b_x1, r.b_y1)) for r in got]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


@pytest.mark.parametrize("threshold, tile", [(0.0, 60), (0.3, 25)])
def test_nms_over_many_tiles(spark, threshold, tile):
    rng = random.Random(9)
    spread = []
    for i in range(300):  # mixed sizes, far apart and in clusters
        x, y, side = rng.randint(0, 900), rng.randint(0, 300), rng.choice([2, 9, 30, 30, 200])
        spread.append((x, y, x + side + rng.randint(0, 3), y + side, i, round(rng.random(), 2)))
    dense = [(5 + i % 4, 5 + i % 3, 50 + i % 5, 60, i, float(i % 7)) for i in range(200)]
    rows = [(g, *b) for g, boxes in (("spread", spread), ("dense", dense)) for b in boxes]
    df = spark.createDataFrame(rows, "g string, x0 int, y0 int, x1 int, y1 int, id int, score double")
    got = nms(df, ["g"], threshold, small_group=tile).collect()
    for g, boxes in (("spread", spread), ("dense", dense)):
        assert {r.id for r in got if r.g == g} == greedy(boxes, threshold)


def test_a_falling_row_settles_in_few_rounds(spark, monkeypatch):
    from saccade.operators import suppression
    rounds = []
    tiled = suppression._tiled
    monkeypatch.setattr(suppression, "_tiled", lambda *a: rounds.append(1) or tiled(*a))
    row = [(6 * i, 0, 6 * i + 10, 10, i, float(-i)) for i in range(132)]
    df = spark.createDataFrame([("g", *b) for b in row], "g string, x0 int, y0 int, x1 int, y1 int, id int, score double")
    assert {r.id for r in nms(df, ["g"], 0.2).collect()} == greedy(row, 0.2) and len(rounds) == 0  # one tile
    assert {r.id for r in nms(df, ["g"], 0.2, small_group=100).collect()} == greedy(row, 0.2) and len(rounds) <= 5


def test_overlap_summary(spark):
    rng = random.Random(4)
    boxes = random_boxes(150, rng, [1, 1, 3])
    df = spark.createDataFrame([("g", *b) for b in boxes], "g string, x0 int, y0 int, x1 int, y1 int, id int, score double")
    boxes = [b for b in boxes if b[2] > b[0]]
    want = {}
    for b in boxes:
        near = [iou(b, o) for o in boxes if o[4] != b[4] and iou(b, o) > 0.3]
        want[b[:4]] = (sum(o[:4] == b[:4] for o in boxes), len(near), max(near, default=None))
    for tile in (5, 4096):
        got = {(r.x0, r.y0, r.x1, r.y1): (r.copies, r.n_overlaps, r.best_iou) for r in overlap_summary(df, ["g"], 0.3, tile).collect()}
        assert got == want


def test_clean_candidates_against_plain_code(spark):
    rng = np.random.default_rng(11)
    arrays = [rng.random((8, 8)) < 0.6 for _ in range(6)]
    masks = C.logits_to_masks(mask_frame(spark, arrays))
    records = M.mask_box(masks).select(F.lit("i").alias("image_id"), F.col("label_ord").cast("long").alias("candidate_id"), "h", "w",
                                       "counts", "x0", "y0", "x1", "y1")
    cleaned, boxes = {}, []
    for i, a in enumerate(arrays):
        filled, one = remove_small(a, 4, True)
        final, two = remove_small(filled, 4, False)
        y, x = np.nonzero(final)
        box = (x.min(), y.min(), x.max(), y.max()) if len(x) else (0, 0, 0, 0)
        cleaned[i] = final
        boxes.append((*box, i, 0.0 if one or two else 1.0))
    got = K.clean_candidates(records, 4, 0.9).collect()
    assert {r.candidate_id for r in got} == greedy(boxes, 0.9)
    for r in got:
        assert (decode(r.counts, r.h, r.w) == cleaned[r.candidate_id]).all()
        assert (r.x0, r.y0, r.x1, r.y1) == tuple(int(v) for v in boxes[r.candidate_id][:4])


def test_empty_masks_do_not_pass_the_stability_filter(spark):
    df = mask_frame(spark, [np.zeros((3, 3), bool)]).withColumn("predicted_iou", F.lit(0.9))
    assert K.quality_filter(df, K.QualityOptions(stability_offset=0.1)).count() == 0


def test_non_overlap_ties_and_single(spark):
    rows = [("p", 0, 0, 1, 1, 0.5), ("p", 0, 1, 1, 1, 0.5), ("p", 0, 2, 1, 1, -20.0), ("p", 1, 0, 0, 0, -3.0)]
    df = spark.createDataFrame(rows, "participant_id string, frame int, label_ord int, x int, y int, logit double")
    got = {(r.frame, r.label_ord): r.logit for r in M.non_overlap(df).collect()}
    assert got == {(0, 0): 0.5, (0, 1): -10.0, (0, 2): -20.0, (1, 0): -3.0}
