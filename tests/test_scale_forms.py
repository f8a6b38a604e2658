"""Forms made for large keys and files: numbering, nearest prompts, file order, files of archives and images, mask differences."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from saccade.operators import masks as M
from saccade.operators import metrics
from saccade.operators import prompts as P
from saccade.operators.components import logits_to_masks
from saccade.operators.ordered import numbered
from saccade.operators.runs import collapse_runs
from saccade.sources import binary, readers


def test_numbering_of_a_whole_table(spark):
    rng = random.Random(1)
    values = rng.sample(range(10_000), 500)
    df = spark.createDataFrame([(v, "x") for v in values], "v int, other string").repartition(7)
    assert {r.v: r.place for r in numbered(df, ["v"], "place").collect()} == {v: k + 1 for k, v in enumerate(sorted(values))}
    assert numbered(df.filter("v < 0"), ["v"], "place").count() == 0


def plain_nearest(frames, marks, k):
    out = set()
    for who, frame in frames:
        own = sorted((f, s) for (w, f), s in marks.items() if w == who)
        before, after = [m for m in own if m[0] < frame], [m for m in own if m[0] >= frame]
        close = before[-1:] + after[:1]
        rest = sorted((m for m in own if m not in close), key=lambda m: (abs(m[0] - frame), m[1]))
        close.sort(key=lambda m: (abs(m[0] - frame), m[1]))
        out |= {(who, frame, f) for f, _ in (close + rest)[:k]}
    return out


@pytest.mark.parametrize("k, chunk", [(2, 5), (4, 7), (3, 10_000)])
def test_nearest_prompts_in_chunks(spark, k, chunk):
    rng = random.Random(k)
    clicks = [("hot", s, "a", rng.randrange(0, 150) * (1 + (s % 9 == 0))) for s in range(60)] + [("few", 100, "a", 40), ("none", 101, "a", 3)]
    frames = [("hot", f) for f in range(0, 320)] + [("few", f) for f in (0, 39, 40, 41, 90)] + [("lost", 5)]
    marks = {}
    for who, seq, _, frame in clicks:
        marks[who, frame] = min(seq, marks.get((who, frame), seq))
    prompts = spark.createDataFrame(clicks, "participant_id string, seq long, label string, frame int")
    found = P.nearest_prompts(spark.createDataFrame(frames, "participant_id string, frame int"), prompts, k, chunk).collect()
    assert {tuple(r) for r in found} == plain_nearest(frames, marks, k) and len(found) == len(set(found))


def test_file_order_over_pieces_of_a_file(spark, tmp_path):
    lines = [f"{k},{k % 5},0.{k},{(k * 7) % 100 / 100},{k / 2000}" for k in range(2000)]
    (tmp_path / "p1.csv").write_text("\n".join(["a,world_index,b,x,y", *lines]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        gaze = readers.read_gaze(spark, str(tmp_path))
        assert gaze.rdd.getNumPartitions() > 4
        rows = gaze.orderBy("sample_seq").collect()
        first = gaze.groupBy("world_index").agg(F.min_by("norm_y", "sample_seq").alias("y")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.norm_y for r in rows] == [k / 2000 for k in range(2000)]
    assert {r.world_index: r.y for r in first} == {k: k / 2000 for k in range(5)}


def test_archive_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(f"p{p}", f, o, f"m{o}", 5, 7, [float(v) for v in rng.normal(size=35)]) for p in range(3) for f in range(4) for o in range(2)]
    masks = logits_to_masks(spark.createDataFrame(rows, "participant_id string, frame int, label_ord int, label string, h int, w int, logits array<float>"))
    folder = f"file://{tmp_path}/masks"
    assert binary.write_mask_archives(masks, folder).count() == 12
    key = lambda df: {(r.participant_id, r.frame, r.label_ord, r.label, tuple(r.counts)) for r in df.collect()}
    assert key(binary.read_mask_archives(spark, folder)) == key(masks)
    some = binary.read_mask_archives(spark, folder, ["p0", "p2"], (1, 2))
    assert key(some) == key(masks.filter("participant_id <> 'p1' AND frame BETWEEN 1 AND 2"))


def test_mask_errors_by_pieces(spark):
    rng = np.random.default_rng(5)
    arrays = [(rng.random((9, 6)) < 0.5, rng.random((9, 6)) < 0.5) for _ in range(20)] + [(np.zeros((3, 3), bool), np.ones((3, 3), bool))]

    def table(side):
        return logits_to_masks(spark.createDataFrame(
            [("p", 0, k, "m", *pair[side].shape, [float(v) - 0.5 for v in pair[side].ravel()]) for k, pair in enumerate(arrays)],
            "participant_id string, frame int, label_ord int, label string, h int, w int, logits array<float>"))

    found = {(r.label_ord, r.x, r.y, r.kind) for r in M.mask_errors(table(0), table(1)).collect()}
    want = {(k, x, y, kind) for k, (a, b) in enumerate(arrays) for kind, d in (("false_positive", b & ~a), ("false_negative", a & ~b)) for y, x in zip(*np.nonzero(d))}
    assert found == want


def test_images_without_pixels_keep_their_row(spark):
    rows = [("p", 0, 0, "m", 0, 4, []), ("p", 0, 1, "m", 1, 1, [1.0])]
    masks = logits_to_masks(spark.createDataFrame(rows, "participant_id string, frame int, label_ord int, label string, h int, w int, logits array<float>"))
    assert {r.label_ord: r.counts for r in masks.collect()}[1] == [0, 1] and masks.count() == 2


def test_own_rates_and_phase_default(spark):
    codes = spark.createDataFrame([(who, f, "ab"[f // 3 % 2]) for who in ("p", "q") for f in range(9)], "participant_id string, frame int, code string")
    rates = spark.createDataFrame([("p", 10.0), ("q", 20.0)], "participant_id string, fps double")
    events = collapse_runs(codes, None, rates=rates)
    assert {(r.participant_id, r.duration_ms) for r in events.collect()} == {("p", 300.0), ("q", 150.0)}
    scores = metrics.summary_scores(events, None, 0, wide=False, rates=rates)
    assert "temporal_dynamics_phase3" in scores.columns and "temporal_dynamics_phase4" not in scores.columns
    assert {(r.participant_id, r.aoi_name): r.dwell_time for r in scores.collect()} == {("p", "a"): 600.0, ("p", "b"): 300.0, ("q", "a"): 300.0, ("q", "b"): 150.0}


def test_score_arrays_go_to_their_best_object_like_pixels(spark):
    from saccade.operators import masks as M
    rng = np.random.default_rng(4)
    rows = [(p, f, o, 6, 7, [float(v) for v in rng.integers(-12, 4, 42)]) for p in "ab" for f in range(3) for o in range(1 + f)]
    logits = spark.createDataFrame(rows, "participant_id string, frame int, label_ord int, h int, w int, logits array<float>")
    plain = sorted(M.non_overlap(M.logit_pixels(logits)).select(*M.MASK_KEYS, "x", "y", "logit").collect())
    for block in (5, 42, 4096):
        left = M.non_overlap_scores(logits, block=block)
        assert left.columns == logits.columns
        assert sorted(M.logit_pixels(left).select(*M.MASK_KEYS, "x", "y", "logit").collect()) == plain
