import numpy as np
import pytest
from pyspark.sql import functions as F

from saccade.functions import geometry as G
from saccade.functions import timecode as T
from saccade.functions.numeric import zero_padded_id
from saccade.operators import cohort as C
from saccade.operators import mapping
from saccade.operators import prompts as P
from saccade.operators import sync as S
from saccade.operators.components import logits_to_masks
from saccade.plans import jobs


def masks_of(spark, arrays):
    rows = [("p", f, o, f"m{o}", a.shape[0], a.shape[1], [float(v) for v in np.where(a, 1.0, -1.0).ravel()]) for (f, o), a in arrays.items()]
    return logits_to_masks(spark.createDataFrame(
        rows, "participant_id string, frame int, label_ord int, label string, h int, w int, logits array<float>"))


@pytest.mark.parametrize("radius", [0, 2])
def test_hit_test_against_plain_code(spark, radius):
    rng = np.random.default_rng(4)
    h, w = 20, 40
    arrays = {(f, o): rng.random((h, w)) < 0.02 + 0.2 * (radius == 0) for f in range(2) for o in range(2)}
    points = [("p", f, int(x), int(y), True) for f in range(2) for x, y in zip(rng.integers(0, w, 60), rng.integers(0, h, 60))]
    points += [("p", 0, 0, 0, True), ("p", 0, w - 1, h - 1, True), ("p", 0, 5, 5, False)]
    df = spark.createDataFrame(points, "participant_id string, frame int, px int, py int, is_valid boolean")
    ys, xs = np.mgrid[0:h, 0:w]
    for r in mapping.hit_test(df, masks_of(spark, arrays), radius=radius).collect():
        disc = (xs - r.px) ** 2 + (ys - r.py) ** 2 <= radius * radius
        want = next((f"m{o}" for o in range(2) if (arrays[r.frame, o] & disc).any()), "none") if r.is_valid else "none"
        assert r.code == want


def test_map_gaze_edges_and_alignment(spark):
    sessions = spark.createDataFrame([("p", 10, 16)], "participant_id string, start_frame int, end_frame int")
    gaze = spark.createDataFrame(
        [("p", 1, 10, 0.0, 1.0), ("p", 2, 10, 0.9, 0.1), ("p", 3, 11, -0.05, 1.0), ("p", 4, 12, -0.3, 1.0),
         ("p", 5, 13, float("nan"), 0.5), ("p", 6, 14, 5.0, 0.5)],
        "participant_id string, sample_seq long, world_index int, norm_x double, norm_y double")
    corner = np.zeros((4, 4), bool)
    corner[0, 0] = True
    masks = masks_of(spark, {(f, 0): corner for f in range(10, 16)})
    got = mapping.map_gaze(sessions, gaze, masks, 4, 4).orderBy("frame").collect()
    assert [(r.frame, r.framenum) for r in got] == [(f, f - 9) for f in range(10, 16)]
    assert [r.code for r in got] == ["m0", "m0", "none", "none", "none", "none"]
    early = masks_of(spark, {(f, 0): corner for f in range(0, 6)})
    assert {r.code for r in mapping.map_gaze(sessions, gaze, early, 4, 4).collect()} == {"none"}
    placed = mapping.map_gaze(sessions, gaze, early, 4, 4, align="position").orderBy("frame").collect()
    assert [r.code for r in placed] == ["m0", "m0", "none", "none", "none", "none"]
    runs = jobs.map_gaze_runs(sessions, gaze, masks, 4, 4, 10.0).orderBy("start_frame").collect()
    assert [(r.name, r.frame_duration, r.start_frame, r.end_frame) for r in runs] == [("m0", 2, 10, 12), ("none", 4, 11, 15)]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_scalars(spark):
    assert [one(spark, zero_padded_id(F.lit(n))) for n in (5, 510, 12345)] == ["005", "510", "12345"]
    assert one(spark, T.hms_to_seconds(F.lit(" 01:02:03 "))) == 3723.0
    assert one(spark, T.hms_to_seconds(F.lit("02:03"))) == 123.0
    assert one(spark, T.hms_to_seconds(F.lit("x:03"))) is None
    assert one(spark, T.msm_to_seconds(F.lit("01:02:250"))) == 62.25
    assert one(spark, T.seconds_to_frame(F.lit(-0.5), 3.0)) == -1
    assert one(spark, G.gaze_pixel_x(F.lit(-0.05), 10)) == 0
    assert one(spark, G.display_to_image(F.lit(5000), F.lit(1920), F.lit(1280))) == 1919


def click_rows(spark):
    rows = [("p", 1, "a", 3, 1, 1, 1), ("p", 2, "b", 3, 2, 2, 0), ("p", 3, "a", 3, 5, 6, 1), ("p", 4, "c", 9, 7, 7, 1), ("q", 5, "b", 1, 0, 0, 1)]
    return spark.createDataFrame(rows, "participant_id string, seq long, label string, frame int, x int, y int, positive int")


def test_prompts(spark):
    clicks = click_rows(spark)
    last = {(r.participant_id, r.label, r.frame): r.x for r in P.effective_prompts(clicks).collect()}
    assert last["p", "a", 3] == 5 and len(last) == 4
    left = P.undo_last_click(clicks, spark.createDataFrame([("p", 3), ("p", 77)], "participant_id string, frame int"))
    assert sorted(r.seq for r in left.collect()) == [1, 2, 4, 5]
    for size in (1, 2, 100):
        documents = P.prompt_json(clicks, ["b", "a"], size)
        texts = {(r.participant_id, r.part): r.json for r in documents.collect()}
        back = P.parse_prompt_json(documents).filter("participant_id = 'p'").orderBy("part", "label_ord", "click_ord").collect()
        assert sorted((r.label, r.x, r.y) for r in back) == [("a", 1, 1), ("a", 5, 6), ("b", 2, 2)]
    assert texts["p", 0].startswith('{"b":[{"x":2,"y":2,"positive":0,"label":"b","frame":3}],"a":')
    ids = {(r.participant_id, r.label): r.object_id for r in P.dense_object_ids(clicks).collect()}
    assert ids == {("p", "a"): 0, ("p", "b"): 1, ("p", "c"): 2, ("q", "b"): 0}


def nearest(frame, marks, k):
    """marks: frame to order of first click."""
    before = [t for t in marks if t < frame]
    after = [t for t in marks if t >= frame]
    chosen = ([max(before)] if before else []) + ([min(after)] if after else [])
    rest = sorted((t for t in sorted(marks, key=marks.get) if t not in chosen), key=lambda t: abs(t - frame))
    return set(chosen + rest[: k - len(chosen)])


@pytest.mark.parametrize("k", [2, 4])
def test_nearest_prompts(spark, k):
    marks = {30: 0, 10: 1, 20: 2, 13: 3, 26: 4, 40: 5}
    prompts = spark.createDataFrame([("p", t, s) for t, s in marks.items()], "participant_id string, frame int, seq long")
    frames = spark.createDataFrame([("p", f) for f in range(0, 50)], "participant_id string, frame int")
    got = {}
    for r in P.nearest_prompts(frames, prompts, k).collect():
        got.setdefault(r.frame, set()).add(r.prompt_frame)
    assert got == {f: nearest(f, marks, k) for f in range(50)}
    with pytest.raises(ValueError):
        P.nearest_prompts(frames, prompts, 1)


def test_tracked_frames(spark):
    clicks = click_rows(spark)
    sizes = spark.createDataFrame([("p", 12), ("q", 3)], "participant_id string, num_frames int")
    ahead = P.tracked_frames(clicks, sizes).filter("participant_id = 'p'").orderBy("step").collect()
    assert [r.frame for r in ahead] == list(range(3, 12))
    back = P.tracked_frames(clicks, sizes, limit=2, reverse=True).orderBy("participant_id", "step").collect()
    assert [(r.participant_id, r.frame) for r in back] == [("p", 3), ("p", 2), ("p", 1), ("q", 1), ("q", 0)]


def test_lights(spark):
    series = {"normal": [9, 1, 2, 9, 9], "never_dark": [9, 9, 9], "dark_to_end": [9, 1, 1], "bright_start": [9, 9, 1, 9]}
    rows = [(r, i, i / 10, float(v)) for r, values in series.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "recording_id string, frame int, ts_sec double, brightness double")
    got = {r.recording_id: r.lights_on_frame for r in S.lights_on(df, 10.0, threshold=5.0).collect()}
    assert got == {"normal": 4, "bright_start": 4}
    assert S.lights_on(df, 10.0, end_sec=0.3, threshold=5.0).count() == 0
    pairs = spark.createDataFrame(
        [("1", "normal", "bright_start"), ("2", "never_dark", "normal"), ("3", "normal", "dark_to_end"), ("4", "gone", "normal"), ("5", "normal", "gone")],
        "participant_id string, reference_video string, target_video string")
    notes = {r.participant_id: (r.offset_sec, r.notes) for r in jobs.sync_recordings(pairs, df, 10.0, 0.0, threshold=5.0).collect()}
    assert notes["1"] == (0.0, "")
    assert notes["2"][1] == S.NOTE_NO_REFERENCE and notes["3"][1] == S.NOTE_NO_TARGET
    assert notes["4"][1].endswith("gone") and notes["5"] == (None, "Cannot open video: gone")


def test_readiness_order(spark):
    cohort = C.select_range(spark, 1, 5)
    metadata = spark.createDataFrame([(1, 0, 10, 1), (1, 5, 50, 2), (2, 0, 10, 3), (3, 1, 4, 4), (5, 0, 9, 5)], "id long, start_frame int, end_frame int, seq long")
    files = spark.createDataFrame([("001.json",), ("003.json",), ("004.json",)], "path string")
    frames = spark.createDataFrame([(1, f) for f in range(4)], "id long, file int")
    states, report = jobs.cohort_readiness(cohort, metadata, files, frames, spark.createDataFrame([(9,)], "id long"), "{id}.json", video_pattern="{id}.mp4")
    got = {r.participant_id: (r.status, r.details) for r in states.collect()}
    assert got == {"001": ("SUCCESS", ""), "002": ("FAILED", C.REASON_NO_PROMPT), "003": ("FAILED", C.REASON_NO_FRAMES),
                   "004": ("SKIPPED", C.REASON_NOT_LISTED), "005": ("FAILED", C.REASON_NO_PROMPT)}
    first = states.filter("participant_id = '001'").first()
    assert (first.start_frame, first.n_files, first.last_frame) == (0, 4, 3)
    assert tuple(report.first()) == (5, 1, 3, 1, 20, 1)
