"""Labels that differ in case or are many, prompt documents in parts, thresholds and folders."""

import pytest

from saccade.operators import cohort as C
from saccade.operators import metrics as M
from saccade.operators import prompts as P
from saccade.operators.suppression import nms
from saccade.plans import jobs

EVENTS = "participant_id string, aoi_name string, duration_frames int, start_frame int, end_frame int"


def test_wide_scores_with_labels_equal_but_for_case(spark):
    rows = [("p", label, 2, 2 * i, 2 * i + 2) for i, label in enumerate(["none", "None", "none", "None", "None"])]
    scores = M.summary_scores(spark.createDataFrame(rows, EVENTS), 10.0)
    got = {r["aoi_name"]: (r["transition_probability_to_None"], r["transition_probability_to_none_2"]) for r in scores.collect()}
    assert got == {"none": (1.0, 0.0), "None": (0.5, 0.5)}


def test_wide_scores_with_many_labels(spark):
    rows = [("p", f"a{i:04}", 1, i, i + 1) for i in range(300)]
    scores = M.summary_scores(spark.createDataFrame(rows, EVENTS), 10.0)
    row = scores.where("aoi_name = 'a0007'").first()
    assert row["transition_probability_to_a0008"] == 1.0 and row["transition_probability_to_a0009"] == 0.0


def test_long_forms_hold_every_label(spark):
    events = spark.createDataFrame([("p", "a", 1, 0, 1), ("p", "b", 1, 1, 2), ("q", "c", 1, 4, 5)], EVENTS)
    grid = {(r[0], r[1]): r[2] for r in M.latency_grid(events, 10.0).collect()}
    assert len(grid) == 6 and grid["q", "a"] == M.NEVER_FIXATED and grid["q", "c"] == 400.0
    matrix = {tuple(r[:3]): r.probability for r in M.transition_matrix(events).collect()}
    assert len(matrix) == 9 and matrix["p", "a", "b"] == 1.0 and matrix["q", "c", "a"] == 0.0


def test_object_numbers_hold_over_parts(spark):
    rows = [("7", i, label, i, i, 2 * i, 1) for i, label in enumerate(["buy", "click", "view", "click"])]
    clicks = spark.createDataFrame(rows, "participant_id string, seq long, label string, frame int, x int, y int, positive int")
    documents = P.prompt_json(clicks, ["click", "view", "buy"], 2)
    assert documents.count() == 2
    numbers = {(r.label, r.object_id) for r in P.label_ids(documents).collect()}
    assert numbers == {("click", 0), ("view", 1), ("buy", 2)}
    objects = {(r.label, r.frame): (r.x, r.object_id) for r in jobs.prompt_objects(documents).collect()}
    assert objects == {("buy", 0): (0, 2), ("click", 1): (1, 0), ("view", 2): (2, 1), ("click", 3): (3, 0)}


@pytest.mark.parametrize("n", [3, 70])
def test_threshold_of_one_keeps_all(spark, n):
    boxes = spark.createDataFrame([("g", i, 0, 0, 10, 10, float(i)) for i in range(n)],
                                  "g string, id long, x0 int, y0 int, x1 int, y1 int, score double")
    assert nms(boxes, ["g"], 0.9999).count() == 1
    assert nms(boxes, ["g"], 1.0).count() == n
    assert nms(boxes, ["g"], 0.0).count() == 1
    with pytest.raises(ValueError):
        nms(boxes, ["g"], -0.1)


def test_empty_frame_folder(spark):
    cohort = C.select_ids(spark.range(1, 3), "id")
    metadata = spark.createDataFrame([(1, 0, 9, 0), (2, 0, 9, 1)], "id long, start_frame int, end_frame int, seq long")
    paths = cohort.selectExpr("concat(participant_id, '.json') AS path")
    none = spark.createDataFrame([], "id long")
    found = C.readiness(cohort, metadata, paths, none, none, "{id}.json", extraction_enabled=False,
                        folders=spark.createDataFrame([(1,)], "id long"))
    assert [r.status for r in found.orderBy("participant_id").collect()] == ["SUCCESS", "FAILED"]
