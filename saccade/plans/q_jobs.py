"""Queries on the gaze mapping jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from saccade.operators.mapping import write_mask_index
from saccade.plans import jobs
from saccade.plans.fixtures import FPS, MAP_FPS, RUNS, V1, gaze_samples, mask_rows, mask_wearer, sessions
from saccade.plans.q_mapping import hits_sql
from saccade.plans.q_metrics import MS, OPEN_RUNS, SCORES_HEAD, seconds, targets_sql
from saccade.plans.registry import query
from saccade.session import scratch_path

LABELS = ["none", "obj0", "obj1", "obj2", "obj3"]


def mapped_sql(radius):
    """The mapped codes as view v1, so that the run and score SQL reads them."""
    head, final = hits_sql(radius).rsplit("\nSELECT v.participant_id, v.frame,", 1)
    head = head.replace("v1 AS", "ev AS", 1).replace("FROM v1", "FROM ev")
    return f"{head},\nv1 AS (SELECT v.participant_id, v.frame,{final})"


def wearing(spark, sf_dir):
    """Who looks at which masks: those of a mask participant, whose 25 frames go round."""
    return {"mask_owner": mask_wearer(spark, sf_dir, F.col("participant_id")), "mask_frame": F.col("frame") % 25}


def kept_index(spark, sf_dir, radius, masks=None):
    masks = mask_rows(spark, sf_dir) if masks is None else masks
    return write_mask_index(masks, scratch_path(spark, "masks"), radius=radius, buckets=8)


@query("e02_map_gaze", f"""{mapped_sql(1)}{OPEN_RUNS[len(V1):]}
SELECT *, {seconds('frame_duration')} AS duration_s, {seconds('start_frame')} AS start_s, {seconds('end_frame')} AS end_s FROM file_runs""")
def e02(spark, sf_dir):
    return jobs.map_gaze_runs(sessions(spark, sf_dir), gaze_samples(spark, sf_dir), mask_rows(spark, sf_dir), 8, 8, MAP_FPS, radius=1,
                              **wearing(spark, sf_dir))


def own_sql(sql):
    """The mapping SQL with sizes and rates of the participant's own, and masks by position: every fourth mask frame is missing."""
    sql = sql.replace("p.s.x * 8", "p.s.x * (6 + CAST(f.participant_id AS BIGINT) % 3)").replace("(1 - p.s.y) * 8", "(1 - p.s.y) * (8 - CAST(f.participant_id AS BIGINT) % 2)")
    sql = sql.replace("px < 8", "px < 6 + CAST(participant_id AS BIGINT) % 3").replace("py < 8", "py < 8 - CAST(participant_id AS BIGINT) % 2")
    sql = sql.replace("AND m.frame = v.frame % 25 AND", "AND m.frame = (v.framenum - 1) + (v.framenum + 1) // 3 AND")
    return sql.replace("fg AS (SELECT * FROM px WHERE logit > 0)", "fg AS (SELECT * FROM px WHERE logit > 0 AND frame % 4 <> 1)")


def own_sessions(spark, sf_dir):
    number = F.col("participant_id").cast("long")
    return sessions(spark, sf_dir).select("*", (6 + number % 3).alias("width"), (8 - number % 2).alias("height"), (20.96 + number % 7).alias("fps"))


def by_position(spark, sf_dir, radius):
    masks = mask_rows(spark, sf_dir).filter(F.col("frame") % 4 != 1)
    return {"align": "position", "index": kept_index(spark, sf_dir, radius, masks), "mask_owner": wearing(spark, sf_dir)["mask_owner"], "radius": radius}


OWN_RATE = "(20.96::DOUBLE + CAST(participant_id AS BIGINT) % 7)"


@query("e02b_map_gaze_own_sizes", f"""{own_sql(mapped_sql(1))}{OPEN_RUNS[len(V1):]}
SELECT *, {', '.join(f"round({c} / {OWN_RATE}, 2) AS {s}" for c, s in (('frame_duration', 'duration_s'), ('start_frame', 'start_s'), ('end_frame', 'end_s')))}
FROM file_runs""")
def e02b(spark, sf_dir):
    return jobs.map_gaze_runs(own_sessions(spark, sf_dir), gaze_samples(spark, sf_dir), None, **by_position(spark, sf_dir, 1))


@query("e07_end_to_end", mapped_sql(0) + SCORES_HEAD[len("WITH ") + len(V1):] + targets_sql(LABELS))
def e07(spark, sf_dir):
    return jobs.end_to_end(sessions(spark, sf_dir), gaze_samples(spark, sf_dir), mask_rows(spark, sf_dir), 8, 8, FPS, labels=LABELS,
                           **wearing(spark, sf_dir))


READ_BACK = """,
runs AS (SELECT participant_id, name AS aoi_name, frame_duration AS duration_frames, start_frame, end_frame FROM file_runs)"""


@query("e07b_end_to_end_files", own_sql(mapped_sql(0)) + OPEN_RUNS[len(V1):].replace("runs AS (\n  SELECT participant_id, min(code)", "own_runs AS (\n  SELECT participant_id, min(code)").replace(
    "FROM runs", "FROM own_runs") + READ_BACK + (SCORES_HEAD[len("WITH ") + len(RUNS):] + targets_sql(LABELS)).replace(MS, f"(1000.0::DOUBLE / {OWN_RATE})"))
def e07b(spark, sf_dir):
    return jobs.end_to_end(own_sessions(spark, sf_dir), gaze_samples(spark, sf_dir), None, labels=LABELS, end_mode="reference",
                           **by_position(spark, sf_dir, 0))
