"""Queries on recordings and on cohorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from saccade.operators import cohort as C
from saccade.operators import sync as S
from saccade.plans import jobs
from saccade.plans.fixtures import (
    MAP_FPS, PAIRS, PROMPT_FILE, V3, V6, brightness, cohort, frame_files, frame_metadata, gaze_codes, prompt_files,
    recording_pairs, table,
)
from saccade.plans.registry import query

ANCHORS = V3 + """,
scan AS (SELECT *, brightness < 8.0 AS dark FROM v3 WHERE frame BETWEEN 5 AND 60),
d AS (SELECT recording_id, min(frame) AS f FROM scan WHERE dark GROUP BY 1),
anchors AS (
  SELECT s.recording_id, min(s.frame) + 1 AS lights_on_frame, arg_min(s.ts_sec, s.frame) AS lights_on_sec
  FROM scan s JOIN d USING (recording_id) WHERE NOT s.dark AND s.frame > d.f GROUP BY 1)"""


def anchors(spark, sf_dir):
    return S.lights_on(brightness(spark, sf_dir), 1.0, 5.0, 61.0, 8.0)


@query("w04_lights_on", f"WITH {ANCHORS} SELECT * FROM anchors")
def w04(spark, sf_dir):
    return anchors(spark, sf_dir)


@query("w04b_lights_on_own_rates", "WITH " + ANCHORS.replace(
    "frame BETWEEN 5 AND 60", "frame >= 5 * (1 + CAST(recording_id AS BIGINT) % 3) AND frame < 61 * (1 + CAST(recording_id AS BIGINT) % 3)")
    + " SELECT * FROM anchors")
def w04b(spark, sf_dir):
    """Recordings of one, two and three frames a second."""
    rated = brightness(spark, sf_dir).withColumn("fps", (F.col("recording_id").cast("long") % 3 + 1).cast("double"))
    return S.lights_on(rated, F.col("fps"), 5.0, 61.0, 8.0)


def four(column):
    return f"round({column}, 4)"


# The whole recordings, from the default start of the search.
OFFSETS = ANCHORS.replace("frame BETWEEN 5 AND 60", "frame >= 2") + f""", {PAIRS},
opened AS (SELECT DISTINCT recording_id, true AS o FROM v3),
matched AS (
  SELECT participant_id, reference_video, target_video, a.lights_on_sec AS r, b.lights_on_sec AS t, oa.o AS ro, ob.o AS tgt_o
  FROM pairs LEFT JOIN opened oa ON oa.recording_id = reference_video LEFT JOIN anchors a ON a.recording_id = reference_video
  LEFT JOIN opened ob ON ob.recording_id = target_video LEFT JOIN anchors b ON b.recording_id = target_video),
offsets AS (
  SELECT participant_id, {four('r')} AS reference_lights_on_sec, CASE WHEN r IS NOT NULL THEN {four('t')} END AS target_lights_on_sec,
    {four('t - r')} AS offset_sec,
    CASE WHEN ro IS NULL THEN 'Cannot open video: ' || reference_video WHEN r IS NULL THEN 'Lights-on not detected in reference video'
         WHEN tgt_o IS NULL THEN 'Cannot open video: ' || target_video WHEN t IS NULL THEN 'Lights-on not detected in target video' ELSE '' END AS notes
  FROM matched)"""


def offsets(spark, sf_dir):
    return jobs.sync_recordings(recording_pairs(spark, sf_dir), brightness(spark, sf_dir), 1.0, threshold=8.0)


@query("j09_sync_offsets", f"WITH {OFFSETS} SELECT * FROM offsets")
def j09(spark, sf_dir):
    return offsets(spark, sf_dir)


ALIGNED = OFFSETS + """,
aligned AS (
  SELECT event_id, v1.participant_id, value AS t_sec, value + (target_lights_on_sec - reference_lights_on_sec) AS target_sec
  FROM v1 JOIN offsets USING (participant_id) WHERE offset_sec IS NOT NULL)"""


def timed_events(spark, sf_dir):
    return gaze_codes(spark, sf_dir).select("event_id", "participant_id", F.col("value").alias("t_sec"))


@query("j10_aligned_events", f"WITH {ALIGNED} SELECT *, CAST(trunc(target_sec * 29.96::DOUBLE) AS BIGINT) AS target_frame FROM aligned")
def j10(spark, sf_dir):
    return jobs.align_to_target(timed_events(spark, sf_dir), offsets(spark, sf_dir), MAP_FPS)


@query("e03_sync", f"""WITH {ALIGNED}
SELECT participant_id, offset_sec, notes, count(event_id) AS events, min(target_sec) AS first_sec, max(target_sec) AS last_sec
FROM offsets LEFT JOIN aligned USING (participant_id) GROUP BY ALL""")
def e03(spark, sf_dir):
    found = offsets(spark, sf_dir)
    moved = jobs.align_to_target(timed_events(spark, sf_dir), found, MAP_FPS).groupBy("participant_id").agg(
        F.count(F.lit(1)).alias("events"), F.min("target_sec").alias("first_sec"), F.max("target_sec").alias("last_sec"))
    return found.join(moved, "participant_id", "left").select(
        "participant_id", "offset_sec", "notes", F.coalesce("events", F.lit(0)).alias("events"), "first_sec", "last_sec")


def selected(spark, sf_dir):
    return C.select_ids(cohort(spark, sf_dir), "id")


@query("j06_frame_ranges", f"WITH {V6} SELECT id, participant_id, start_frame, end_frame FROM sel LEFT JOIN meta USING (id)")
def j06(spark, sf_dir):
    return C.with_frame_ranges(selected(spark, sf_dir), frame_metadata(spark, sf_dir))


@query("j07_prompt_files", f"""WITH {V6}
SELECT id, participant_id, 'prompts/' || participant_id || '_coordinates.json' AS prompt_file, id IN (SELECT id FROM prompted) AS has_prompt FROM sel""")
def j07(spark, sf_dir):
    return C.with_prompt_flag(selected(spark, sf_dir), prompt_files(spark, sf_dir), PROMPT_FILE)


@query("j08_frames_available", f"""WITH {V6}
SELECT id, n_files IS NOT NULL OR id % 3 <> 0 AS with_video, n_files IS NOT NULL OR (id % 2 = 0 AND id % 3 <> 0) AS disabled, true AS no_pattern
FROM sel LEFT JOIN counted USING (id)""")
def j08(spark, sf_dir):
    counted = cohort(spark, sf_dir).join(C.frame_counts(frame_files(spark, sf_dir)), "id", "left")
    files = F.coalesce(F.col("n_files") > 0, F.lit(False))
    folder, video = F.col("id") % 2 == 0, F.col("id") % 3 != 0
    return counted.select(
        "id", C.frames_available(files, folder, True, "videos/{id}.mp4", video).alias("with_video"),
        C.frames_available(files, folder, False, "videos/{id}.mp4", video).alias("disabled"),
        C.frames_available(files, folder, True, "", video).alias("no_pattern"))


@query("a22_frame_counts", f"""WITH {V6}
SELECT id, participant_id, start_frame, end_frame, COALESCE(n_files, 0) AS n_files,
       CASE WHEN n_files > 0 THEN n_files - 1 ELSE end_frame - start_frame END AS last_frame
FROM sel LEFT JOIN meta USING (id) LEFT JOIN counted USING (id)""")
def a22(spark, sf_dir):
    listed = C.with_frame_ranges(selected(spark, sf_dir), frame_metadata(spark, sf_dir))
    return C.with_frame_counts(listed, frame_files(spark, sf_dir))


STATES = V6 + """,
states AS (
  SELECT participant_id, start_frame, end_frame, COALESCE(n_files, 0) AS n_files,
    CASE WHEN n_files > 0 THEN n_files - 1 ELSE end_frame - start_frame END AS last_frame,
    CASE WHEN start_frame IS NULL THEN 'Not in metadata' WHEN id NOT IN (SELECT id FROM prompted) THEN 'Prompt file not found'
         WHEN n_files IS NULL AND id % 3 = 0 THEN 'Frame extraction failed' ELSE '' END AS details
  FROM sel LEFT JOIN meta USING (id) LEFT JOIN counted USING (id)),
results AS (SELECT *, CASE details WHEN '' THEN 'SUCCESS' WHEN 'Not in metadata' THEN 'SKIPPED' ELSE 'FAILED' END AS status FROM states)"""


def states(spark, sf_dir):
    videos = cohort(spark, sf_dir).filter(F.col("id") % 3 != 0)
    return jobs.cohort_readiness(selected(spark, sf_dir), frame_metadata(spark, sf_dir), prompt_files(spark, sf_dir),
                                 frame_files(spark, sf_dir), videos, PROMPT_FILE, video_pattern="videos/{id}.mp4")


@query("e04_readiness", f"WITH {STATES} SELECT * FROM results")
def e04(spark, sf_dir):
    return states(spark, sf_dir)[0]


@query("a15_batch_report", f"""WITH {STATES},
n AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'SUCCESS') AS successful, count(*) FILTER (WHERE status = 'FAILED') AS failed,
      count(*) FILTER (WHERE status = 'SKIPPED') AS skipped FROM results)
SELECT *, 100 * successful // greatest(total, 1) AS success_percent, CASE WHEN failed = 0 THEN 0 ELSE 1 END AS exit_code FROM n""")
def a15(spark, sf_dir):
    return states(spark, sf_dir)[1]


@query("a15b_rerun_list", f"WITH {STATES} SELECT participant_id, details FROM results WHERE status = 'FAILED'")
def a15b(spark, sf_dir):
    return C.rerun_list(states(spark, sf_dir)[0])


PIXEL_VALUE = "CAST(trunc(abs(CAST(embedding[{i}] AS DOUBLE)) * 400) AS INTEGER)"
GRAYS = f"""
p AS (SELECT vec_id, embedding, unnest(range(21)) AS p FROM embeddings),
rgb AS (SELECT vec_id, {PIXEL_VALUE.format(i='3 * p + 1')} AS r, {PIXEL_VALUE.format(i='3 * p + 2')} AS g, {PIXEL_VALUE.format(i='3 * p + 3')} AS b FROM p),
gray AS (SELECT vec_id, sum((r * 299 + g * 587 + b * 114 + 500) // 1000) / CAST(count(*) AS DOUBLE) AS brightness FROM rgb GROUP BY 1)"""


@query("p12_pixel_brightness", f"WITH {GRAYS} SELECT vec_id, brightness FROM gray")
def p12(spark, sf_dir):
    def value(place):
        return (F.abs(F.element_at("embedding", place).cast("double")) * 400).cast("int")
    pixels = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("p"))
    named = pixels.select("vec_id", value(F.col("p") * 3 + 1).alias("red"), value(F.col("p") * 3 + 2).alias("green"),
                          value(F.col("p") * 3 + 3).alias("blue"))
    return S.pixel_brightness(named, ["vec_id"])
