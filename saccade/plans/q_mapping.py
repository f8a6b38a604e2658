"""Queries on gaze-to-mask mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from saccade.operators import mapping as G
from saccade.operators.ordered import frame_chunk, ranked
from saccade.plans.fixtures import SESSIONS, V1, V2, V4, WEARER, gaze_codes, gaze_samples, mask_rows, mask_wearer, sessions
from saccade.plans.registry import query


def seen(spark, sf_dir):
    frames = G.frame_range(sessions(spark, sf_dir))
    return G.gaze_pixels(G.first_gaze_per_frame(frames, gaze_samples(spark, sf_dir)), 8, 8)


def keyed_masks(spark, sf_dir):
    return mask_rows(spark, sf_dir).withColumnRenamed("participant_id", "mask_participant").withColumnRenamed("frame", "mask_frame")


def keyed_points(spark, sf_dir):
    return seen(spark, sf_dir).withColumn("mask_participant", mask_wearer(spark, sf_dir, F.col("participant_id"))).withColumn(
        "mask_frame", F.col("frame") % 25)


@query("j01_first_gaze", f"WITH {V2}, {SESSIONS} SELECT participant_id, frame, framenum, norm_x, norm_y FROM seen")
def j01(spark, sf_dir):
    frames = G.frame_range(sessions(spark, sf_dir))
    return G.first_gaze_per_frame(frames, gaze_samples(spark, sf_dir)).select(
        "participant_id", "frame", "framenum", "norm_x", "norm_y")


def hits_sql(radius):
    near = f"(m.x - v.px) * (m.x - v.px) + (m.y - v.py) * (m.y - v.py) <= {radius * radius}"
    return f"""WITH {V2}, {SESSIONS}, {V4},
fg AS (SELECT * FROM px WHERE logit > 0),
wearing AS (SELECT *, {WEARER} AS wearer FROM valid),
hits AS (
  SELECT v.participant_id, v.frame, arg_min(m.label, m.label_ord) AS label
  FROM wearing v JOIN fg m ON m.participant_id = v.wearer
    AND m.frame = v.frame % 25 AND v.is_valid AND {near}
  GROUP BY ALL)
SELECT v.participant_id, v.frame, COALESCE(h.label, 'none') AS code
FROM valid v LEFT JOIN hits h USING (participant_id, frame)"""


def hits(radius):
    def run(spark, sf_dir):
        return G.hit_test(keyed_points(spark, sf_dir), keyed_masks(spark, sf_dir), ["mask_participant", "mask_frame"], radius).select(
            "participant_id", "frame", "code")
    return run


query("j02_gaze_in_mask", hits_sql(0))(hits(0))
query("j03_gaze_disc_hits_mask", hits_sql(1))(hits(1))
query("j03b_wide_gaze_disc", hits_sql(3))(hits(3))


@query("j04_first_label", f"""WITH {V2}, {SESSIONS}, {V4},
fg AS (SELECT * FROM px WHERE logit > 0),
wearing AS (SELECT *, {WEARER} AS wearer FROM valid)
SELECT v.participant_id, v.frame, min(m.label_ord) AS label_ord, count(*) AS candidates
FROM wearing v JOIN fg m ON m.participant_id = v.wearer
  AND m.frame = v.frame % 25 AND v.is_valid AND m.x = v.px AND m.y = v.py
GROUP BY ALL""")
def j04(spark, sf_dir):
    keys = ["mask_participant", "mask_frame"]
    masks = keyed_masks(spark, sf_dir)
    found = keyed_points(spark, sf_dir).filter("is_valid").join(
        G.column_segments(masks, [*keys, "label_ord"]).withColumnRenamed("x", "px"), [*keys, "px"])
    return found.filter(F.col("py").between(F.col("y0"), F.col("y1"))).groupBy("participant_id", "frame").agg(
        F.min("label_ord").alias("label_ord"), F.count(F.lit(1)).alias("candidates"))


@query("j05_masks_by_position", f"""WITH {V4},
frames AS (SELECT DISTINCT participant_id, frame + 3 AS frame FROM v4),
a AS (SELECT *, row_number() OVER (PARTITION BY participant_id ORDER BY frame) AS p FROM frames),
b AS (SELECT participant_id, frame AS mask_frame, row_number() OVER (PARTITION BY participant_id ORDER BY frame) AS p
      FROM (SELECT DISTINCT participant_id, frame FROM v4 WHERE frame % 4 <> 1))
SELECT a.participant_id, a.frame, b.mask_frame FROM a LEFT JOIN b USING (participant_id, p)""")
def j05(spark, sf_dir):
    masks = mask_rows(spark, sf_dir)
    frames = masks.select("participant_id", (F.col("frame") + 3).alias("frame")).distinct()
    return G.attach_masks(frames, masks.filter(F.col("frame") % 4 != 1), align="position").select(
        "participant_id", "frame", "mask_frame")


@query("j05b_masks_by_frame", f"""WITH {V4},
frames AS (SELECT DISTINCT participant_id, frame + 3 AS frame FROM v4)
SELECT f.participant_id, f.frame, m.frame AS mask_frame
FROM frames f LEFT JOIN (SELECT DISTINCT participant_id, frame FROM v4) m USING (participant_id, frame)""")
def j05b(spark, sf_dir):
    masks = mask_rows(spark, sf_dir)
    frames = masks.select("participant_id", (F.col("frame") + 3).alias("frame")).distinct()
    return G.attach_masks(frames, masks).select("participant_id", "frame", "mask_frame")


@query("w05_position_index", f"""WITH {V1}
SELECT participant_id, event_id, row_number() OVER (PARTITION BY participant_id ORDER BY event_id) - 1 AS position FROM v1""")
def w05(spark, sf_dir):
    codes = gaze_codes(spark, sf_dir).select("participant_id", "event_id")
    return ranked(codes, ["participant_id"], ["event_id"], frame_chunk(F.col("event_id")), "place").select(
        "participant_id", "event_id", (F.col("place") - 1).alias("position"))


@query("w06_relative_frame", f"WITH {V2}, {SESSIONS} SELECT participant_id, frame, frame - start_frame + 1 AS framenum FROM frames")
def w06(spark, sf_dir):
    return G.frame_range(sessions(spark, sf_dir)).select("participant_id", "frame", "framenum")
