"""Queries on column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from saccade.functions import geometry as G
from saccade.functions import numeric as N
from saccade.functions import timecode as T
from saccade.operators.sync import is_dark
from saccade.plans.fixtures import (
    FPS, MAP_FPS, V1, V2, V3, V5, V6, V7, V8, boxes, brightness, cohort, gaze_codes, gaze_samples, prompts, table,
    time_strings,
)
from saccade.plans.registry import query


@query("p01_safe_division", f"""WITH {V1}
SELECT event_id, CASE WHEN k % 4 = 0 THEN 0.0::DOUBLE ELSE value / CAST(k % 4 AS DOUBLE) END AS ratio FROM v1""")
def p01(spark, sf_dir):
    return gaze_codes(spark, sf_dir).select("event_id", N.safe_div(F.col("value"), (F.col("k") % 4).cast("double")).alias("ratio"))


@query("p02_frames_to_ms", f"""WITH {V1}
SELECT event_id, frame * (1000.0::DOUBLE / 30.0::DOUBLE) AS ms FROM v1""")
def p02(spark, sf_dir):
    return gaze_codes(spark, sf_dir).select("event_id", N.frames_to_ms(F.col("frame"), FPS).alias("ms"))


@query("p03_frames_to_seconds", f"WITH {V1} SELECT event_id, round(frame / 29.96::DOUBLE, 2) AS sec FROM v1")
def p03(spark, sf_dir):
    return gaze_codes(spark, sf_dir).select("event_id", N.frames_to_seconds(F.col("frame"), MAP_FPS).alias("sec"))


PIXELS = V2 + """,
placed AS (
  SELECT *, CAST(trunc(norm_x * 8) AS INTEGER) AS px, CAST(trunc((1 - norm_y) * 8) AS INTEGER) AS py FROM v2)"""


def placed(spark, sf_dir):
    return gaze_samples(spark, sf_dir, gaps=False).select(
        "*", G.gaze_pixel_x(F.col("norm_x"), 8).alias("px"), G.gaze_pixel_y(F.col("norm_y"), 8).alias("py"))


@query("p04_gaze_pixel", f"WITH {PIXELS} SELECT sample_seq, px, py FROM placed")
def p04(spark, sf_dir):
    return placed(spark, sf_dir).select("sample_seq", "px", "py")


@query("p05_gaze_valid", f"""WITH {PIXELS}
SELECT sample_seq, norm_x IS NOT NULL AND norm_y IS NOT NULL AND COALESCE(px BETWEEN 0 AND 7 AND py BETWEEN 0 AND 7, false) AS is_valid
FROM placed""")
def p05(spark, sf_dir):
    valid = G.gaze_is_valid(F.col("norm_x"), F.col("norm_y"), F.col("px"), F.col("py"), 8, 8)
    return placed(spark, sf_dir).select("sample_seq", valid.alias("is_valid"))


@query("p06_default_label", f"""WITH {V1} SELECT event_id, COALESCE(CASE WHEN k % 2 = 0 THEN code END, 'none') AS code FROM v1""")
def p06(spark, sf_dir):
    seen = F.when(F.col("k") % 2 == 0, F.col("code"))
    return gaze_codes(spark, sf_dir).select("event_id", F.coalesce(seen, F.lit("none")).alias("code"))


@query("p08_hms_to_seconds", f"""WITH {V7}
SELECT event_id, CAST(hh * 3600 + mi * 60 + se AS DOUBLE) AS long_form, CAST(mi * 60 + se AS DOUBLE) AS short_form FROM v7""")
def p08(spark, sf_dir):
    return time_strings(spark, sf_dir).select(
        "event_id", T.hms_to_seconds(F.col("hms")).alias("long_form"), T.hms_to_seconds(F.col("ms")).alias("short_form"))


@query("p09_msm_to_seconds", f"""WITH {V7}
SELECT event_id, CAST(mi * 60 + se AS DOUBLE) + mmm / 1000.0::DOUBLE AS long_form, CAST(mi * 60 + se AS DOUBLE) AS short_form FROM v7""")
def p09(spark, sf_dir):
    return time_strings(spark, sf_dir).select(
        "event_id", T.msm_to_seconds(F.col("msm")).alias("long_form"), T.msm_to_seconds(F.col("ms")).alias("short_form"))


@query("p10_seconds_to_frame", f"""WITH {V7},
t AS (SELECT event_id, CAST(mi * 60 + se AS DOUBLE) + mmm / 1000.0::DOUBLE AS sec, value FROM v7)
SELECT event_id, CAST(trunc(sec * 29.96::DOUBLE) AS BIGINT) AS frame,
       [CAST(trunc(sec * 30.0::DOUBLE) AS BIGINT), CAST(trunc(value * 30.0::DOUBLE) AS BIGINT)] AS frames FROM t""")
def p10(spark, sf_dir):
    sec = T.msm_to_seconds(F.col("msm"))
    return time_strings(spark, sf_dir).withColumn("sec", sec).select(
        "event_id", T.seconds_to_frame(F.col("sec"), MAP_FPS).alias("frame"),
        T.all_to_frames(F.array("sec", "value"), 30.0).alias("frames"))


@query("p11_shift_time", f"""WITH {V7},
t AS (SELECT event_id, CAST(mi * 60 + se AS DOUBLE) + mmm / 1000.0::DOUBLE AS sec, value, k FROM v7)
SELECT event_id, sec + (value - k) AS shifted, [sec + (value - k), value + (value - k)] AS all_shifted FROM t""")
def p11(spark, sf_dir):
    source, target = F.col("k").cast("double"), F.col("value")
    return time_strings(spark, sf_dir).withColumn("sec", T.msm_to_seconds(F.col("msm"))).select(
        "event_id", T.shift_to_target(F.col("sec"), source, target).alias("shifted"),
        T.shift_all(F.array("sec", "value"), source, target).alias("all_shifted"))


@query("p13_dark_frame", f"WITH {V3} SELECT recording_id, frame, brightness < 8.0 AS dark FROM v3")
def p13(spark, sf_dir):
    return brightness(spark, sf_dir).select("recording_id", "frame", is_dark(F.col("brightness"), 8.0).alias("dark"))


@query("p14_padded_id", f"WITH {V6} SELECT id, participant_id FROM sel")
def p14(spark, sf_dir):
    return cohort(spark, sf_dir).select("id", N.zero_padded_id(F.col("id")).alias("participant_id"))


@query("p15_path_template", f"""WITH {V6} SELECT id, 'data/' || participant_id || '/' || participant_id || '_coordinates.json' AS path FROM sel""")
def p15(spark, sf_dir):
    who = N.zero_padded_id(F.col("id"))
    return cohort(spark, sf_dir).select("id", N.fill_template("data/{id}/{id}_coordinates.json", who).alias("path"))


@query("p16_label_list", f"""WITH v AS (SELECT event_id, event_type || ' , ,  ' || user_id || ',' || CASE WHEN event_id % 2 = 0 THEN '' ELSE ' x y ' END AS t FROM events)
SELECT event_id, list_filter(list_transform(string_split(t, ','), lambda p: trim(p)), lambda p: p <> '') AS labels FROM v""")
def p16(spark, sf_dir):
    text = F.concat("event_type", F.lit(" , ,  "), F.col("user_id").cast("string"), F.lit(","),
                    F.when(F.col("event_id") % 2 == 0, "").otherwise(" x y "))
    return table(spark, sf_dir, "events").select("event_id", N.label_list(text).alias("labels"))


@query("p17_display_coordinates", f"""WITH {V8},
sized AS (SELECT seq, x, y, 640 + (seq % 7) * 300 AS w, 480 + (seq % 5) * 200 AS h FROM v8),
scaled AS (SELECT *, least(1280.0::DOUBLE / w, 720.0::DOUBLE / h) AS s FROM sized),
shown AS (SELECT *, CAST(trunc(w * s) AS BIGINT) AS dw, CAST(trunc(h * s) AS BIGINT) AS dh FROM scaled),
clicked AS (
  SELECT *, greatest(0, least(w - 1, CAST(trunc(x * w / CAST(dw AS DOUBLE)) AS BIGINT))) AS ox,
            greatest(0, least(h - 1, CAST(trunc(y * h / CAST(dh AS DOUBLE)) AS BIGINT))) AS oy FROM shown)
SELECT seq, dw, dh, ox, oy, CAST(trunc(ox * (CAST(dw AS DOUBLE) / w)) AS BIGINT) AS dx,
       CAST(trunc(oy * (CAST(dh AS DOUBLE) / h)) AS BIGINT) AS dy FROM clicked""")
def p17(spark, sf_dir):
    sized = prompts(spark, sf_dir).select(
        "seq", "x", "y", (F.lit(640) + (F.col("seq") % 7) * 300).alias("w"), (F.lit(480) + (F.col("seq") % 5) * 200).alias("h"))
    wide, high = G.display_size(F.col("w"), F.col("h"))
    shown = sized.select("*", wide.alias("dw"), high.alias("dh"))
    clicked = shown.select("*", G.display_to_image(F.col("x"), F.col("w"), F.col("dw")).alias("ox"),
                           G.display_to_image(F.col("y"), F.col("h"), F.col("dh")).alias("oy"))
    return clicked.select("seq", "dw", "dh", "ox", "oy", G.image_to_display(F.col("ox"), F.col("w"), F.col("dw")).alias("dx"),
                          G.image_to_display(F.col("oy"), F.col("h"), F.col("dh")).alias("dy"))


@query("p18_click_sign", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS positive FROM events""")
def p18(spark, sf_dir):
    mode = F.when(F.col("event_id") % 3 == 0, "Negative").otherwise("Positive")
    return table(spark, sf_dir, "events").select("event_id", N.click_sign(mode).alias("positive"))


@query("p19_model_coordinates", f"""WITH {V5}
SELECT g, id, x0 / 60.0::DOUBLE * 1024 AS mx0, y0 / 50.0::DOUBLE * 1024 AS my0, x1 / 60.0::DOUBLE * 1024 AS mx1, y1 / 50.0::DOUBLE * 1024 AS my1,
       x0 * 1024 AS ux0 FROM v5""")
def p19(spark, sf_dir):
    sides = {"mx0": ("x0", 60), "my0": ("y0", 50), "mx1": ("x1", 60), "my1": ("y1", 50)}
    return boxes(spark, sf_dir).select(
        "g", "id", *[G.model_coordinate(F.col(c), F.lit(size), 1024).alias(name) for name, (c, size) in sides.items()],
        G.model_coordinate(F.col("x0"), 60, 1024, normalize=False).alias("ux0"))


def box():
    return [F.col(c) for c in ("x0", "y0", "x1", "y1")]


@query("p20_box_xywh", f"WITH {V5} SELECT g, id, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h FROM v5")
def p20(spark, sf_dir):
    parts = G.box_width_height(*box())
    return boxes(spark, sf_dir).select("g", "id", *[p.alias(n) for p, n in zip(parts, "xywh")])


@query("p21_uncrop", f"""WITH {V5}
SELECT g, id, x0 + g % 100 AS x0, y0 + g % 50 AS y0, x1 + g % 100 AS x1, y1 + g % 50 AS y1, x0 + g % 100 AS px, y1 + g % 50 AS py FROM v5""")
def p21(spark, sf_dir):
    dx, dy = F.col("g") % 100, F.col("g") % 50
    moved = G.uncrop_box(box(), dx, dy)
    px, py = G.uncrop_point(F.col("x0"), F.col("y1"), dx, dy)
    return boxes(spark, sf_dir).select(
        "g", "id", *[m.alias(n) for m, n in zip(moved, ("x0", "y0", "x1", "y1"))], px.alias("px"), py.alias("py"))


@query("p23_near_crop_edge", f"""WITH {V5},
c AS (SELECT g, id, (g % 3) * 30 AS cx, (g % 2) * 25 AS cy, x0, y0, x1, y1 FROM v5)
SELECT g, id,
  (abs(x0 + cx - cx) <= 5 AND NOT abs(x0 + cx) <= 5) OR (abs(y0 + cy - cy) <= 5 AND NOT abs(y0 + cy) <= 5)
  OR (abs(x1 + cx - (cx + 45)) <= 5 AND NOT abs(x1 + cx - 100) <= 5) OR (abs(y1 + cy - (cy + 40)) <= 5 AND NOT abs(y1 + cy - 80) <= 5) AS near
FROM c""")
def p23(spark, sf_dir):
    cx, cy = (F.col("g") % 3) * 30, (F.col("g") % 2) * 25
    crop = [cx, cy, cx + 45, cy + 40]
    image = [F.lit(0), F.lit(0), F.lit(100), F.lit(80)]
    return boxes(spark, sf_dir).select("g", "id", G.near_crop_edge(box(), crop, image, 5.0).alias("near"))


@query("p26_prompt_error", f"""WITH {V8}
SELECT seq, CASE
  WHEN (seq % 5 = 0) <> (seq % 7 = 0) THEN 'points need as many labels, and labels need points'
  WHEN seq % 5 = 0 AND seq % 2 = 0 THEN 'the prompt has neither points nor a box'
  WHEN seq % 2 <> 0 AND seq % 3 = 0 THEN 'a box replaces earlier points' END AS error FROM v8""")
def p26(spark, sf_dir):
    seq = F.col("seq")
    points = F.when(seq % 5 != 0, F.array("x", "y"))
    labels = F.when(seq % 7 != 0, F.array("positive"))
    corners = F.when(seq % 2 != 0, F.array("x", "y", "x", "y"))
    return prompts(spark, sf_dir).select("seq", G.prompt_error(points, labels, corners, seq % 3 != 0).alias("error"))


@query("p27_box_corners", f"""WITH {V8},
pts AS (
  SELECT seq, 0 AS place, x, y, 2 AS label FROM v8 WHERE seq % 2 = 1
  UNION ALL SELECT seq, 1, x + 5, y + 7, 3 FROM v8 WHERE seq % 2 = 1
  UNION ALL SELECT seq, CASE WHEN seq % 2 = 1 THEN 2 ELSE 0 END, x, y, positive FROM v8)
SELECT * FROM pts""")
def p27(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    corners = F.when(F.col("seq") % 2 == 1, F.array(x, y, x + 5, y + 7))
    points = F.array(F.struct("x", "y", F.col("positive").alias("label")))
    joined = prompts(spark, sf_dir).select("seq", F.posexplode(G.with_box_corners(points, corners)).alias("place", "p"))
    return joined.select("seq", "place", "p.x", "p.y", "p.label")
