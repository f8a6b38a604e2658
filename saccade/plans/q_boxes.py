"""Queries on boxes and mask candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from saccade.operators import candidates as K
from saccade.operators.suppression import box_overlaps, nms, overlap_summary
from saccade.plans.fixtures import IOU, V4, V5, boxes, mask_logits
from saccade.plans.registry import query


def iou_sql(a, b):
    wide = f"greatest(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0), 0)"
    high = f"greatest(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0), 0)"
    areas = " + ".join(f"({s}.x1 - {s}.x0) * ({s}.y1 - {s}.y0)" for s in (a, b))
    return f"({wide} * {high}) / CAST(NULLIF({areas} - {wide} * {high}, 0) AS DOUBLE)"


def nms_sql(source, group, order, threshold, name):
    """Greedy suppression as a fold over the boxes of a group, best first."""
    keys = ", ".join(group)
    return f"""
{name}_lists AS (
  SELECT {keys}, list({{'id': CAST(id AS BIGINT), 'x0': CAST(x0 AS BIGINT), 'y0': CAST(y0 AS BIGINT), 'x1': CAST(x1 AS BIGINT), 'y1': CAST(y1 AS BIGINT)}} ORDER BY {order}, id) AS bs
  FROM {source} GROUP BY {keys}),
{name}_folded AS (
  SELECT {keys}, list_reduce(bs, lambda acc, b: CASE WHEN len(list_filter(acc, lambda k: {iou_sql('k', 'b')} > {threshold})) = 0
                                                  THEN list_append(acc, b) ELSE acc END,
         CAST([] AS STRUCT(id BIGINT, x0 BIGINT, y0 BIGINT, x1 BIGINT, y1 BIGINT)[])) AS kept FROM {name}_lists),
{name} AS (SELECT {keys}, k.id AS id FROM (SELECT {keys}, unnest(kept) AS k FROM {name}_folded))"""


@query("j13_box_overlaps", f"""WITH {V5},
d AS (SELECT g, x0, y0, x1, y1, count(*) AS copies FROM v5 GROUP BY ALL),
p AS (SELECT a.g, a.x0 AS a_x0, a.y0 AS a_y0, a.x1 AS a_x1, a.y1 AS a_y1, a.copies AS a_copies, b.x0 AS b_x0, b.y0 AS b_y0, b.x1 AS b_x1, b.y1 AS b_y1,
      b.copies AS b_copies, {iou_sql('a', 'b')} AS iou
      FROM d a JOIN d b ON a.g = b.g AND (a.x0, a.y0, a.x1, a.y1) < (b.x0, b.y0, b.x1, b.y1))
SELECT * FROM p WHERE iou > {IOU}""")
def j13(spark, sf_dir):
    return box_overlaps(boxes(spark, sf_dir), ["g"], IOU)


@query("j13b_overlap_summary", f"""WITH {V5},
o AS (SELECT a.g, a.x0, a.y0, a.x1, a.y1, a.id, max({iou_sql('a', 'b')}) AS best, count(*) AS n
      FROM v5 a JOIN v5 b ON a.g = b.g AND a.id <> b.id AND {iou_sql('a', 'b')} > {IOU} GROUP BY ALL)
SELECT v5.g, v5.x0, v5.y0, v5.x1, v5.y1, count(*) AS copies, any_value(coalesce(n, 0)) AS n_overlaps, any_value(best) AS best_iou
FROM v5 LEFT JOIN o USING (g, id) GROUP BY v5.g, v5.x0, v5.y0, v5.x1, v5.y1""")
def j13b(spark, sf_dir):
    return overlap_summary(boxes(spark, sf_dir), ["g"], IOU)


@query("m11b_nms_any_overlap", f"WITH {V5}, {nms_sql('v5', ['g'], 'score DESC', 0, 'kept')} SELECT v5.* FROM v5 SEMI JOIN kept USING (g, id)")
def m11b(spark, sf_dir):
    return nms(boxes(spark, sf_dir), ["g"], 0.0)


@query("m11_nms", f"WITH {V5}, {nms_sql('v5', ['g'], 'score DESC', IOU, 'kept')} SELECT v5.* FROM v5 SEMI JOIN kept USING (g, id)")
def m11(spark, sf_dir):
    return nms(boxes(spark, sf_dir), ["g"], IOU)


CROPPED = V5 + """,
cropped AS (SELECT g, id, x0, y0, x1, y1, 1.0::DOUBLE / CASE id % 3 WHEN 0 THEN 3600 WHEN 1 THEN 900 ELSE 400 END AS s FROM v5)"""


@query("m14_crop_dedupe", f"""WITH {CROPPED}, {nms_sql('cropped', ['g'], 's DESC', IOU, 'kept')}
SELECT g AS image_id, id AS candidate_id FROM kept""")
def m14(spark, sf_dir):
    side = F.when(F.col("id") % 3 == 0, 60).when(F.col("id") % 3 == 1, 30).otherwise(20)
    records = boxes(spark, sf_dir).select(
        F.col("g").alias("image_id"), F.col("id").alias("candidate_id"), "x0", "y0", "x1", "y1",
        F.lit(0).alias("crop_x0"), F.lit(0).alias("crop_y0"), side.alias("crop_x1"), side.alias("crop_y1"))
    return K.crop_dedupe(records, IOU).select("image_id", "candidate_id")


def candidates(spark, sf_dir):
    """Four candidates per image, two in a crop at the origin and two in one further inside."""
    inner = F.col("label_ord") % 2 == 1
    logits = mask_logits(spark, sf_dir)
    return logits.select(
        F.concat_ws("/", "participant_id", F.col("frame").cast("string")).alias("image_id"), F.col("label_ord").cast("long").alias("candidate_id"),
        "logits", "h", "w", F.abs(F.element_at("logits", 64).cast("double")).alias("predicted_iou"),
        F.col("label_ord").alias("point_x"), (F.col("frame") % 8).alias("point_y"),
        F.when(inner, 4).otherwise(0).alias("crop_x0"), F.when(inner, 2).otherwise(0).alias("crop_y0"),
        F.when(inner, 12).otherwise(8).alias("crop_x1"), F.when(inner, 10).otherwise(8).alias("crop_y1"),
        F.lit(12).alias("image_h"), F.lit(14).alias("image_w"))


OPTIONS = K.QualityOptions(pred_iou=0.02, stability=0.3, stability_offset=0.05, mask_threshold=0.25, box_nms=0.5,
                           crop_nms=0.4, edge_tolerance=0.5)

SCORED = V4 + f""",
c AS (
  SELECT participant_id || '/' || frame AS image_id, CAST(label_ord AS BIGINT) AS id, any_value(frame) AS frame, max(abs(CAST(embedding[64] AS DOUBLE))) AS predicted_iou,
    count(*) FILTER (WHERE CAST(logit AS DOUBLE) > 0.25::DOUBLE + 0.05::DOUBLE) AS i, count(*) FILTER (WHERE CAST(logit AS DOUBLE) > 0.25::DOUBLE - 0.05::DOUBLE) AS u,
    count(*) FILTER (WHERE CAST(logit AS DOUBLE) > 0.25) AS area,
    COALESCE(min(x) FILTER (WHERE CAST(logit AS DOUBLE) > 0.25), 0) AS bx0, COALESCE(min(y) FILTER (WHERE CAST(logit AS DOUBLE) > 0.25), 0) AS by0,
    COALESCE(max(x) FILTER (WHERE CAST(logit AS DOUBLE) > 0.25), 0) AS bx1, COALESCE(max(y) FILTER (WHERE CAST(logit AS DOUBLE) > 0.25), 0) AS by1
  FROM px GROUP BY participant_id, frame, label_ord),
f AS (
  SELECT *, i / u::DOUBLE AS stability_score, CASE WHEN id % 2 = 1 THEN 4 ELSE 0 END AS cx, CASE WHEN id % 2 = 1 THEN 2 ELSE 0 END AS cy
  FROM c WHERE predicted_iou > 0.02 AND u > 0 AND i / u::DOUBLE >= 0.3),
e AS (
  SELECT *, bx0 + cx AS x0, by0 + cy AS y0, bx1 + cx AS x1, by1 + cy AS y1 FROM f
  WHERE NOT (id % 2 = 1 AND (bx0 = 0 OR by0 = 0))),
{nms_sql('e', ['image_id', 'cx'], 'predicted_iou DESC', 0.5, 'one')},
g AS (SELECT e.*, 1.0::DOUBLE / 64 AS s FROM e SEMI JOIN one USING (image_id, cx, id)),
{nms_sql('g', ['image_id'], 's DESC', 0.4, 'two')},
final AS (SELECT g.* FROM g SEMI JOIN two USING (image_id, id))"""


PLACES = "[cx, cy, 8, 8] AS crop_box, [[CAST(id + cx AS BIGINT), frame % 8 + cy]] AS point_coords"


def lit_sql(source):
    """Pixels of the candidates of ``source`` in their image of 12 rows and 14 columns: all as places, the set ones as lit."""
    return f"""
places AS (SELECT image_id, id, o, CAST(o // 12 AS INTEGER) AS x, CAST(o % 12 AS INTEGER) AS y FROM (SELECT image_id, id, unnest(range(168)) AS o FROM {source})),
lit AS (
  SELECT s.image_id, s.id, px.x + s.cx AS x, px.y + s.cy AS y
  FROM {source} s JOIN px ON s.image_id = px.participant_id || '/' || px.frame AND s.id = px.label_ord WHERE CAST(px.logit AS DOUBLE) > 0.25)"""


def counts_sql(pixels):
    """Run lengths, column by column, of the given pixels, as view coded."""
    return f"""
told AS (SELECT p.image_id, p.id, p.o, k.x IS NOT NULL AS fg FROM places p LEFT JOIN {pixels} k USING (image_id, id, x, y)),
turns AS (SELECT *, CASE WHEN lag(fg) OVER (PARTITION BY image_id, id ORDER BY o) = fg THEN 0 ELSE 1 END AS turn FROM told),
runs12 AS (SELECT *, sum(turn) OVER (PARTITION BY image_id, id ORDER BY o) AS run FROM turns),
lengths AS (SELECT image_id, id, run, bool_and(fg) AS fg, CAST(count(*) AS INTEGER) AS n FROM runs12 GROUP BY image_id, id, run),
coded AS (
  SELECT image_id, id, CASE WHEN arg_min(fg, run) THEN [0] ELSE [] END || list(n ORDER BY run) AS counts,
         CAST(sum(n) FILTER (WHERE fg) AS BIGINT) AS set_pixels FROM lengths GROUP BY image_id, id)"""


def small_sql(name, pixels):
    """Pixels whose region has fewer than 4 pixels: three steps from them reach fewer than 4. With the area and the first pixel."""
    same = "a.image_id = b.image_id AND a.id = b.id"
    step = f"""SELECT DISTINCT a.image_id, a.id, a.rx, a.ry, b.x, b.y FROM {name}_%d a JOIN {name}_1 b ON {same} AND a.x = b.rx AND a.y = b.ry"""
    return f"""
{name}_1 AS (SELECT a.image_id, a.id, a.x AS rx, a.y AS ry, b.x, b.y FROM {pixels} a JOIN {pixels} b ON {same} AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
{name}_2 AS ({step % 1}),
{name}_3 AS ({step % 2}),
{name}_sizes AS (SELECT image_id, id, rx, ry, count(*) AS area, min(y * 14 + x) AS first FROM {name}_3 GROUP BY image_id, id, rx, ry),
{name} AS (SELECT image_id, id, rx AS x, ry AS y, area, first FROM {name}_sizes WHERE area < 4)"""


def cleaned_sql(source, threshold):
    """Repaired candidates of ``source`` after suppression, as view clean, and their run lengths."""
    return f"""{lit_sql(source)},
dark AS (SELECT image_id, id, x, y FROM places ANTI JOIN lit USING (image_id, id, x, y)),
{small_sql('hole', 'dark')},
filled AS (SELECT image_id, id, x, y FROM lit UNION ALL SELECT image_id, id, x, y FROM hole),
{small_sql('isle', 'filled')},
judged AS (SELECT f.*, i.area, i.first FROM filled f LEFT JOIN isle i USING (image_id, id, x, y)),
verdict AS (
  SELECT image_id, id, bool_or(area IS NOT NULL) AS broken, bool_and(area IS NOT NULL) AS all_small, arg_max(first, area * 1000 - first) AS largest
  FROM judged GROUP BY image_id, id),
stays AS (SELECT j.image_id, j.id, j.x, j.y FROM judged j JOIN verdict USING (image_id, id) WHERE area IS NULL OR (all_small AND first = largest)),
mended AS (
  SELECT v.image_id, v.id, CASE WHEN broken OR h.id IS NOT NULL THEN 0.0 ELSE 1.0 END AS s
  FROM verdict v LEFT JOIN (SELECT DISTINCT image_id, id FROM hole) h USING (image_id, id)),
boxed AS (
  SELECT image_id, id, any_value(s) AS s, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1
  FROM stays JOIN mended USING (image_id, id) GROUP BY image_id, id),
{nms_sql('boxed', ['image_id'], 's DESC', threshold, 'three')},
{counts_sql('stays')},
clean AS (SELECT boxed.*, coded.counts, coded.set_pixels FROM boxed SEMI JOIN three USING (image_id, id) JOIN coded USING (image_id, id))"""


def flat(records):
    return records.select("segmentation.size", "segmentation.counts", *[c for c in records.columns if c != "segmentation"])


@query("m13_candidate_flow", f"""WITH {SCORED},
{lit_sql('final')}, {counts_sql('lit')}
SELECT image_id, id AS candidate_id, [12, 14] AS size, counts, area, [x0, y0, x1 - x0, y1 - y0] AS bbox, predicted_iou, stability_score,
       {PLACES} FROM final JOIN coded USING (image_id, id)""")
def m13(spark, sf_dir):
    return flat(K.mask_quality(candidates(spark, sf_dir), OPTIONS))


@query("m15_records", f"""WITH {SCORED},
{lit_sql('e')}, {counts_sql('lit')}
SELECT image_id, id AS candidate_id, [12, 14] AS size, counts, area, [x0, y0, x1 - x0, y1 - y0] AS bbox, predicted_iou, stability_score,
       {PLACES} FROM e JOIN coded USING (image_id, id)""")
def m15(spark, sf_dir):
    options = K.QualityOptions(pred_iou=0.02, stability=0.3, stability_offset=0.05, mask_threshold=0.25, box_nms=0.999999,
                               crop_nms=0.999999, edge_tolerance=0.5)
    return flat(K.candidate_records(K.candidate_masks(candidates(spark, sf_dir), options)))


@query("m12_clean_candidates", f"""WITH {SCORED},
{cleaned_sql('g', 0.4)}
SELECT image_id, id AS candidate_id, counts, x0, y0, x1, y1 FROM clean""")
def m12(spark, sf_dir):
    records = K.candidate_masks(candidates(spark, sf_dir), OPTIONS)
    return K.clean_candidates(records, 4, 0.4).select("image_id", "candidate_id", "counts", "x0", "y0", "x1", "y1")


@query("e06_mask_quality", f"""WITH {SCORED},
{cleaned_sql('final', 0.5)}
SELECT image_id, id AS candidate_id, [12, 14] AS size, c.counts, c.set_pixels AS area, [c.x0, c.y0, c.x1 - c.x0, c.y1 - c.y0] AS bbox,
       predicted_iou, stability_score, {PLACES}
FROM final JOIN clean c USING (image_id, id)""")
def e06(spark, sf_dir):
    options = K.QualityOptions(pred_iou=0.02, stability=0.3, stability_offset=0.05, mask_threshold=0.25, box_nms=0.5,
                               crop_nms=0.4, edge_tolerance=0.5, min_region_area=4)
    return flat(K.mask_quality(candidates(spark, sf_dir), options))
