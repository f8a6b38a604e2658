"""Queries on masks, score arrays and connected regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from saccade.operators import candidates as K
from saccade.operators import components as C
from saccade.operators import masks as M
from saccade.operators import tiles as T
from saccade.plans.fixtures import V4, mask_logits, mask_rows, table
from saccade.plans.registry import query

KEY = "participant_id, frame, label_ord"


def runs_sql(value):
    """Stretches of equal pixels in column order, and the counts array they give."""
    return f"""{V4},
flagged AS (SELECT *, {value} AS fg FROM px),
stepped AS (
  SELECT *, CASE WHEN lag(fg) OVER (PARTITION BY {KEY} ORDER BY off) = fg THEN 0 ELSE 1 END AS starts FROM flagged),
grouped AS (SELECT *, sum(starts) OVER (PARTITION BY {KEY} ORDER BY off) AS run FROM stepped),
stretches AS (
  SELECT {KEY}, any_value(label) AS label, bool_and(fg) AS fg, min(off) AS run_start, max(off) + 1 AS run_end
  FROM grouped GROUP BY {KEY}, run),
rle AS (
  SELECT {KEY}, CASE WHEN arg_min(fg, run_start) THEN [0] ELSE [] END
         || list(CAST(run_end - run_start AS INTEGER) ORDER BY run_start) AS counts
  FROM stretches GROUP BY {KEY})"""


FG = runs_sql("logit > 0")


@query("m01_rle_encode", f"WITH {FG} SELECT {KEY}, counts FROM rle")
def m01(spark, sf_dir):
    return mask_rows(spark, sf_dir).select("participant_id", "frame", "label_ord", "counts")


@query("m01b_rle_from_pixels", f"WITH {FG} SELECT {KEY}, counts FROM rle")
def m01b(spark, sf_dir):
    logits = mask_logits(spark, sf_dir)
    pixels = M.logit_pixels(logits).filter(F.col("logit") > 0)
    return M.rle_from_pixels(logits.select(*M.MASK_KEYS, "h", "w"), pixels).select(*M.MASK_KEYS, "counts")


@query("m02_rle_decode", f"WITH {V4} SELECT {KEY}, x, y FROM px WHERE logit > 0")
def m02(spark, sf_dir):
    return M.rle_decode(mask_rows(spark, sf_dir))


@query("m03_run_table", f"""WITH {FG}
SELECT {KEY}, run_start, run_end, run_start // 8 AS x_first, run_start % 8 AS y_first,
       (run_end - 1) // 8 AS x_last, (run_end - 1) % 8 AS y_last FROM stretches WHERE fg""")
def m03(spark, sf_dir):
    return M.mask_runs(mask_rows(spark, sf_dir))


@query("a17_mask_area", f"WITH {V4} SELECT {KEY}, count(*) FILTER (WHERE logit > 0.3) AS area FROM px GROUP BY ALL")
def a17(spark, sf_dir):
    masks = C.logits_to_masks(mask_logits(spark, sf_dir), 0.3)
    return masks.select(*M.MASK_KEYS, M.rle_area(F.col("counts")).alias("area"))


def box_sql(empty):
    return f"""WITH {V4}
SELECT {KEY}, COALESCE(min(x) FILTER (WHERE logit > 0.35), {empty[0]}) AS x0, COALESCE(min(y) FILTER (WHERE logit > 0.35), {empty[1]}) AS y0,
       COALESCE(max(x) FILTER (WHERE logit > 0.35), {empty[2]}) AS x1, COALESCE(max(y) FILTER (WHERE logit > 0.35), {empty[3]}) AS y1
FROM px GROUP BY ALL"""


@query("a18_mask_box", box_sql((0, 0, 0, 0)))
def a18(spark, sf_dir):
    return M.mask_box(C.logits_to_masks(mask_logits(spark, sf_dir), 0.35)).select(*M.MASK_KEYS, "x0", "y0", "x1", "y1")


@query("a18b_mask_box_inverted", box_sql((8, 8, -1, -1)))
def a18b(spark, sf_dir):
    masks = C.logits_to_masks(mask_logits(spark, sf_dir), 0.35)
    return M.mask_box(masks, "inverted").select(*M.MASK_KEYS, "x0", "y0", "x1", "y1")


@query("a19_stability", f"""WITH {V4},
n AS (SELECT {KEY}, count(*) FILTER (WHERE CAST(logit AS DOUBLE) > 0.05) AS i, count(*) FILTER (WHERE CAST(logit AS DOUBLE) > -0.05) AS u,
      count(*) FILTER (WHERE CAST(logit AS DOUBLE) > 0.4::DOUBLE + 0.05::DOUBLE) AS i2, count(*) FILTER (WHERE CAST(logit AS DOUBLE) > 0.4::DOUBLE - 0.05::DOUBLE) AS u2
      FROM px GROUP BY ALL)
SELECT {KEY}, CASE WHEN u > 0 THEN i / u::DOUBLE ELSE 'nan'::DOUBLE END AS stability_score,
       CASE WHEN u2 > 0 THEN i2 / u2::DOUBLE ELSE 1.0 END AS guarded_score FROM n""")
def a19(spark, sf_dir):
    return mask_logits(spark, sf_dir).select(
        *M.MASK_KEYS, M.stability(F.col("logits"), 0.0, 0.05).alias("stability_score"),
        M.stability(F.col("logits"), 0.4, 0.05, guarded=True).alias("guarded_score"))


@query("a20_best_candidate", f"""WITH {V4},
n AS (SELECT participant_id, frame, label_ord, count(*) FILTER (WHERE CAST(logit AS DOUBLE) > 0.02) / count(*) FILTER (WHERE CAST(logit AS DOUBLE) > -0.02)::DOUBLE AS st,
      max(CAST(embedding[64] AS DOUBLE)) AS iou FROM px GROUP BY ALL)
SELECT participant_id, frame, max(st) FILTER (WHERE label_ord = 0) AS stability_score,
  CASE WHEN max(st) FILTER (WHERE label_ord = 0) >= 0.75 THEN 0 ELSE arg_max(label_ord, iou) FILTER (WHERE label_ord > 0) END AS candidate_id,
  CASE WHEN max(st) FILTER (WHERE label_ord = 0) >= 0.75 THEN max(iou) FILTER (WHERE label_ord = 0) ELSE max(iou) FILTER (WHERE label_ord > 0) END AS predicted_iou
FROM n GROUP BY ALL""")
def a20(spark, sf_dir):
    cands = mask_logits(spark, sf_dir).withColumnRenamed("label_ord", "candidate_id").withColumn(
        "predicted_iou", F.element_at("logits", 64).cast("double"))
    return K.best_candidate(cands, ["participant_id", "frame"], 0.02, 0.75)


@query("p22_uncrop_masks", f"""WITH {V4}
SELECT {KEY}, x + 2 + frame % 3 AS x, y + 1 + label_ord AS y FROM px WHERE logit > 0""")
def p22(spark, sf_dir):
    masks = mask_rows(spark, sf_dir).withColumn("cx", F.lit(2) + F.col("frame") % 3).withColumn("cy", F.lit(1) + F.col("label_ord"))
    return M.rle_decode(M.uncrop_masks(masks, ("cx", "cy"), F.lit(14), F.lit(13)))


@query("p24_threshold", f"WITH {V4} SELECT {KEY}, x, y, logit > 0.1 AS set FROM px")
def p24(spark, sf_dir):
    bits = mask_logits(spark, sf_dir).select(*M.MASK_KEYS, F.posexplode(M.threshold_pixels(F.col("logits"), 0.1)).alias("i", "set"))
    return bits.select(*M.MASK_KEYS, (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).alias("y"), "set")


@query("p25_quality_filter", f"""WITH {V4},
n AS (SELECT vec_id, count(*) FILTER (WHERE CAST(logit AS DOUBLE) > 0.05) / count(*) FILTER (WHERE CAST(logit AS DOUBLE) > -0.05)::DOUBLE AS stability_score,
      max(CAST(embedding[1] AS DOUBLE)) AS predicted_iou FROM px GROUP BY ALL)
SELECT vec_id, stability_score, predicted_iou FROM n WHERE predicted_iou > 0.05 AND stability_score >= 0.6""")
def p25(spark, sf_dir):
    cands = mask_logits(spark, sf_dir).withColumn("predicted_iou", F.element_at("logits", 1).cast("double"))
    options = K.QualityOptions(pred_iou=0.05, stability=0.6, stability_offset=0.05)
    return K.quality_filter(cands, options).select("vec_id", "stability_score", "predicted_iou")


@query("w09_non_overlap", f"""WITH {V4},
r AS (SELECT *, row_number() OVER (PARTITION BY participant_id, frame, x, y ORDER BY logit DESC, label_ord) AS rn FROM px)
SELECT {KEY}, x, y, CAST(CASE WHEN rn = 1 THEN logit ELSE least(logit, -10.0::FLOAT) END AS DOUBLE) AS logit FROM r""")
def w09(spark, sf_dir):
    pixels = M.non_overlap(M.logit_pixels(mask_logits(spark, sf_dir)))
    return pixels.select(*M.MASK_KEYS, "x", "y", F.col("logit").cast("double").alias("logit"))


@query("w09b_non_overlap_scores", f"""WITH {V4},
r AS (SELECT *, row_number() OVER (PARTITION BY participant_id, frame, x, y ORDER BY logit DESC, label_ord) AS rn FROM px)
SELECT {KEY}, x, y, CAST(CASE WHEN rn = 1 THEN logit ELSE least(logit, -10.0::FLOAT) END AS DOUBLE) AS logit FROM r""")
def w09b(spark, sf_dir):
    left = M.non_overlap_scores(mask_logits(spark, sf_dir), block=24)
    return M.logit_pixels(left).select(*M.MASK_KEYS, "x", "y", F.col("logit").cast("double").alias("logit"))


def shifted(spark, sf_dir):
    """Masks of the next object of the frame, as a second opinion."""
    return mask_rows(spark, sf_dir).withColumn("label_ord", (F.col("label_ord") + 1) % 4)


@query("u02_mask_errors", f"""WITH {V4},
t AS (SELECT {KEY}, x, y FROM px WHERE logit > 0),
p AS (SELECT participant_id, frame, (label_ord + 1) % 4 AS label_ord, x, y FROM px WHERE logit > 0)
SELECT *, 'false_positive' AS kind FROM (SELECT * FROM p EXCEPT SELECT * FROM t)
UNION ALL SELECT *, 'false_negative' FROM (SELECT * FROM t EXCEPT SELECT * FROM p)""")
def u02(spark, sf_dir):
    return M.mask_errors(mask_rows(spark, sf_dir), shifted(spark, sf_dir))


@query("u03_mask_overlap", f"""WITH {V4},
t AS (SELECT {KEY}, x, y, logit > 0 AS a FROM px),
p AS (SELECT participant_id, frame, (label_ord + 1) % 4 AS label_ord, x, y, logit > 0 AS b FROM px),
c AS (SELECT {KEY}, count(*) FILTER (WHERE a) AS area_left, count(*) FILTER (WHERE b) AS area_right, count(*) FILTER (WHERE a AND b) AS intersection,
      count(*) FILTER (WHERE a OR b) AS union_area, bool_and(a = b) AS all_correct FROM t JOIN p USING (participant_id, frame, label_ord, x, y) GROUP BY ALL)
SELECT {KEY}, area_left, area_right, intersection, union_area, intersection / union_area::DOUBLE AS iou, all_correct FROM c""")
def u03(spark, sf_dir):
    return M.mask_overlap(mask_rows(spark, sf_dir), shifted(spark, sf_dir))


def regions_sql(condition, name="reach"):
    """Smallest offset reachable from each pixel that meets the condition."""
    return f"""
{name}_px AS (SELECT {KEY}, x, y, off FROM px WHERE {condition}),
{name} AS (
  SELECT {KEY}, off AS root, x, y, off FROM {name}_px
  UNION
  SELECT r.participant_id, r.frame, r.label_ord, r.root, p.x, p.y, p.off
  FROM {name} r JOIN {name}_px p ON r.participant_id = p.participant_id AND r.frame = p.frame AND r.label_ord = p.label_ord
    AND abs(p.x - r.x) <= 1 AND abs(p.y - r.y) <= 1),
{name}_labels AS (SELECT {KEY}, x, y, off, min(root) AS component FROM {name} GROUP BY {KEY}, x, y, off),
{name}_areas AS (SELECT *, count(*) OVER (PARTITION BY {KEY}, component) AS area FROM {name}_labels)"""


@query("m07_components", f"WITH RECURSIVE {V4}, {regions_sql('logit > 0')} SELECT {KEY}, x, y, component, area FROM reach_areas")
def m07(spark, sf_dir):
    return C.component_pixels(C.components(mask_rows(spark, sf_dir)))


@query("a23_component_areas", f"""WITH RECURSIVE {V4}, {regions_sql('logit > 0.1')}
SELECT {KEY}, component, count(*) AS area FROM reach_labels GROUP BY ALL""")
def a23(spark, sf_dir):
    masks = C.logits_to_masks(mask_logits(spark, sf_dir), 0.1)
    return C.component_areas(C.components(masks)).select(*M.MASK_KEYS, "component", "area")


@query("m08_fill_holes", f"""WITH RECURSIVE {V4}, {regions_sql('logit <= 0')}
SELECT {KEY}, x, y, CASE WHEN area <= 3 THEN CAST(0.1::FLOAT AS DOUBLE) ELSE CAST(logit AS DOUBLE) END AS logit
FROM px LEFT JOIN reach_areas USING (participant_id, frame, label_ord, x, y)""")
def m08(spark, sf_dir):
    filled = M.logit_pixels(C.fill_holes(mask_logits(spark, sf_dir), 3))
    return filled.select(*M.MASK_KEYS, "x", "y", F.col("logit").cast("double").alias("logit"))


@query("m09_repair_scores", f"""WITH RECURSIVE {V4}, {regions_sql('logit <= 0', 'hole')}, {regions_sql('logit > 0', 'spot')}
SELECT px.participant_id, px.frame, px.label_ord, px.x, px.y,
  CASE WHEN s.area <= 2 THEN -10.0 WHEN h.area <= 3 THEN 10.0 ELSE CAST(logit AS DOUBLE) END AS logit
FROM px LEFT JOIN hole_areas h USING (participant_id, frame, label_ord, x, y) LEFT JOIN spot_areas s USING (participant_id, frame, label_ord, x, y)""")
def m09(spark, sf_dir):
    fixed = M.logit_pixels(C.repair_scores(mask_logits(spark, sf_dir), 3, 2))
    return fixed.select(*M.MASK_KEYS, "x", "y", F.col("logit").cast("double").alias("logit"))


def cleaned_sql(condition, area, keep):
    return f"""WITH RECURSIVE {V4}, {regions_sql(condition)},
regions AS (SELECT {KEY}, component, any_value(area) AS area, min(y * 8 + x) AS first FROM reach_areas GROUP BY {KEY}, component),
verdict AS (
  SELECT {KEY}, bool_or(area < {area}) AS changed, bool_and(area < {area}) AS all_small, arg_max(component, area * 100 - first) AS largest
  FROM regions GROUP BY {KEY}),
judged AS (
  SELECT px.participant_id, px.frame, px.label_ord, x, y, px.off, logit > 0 AS fg, area, component, all_small, largest, COALESCE(changed, false) AS changed
  FROM px LEFT JOIN reach_areas a USING (participant_id, frame, label_ord, x, y) LEFT JOIN verdict USING (participant_id, frame, label_ord))
SELECT {KEY}, any_value(changed) AS changed, list(off ORDER BY off) FILTER (WHERE {keep}) AS pixels FROM judged GROUP BY {KEY}"""


def offsets(masks):
    pixels = M.rle_decode(masks).groupBy(*M.MASK_KEYS).agg(F.sort_array(F.collect_list(F.col("x") * 8 + F.col("y"))).alias("pixels"))
    return masks.select(*M.MASK_KEYS, "changed").join(pixels, list(M.MASK_KEYS), "left")


@query("m10_fill_small_holes", cleaned_sql("logit <= 0", 4, "fg OR area < 4"))
def m10(spark, sf_dir):
    return offsets(C.remove_small_regions(mask_rows(spark, sf_dir), 4, "holes"))


@query("m10b_drop_small_islands", cleaned_sql("logit > 0", 25, "area >= 25 OR (all_small AND component = largest)"))
def m10b(spark, sf_dir):
    return offsets(C.remove_small_regions(mask_rows(spark, sf_dir), 25, "islands"))


IMAGES = "images AS (SELECT p_partkey AS image_id, CAST(200 + (p_partkey * 37) % 900 AS INTEGER) AS h, CAST(300 + (p_partkey * 53) % 1300 AS INTEGER) AS w FROM part)"


def images(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("image_id"), (F.lit(200) + (key * 37) % 900).cast("int").alias("h"), (F.lit(300) + (key * 53) % 1300).cast("int").alias("w"))


@query("m04_sample_points", f"""WITH {IMAGES}, p AS (SELECT image_id, unnest(range(16)) AS point FROM images)
SELECT image_id, point, ((point % 4) * 2 + 1) / 8.0::DOUBLE AS x, ((point // 4) * 2 + 1) / 8.0::DOUBLE AS y FROM p""")
def m04(spark, sf_dir):
    return T.sample_points(images(spark, sf_dir).select("image_id"), 4)


@query("m05_layer_points", f"""WITH {IMAGES}, l AS (SELECT image_id, unnest(range(3)) AS layer FROM images),
n AS (SELECT *, CASE layer WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS n FROM l),
p AS (SELECT *, unnest(range(n * n)) AS point FROM n)
SELECT image_id, layer, point, ((point % n) * 2 + 1) / CAST(n * 2 AS DOUBLE) AS x, ((point // n) * 2 + 1) / CAST(n * 2 AS DOUBLE) AS y FROM p""")
def m05(spark, sf_dir):
    return T.layer_points(images(spark, sf_dir).select("image_id"), 5, 2, 2)


@query("m06_tiles", f"""WITH {IMAGES}, l AS (SELECT *, unnest(range(3)) AS layer FROM images),
s AS (SELECT *, 1 << layer AS n FROM l),
o AS (SELECT *, CASE WHEN layer = 0 THEN 0 ELSE CAST(trunc((512 / 1500.0::DOUBLE) * least(h, w) * (2.0::DOUBLE / n)) AS INTEGER) END AS ov FROM s),
t AS (SELECT *, CAST(ceil((ov * (n - 1) + w) / n::DOUBLE) AS INTEGER) AS tw, CAST(ceil((ov * (n - 1) + h) / n::DOUBLE) AS INTEGER) AS th FROM o),
i AS (SELECT *, unnest(range(n)) AS ix FROM t), j AS (SELECT *, unnest(range(n)) AS iy FROM i)
SELECT image_id, h, w, layer, (tw - ov) * ix AS x0, (th - ov) * iy AS y0, least((tw - ov) * ix + tw, w) AS x1, least((th - ov) * iy + th, h) AS y1 FROM j""")
def m06(spark, sf_dir):
    return T.tiles(images(spark, sf_dir), 2, 512 / 1500)
