"""Queries on click prompts and objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from saccade.operators import prompts as P
from saccade.operators.masks import MISSING_SCORE
from saccade.operators.ordered import frame_chunk
from saccade.plans import jobs
from saccade.plans.fixtures import LABELS, V1, V4, V5, V8, boxes, gaze_codes, mask_logits, prompts, table
from saccade.plans.registry import query

CLICKS = """listed AS (
  SELECT *, CASE label WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 END AS place FROM v8 WHERE label <> 'error'),
present AS (SELECT participant_id, label, row_number() OVER (PARTITION BY participant_id ORDER BY place) - 1 AS label_ord
            FROM (SELECT DISTINCT participant_id, label, place FROM listed)),
clicks AS (
  SELECT l.*, label_ord, row_number() OVER (PARTITION BY participant_id, label ORDER BY seq) - 1 AS click_ord
  FROM listed l JOIN present USING (participant_id, label))"""


def documents(spark, sf_dir):
    return P.prompt_json(prompts(spark, sf_dir), LABELS)


@query("s15_prompt_json", f"""WITH {V8}, {CLICKS},
o AS (SELECT participant_id, label, any_value(place) AS place, string_agg('{{"x":' || x || ',"y":' || y || ',"positive":' || positive || ',"label":"' || label || '","frame":' || frame || '}}', ',' ORDER BY seq) AS t
      FROM clicks GROUP BY participant_id, label)
SELECT participant_id, 0 AS part, '{{' || string_agg('"' || label || '":[' || t || ']', ',' ORDER BY place) || '}}' AS json FROM o GROUP BY participant_id""")
def s15(spark, sf_dir):
    return documents(spark, sf_dir)


@query("j11_label_ids", f"WITH {V8}, {CLICKS} SELECT participant_id, 0 AS part, label, label_ord AS object_id FROM present")
def j11(spark, sf_dir):
    return P.label_ids(documents(spark, sf_dir))


@query("j11b_label_ids_of_parts", f"WITH {V8}, {CLICKS} SELECT participant_id, label, label_ord AS object_id FROM present")
def j11b(spark, sf_dir):
    """Every part of a participant's documents gives the same numbers."""
    return P.label_ids(P.prompt_json(prompts(spark, sf_dir), LABELS, 3)).drop("part").distinct()


PROMPT_OBJECTS = f"""WITH {V8}, {CLICKS}
SELECT participant_id, label, frame, arg_max(x, seq) AS x, arg_max(y, seq) AS y, arg_max(positive, seq) AS positive, any_value(label_ord) AS object_id
FROM clicks GROUP BY participant_id, label, frame"""


@query("e05_prompt_objects", PROMPT_OBJECTS)
def e05(spark, sf_dir):
    return jobs.prompt_objects(documents(spark, sf_dir))


@query("w07_effective_prompts", f"""WITH {V8}
SELECT participant_id, label, frame, max(seq) AS seq, arg_max(x, seq) AS x, arg_max(y, seq) AS y, arg_max(positive, seq) AS positive FROM v8 GROUP BY ALL""")
def w07(spark, sf_dir):
    return P.effective_prompts(prompts(spark, sf_dir))


@query("w08_undo_last", f"""WITH {V8},
l AS (SELECT participant_id, frame, max(seq) AS seq FROM v8 WHERE frame % 2 = 0 GROUP BY ALL)
SELECT * FROM v8 ANTI JOIN l USING (participant_id, frame, seq)""")
def w08(spark, sf_dir):
    clicks = prompts(spark, sf_dir)
    return P.undo_last_click(clicks, clicks.filter(F.col("frame") % 2 == 0))


@query("a16_click_counts", f"""WITH {V8}, c AS (SELECT participant_id, frame, count(*) AS frame_clicks FROM v8 GROUP BY ALL)
SELECT *, sum(frame_clicks) OVER (PARTITION BY participant_id) AS total_clicks FROM c""")
def a16(spark, sf_dir):
    return P.click_counts(prompts(spark, sf_dir))


OBJECTS = V8 + """,
first_seen AS (SELECT participant_id, label, min(seq) AS s FROM v8 GROUP BY ALL),
objects AS (SELECT participant_id, label, row_number() OVER (PARTITION BY participant_id ORDER BY s) - 1 AS object_id FROM first_seen)"""


@query("u07_dense_object_ids", f"WITH {OBJECTS} SELECT * FROM objects")
def u07(spark, sf_dir):
    return P.dense_object_ids(prompts(spark, sf_dir))


@query("u05_remove_object", f"""WITH {OBJECTS}
SELECT participant_id, label, object_id AS old_object_id, row_number() OVER (PARTITION BY participant_id ORDER BY object_id) - 1 AS object_id
FROM objects WHERE label <> 'view'""")
def u05(spark, sf_dir):
    objects = P.dense_object_ids(prompts(spark, sf_dir))
    return P.remove_objects(objects, objects.filter("label = 'view'"))


@query("u06_clear_prompts", f"""WITH {V8}, gone AS (SELECT DISTINCT participant_id, label, frame FROM v8 WHERE positive = 0)
SELECT * FROM v8 ANTI JOIN gone USING (participant_id, label, frame)""")
def u06(spark, sf_dir):
    clicks = prompts(spark, sf_dir)
    return P.clear_prompts(clicks, clicks.filter("positive = 0"))


@query("u04_append_points", f"""WITH {V8}
SELECT participant_id, label, seq, row_number() OVER (PARTITION BY participant_id, label ORDER BY seq % 2, seq) - 1 AS point FROM v8""")
def u04(spark, sf_dir):
    clicks = prompts(spark, sf_dir).select("participant_id", "label", "seq")
    both = P.append_points(clicks.filter("seq % 2 = 0"), clicks.filter("seq % 2 = 1"), ["participant_id", "label"])
    return both.select("participant_id", "label", "seq", "point")


SIZES = V8 + """,
sizes AS (SELECT participant_id, max(frame) + 1 AS num_frames, min(frame) AS first_frame FROM v8 GROUP BY 1)"""


def sizes(spark, sf_dir):
    return prompts(spark, sf_dir).groupBy("participant_id").agg((F.max("frame") + 1).alias("num_frames"))


@query("a21_tracked_frames", f"""WITH {SIZES},
v AS (SELECT participant_id, unnest(range(first_frame, least(first_frame + 7, num_frames - 1) + 1)) AS frame, first_frame FROM sizes)
SELECT participant_id, frame - first_frame AS step, frame FROM v""")
def a21(spark, sf_dir):
    return P.tracked_frames(prompts(spark, sf_dir), sizes(spark, sf_dir), limit=7)


@query("a21b_tracked_backwards", f"""WITH {SIZES},
v AS (SELECT participant_id, num_frames - 1 AS start, unnest(range(greatest(num_frames - 1 - 9, 0), num_frames)) AS frame FROM sizes WHERE num_frames > 1)
SELECT participant_id, start - frame AS step, frame FROM v""")
def a21b(spark, sf_dir):
    return P.tracked_frames(prompts(spark, sf_dir), sizes(spark, sf_dir), start=F.col("num_frames") - 1, limit=9, reverse=True)


@query("a21c_tracked_to_the_end", f"""WITH {SIZES}, v AS (SELECT participant_id, unnest(range(first_frame, num_frames)) AS frame, first_frame FROM sizes)
SELECT participant_id, frame - first_frame AS step, frame FROM v""")
def a21c(spark, sf_dir):
    return P.tracked_frames(prompts(spark, sf_dir), sizes(spark, sf_dir))


def nearest_sql(k):
    return f"""WITH {V1}, {V8[1:]},
fr AS (SELECT participant_id, frame FROM v1),
mk AS (SELECT participant_id, frame AS prompt_frame, min(seq) AS seq FROM v8 GROUP BY ALL),
c AS (SELECT fr.participant_id, frame, prompt_frame, seq, abs(prompt_frame - frame) AS d,
        max(prompt_frame) FILTER (WHERE prompt_frame < frame) OVER (PARTITION BY participant_id, frame) AS b,
        min(prompt_frame) FILTER (WHERE prompt_frame >= frame) OVER (PARTITION BY participant_id, frame) AS a
      FROM fr JOIN mk USING (participant_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY participant_id, frame ORDER BY CASE WHEN prompt_frame = a OR prompt_frame = b THEN 0 ELSE 1 END, d, seq) AS rn FROM c)
SELECT participant_id, frame, prompt_frame FROM r WHERE rn <= {k}"""


def nearest(k):
    def run(spark, sf_dir):
        return P.nearest_prompts(gaze_codes(spark, sf_dir).select("participant_id", "frame"), prompts(spark, sf_dir), k)
    return run


query("j12_nearest_prompts", nearest_sql(4))(nearest(4))
query("t04_nearest_two", nearest_sql(2))(nearest(2))


def context_sql(expression):
    return f"""WITH {V1}, s AS (SELECT participant_id, frame, unnest(range(1, 7)) AS back FROM v1),
w AS (SELECT participant_id, frame, 7 - back AS slot, CAST({expression} AS INTEGER) AS context_frame FROM s)
SELECT w.* FROM w SEMI JOIN (SELECT participant_id, frame AS context_frame FROM v1) USING (participant_id, context_frame)"""


def context(reverse):
    def run(spark, sf_dir):
        return P.context_frames(gaze_codes(spark, sf_dir).select("participant_id", "frame"), 7, 3, reverse)
    return run


query("w11_context_frames", context_sql(
    "CASE WHEN back = 1 THEN frame - 1 ELSE floor((frame - 2) / 3.0) * 3 - (back - 2) * 3 END"))(context(False))
query("w11b_context_reverse", context_sql(
    "CASE WHEN back = 1 THEN frame + 1 ELSE ceil((frame + 2) / 3.0) * 3 + (back - 2) * 3 END"))(context(True))


@query("j14_fill_missing_objects", f"""WITH {V4},
fr AS (SELECT DISTINCT participant_id, frame FROM v4), ob AS (SELECT DISTINCT participant_id, label_ord AS object_id FROM v4),
s AS (SELECT participant_id, frame, label_ord AS object_id, vec_id, CAST(embedding[1] AS DOUBLE) AS s FROM v4)
SELECT participant_id, frame, object_id, COALESCE(t.s, c.s * 2, n.s * 3, -1024.0) AS score
FROM fr JOIN ob USING (participant_id)
LEFT JOIN (SELECT * FROM s WHERE vec_id % 4 = 1) t USING (participant_id, frame, object_id)
LEFT JOIN (SELECT * FROM s WHERE vec_id % 3 = 0) c USING (participant_id, frame, object_id)
LEFT JOIN (SELECT * FROM s WHERE vec_id % 2 = 0) n USING (participant_id, frame, object_id)""")
def j14(spark, sf_dir):
    known = mask_logits(spark, sf_dir).select("participant_id", "frame", F.col("label_ord").alias("object_id"), "vec_id",
                                              F.element_at("logits", 1).cast("double").alias("score"))
    vec, score = F.col("vec_id"), F.col("score")
    columns = ["participant_id", "frame", "object_id"]
    layers = [known.filter(vec % 4 == 1).select(*columns, "score"),
              known.filter(vec % 3 == 0).select(*columns, (score * 2).alias("score")),
              known.filter(vec % 2 == 0).select(*columns, (score * 3).alias("score"))]
    return P.fill_missing_objects(known.select("participant_id", "frame").distinct(),
                                  known.select("participant_id", "object_id").distinct(), layers, MISSING_SCORE)


@query("w10_batches", """SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS batch FROM events""")
def w10(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id")
    return P.batch_ids(rows, 64, ["event_id"], frame_chunk(F.col("event_id")))


@query("u01_concatenate", f"""WITH {V5}
SELECT g, id, x0, score FROM v5 WHERE x0 < 10 UNION ALL SELECT g, id, x0, score FROM v5 WHERE x0 >= 10""")
def u01(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return b.filter("x0 < 10").select("g", "id", "x0", "score").unionByName(b.filter("x0 >= 10").select("score", "x0", "id", "g"))


@query("t05_keep_by_index", f"""WITH {V5}, kept AS (SELECT g, max(id) AS id FROM v5 GROUP BY g)
SELECT g, id, x0, y0, x1, y1, score FROM v5 SEMI JOIN kept USING (g, id)""")
def t05(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return b.join(b.groupBy("g").agg(F.max("id").alias("id")), ["g", "id"], "left_semi")
