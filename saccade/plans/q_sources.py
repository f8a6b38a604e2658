"""Queries that write files from the tables and read them back, and queries on file lists and bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from saccade.operators.metrics import summary_scores
from saccade.operators.prompts import parse_prompt_json, prompt_json
from saccade.operators.runs import collapse_runs
from saccade.plans import jobs
from saccade.plans.fixtures import (
    FPS, LABELS, MAP_FPS, PAIRS, V1, V2, V8, frame_metadata, gaze_codes, gaze_samples, mask_rows, prompts,
    recording_pairs, table,
)
from saccade.plans.q_masks import FG, KEY
from saccade.plans.q_metrics import MS, OPEN_RUNS, SCORES, WIDE, events, seconds
from saccade.plans.q_prompts import CLICKS, PROMPT_OBJECTS
from saccade.plans.q_sync import GRAYS, OFFSETS, offsets
from saccade.plans.registry import query
from saccade.schemas import SYNC_RESULTS
from saccade.session import scratch_path
from saccade.sources import binary, readers, writers


def run_file(spark, sf_dir, partitioned=True):
    path = scratch_path(spark, "runs")
    writers.write_runs(collapse_runs(gaze_codes(spark, sf_dir), MAP_FPS, end_mode="half_open"), path, partitioned)
    return path


HALF_OPEN = OPEN_RUNS + """,
half AS (SELECT participant_id, aoi_name, duration_frames, start_frame, end_frame + 1 AS end_frame FROM runs)"""


@query("s01_run_scan", f"""WITH {HALF_OPEN}
SELECT participant_id, aoi_name, duration_frames * {MS} AS duration_ms, duration_frames, start_frame * {MS} AS timestamp_ms, start_frame, end_frame FROM half""")
def s01(spark, sf_dir):
    return readers.read_cohort_runs(spark, run_file(spark, sf_dir), FPS)


@query("s09_run_sink", f"""WITH {HALF_OPEN}
SELECT participant_id, aoi_name AS name, duration_frames AS "frame duration", start_frame AS "start frame", end_frame AS "end frame",
  {seconds('duration_frames')} AS "duration (s)", {seconds('start_frame')} AS "start (s)", {seconds('end_frame')} AS "end (s)" FROM half""")
def s09(spark, sf_dir):
    schema = "`name` string, `frame duration` int, `start frame` int, `end frame` int, `duration (s)` double, `start (s)` double, `end (s)` double"
    return _partitioned_csv(spark, run_file(spark, sf_dir), schema)


def _partitioned_csv(spark, path, schema):
    """Files with a header, kept in folders that participants share; participant_id goes last."""
    return spark.read.schema(f"{schema}, participant_id string").option("header", True).option("mode", "FAILFAST").csv(path).drop(writers.GROUP)


@query("s02_gaze_scan", f"WITH {V2} SELECT * FROM v2")
def s02(spark, sf_dir):
    path = scratch_path(spark, "gaze")
    gaze_samples(spark, sf_dir, gaps=False).select("sample_seq", "participant_id", "world_index", "norm_x", "norm_y").write.option("header", True).csv(path)
    return readers.read_gaze(spark, path, participant_id=F.col("participant_id"), sample_seq="sample_seq")


@query("s03_pair_scan", f"WITH {PAIRS} SELECT * FROM pairs")
def s03(spark, sf_dir):
    path = scratch_path(spark, "pairs")
    recording_pairs(spark, sf_dir).write.option("header", True).csv(path)
    return readers.read_recording_pairs(spark, path)


@query("s04_frame_range_scan", """SELECT o_custkey AS id, CAST(o_orderkey % 1000 AS INTEGER) AS start_frame, CAST(o_orderkey % 1000 AS INTEGER) + 100 AS end_frame FROM orders""")
def s04(spark, sf_dir):
    path = scratch_path(spark, "ranges")
    frame_metadata(spark, sf_dir).select(F.col("id").alias("ID"), F.col("start_frame").alias("Start_Frame"),
                                         F.col("end_frame").alias("End_Frame")).write.option("header", True).csv(path)
    return readers.read_frame_ranges(spark, path).drop("seq")


@query("s05_prompt_scan", f"WITH {V8}, {CLICKS} SELECT participant_id, label_ord, label, click_ord, x, y, positive, frame FROM clicks")
def s05(spark, sf_dir):
    path = scratch_path(spark, "prompts")
    writers.write_prompt_documents(prompt_json(prompts(spark, sf_dir), LABELS), path)
    return parse_prompt_json(_written_prompts(spark, path)).drop("part")


def _written_prompts(spark, path):
    return spark.read.schema("participant_id string, part long, json string").option("mode", "FAILFAST").json(path).drop(writers.GROUP)


@query("e05b_prompt_parts", PROMPT_OBJECTS)
def e05b(spark, sf_dir):
    """Objects from documents of thirty clicks each, after writing and reading."""
    path = scratch_path(spark, "prompts")
    writers.write_prompt_documents(prompt_json(prompts(spark, sf_dir), LABELS, 30), path)
    return jobs.prompt_objects(_written_prompts(spark, path))


@query("s06_mask_archives", f"WITH {FG} SELECT {KEY}, 'obj' || label_ord AS label, 8 AS h, 8 AS w, counts FROM rle")
def s06(spark, sf_dir):
    return binary.archive_masks(binary.mask_archives(mask_rows(spark, sf_dir)))


@query("s06b_archive_files", f"""WITH {FG} SELECT {KEY}, 'obj' || label_ord AS label, 8 AS h, 8 AS w, counts FROM rle""")
def s06b(spark, sf_dir):
    """Archives written as files and scanned."""
    folder = scratch_path(spark, "archives")
    binary.write_mask_archives(mask_rows(spark, sf_dir), folder)
    return binary.read_mask_archives(spark, folder)


@query("s06c_some_archive_files", f"""WITH {FG} SELECT {KEY}, 'obj' || label_ord AS label, 8 AS h, 8 AS w, counts FROM rle
WHERE participant_id IN ('0', '3') AND frame BETWEEN 5 AND 11""")
def s06c(spark, sf_dir):
    folder = scratch_path(spark, "archives")
    binary.write_mask_archives(mask_rows(spark, sf_dir), folder)
    return binary.read_mask_archives(spark, folder, ["0", "3"], (5, 11))


def image_bytes(spark, sf_dir):
    """vec_id and 21 pixels of three channels."""
    def byte(place):
        value = (F.abs(F.element_at("embedding", place).cast("double")) * 400).cast("int")
        return F.lpad(F.hex(value), 2, "0")
    order = F.sequence(F.lit(0), F.lit(62))
    data = F.unhex(F.array_join(F.transform(order, lambda i: byte(F.floor(i / 3).cast("int") * 3 + 3 - i % 3)), ""))
    return table(spark, sf_dir, "embeddings").select("vec_id", data.alias("data"))


def image_files(spark, sf_dir):
    """The images as files <participant>/<frame>.bmp: a header for one row of 21 pixels, the pixels, and one byte of fill."""
    # The two headers of an uncompressed bitmap with 24 bits a pixel.
    head = "424d760000000000000036000000" "28000000150000000100000001001800000000004000000000000000000000000000000000000000"
    folder = scratch_path(spark, "images")
    vec = F.col("vec_id")
    files = image_bytes(spark, sf_dir).select(
        F.format_string("p%d/%d.bmp", F.floor(vec / 100), vec % 100).alias("name"), F.concat(F.unhex(F.lit(head)), "data", F.unhex(F.lit("00"))).alias("content"))
    binary.write_files(files, folder)
    return folder


@query("s07b_frame_folders", """SELECT 'p' || (vec_id // 100) AS participant_id, CAST(vec_id % 100 AS VARCHAR) AS stem, vec_id % 100 AS frame_number,
  row_number() OVER (PARTITION BY vec_id // 100 ORDER BY vec_id % 100) - 1 AS position FROM embeddings""")
def s07b(spark, sf_dir):
    found = readers.list_frame_files(spark, image_files(spark, sf_dir))
    owned = found.select(F.regexp_extract("path", "([^/]+)/[^/]*$", 1).alias("participant_id"), "path")
    return readers.frame_catalogue(owned, ["participant_id"]).drop("path")


@query("s08b_image_files", f"WITH {GRAYS} SELECT vec_id, brightness FROM gray")
def s08b(spark, sf_dir):
    found = binary.read_frame_brightness(spark, image_files(spark, sf_dir))
    place = [F.regexp_extract("origin", r"p([0-9]+)/([0-9]+)\.bmp$", k).cast("long") for k in (1, 2)]
    return found.select((place[0] * 100 + place[1]).alias("vec_id"), "brightness")


NAMES = """
named AS (
  SELECT CAST(user_id AS VARCHAR) AS participant_id, CASE WHEN event_id % 10 = 0 THEN 'f' ELSE '' END || event_id AS stem,
    CASE WHEN event_id % 10 <> 0 THEN event_id END AS frame_number, CASE event_id % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' WHEN 2 THEN '.txt' ELSE '.jpeg' END AS ending FROM events)"""


def names(spark, sf_dir):
    key = F.col("event_id")
    stem = F.concat(F.when(key % 10 == 0, "f").otherwise(""), key.cast("string"))
    ending = F.when(key % 4 == 0, ".jpg").when(key % 4 == 1, ".PNG").when(key % 4 == 2, ".txt").otherwise(".jpeg")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("participant_id"), F.concat(F.lit("frames/"), stem, ending).alias("path"))


CATALOGUE = f"""WITH {NAMES}
SELECT participant_id, 'frames/' || stem || ending AS path, stem, frame_number,
  row_number() OVER (PARTITION BY participant_id ORDER BY frame_number IS NULL, frame_number, stem) - 1 AS position FROM named WHERE ending <> '.txt'"""


@query("s07_frame_catalogue", CATALOGUE)
def s07(spark, sf_dir):
    return readers.frame_catalogue(names(spark, sf_dir), ["participant_id"])


@query("t03_numeric_order", CATALOGUE + " ORDER BY participant_id, position")
def t03(spark, sf_dir):
    return readers.frame_catalogue(names(spark, sf_dir), ["participant_id"]).orderBy("participant_id", "position")


@query("s08_image_brightness", f"WITH {GRAYS} SELECT vec_id, brightness FROM gray")
def s08(spark, sf_dir):
    return image_bytes(spark, sf_dir).select("vec_id", binary.frame_brightness(F.col("data"), F.lit(3)).alias("brightness"))


@query("s10_code_sink", f"WITH {V1} SELECT participant_id, frame + 1 AS framenum, code FROM v1")
def s10(spark, sf_dir):
    path = scratch_path(spark, "codes")
    writers.write_codes(gaze_codes(spark, sf_dir).withColumn("framenum", F.col("frame") + 1), path)
    return _partitioned_csv(spark, path, "framenum int, code string")


@query("s11_score_csv", SCORES)
def s11(spark, sf_dir):
    path = scratch_path(spark, "scores")
    scores = summary_scores(events(spark, sf_dir), FPS)
    writers.write_scores_csv(scores, path)
    return spark.read.schema(scores.schema).option("header", True).csv(path)


@query("s12_score_json", SCORES)
def s12(spark, sf_dir):
    path = scratch_path(spark, "scores")
    scores = summary_scores(events(spark, sf_dir), FPS)
    writers.write_scores_json(scores, path)
    return spark.read.schema(scores.schema).json(path)


@query("s13_offset_sink", f"WITH {OFFSETS} SELECT participant_id, reference_lights_on_sec, target_lights_on_sec, offset_sec, NULLIF(notes, '') AS notes FROM offsets")
def s13(spark, sf_dir):
    path = scratch_path(spark, "offsets")
    writers.write_offsets(offsets(spark, sf_dir), path)
    return spark.read.schema(SYNC_RESULTS).option("header", True).option("emptyValue", "").csv(path).withColumn("notes", F.nullif("notes", F.lit("")))


@query("s14_partitioned_layout", f"""WITH {WIDE}
SELECT participant_id, count(*) AS n_rows, sum(fixation_count) AS fixations FROM summary GROUP BY participant_id""")
def s14(spark, sf_dir):
    path = scratch_path(spark, "scores")
    scores = summary_scores(events(spark, sf_dir), FPS, wide=False)
    writers.write_scores_json(scores, path, partitioned=True)
    back = spark.read.schema(scores.schema).json(path)
    folder = F.regexp_extract(F.col("_metadata.file_path"), "participant_id=([^/]+)/", 1)
    return back.withColumn("folder", folder).groupBy(F.col("folder").alias("participant_id")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("fixation_count").alias("fixations"))


E01 = SCORES.replace("WITH " + WIDE[:WIDE.index(",\nsums AS")], "WITH " + HALF_OPEN).replace("FROM runs r JOIN", "FROM half r JOIN")


def _half(sql):
    head, tail = sql.split(",\nsums AS", 1)
    return head + ",\nsums AS" + tail.replace("FROM runs", "FROM half")


@query("e01_fixation_metrics", _half(E01))
def e01(spark, sf_dir):
    return jobs.run_fixation_metrics(spark, run_file(spark, sf_dir, partitioned=False), scratch_path(spark, "metrics"), FPS,
                                     cohort_source=True, partitioned=False)
