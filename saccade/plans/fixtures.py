"""Gaze-like views over general tables, in Spark and, for checking, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from saccade.operators.components import logits_to_masks
from saccade.operators.ordered import minute_chunk, ranked

FPS = 30.0
MAP_FPS = 29.96
GRID = 8
IOU = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("int")


def gaze_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """participant_id, frame, code, event_id, ts, value, k: the events of a user as frames."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("participant_id"), "ts", "event_id", "value", _k().alias("k"),
        F.when(F.col("event_type") == "error", "none").otherwise(F.col("event_type")).alias("code"))
    placed = ranked(events, ["participant_id"], ["ts", "event_id"], minute_chunk(F.col("ts")), "place")
    return placed.withColumn("frame", (F.col("place") - 1).cast("int")).drop("place")


V1 = """
v1 AS (
  SELECT CAST(user_id AS VARCHAR) AS participant_id,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame,
         CASE WHEN event_type = 'error' THEN 'none' ELSE event_type END AS code,
         event_id, ts, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""

RUNS = V1 + """,
marked AS (
  SELECT *, CASE WHEN lag(code) OVER (PARTITION BY participant_id ORDER BY frame) = code THEN 0 ELSE 1 END AS starts
  FROM v1),
numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY participant_id ORDER BY frame) AS run FROM marked),
runs AS (
  SELECT participant_id, min(code) AS aoi_name, CAST(count(*) AS INTEGER) AS duration_frames,
         min(frame) AS start_frame, max(frame) AS end_frame
  FROM numbered GROUP BY participant_id, run)"""


def gaze_samples(spark: SparkSession, sf_dir: str, gaps: bool = True) -> DataFrame:
    """Two samples per frame, some without a position, some outside, and some frames without a sample."""
    codes = gaze_codes(spark, sf_dir)
    samples = codes.select(
        "participant_id", F.col("event_id").alias("sample_seq"), F.floor(F.col("frame") / 2).cast("int").alias("world_index"),
        F.when(F.col("k") % 11 != 0, F.col("k") / F.lit(80.0)).alias("norm_x"), (F.col("value") / F.lit(250.0)).alias("norm_y"))
    return samples.filter(F.col("world_index") % 7 != 3) if gaps else samples


V2 = V1 + """,
v2 AS (
  SELECT participant_id, event_id AS sample_seq, CAST(frame // 2 AS INTEGER) AS world_index,
         CASE WHEN k % 11 <> 0 THEN k / 80.0::DOUBLE END AS norm_x, value / 250.0::DOUBLE AS norm_y
  FROM v1),
v2b AS (SELECT * FROM v2 WHERE world_index % 7 <> 3)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame range of each participant, covering also frames without a sample."""
    return gaze_samples(spark, sf_dir, gaps=False).groupBy("participant_id").agg(
        F.min("world_index").alias("start_frame"), (F.max("world_index") + 1).alias("end_frame"))


SESSIONS = """
sessions AS (
  SELECT participant_id, min(world_index) AS start_frame, max(world_index) + 1 AS end_frame FROM v2 GROUP BY 1),
frames AS (
  SELECT participant_id, CAST(unnest(range(start_frame, end_frame)) AS INTEGER) AS frame, start_frame FROM sessions),
first_sample AS (
  SELECT participant_id, world_index AS frame, arg_min({'x': norm_x, 'y': norm_y}, sample_seq) AS s
  FROM v2b GROUP BY ALL),
seen AS (
  SELECT f.participant_id, f.frame, f.frame - f.start_frame + 1 AS framenum, p.s.x AS norm_x, p.s.y AS norm_y,
         CAST(trunc(p.s.x * 8) AS INTEGER) AS px, CAST(trunc((1 - p.s.y) * 8) AS INTEGER) AS py
  FROM frames f LEFT JOIN first_sample p USING (participant_id, frame)),
valid AS (
  SELECT *, COALESCE(norm_x IS NOT NULL AND norm_y IS NOT NULL AND NOT isnan(norm_x) AND NOT isnan(norm_y)
                     AND px >= 0 AND px < 8 AND py >= 0 AND py < 8, false) AS is_valid
  FROM seen)"""


def brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaze_codes(spark, sf_dir).select(
        F.col("participant_id").alias("recording_id"), "frame", (F.col("frame") / F.lit(MAP_FPS)).alias("ts_sec"),
        F.col("value").alias("brightness"))


V3 = V1 + """,
v3 AS (
  SELECT participant_id AS recording_id, frame, frame / 29.96::DOUBLE AS ts_sec, value AS brightness FROM v1)"""


def recording_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's recording against that of the user half the number of users further on."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    half = F.floor(users.agg(F.count(F.lit(1)).alias("n")).scalar() / 2)
    return users.select(
        F.col("user_id").cast("string").alias("participant_id"), F.col("user_id").cast("string").alias("reference_video"),
        (F.col("user_id") + half).cast("string").alias("target_video"))


PAIRS = """
pairs AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS participant_id, CAST(user_id AS VARCHAR) AS reference_video,
         CAST(user_id + (SELECT count(DISTINCT user_id) FROM events) // 2 AS VARCHAR) AS target_video
  FROM events)"""


def mask_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score arrays of 8 x 8 pixels, four objects per frame, 25 frames per participant."""
    vec = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(vec / 100).cast("string").alias("participant_id"),
        F.floor((vec % 100) / 4).cast("int").alias("frame"), (vec % 4).cast("int").alias("label_ord"),
        F.concat(F.lit("obj"), (vec % 4).cast("string")).alias("label"),
        F.lit(GRID).alias("h"), F.lit(GRID).alias("w"), F.col("embedding").alias("logits"), "vec_id")


V4 = """
v4 AS (
  SELECT CAST(vec_id // 100 AS VARCHAR) AS participant_id, CAST((vec_id % 100) // 4 AS INTEGER) AS frame,
         CAST(vec_id % 4 AS INTEGER) AS label_ord, 'obj' || (vec_id % 4) AS label, embedding, vec_id
  FROM embeddings),
spots AS (SELECT *, unnest(range(64)) AS i FROM v4),
px AS (
  SELECT participant_id, frame, label_ord, label, vec_id, embedding, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y,
         (i % 8) * 8 + i // 8 AS off, embedding[i + 1] AS logit
  FROM spots)"""


def mask_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logits_to_masks(mask_logits(spark, sf_dir)).drop("vec_id")


def mask_wearer(spark: SparkSession, sf_dir: str, participant: F.Column) -> F.Column:
    """The mask participant whose masks a participant of the events wears; all of them are worn."""
    last = table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).scalar()
    return (participant.cast("long") % (F.floor(last / 100) + 1)).cast("string")


WEARER = "CAST(CAST(participant_id AS BIGINT) % (SELECT max(vec_id) // 100 + 1 FROM embeddings) AS VARCHAR)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes grouped by order: g, id, x0, y0, x1, y1, score."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *order, "l_quantity")
    # A struct, as its nulls equal each other when the chunks are joined.
    chunk = F.struct(F.floor(F.col("l_linenumber") / 16).alias("lines"))
    placed = ranked(lines, ["l_orderkey"], order, chunk, "id")
    return placed.select(
        F.col("l_orderkey").alias("g"), "id", (F.col("l_partkey") % 20).cast("int").alias("x0"),
        (F.col("l_suppkey") % 20).cast("int").alias("y0"), "l_quantity", "l_linenumber",
        F.col("l_extendedprice").alias("score")
    ).select("g", "id", "x0", "y0", (F.col("x0") + 10 + F.col("l_quantity").cast("int") % 20).alias("x1"),
             (F.col("y0") + 10 + 3 * F.col("l_linenumber")).alias("y1"), "score")


V5 = """
v5a AS (
  SELECT l_orderkey AS g,
         row_number() OVER (PARTITION BY l_orderkey
                            ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS id,
         CAST(l_partkey % 20 AS INTEGER) AS x0, CAST(l_suppkey % 20 AS INTEGER) AS y0,
         CAST(trunc(l_quantity) AS INTEGER) % 20 AS q, l_linenumber AS n, l_extendedprice AS score
  FROM lineitem),
v5 AS (SELECT g, id, x0, y0, x0 + 10 + q AS x1, y0 + 10 + 3 * n AS y1, score FROM v5a)"""


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))


def frame_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("o_orderkey") % 1000).cast("int")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), start.alias("start_frame"), (start + 100).alias("end_frame"),
        F.col("o_orderkey").alias("seq"))


PROMPT_FILE = "prompts/{id}_coordinates.json"


def prompt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter(F.col("c_nationkey") % 5 != 0).select(
        F.format_string("prompts/%03d_coordinates.json", F.col("c_custkey")).alias("path"))


def frame_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many frame files per participant as the nation number says, and none for some participants."""
    return table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") != "BUILDING").select(
        F.col("c_custkey").alias("id"), F.explode(F.sequence(F.lit(0), F.col("c_nationkey"))).alias("file"))


V6 = """
sel AS (SELECT c_custkey AS id, lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(3, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS participant_id
        FROM customer),
meta AS (
  SELECT o_custkey AS id, CAST(arg_min(o_orderkey % 1000, o_orderkey) AS INTEGER) AS start_frame,
         CAST(arg_min(o_orderkey % 1000, o_orderkey) AS INTEGER) + 100 AS end_frame
  FROM orders GROUP BY o_custkey),
prompted AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey % 5 <> 0),
counted AS (SELECT c_custkey AS id, CAST(c_nationkey + 1 AS BIGINT) AS n_files FROM customer WHERE c_mktsegment <> 'BUILDING')"""


def time_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select(
        "event_id", F.date_format(ts, "HH:mm:ss").alias("hms"), F.date_format(ts, "mm:ss").alias("ms"),
        F.date_format(ts, "mm:ss:SSS").alias("msm"), "value", _k().alias("k"))


V7 = """
v7 AS (
  SELECT event_id, strftime(ts, '%H:%M:%S') AS hms, strftime(ts, '%M:%S') AS ms, strftime(ts, '%M:%S:%g') AS msm,
         CAST(strftime(ts, '%H') AS INTEGER) AS hh, CAST(strftime(ts, '%M') AS INTEGER) AS mi,
         CAST(strftime(ts, '%S') AS INTEGER) AS se, CAST(strftime(ts, '%g') AS INTEGER) AS mmm, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _k()
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("participant_id"), F.col("event_id").alias("seq"),
        F.col("event_type").alias("label"), F.floor(k / 5).cast("int").alias("frame"),
        F.col("value").cast("int").alias("x"), k.alias("y"),
        F.when(F.col("event_id") % 3 == 0, 0).otherwise(1).alias("positive"))


V8 = """
v8 AS (
  SELECT CAST(user_id AS VARCHAR) AS participant_id, event_id AS seq, event_type AS label,
         CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) // 5 AS INTEGER) AS frame,
         CAST(trunc(value) AS INTEGER) AS x, CAST(json_extract_string(props, '$.k') AS INTEGER) AS y,
         CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS positive
  FROM events)"""

LABELS = ["click", "view", "purchase", "signup"]
