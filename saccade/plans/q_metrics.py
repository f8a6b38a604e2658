"""Queries on runs and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from saccade.operators import metrics as M
from saccade.operators.runs import collapse_runs, drop_labels
from saccade.plans.fixtures import FPS, MAP_FPS, RUNS, V1, gaze_codes
from saccade.plans.registry import query

MS = "(1000.0::DOUBLE / 30.0::DOUBLE)"
NAMES = ["click", "none", "purchase", "signup", "view"]


def events(spark, sf_dir):
    return collapse_runs(gaze_codes(spark, sf_dir), FPS)


@query("w01_runs", f"""WITH {RUNS}
SELECT participant_id, aoi_name, duration_frames * {MS} AS duration_ms, duration_frames,
       start_frame * {MS} AS timestamp_ms, start_frame, end_frame FROM runs""")
def w01(spark, sf_dir):
    return collapse_runs(gaze_codes(spark, sf_dir), FPS)


@query("p07_none_filter", f"""WITH {RUNS}
SELECT participant_id, aoi_name, start_frame, end_frame FROM runs WHERE aoi_name <> 'none'""")
def p07(spark, sf_dir):
    kept = collapse_runs(gaze_codes(spark, sf_dir), FPS, none_label="none")
    return kept.select("participant_id", "aoi_name", "start_frame", "end_frame")


@query("p07b_label_filter", f"WITH {V1} SELECT participant_id, frame, code FROM v1 WHERE code NOT IN ('none', 'None')")
def p07b(spark, sf_dir):
    return drop_labels(gaze_codes(spark, sf_dir), "code", ["none", "None"]).select("participant_id", "frame", "code")


def seconds(column):
    return f"round({column} / 29.96::DOUBLE, 2)"


OPEN_RUNS = RUNS + """,
lasts AS (SELECT participant_id, max(end_frame) AS last_frame FROM runs GROUP BY participant_id),
file_runs AS (
  SELECT r.participant_id, aoi_name AS name, duration_frames AS frame_duration,
         start_frame - CASE WHEN end_frame = last_frame THEN 1 ELSE 0 END AS start_frame,
         end_frame + CASE WHEN end_frame = last_frame THEN 0 ELSE 1 END AS end_frame
  FROM runs r JOIN lasts l USING (participant_id))"""


@query("w02_run_file", f"""WITH {OPEN_RUNS}
SELECT *, {seconds('frame_duration')} AS duration_s, {seconds('start_frame')} AS start_s, {seconds('end_frame')} AS end_s
FROM file_runs""")
def w02(spark, sf_dir):
    return collapse_runs(gaze_codes(spark, sf_dir), MAP_FPS, end_mode="reference")


@query("w02b_run_half_open", f"""WITH {RUNS}
SELECT participant_id, aoi_name AS name, duration_frames AS frame_duration, start_frame, end_frame + 1 AS end_frame,
       {seconds('duration_frames')} AS duration_s, {seconds('start_frame')} AS start_s, {seconds('(end_frame + 1)')} AS end_s
FROM runs""")
def w02b(spark, sf_dir):
    return collapse_runs(gaze_codes(spark, sf_dir), MAP_FPS, end_mode="half_open")


NEXT = RUNS + """,
paired AS (
  SELECT participant_id, aoi_name, start_frame, end_frame,
         lead(aoi_name) OVER (PARTITION BY participant_id ORDER BY start_frame, end_frame) AS next_aoi
  FROM runs)"""


@query("w03_next_event", f"WITH {NEXT} SELECT * FROM paired")
def w03(spark, sf_dir):
    return M.next_events(events(spark, sf_dir))


SUMS = RUNS + f""",
sums AS (
  SELECT participant_id, aoi_name, sum(duration_frames) AS frames, count(*) AS fixation_count,
         min(duration_frames) AS min_frames, max(duration_frames) AS max_frames, min(start_frame) AS first_frame
  FROM runs GROUP BY participant_id, aoi_name),
shared AS (SELECT *, sum(frames) OVER (PARTITION BY participant_id) AS total_frames FROM sums),
summary AS (
  SELECT participant_id, aoi_name, frames * {MS} AS dwell_time,
         CAST(frames AS DOUBLE) / total_frames AS proportion_of_dwell_time, fixation_count,
         min_frames * {MS} AS fixation_duration_min, max_frames * {MS} AS fixation_duration_max,
         frames * {MS} / fixation_count AS mean_fixation_duration_per_aoi, first_frame * {MS} AS latency_to_first_fixation
  FROM shared)"""


def summary_query(name, columns):
    @query(name, f"WITH {SUMS} SELECT participant_id, aoi_name, {', '.join(columns)} FROM summary")
    def run(spark, sf_dir):
        return M.aoi_summary(events(spark, sf_dir), FPS).select("participant_id", "aoi_name", *columns)
    return run


a01 = summary_query("a01_dwell_time", ["dwell_time"])
a03 = summary_query("a03_dwell_proportion", ["proportion_of_dwell_time"])
a04 = summary_query("a04_fixation_count", ["fixation_count"])
a05 = summary_query("a05_fixation_min_max", ["fixation_duration_min", "fixation_duration_max"])
a06 = summary_query("a06_mean_fixation", ["mean_fixation_duration_per_aoi"])


@query("a02_participant_total", f"""WITH {RUNS}
SELECT participant_id, sum(duration_frames) * {MS} AS total_time FROM runs GROUP BY participant_id""")
def a02(spark, sf_dir):
    total = events(spark, sf_dir).groupBy("participant_id").agg(F.sum("duration_frames").alias("frames"))
    return total.select("participant_id", (F.col("frames") * F.lit(1000.0 / FPS)).alias("total_time"))


@query("a07_latency", f"""WITH {RUNS},
grid AS (SELECT * FROM (SELECT DISTINCT participant_id FROM runs) CROSS JOIN (SELECT DISTINCT aoi_name FROM runs)),
firsts AS (SELECT participant_id, aoi_name, min(start_frame) AS f FROM runs GROUP BY ALL)
SELECT participant_id, aoi_name, COALESCE(f * {MS}, -1.0::DOUBLE) AS latency_to_first_fixation
FROM grid LEFT JOIN firsts USING (participant_id, aoi_name)""")
def a07(spark, sf_dir):
    return M.latency_grid(events(spark, sf_dir), FPS)


@query("a08_transition_counts", f"""WITH {NEXT}
SELECT participant_id, aoi_name AS source_aoi, next_aoi AS target_aoi, count(*) AS n
FROM paired WHERE next_aoi IS NOT NULL GROUP BY ALL""")
def a08(spark, sf_dir):
    return M.transition_counts(events(spark, sf_dir))


@query("a08b_self_transitions", f"""WITH {RUNS},
kept AS (SELECT * FROM runs WHERE aoi_name <> 'none'),
paired AS (SELECT participant_id, aoi_name, lead(aoi_name) OVER (PARTITION BY participant_id ORDER BY start_frame) AS next_aoi FROM kept)
SELECT participant_id, aoi_name AS source_aoi, next_aoi AS target_aoi, count(*) AS n
FROM paired WHERE next_aoi IS NOT NULL GROUP BY ALL""")
def a08b(spark, sf_dir):
    return M.transition_counts(collapse_runs(gaze_codes(spark, sf_dir), FPS, none_label="none"))


MATRIX = NEXT + """,
pairs AS (
  SELECT participant_id, aoi_name AS source_aoi, next_aoi AS target_aoi, count(*) AS n
  FROM paired WHERE next_aoi IS NOT NULL GROUP BY ALL),
grid AS (
  SELECT participant_id, source_aoi, target_aoi
  FROM (SELECT DISTINCT participant_id, aoi_name AS source_aoi FROM runs) CROSS JOIN (SELECT DISTINCT aoi_name AS target_aoi FROM runs)),
dense AS (
  SELECT participant_id, source_aoi, target_aoi, COALESCE(n, 0) AS n,
         sum(COALESCE(n, 0)) OVER (PARTITION BY participant_id, source_aoi) AS n_from
  FROM grid LEFT JOIN pairs USING (participant_id, source_aoi, target_aoi)),
matrix AS (
  SELECT participant_id, source_aoi, target_aoi, n,
         CASE WHEN n_from = 0 THEN 0.0::DOUBLE ELSE CAST(n AS DOUBLE) / CAST(n_from AS DOUBLE) END AS probability
  FROM dense)"""


@query("a09_transition_probability", f"WITH {MATRIX} SELECT * FROM matrix")
def a09(spark, sf_dir):
    return M.transition_matrix(events(spark, sf_dir))


@query("a09b_transition_maps", f"""WITH {NEXT},
pairs AS (
  SELECT participant_id, aoi_name AS source_aoi, next_aoi AS target_aoi, count(*) AS n
  FROM paired WHERE next_aoi IS NOT NULL GROUP BY ALL)
SELECT participant_id, source_aoi,
       '{{' || string_agg('"' || target_aoi || '":' || n, ',' ORDER BY target_aoi) || '}}' AS targets
FROM pairs GROUP BY ALL""")
def a09b(spark, sf_dir):
    maps = M.transition_maps(events(spark, sf_dir))
    return maps.withColumn("targets", F.to_json("targets"))


def phase_sql(bounds):
    limits = ("(SELECT min(start_frame) AS lo, max(end_frame) AS hi FROM runs) b ON true" if bounds == "global" else
              "(SELECT participant_id, min(start_frame) AS lo, max(end_frame) AS hi FROM runs GROUP BY 1) b USING (participant_id)")
    return f""",
framewise AS (
  SELECT r.participant_id, aoi_name, lo, hi - lo + 1 AS t, unnest(range(start_frame, end_frame + 1)) AS frame
  FROM runs r JOIN {limits}),
phased AS (
  SELECT participant_id, aoi_name, least((frame - lo) * 3 // t, 2) + 1 AS phase, count(*) AS n FROM framewise GROUP BY ALL),
phases AS (
  SELECT s.participant_id, s.aoi_name, p.phase, CAST(COALESCE(n, 0) AS DOUBLE) / CAST(s.total_frames AS DOUBLE) AS proportion
  FROM shared s CROSS JOIN (SELECT unnest(range(1, 4)) AS phase) p
  LEFT JOIN phased USING (participant_id, aoi_name, phase))"""


PHASES = SUMS + phase_sql("global")


@query("a10_temporal_dynamics", f"WITH {PHASES} SELECT participant_id, aoi_name, CAST(phase AS INTEGER) AS phase, proportion FROM phases")
def a10(spark, sf_dir):
    return M.temporal_dynamics(events(spark, sf_dir))


@query("a10b_phases_by_participant",
       f"WITH {SUMS + phase_sql('participant')} SELECT participant_id, aoi_name, CAST(phase AS INTEGER) AS phase, proportion FROM phases")
def a10b(spark, sf_dir):
    return M.temporal_dynamics(events(spark, sf_dir), bounds="participant")


@query("a11_session_bounds", f"WITH {RUNS} SELECT min(start_frame) AS min_frame, max(end_frame) AS max_frame FROM runs")
def a11(spark, sf_dir):
    return M.session_bounds(events(spark, sf_dir))


@query("a12_distinct", f"""WITH {RUNS}
SELECT DISTINCT 'participant' AS kind, participant_id AS name FROM runs
UNION ALL SELECT DISTINCT 'aoi', aoi_name FROM runs""")
def a12(spark, sf_dir):
    e = events(spark, sf_dir)
    people = e.select(F.lit("participant").alias("kind"), F.col("participant_id").alias("name")).distinct()
    return people.unionByName(e.select(F.lit("aoi").alias("kind"), F.col("aoi_name").alias("name")).distinct())


WIDE = PHASES + """,
phase_columns AS (
  SELECT participant_id, aoi_name, """ + ", ".join(
    f"max(CASE WHEN phase = {p} THEN proportion END) AS temporal_dynamics_phase{p}" for p in (1, 2, 3)) + """
  FROM phases GROUP BY ALL)"""


@query("a13_summary_scores", f"WITH {WIDE} SELECT * FROM summary JOIN phase_columns USING (participant_id, aoi_name)")
def a13(spark, sf_dir):
    return M.summary_scores(events(spark, sf_dir), FPS, wide=False)


@query("a13b_event_scores", f"""WITH {RUNS},
own AS (SELECT *, duration_frames * {MS} + (start_frame % 7) * 0.3::DOUBLE AS ms, start_frame * {MS} + 5.0::DOUBLE AS began FROM runs),
limits AS (SELECT min(start_frame) AS low, max(end_frame) AS high FROM runs),
frames AS (SELECT participant_id, aoi_name, start_frame, ms, duration_frames, unnest(range(start_frame, end_frame + 1)) AS frame FROM own),
shares AS (
  SELECT participant_id, aoi_name, phase, sum((n * ms / duration_frames)::DECIMAL(24, 6)) AS phase_ms
  FROM (SELECT participant_id, aoi_name, start_frame, ms, duration_frames, least(3, 1 + (frame - low) * 3 // (high - low + 1)) AS phase, count(*) AS n
        FROM frames, limits GROUP BY ALL) GROUP BY ALL),
phase_columns AS (
  SELECT participant_id, aoi_name, {", ".join(f"coalesce(max(phase_ms) FILTER (phase = {p}), 0)::DOUBLE AS phase{p}" for p in (1, 2, 3))}
  FROM shares GROUP BY ALL),
sums AS (
  SELECT participant_id, aoi_name, sum(ms::DECIMAL(24, 6)) AS dwell, count(*) AS fixation_count, min(ms) AS shortest, max(ms) AS longest, min(began) AS first
  FROM own GROUP BY ALL),
totals AS (SELECT *, sum(dwell) OVER (PARTITION BY participant_id)::DOUBLE AS total FROM sums)
SELECT participant_id, aoi_name, dwell::DOUBLE AS dwell_time, dwell::DOUBLE / total AS proportion_of_dwell_time, fixation_count,
  shortest AS fixation_duration_min, longest AS fixation_duration_max, dwell::DOUBLE / fixation_count AS mean_fixation_duration_per_aoi,
  first AS latency_to_first_fixation, {", ".join(f"phase{p} / total AS temporal_dynamics_phase{p}" for p in (1, 2, 3))}
FROM totals JOIN phase_columns USING (participant_id, aoi_name)""")
def a13b(spark, sf_dir):
    """Events whose own times differ from frames by the rate."""
    own = events(spark, sf_dir).withColumn("duration_ms", F.col("duration_ms") + F.col("start_frame") % 7 * 0.3)
    return M.event_scores(own.withColumn("timestamp_ms", F.col("timestamp_ms") + 5.0))


SCORES_HEAD = f"WITH {WIDE}{MATRIX[len(RUNS):]}"


def targets_sql(names):
    columns = ", ".join(f"max(CASE WHEN target_aoi = '{n}' THEN probability END) AS transition_probability_to_{n}" for n in names)
    return f""",
target_columns AS (SELECT participant_id, source_aoi AS aoi_name, {columns} FROM matrix GROUP BY ALL)
SELECT * FROM summary JOIN target_columns USING (participant_id, aoi_name) JOIN phase_columns USING (participant_id, aoi_name)"""


SCORES = SCORES_HEAD + targets_sql(NAMES)


@query("a14_wide_scores", SCORES)
def a14(spark, sf_dir):
    return M.summary_scores(events(spark, sf_dir), FPS)


@query("t01_sorted_scores", SCORES + " ORDER BY participant_id, aoi_name")
def t01(spark, sf_dir):
    return M.summary_scores(events(spark, sf_dir), FPS).orderBy("participant_id", "aoi_name")


@query("t02_preview", SCORES + " ORDER BY participant_id, aoi_name LIMIT 5")
def t02(spark, sf_dir):
    return M.summary_scores(events(spark, sf_dir), FPS).orderBy("participant_id", "aoi_name").limit(5)
