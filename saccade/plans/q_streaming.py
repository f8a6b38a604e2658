"""Streaming queries, run to the end of the given tables and read back from their sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from saccade.plans.fixtures import V1, table
from saccade.plans.registry import query
from saccade.session import scratch_path
from saccade.streaming import live


def event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.unionByName(end_of_session(spark, sf_dir, schema)).select(
        F.col("user_id").cast("string").alias("participant_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"), "value",
        F.when(F.col("event_type") == "error", "none").otherwise(F.col("event_type")).alias("code"))


def end_of_session(spark, sf_dir, schema):
    """One row of no participant, a day after all others: the watermark then passes every slice that holds events."""
    path = scratch_path(spark, "end-of-session")
    end = (F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")
    last = table(spark, sf_dir, "events").agg(end)
    last.select(*[F.col(f.name) if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def drain(stream, name):
    spark = stream.sparkSession
    target = scratch_path(spark, name)
    started = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{target}-state")
        .trigger(availableNow=True).start(target)
    )
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


@query("x01_live_runs", f"""WITH {V1},
m AS (SELECT *, row_number() OVER w - 1 AS f, CASE WHEN lag(code) OVER w = code THEN 0 ELSE 1 END AS s FROM v1 WINDOW w AS (PARTITION BY participant_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(s) OVER (PARTITION BY participant_id ORDER BY f) AS run FROM m)
SELECT participant_id, min(code) AS code, min(f) AS start_frame, max(f) AS end_frame, count(*) AS n_frames FROM n GROUP BY participant_id, run""")
def x01(spark, sf_dir):
    codes = event_stream(spark, sf_dir).select("participant_id", "ts", "seq", "code")
    return live.stitch_runs(drain(live.live_runs(codes), "live-runs"))


@query("x01b_closed_runs", f"""WITH {V1},
m AS (SELECT *, row_number() OVER w - 1 AS f, CASE WHEN lag(code) OVER w = code THEN 0 ELSE 1 END AS s FROM v1 WINDOW w AS (PARTITION BY participant_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(s) OVER (PARTITION BY participant_id ORDER BY f) AS run, sum(s) OVER (PARTITION BY participant_id) AS last_run FROM m)
SELECT participant_id, min(code) AS code, min(f) AS start_frame, max(f) AS end_frame, count(*) AS n_frames FROM n
WHERE run < last_run GROUP BY participant_id, run""")
def x01b(spark, sf_dir):
    codes = event_stream(spark, sf_dir).select("participant_id", "ts", "seq", "code")
    return drain(live.closed_runs(codes), "closed-runs")


@query("x02b_light_alerts", f"""WITH {V1},
d AS (SELECT participant_id, min(ts) AS t FROM v1 WHERE value < 8.0 GROUP BY 1)
SELECT participant_id AS recording_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS lights_on
FROM v1 JOIN d USING (participant_id) WHERE value >= 8.0 AND ts > d.t GROUP BY 1""")
def x02b(spark, sf_dir):
    levels = event_stream(spark, sf_dir).select(F.col("participant_id").alias("recording_id"), "ts", F.col("value").alias("brightness"))
    found = drain(live.light_alerts(levels, 8.0), "light-alerts")
    return found.select("recording_id", F.date_format("lights_on", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("lights_on"))


@query("x02_live_lights", f"""WITH {V1},
d AS (SELECT participant_id, min(ts) AS t FROM v1 WHERE value < 8.0 GROUP BY 1)
SELECT participant_id AS recording_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS lights_on
FROM v1 JOIN d USING (participant_id) WHERE value >= 8.0 AND ts > d.t GROUP BY 1""")
def x02(spark, sf_dir):
    levels = event_stream(spark, sf_dir).select(F.col("participant_id").alias("recording_id"), "ts", F.col("value").alias("brightness"))
    found = live.first_light(drain(live.live_lights(levels, 8.0), "live-lights"))
    return found.select("recording_id", F.date_format("lights_on", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("lights_on"))


@query("x03_rolling_dwell", f"""WITH {V1},
w AS (SELECT participant_id, code, time_bucket(INTERVAL 10 MINUTE, ts) AS b FROM v1)
SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS window_start, participant_id, code, count(*) AS n_frames FROM w
GROUP BY ALL""")
def x03(spark, sf_dir):
    codes = event_stream(spark, sf_dir).select("participant_id", "ts", "code")
    dwell = drain(live.rolling_dwell(codes), "live-dwell")
    return dwell.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "participant_id", "code", "n_frames")
