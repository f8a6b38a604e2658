"""Live operators over several batches whose rows come out of order, against the same rows in order."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from saccade.operators.candidates import crop_dedupe
from saccade.streaming import live

DAY = datetime(2024, 1, 1)


def at(seconds):
    return DAY + timedelta(seconds=seconds)


def drained(spark, folder, batches, schema, operator, name):
    """The operator's rows; every batch is one file and one trigger, the last row passes the watermark over all slices."""
    source = folder / f"{name}-in"
    source.mkdir()
    for number, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, schema).toPandas()
        frame["ts"] = frame["ts"].astype("datetime64[us]").dt.tz_localize("UTC")
        path = source / f"{number}.parquet"
        frame.to_parquet(path, index=False)
        os.utime(path, (1_700_000_000 + 10 * number,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    found = operator(stream)
    query = (found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(folder / f"{name}-state"))
             .trigger(availableNow=True).start(str(folder / f"{name}-out")))
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(str(folder / f"{name}-out")), query


def test_runs_wait_for_rows_inside_the_delay(spark, tmp_path):
    schema = "participant_id string, ts timestamp, seq long, code string"
    batches = [[("p", at(10), 1, "a"), ("p", at(20), 3, "b")],
               [("p", at(15), 2, "a"), ("p", at(70), 5, "b"), ("q", at(5), 9, None), ("q", at(6), 10, None)],
               [("p", at(61), 4, "b"), ("p", at(75), 6, "c")],
               [("end", at(90000), 0, "-")],
               [("end", at(90000), 1, "-")],
               [("p", at(12), 7, "z"), ("end", at(90001), 0, "-")]]
    pieces, query = drained(spark, tmp_path, batches, schema, lambda s: live.live_runs(s, "10 minutes", 60), "live_runs_test")
    runs = live.stitch_runs(pieces).orderBy("participant_id", "start_frame").collect()
    assert [tuple(r) for r in runs] == [
        ("p", "a", 0, 1, 2), ("p", "b", 2, 4, 3), ("p", "c", 5, 5, 1), ("q", None, 0, 1, 2)]
    assert live.late_rows(query) == 1


def test_lights_in_any_order(spark, tmp_path):
    schema = "recording_id string, ts timestamp, brightness double"
    batches = [[("r", at(10), 5.0), ("r", at(20), 90.0)], [("r", at(15), 90.0), ("s", at(30), 90.0), ("t", at(1), 90.0)],
               [("s", at(25), 5.0), ("t", at(50), 5.0), ("t", at(70), 90.0), ("u", at(1), None)], [("end", at(90000), 0.0)]]
    slices, _ = drained(spark, tmp_path, batches, schema, lambda s: live.live_lights(s, 50.0, "10 minutes", 60), "live_lights_test")
    found = live.first_light(slices).select("recording_id", F.date_format("lights_on", "mm:ss").alias("t")).collect()
    assert sorted(tuple(r) for r in found) == [("r", "00:15"), ("s", "00:30"), ("t", "01:10")]


def test_runs_are_sent_when_the_next_label_is_settled(spark, tmp_path):
    schema = "participant_id string, ts timestamp, seq long, code string"
    batches = [[("p", at(10), 1, "a"), ("p", at(20), 3, "b"), ("r", at(3), 1, "a")],
               [("p", at(15), 2, "a"), ("p", at(70), 5, "b"), ("q", at(5), 9, None), ("q", at(6), 10, None), ("q", at(7), 11, "c"), ("p", None, 3, "z")],
               [("p", at(61), 4, "b"), ("p", at(75), 6, "c"), ("p", at(5000), 7, "d")],
               [("end", at(5000), 0, "-")],
               [("p", at(12), 8, "z")],
               [("p", at(5001), 9, "e")]]
    runs, query = drained(spark, tmp_path, batches, schema, lambda s: live.closed_runs(s, "10 minutes"), "closed_runs_test")
    assert sorted(tuple(r) for r in runs.collect() if r.code) == [("p", "a", 0, 1, 2), ("p", "b", 2, 4, 3)]
    assert [tuple(r) for r in runs.collect() if not r.code] == [("q", None, 0, 1, 2)]
    assert live.late_rows(query) == 1


def test_light_alerts_in_any_order(spark, tmp_path):
    schema = "recording_id string, ts timestamp, brightness double"
    batches = [[("r", at(10), 5.0), ("r", at(20), 90.0)], [("r", at(15), 90.0), ("s", at(30), 90.0), ("t", at(1), 90.0)],
               [("s", at(25), 5.0), ("s", at(25), 90.0), ("t", at(50), 5.0), ("t", at(70), 90.0), ("u", at(1), None)],
               [("end", at(90000), 0.0)], [("r", at(90001), 0.0), ("end", at(90001), 90.0)], [("r", at(99999), 90.0)]]
    alerts, _ = drained(spark, tmp_path, batches, schema, lambda s: live.light_alerts(s, 50.0, "10 minutes"), "light_alerts_test")
    found = alerts.select("recording_id", F.date_format("lights_on", "mm:ss").alias("t")).collect()
    assert sorted(tuple(r) for r in found if r.recording_id != "end") == [("r", "00:15"), ("s", "00:30"), ("t", "01:10")]


@pytest.mark.parametrize("second_crop, kept", [(8, [1, 2]), (4, [2])])
def test_crop_copies_go_only_where_an_image_has_several_crops(spark, second_crop, kept):
    columns = ["image_id", "candidate_id", "x0", "y0", "x1", "y1", "crop_x0", "crop_y0", "crop_x1", "crop_y1"]
    records = spark.createDataFrame([("i", 1, 0, 0, 4, 4, 0, 0, 8, 8), ("i", 2, 0, 0, 4, 4, 0, 0, second_crop, 8)], columns)
    assert sorted(r.candidate_id for r in crop_dedupe(records, 0.5).collect()) == kept


def test_keys_share_states(spark, tmp_path, monkeypatch):
    """Many keys are few states, and every key still has its own runs and its own type."""
    monkeypatch.setattr(live, "SHARES", 3)
    schema = "participant_id long, ts timestamp, seq long, code string"
    users = range(30)
    batches = [[(u, at(10 + k), k, "ab"[k // 2]) for u in users for k in (3, 0)], [(u, at(10 + k), k, "ab"[k // 2]) for u in users for k in (1, 2)],
               [(-1, at(90000), 0, "-")], [(-1, at(90001), 0, "-")]]
    runs, query = drained(spark, tmp_path, batches, schema, lambda s: live.closed_runs(s, "10 minutes"), "shared_states_test")
    assert runs.schema["participant_id"].dataType.simpleString() == "bigint"
    assert sorted(map(tuple, runs.collect())) == [(u, "a", 0, 1, 2) for u in users]
    assert max(s["numRowsTotal"] for r in query.recentProgress for s in r["stateOperators"]) <= 3


def test_light_alerts_share_states(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "SHARES", 3)
    schema = "recording_id long, ts timestamp, brightness double"
    batches = [[(u, at(10 + u + k), 90.0 * (k % 2)) for u in range(30) for k in (1, 0)], [(u, at(12 + u + u % 2), 90.0) for u in range(30)],
               [(-1, at(90000), None)], [(-1, at(90001), None)]]
    alerts, query = drained(spark, tmp_path, batches, schema, lambda s: live.light_alerts(s, 50.0, "10 minutes"), "shared_alerts_test")
    found = alerts.select("recording_id", F.unix_timestamp("lights_on")).collect()
    start = int((DAY - datetime(1970, 1, 1)).total_seconds())
    assert sorted(map(tuple, found)) == [(u, start + 11 + u) for u in range(30)]
    assert max(s["numRowsTotal"] for r in query.recentProgress for s in r["stateOperators"]) <= 3


def test_light_alerts_keep_only_rows_that_may_decide(spark, tmp_path):
    """A recording's state is its first dark row and the bright ones up to the first after it, not all rows inside the delay."""
    schema = "recording_id string, ts timestamp, brightness double"
    batches = [[(f"r{u}", at(100 + k), (None, 90.0, 5.0)[k % 3]) for u in range(5) for k in range(60)],
               [("r1", at(50), 5.0), ("r2", at(101.5), 5.0), ("r3", at(103.5), 90.0), ("r4", at(101), 5.0)],
               [("end", at(90000), None)], [("end", at(90001), None)]]
    alerts, _ = drained(spark, tmp_path, batches, schema, lambda s: live.light_alerts(s, 50.0, "10 minutes"), "few_rows_test")
    found = alerts.select("recording_id", F.date_format("lights_on", "mm:ss.S").alias("t")).collect()
    assert sorted(map(tuple, found)) == [("r0", "01:44.0"), ("r1", "01:41.0"), ("r2", "01:44.0"), ("r3", "01:43.5"), ("r4", "01:44.0")]
    held = spark.read.format("statestore").option("batchId", 0).load(str(tmp_path / "few_rows_test-state"))
    [(rows,)] = held.agg(F.sum(F.size("value.groupState.ts"))).collect()
    assert rows == 5 * 3


def test_rows_left_out_never_decide_an_alert():
    """Alerts from the kept rows and any that come later are those from all rows."""
    def alert(rows, dark_at):
        for ts, _, _, light in sorted(rows, key=lambda r: r[:2]):
            if light == "dark" and dark_at is None:
                dark_at = ts
            elif light == "bright" and dark_at is not None and ts > dark_at:
                return ts
        return None

    draw = random.Random(7)
    for _ in range(3000):
        def drawn(n):
            lights = draw.choices([("dark", 0), ("bright", 1), (None, 1)], k=n)
            return sorted(((draw.randint(1, 9), seq, "p", light) for light, seq in lights), key=lambda r: r[:2])

        waiting, dark_at = drawn(draw.randint(0, 8)), draw.choice([None, None, 0])
        kept, later = live._deciding(waiting, {"p": (dark_at, None)} if dark_at is not None else {}), drawn(draw.randint(0, 3))
        assert alert(kept + later, dark_at) == alert(waiting + later, dark_at)
        assert sum(row[3] == "dark" for row in kept) <= (dark_at is None)
    assert live._deciding([(5, 1, "p", "bright")], {"p": (1, 3)}) == []


def test_crop_copies_read_their_records_once(spark, tmp_path):
    """What makes the records runs once, not again for each part of the answer."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(image, place, 0, 0, 4, 4, 0, 0, 8 - 4 * (place * image % 2), 8) for image in range(6) for place in range(2)]
    records = spark.createDataFrame(rows, "image_id int, candidate_id int, x0 int, y0 int, x1 int, y1 int, crop_x0 int, crop_y0 int, crop_x1 int, crop_y1 int")
    kept = crop_dedupe(records.mapInArrow(counted, records.schema), 0.5)
    assert sorted((r.image_id, r.candidate_id) for r in kept.collect()) == [
        (0, 0), (0, 1), (1, 1), (2, 0), (2, 1), (3, 1), (4, 0), (4, 1), (5, 1)]
    assert read.value == len(rows)
