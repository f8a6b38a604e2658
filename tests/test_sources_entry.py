import io
import os
import struct
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from check import compare, connect  # noqa: E402

import __spark_entry__ as entry_points  # noqa: E402
from saccade.plans import jobs  # noqa: E402
from saccade.sources import binary, readers  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_run_files(spark, tmp_path):
    (tmp_path / "007.csv").write_text("name,frame duration,start frame,end frame,duration (s),start (s),end (s)\n"
                                      " a ,2,0,2,0.2,0.0,0.2\nnone,3,2,5,0.3,0.2,0.5\n")
    rows = readers.read_runs(spark, str(tmp_path / "*.csv"), 10.0).orderBy("start_frame").collect()
    assert [(r.participant_id, r.aoi_name, r.duration_ms, r.timestamp_ms) for r in rows] == [("007", "a", 200.0, 0.0), ("007", "none", 300.0, 200.0)]
    scores = jobs.run_fixation_metrics(spark, str(tmp_path / "007.csv"), str(tmp_path / "out"), 10.0)
    assert scores.count() == 2
    assert (tmp_path / "out" / "csv" / "participant_id=007").is_dir()
    with pytest.raises(Exception):
        readers.read_runs(spark, str(tmp_path / "missing.csv")).count()


def test_gaze_and_ranges(spark, tmp_path):
    (tmp_path / "g.csv").write_text("ts,world_index,conf,x,y\n0,4,1,0.5,0.25\n1,4,1,,0.5\n")
    rows = readers.read_gaze(spark, str(tmp_path / "g.csv")).orderBy("sample_seq").collect()
    assert [(r.participant_id, r.world_index, r.norm_x, r.norm_y) for r in rows] == [("g", 4, 0.5, 0.25), ("g", 4, None, 0.5)]
    (tmp_path / "r.csv").write_text("ID,Start_Frame,End_Frame\n510,3,9\n")
    assert tuple(readers.read_frame_ranges(spark, str(tmp_path / "r.csv")).first())[:3] == (510, 3, 9)


def test_prompt_file(spark, tmp_path):
    (tmp_path / "12_coordinates.json").write_text('{"b": [{"x": 1, "y": 2, "positive": 1, "label": "b", "frame": 3}],\n "a": [{"x": 4, "y": 5, "positive": 0, "label": "a", "frame": 6}]}')
    rows = readers.read_prompts(spark, str(tmp_path)).orderBy("label_ord").collect()
    assert [(r.participant_id, r.label, r.x, r.frame) for r in rows] == [("12", "b", 1, 3), ("12", "a", 4, 6)]


def test_mask_archives(spark, tmp_path):
    (tmp_path / "9").mkdir()
    mask = np.array([[[1, 0, 1], [1, 0, 0]]], bool)
    buffer = io.BytesIO()
    np.savez_compressed(buffer, z=mask, a=~mask)
    (tmp_path / "9" / "mask_17.npz").write_bytes(buffer.getvalue())
    rows = {r.label: r for r in binary.read_mask_archives(spark, str(tmp_path)).collect()}
    assert rows["z"].counts == [0, 2, 2, 1, 1] and rows["a"].counts == [2, 2, 1, 1]
    assert (rows["z"].participant_id, rows["z"].frame, rows["z"].label_ord, rows["z"].h, rows["z"].w) == ("9", 17, 0, 2, 3)


def test_image_brightness(spark, tmp_path):
    pixels = bytes([0, 0, 255, 0, 255, 0, 0, 0, 255, 0, 0, 255, 255, 255, 0, 0])  # red, green / blue, white; rows padded
    header = b"BM" + struct.pack("<IHHI", 54 + len(pixels), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 24, 0, len(pixels), 0, 0, 0, 0)
    (tmp_path / "f.bmp").write_bytes(header + pixels)
    level = binary.read_frame_brightness(spark, str(tmp_path)).first().brightness
    assert level == (76 + 150 + 29 + 255) / 4


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "transition_probability_to_view" in df.columns


@pytest.mark.parametrize("name", ["w02_run_file", "a10_temporal_dynamics", "j03_gaze_disc_hits_mask", "j09_sync_offsets", "m14_crop_dedupe",
                                  "x01_live_runs", "x02_live_lights", "s07_frame_catalogue"])
def test_queries_match_their_sql(spark, name):
    good, text, _ = compare(spark, connect(SMALL), SMALL, name, entry_points.queries()[name], entry_points.oracle_sql()[name])
    assert good, text


def test_run_files_by_header(spark, tmp_path):
    (tmp_path / "8.csv").write_text("name,start frame,end frame,frame duration\na,10,12,2\n")
    row = readers.read_runs(spark, str(tmp_path / "8.csv"), 10.0).first()
    assert (row.duration_frames, row.start_frame, row.end_frame) == (2, 10, 12)
    (tmp_path / "9.csv").write_text("name,start frame,end frame\na,10,12\n")
    with pytest.raises(ValueError, match="frame duration"):
        readers.read_runs(spark, str(tmp_path / "9.csv"))


def test_unreadable_images_and_documents(spark, tmp_path):
    (tmp_path / "f.bmp").write_bytes(b"no image")
    assert [r.brightness for r in binary.read_frame_brightness(spark, str(tmp_path)).collect()] == [None]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "12_coordinates.json").write_text("{broken")
    with pytest.raises(Exception):
        readers.read_prompts(spark, str(tmp_path / "docs")).collect()
