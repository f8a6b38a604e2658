"""Explicit schemas of the tables the operators read and write."""

from pyspark.sql import types as T

GAZE_SAMPLES = T.StructType([
    T.StructField("participant_id", T.StringType()),
    T.StructField("sample_seq", T.LongType()),
    T.StructField("world_index", T.IntegerType()),
    T.StructField("norm_x", T.DoubleType()),
    T.StructField("norm_y", T.DoubleType()),
])

FRAME_CODES = T.StructType([
    T.StructField("participant_id", T.StringType()),
    T.StructField("frame", T.IntegerType()),
    T.StructField("framenum", T.IntegerType()),
    T.StructField("code", T.StringType()),
])

# Fixed column names of the run file, in file order.
RUN_FILE_COLUMNS = [
    "name", "frame duration", "start frame", "end frame",
    "duration (s)", "start (s)", "end (s)",
]

RUN_FILE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("frame duration", T.IntegerType()),
    T.StructField("start frame", T.IntegerType()),
    T.StructField("end frame", T.IntegerType()),
    T.StructField("duration (s)", T.DoubleType()),
    T.StructField("start (s)", T.DoubleType()),
    T.StructField("end (s)", T.DoubleType()),
])

FIXATION_EVENTS = T.StructType([
    T.StructField("participant_id", T.StringType()),
    T.StructField("aoi_name", T.StringType()),
    T.StructField("duration_ms", T.DoubleType()),
    T.StructField("duration_frames", T.IntegerType()),
    T.StructField("timestamp_ms", T.DoubleType()),
    T.StructField("start_frame", T.IntegerType()),
    T.StructField("end_frame", T.IntegerType()),
])

RECORDING_PAIRS = T.StructType([
    T.StructField("participant_id", T.StringType()),
    T.StructField("reference_video", T.StringType()),
    T.StructField("target_video", T.StringType()),
])

SYNC_RESULTS = T.StructType([
    T.StructField("participant_id", T.StringType()),
    T.StructField("reference_lights_on_sec", T.DoubleType()),
    T.StructField("target_lights_on_sec", T.DoubleType()),
    T.StructField("offset_sec", T.DoubleType()),
    T.StructField("notes", T.StringType()),
])

BRIGHTNESS = T.StructType([
    T.StructField("recording_id", T.StringType()),
    T.StructField("frame", T.IntegerType()),
    T.StructField("ts_sec", T.DoubleType()),
    T.StructField("brightness", T.DoubleType()),
])

CLICK = T.StructType([
    T.StructField("x", T.IntegerType()),
    T.StructField("y", T.IntegerType()),
    T.StructField("positive", T.IntegerType()),
    T.StructField("label", T.StringType()),
    T.StructField("frame", T.IntegerType()),
])

PROMPT_DOCUMENT = T.MapType(T.StringType(), T.ArrayType(CLICK))

MASK_RLE = T.StructType([
    T.StructField("participant_id", T.StringType()),
    T.StructField("frame", T.IntegerType()),
    T.StructField("label_ord", T.IntegerType()),
    T.StructField("label", T.StringType()),
    T.StructField("h", T.IntegerType()),
    T.StructField("w", T.IntegerType()),
    T.StructField("counts", T.ArrayType(T.IntegerType())),
])
