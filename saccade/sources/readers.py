"""Scans of run, gaze, pair, metadata and prompt files, and of frame catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from saccade.functions.numeric import check_fps
from saccade.operators.ordered import ranked
from saccade.operators.prompts import parse_prompt_json
from saccade.operators.runs import fixation_events
from saccade.schemas import RECORDING_PAIRS

# File endings taken as frames.
FRAME_ENDINGS = ("jpg", "jpeg", "png", "bmp")

# Columns of a run file that are read.
RUN_COLUMNS_READ = ["name", "frame duration", "start frame", "end frame"]


def file_stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"\.[^.]*$", "")


def file_order() -> Column:
    """A value that orders the rows of a scan as they stand: by file, by the piece of the file, and by the place in the piece.

    Pieces of one file may be read in any order and by any task; rows of one piece are numbered in turn by the task that
    reads it."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("place"))


def _by_header(spark: SparkSession, path: str, needed: list[str]) -> DataFrame:
    """All columns of files with a header, as text, under their own names in whatever order they stand.

    An error if a needed column is missing or the header of one file differs from another's. Folder columns stay text.
    """
    header = spark.read.option("header", True).csv(path).columns
    missing = [name for name in needed if name not in header]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    schema = StructType([StructField(name, StringType()) for name in header])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def _run_columns() -> list[Column]:
    return [F.trim("name").alias("aoi_name"), F.col("frame duration").cast("int").alias("duration_frames"),
            F.col("start frame").cast("int").alias("start_frame"), F.col("end frame").cast("int").alias("end_frame")]


def read_runs(spark: SparkSession, path: str, fps: float = 30.0, participant_id: str | None = None) -> DataFrame:
    """Fixation events from run files; the participant is the file name's stem unless given."""
    check_fps(fps)
    raw = _by_header(spark, path, RUN_COLUMNS_READ)
    who = F.lit(participant_id) if participant_id is not None else file_stem(F.col("_metadata.file_name"))
    return fixation_events(raw.select(who.alias("participant_id"), *_run_columns()), fps)


def read_cohort_runs(spark: SparkSession, path: str, fps: float = 30.0) -> DataFrame:
    """Fixation events of many participants; participant_id is a folder name or a column."""
    raw = _by_header(spark, path, [*RUN_COLUMNS_READ, "participant_id"])
    return fixation_events(raw.select("participant_id", *_run_columns()), fps)


def read_gaze(spark: SparkSession, path: str, columns: dict[str, str] | None = None,
              participant_id: Column | None = None, sample_seq: str | None = None) -> DataFrame:
    """Gaze samples from files with a header.

    x and y are the fourth and fifth column unless ``columns`` maps norm_x, norm_y or world_index to names.
    ``sample_seq`` names a column with the sample order; without it rows are in file order, also where a file is read in
    several pieces.
    """
    raw = spark.read.option("header", True).csv(path)
    names = {"world_index": "world_index", "norm_x": raw.columns[3], "norm_y": raw.columns[4], **(columns or {})}
    seq = F.col(f"`{sample_seq}`").cast("long") if sample_seq else file_order()
    who = participant_id if participant_id is not None else file_stem(F.col("_metadata.file_name"))

    def number(name: str, kind: str) -> Column:
        text = F.col(f"`{names[name]}`")
        return F.when(F.trim(text) == "", None).otherwise(text).cast(kind).alias(name)

    return raw.select(who.alias("participant_id"), seq.alias("sample_seq"), number("world_index", "int"),
                      number("norm_x", "double"), number("norm_y", "double"))


def read_recording_pairs(spark: SparkSession, path: str) -> DataFrame:
    raw = _by_header(spark, path, RECORDING_PAIRS.names)
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in RECORDING_PAIRS])


def read_frame_ranges(spark: SparkSession, path: str) -> DataFrame:
    """id, start_frame, end_frame and seq (file order); the id column is Participant_ID or ID."""
    raw = spark.read.option("header", True).csv(path)
    if "Participant_ID" in raw.columns:
        name = "Participant_ID"
    elif "ID" in raw.columns:
        name = "ID"
    else:
        raise ValueError("frame ranges need a column Participant_ID or ID")
    return raw.select(
        F.col(name).cast("long").alias("id"), F.col("Start_Frame").cast("int").alias("start_frame"),
        F.col("End_Frame").cast("int").alias("end_frame"), file_order().alias("seq"))


def read_prompts(spark: SparkSession, path: str, suffix: str = "_coordinates") -> DataFrame:
    """Prompt rows from one document per file, <participant><suffix>.json."""
    texts = spark.read.text(path, wholetext=True)
    who = F.regexp_replace(file_stem(F.col("_metadata.file_name")), f"{suffix}$", "")
    return parse_prompt_json(texts.select(who.alias("participant_id"), F.col("value").alias("json")))


def frame_catalogue(files: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Frame files of each key in numeric order: keys, path, stem, frame_number, position (from 0).

    Files whose stem is not a number come after the numbered ones, by name.
    """
    ending = F.lower(F.regexp_extract(F.col(path), r"\.([^./]*)$", 1))
    frames = files.filter(ending.isin(*FRAME_ENDINGS)).withColumn("stem", file_stem(F.col(path)))
    number = F.when(F.col("stem").rlike("^[0-9]+$"), F.col("stem")).try_cast("long")
    chunk = F.struct(F.isnull("frame_number"), F.coalesce(F.floor(F.col("frame_number") / 16384), F.lit(0)),
                     F.when(F.isnull("frame_number"), F.substring("stem", 1, 4)).otherwise(""))
    placed = frames.withColumn("frame_number", number).withColumn("_late", F.isnull("frame_number"))
    numbered = ranked(placed, keys, ["_late", "frame_number", "stem", path], chunk, "_rank")
    return numbered.select(*keys, path, "stem", "frame_number", (F.col("_rank") - 1).alias("position"))


def list_frame_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the frame files under ``path``; the bytes are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select("path", "modificationTime", "length")
