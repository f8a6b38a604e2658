"""Which participants of a cohort are ready to be processed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from saccade.functions.numeric import fill_template, zero_padded_id

# States and reasons of the batch result.
SUCCESS, FAILED, SKIPPED = "SUCCESS", "FAILED", "SKIPPED"
REASON_NOT_LISTED = "Not in metadata"
REASON_NO_PROMPT = "Prompt file not found"
REASON_NO_FRAMES = "Frame extraction failed"


def select_range(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select("id", zero_padded_id(F.col("id")).alias("participant_id"))


def select_ids(ids: DataFrame, column: str) -> DataFrame:
    return ids.select(F.col(column).cast("long").alias("id"), zero_padded_id(F.col(column)).alias("participant_id"))


def first_metadata(metadata: DataFrame, seq: str) -> DataFrame:
    """The first row of each id."""
    return metadata.groupBy("id").agg(F.min_by(F.struct("start_frame", "end_frame"), seq).alias("row")).select(
        "id", "row.start_frame", "row.end_frame")


def with_frame_ranges(cohort: DataFrame, metadata: DataFrame, seq: str = "seq") -> DataFrame:
    return cohort.join(first_metadata(metadata, seq), "id", "left")


def with_prompt_flag(cohort: DataFrame, prompt_files: DataFrame, template: str) -> DataFrame:
    """Adds prompt_file and whether it is listed in ``prompt_files`` (column path)."""
    named = cohort.withColumn("prompt_file", fill_template(template, F.col("participant_id")))
    known = prompt_files.select(F.col("path").alias("prompt_file")).distinct().withColumn("_known", F.lit(True))
    return named.join(known, "prompt_file", "left").withColumn("has_prompt", F.col("_known").isNotNull()).drop("_known")


def frames_available(has_files: Column, has_folder: Column, extraction_enabled: bool, video_pattern: str,
                     has_video: Column) -> Column:
    """Whether frames are there or can be made from a video.

    An existing folder without files passes where no video pattern is set, and needs the video otherwise.
    """
    usable = has_video if video_pattern.strip() else F.lit(True)
    possible = usable if extraction_enabled else has_folder & usable
    return F.coalesce(has_files | possible, F.lit(False))


def frame_counts(catalogue: DataFrame) -> DataFrame:
    """Number of frame files per participant."""
    return catalogue.groupBy("id").agg(F.count(F.lit(1)).alias("n_files"))


def with_frame_counts(cohort: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Adds n_files and the last frame of the run: file count less one, or the length of the listed range."""
    counted = cohort.join(frame_counts(catalogue), "id", "left").withColumn("n_files", F.coalesce("n_files", F.lit(0)))
    return counted.withColumn("last_frame", F.when(F.col("n_files") > 0, F.col("n_files") - 1).otherwise(
        F.col("end_frame") - F.col("start_frame")))


def readiness(cohort: DataFrame, metadata: DataFrame, prompt_files: DataFrame, catalogue: DataFrame,
              videos: DataFrame, template: str, extraction_enabled: bool = True, video_pattern: str = "",
              seq: str = "seq", folders: DataFrame | None = None) -> DataFrame:
    """State of each participant: metadata first, then the prompt, then the frames.

    ``folders`` lists the ids that have a frame folder, be it empty; without it those with frame files are taken to.
    """
    listed = with_prompt_flag(with_frame_ranges(cohort, metadata, seq), prompt_files, template)
    counted = with_frame_counts(listed, catalogue)
    filmed = counted.join(videos.select("id").distinct().withColumn("_video", F.lit(True)), "id", "left")
    has_folder = F.col("n_files") > 0
    if folders is not None:
        filmed = filmed.join(folders.select("id").distinct().withColumn("_folder", F.lit(True)), "id", "left")
        has_folder = has_folder | F.col("_folder").isNotNull()
    frames = frames_available(F.col("n_files") > 0, has_folder, extraction_enabled, video_pattern,
                              F.col("_video").isNotNull())
    reason = (
        F.when(F.col("start_frame").isNull(), REASON_NOT_LISTED)
        .when(~F.col("has_prompt"), REASON_NO_PROMPT)
        .when(~frames, REASON_NO_FRAMES)
        .otherwise("")
    )
    return filmed.select(
        "participant_id", F.when(reason == "", SUCCESS).when(reason == REASON_NOT_LISTED, SKIPPED).otherwise(FAILED).alias("status"),
        reason.alias("details"), "start_frame", "end_frame", "n_files", "last_frame")


def batch_report(results: DataFrame) -> DataFrame:
    """Totals, whole percent of successes and exit flag in one row."""
    def number(state: str) -> Column:
        return F.count(F.when(F.col("status") == state, 1))

    return results.agg(
        F.count(F.lit(1)).alias("total"), number(SUCCESS).alias("successful"), number(FAILED).alias("failed"),
        number(SKIPPED).alias("skipped")
    ).withColumn("success_percent", F.floor(F.lit(100) * F.col("successful") / F.greatest("total", F.lit(1)))).withColumn(
        "exit_code", F.when(F.col("failed") == 0, 0).otherwise(1))


def rerun_list(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == FAILED).select("participant_id", "details")
