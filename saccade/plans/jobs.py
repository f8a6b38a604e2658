"""End-user jobs: each is one plan over a whole cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from saccade.operators import cohort as C
from saccade.operators import mapping as G
from saccade.operators import prompts as P
from saccade.operators import sync as S
from saccade.operators.candidates import QualityOptions, mask_quality
from saccade.operators.metrics import summary_scores
from saccade.operators.runs import collapse_runs, file_events
from saccade.session import cut_lineage
from saccade.sources import readers, writers

__all__ = ["align_to_target", "cohort_readiness", "end_to_end", "fixation_metrics", "map_gaze_runs", "mask_quality",
           "prompt_objects", "QualityOptions", "run_fixation_metrics", "sync_recordings"]


def fixation_metrics(runs: DataFrame, fps: float, num_phases: int = 3, **options) -> DataFrame:
    """All metrics, wide, from fixation events."""
    return summary_scores(runs, fps, num_phases, **options)


def run_fixation_metrics(spark: SparkSession, source: str, target: str, fps: float = 30.0, num_phases: int = 3,
                         participant_id: str | None = None, cohort_source: bool = False,
                         partitioned: bool = True) -> DataFrame:
    """Run files to scores, kept as CSV and JSON. Returns the written scores.

    ``partitioned`` writes one folder per participant; a large cohort is better kept as one table.
    """
    if cohort_source:
        events = readers.read_cohort_runs(spark, source, fps)
    else:
        events = readers.read_runs(spark, source, fps, participant_id)
    scores = cut_lineage(fixation_metrics(events, fps, num_phases))
    writers.write_scores_csv(scores, f"{target.rstrip('/')}/csv", partitioned)
    writers.write_scores_json(scores, f"{target.rstrip('/')}/json", partitioned)
    return scores


def _rates(sessions: DataFrame, fps: float | None) -> DataFrame | None:
    return sessions.select("participant_id", "fps") if fps is None else None


def map_gaze_runs(sessions: DataFrame, gaze: DataFrame, masks: DataFrame | None, width: int | None = None, height: int | None = None,
                  fps: float | None = None, radius: int = 0, align: str = "frame", end_mode: str = "reference", **sources) -> DataFrame:
    """Gaze and masks to runs in file form. Sizes and rates not given are columns of ``sessions`` (width, height, fps).

    ``sources``: a kept index of the masks and who looks at which, see :func:`~saccade.operators.mapping.map_gaze`."""
    # Kept once: runs read the codes several times.
    codes = cut_lineage(G.map_gaze(sessions, gaze, masks, width, height, radius, align, **sources))
    return collapse_runs(codes, fps, end_mode, rates=_rates(sessions, fps))


def end_to_end(sessions: DataFrame, gaze: DataFrame, masks: DataFrame | None, width: int | None = None, height: int | None = None,
               fps: float | None = None, radius: int = 0, num_phases: int = 3, labels: Sequence[str] | None = None,
               align: str = "frame", end_mode: str = "inclusive", **sources) -> DataFrame:
    """Gaze and masks to metrics of the whole cohort in one plan.

    With ``end_mode`` ``half_open`` or ``reference`` the metrics read the runs as a run file holds them, whose ends lie behind
    the run; the chain of separate programs goes by position and ``reference``. Otherwise as in :func:`map_gaze_runs`."""
    codes, rates = cut_lineage(G.map_gaze(sessions, gaze, masks, width, height, radius, align, **sources)), _rates(sessions, fps)
    events = collapse_runs(codes, fps, end_mode, rates=rates)
    if end_mode != "inclusive":
        events = file_events(events, fps, rates)
    return summary_scores(events, fps, num_phases, labels=labels, rates=rates)


def sync_recordings(pairs: DataFrame, brightness: DataFrame, fps: float | Column, start_sec: float = S.SEARCH_FROM_SECONDS,
                    end_sec: float | None = None, threshold: float = S.DARK_BELOW) -> DataFrame:
    """Offset of each recording pair from the brightness of its frames; ``fps`` as in :func:`~saccade.operators.sync.lights_on`."""
    anchors = S.lights_on(brightness, fps, start_sec, end_sec, threshold)
    return S.sync_offsets(pairs, anchors, brightness.select("recording_id"))


def align_to_target(events: DataFrame, offsets: DataFrame, fps: float) -> DataFrame:
    """Event times (participant_id, t_sec) on the target's time line; pairs without an offset are left out."""
    anchors = offsets.filter(F.col("offset_sec").isNotNull()).select(
        "participant_id", F.col("reference_lights_on_sec").alias("source_sec"),
        F.col("target_lights_on_sec").alias("anchor_sec"))
    return S.align_events(events, anchors, fps)


def cohort_readiness(cohort: DataFrame, metadata: DataFrame, prompt_files: DataFrame, catalogue: DataFrame,
                     videos: DataFrame, template: str, **options) -> tuple[DataFrame, DataFrame]:
    """State of each participant, and the report over all."""
    states = C.readiness(cohort, metadata, prompt_files, catalogue, videos, template, **options)
    return states, C.batch_report(states)


def prompt_objects(documents: DataFrame) -> DataFrame:
    """The effective click of each object and frame, with object numbers, from prompt documents."""
    clicks = P.parse_prompt_json(documents).withColumn(
        "seq", F.struct("part", "label_ord", "click_ord") if "part" in documents.columns else F.struct("label_ord", "click_ord"))
    numbers = clicks.groupBy("participant_id", "label").agg(F.min("label_ord").alias("object_id"))
    return P.effective_prompts(clicks).drop("seq").join(numbers, ["participant_id", "label"])
