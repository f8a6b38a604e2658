"""Click prompts: tables, documents, objects and the frames they concern.

A prompt row has participant_id, seq (input order), label, frame, x, y and positive.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from saccade.operators.batches import whole_groups
from saccade.operators.ordered import FRAMES_PER_CHUNK, frame_chunk, numbered, ranked
from saccade.schemas import PROMPT_DOCUMENT
from saccade.session import cut_lineage

# Clicks of one document; a participant with more gets several documents (column part).
CLICKS_PER_DOCUMENT = 10000
_SEQ_CHUNK = 65536
# Shares that the frames of a participant are dealt to when objects are filled in.
FILL_SHARES = 16


def prompt_json(prompts: DataFrame, labels: Sequence[str], clicks_per_document: int = CLICKS_PER_DOCUMENT) -> DataFrame:
    """Prompt documents: participant_id, part, json. Labels come in list order, unlisted and empty ones not.

    Each part lists all labels of its participant, those it has no clicks of with an empty list, so a label has the
    same place, and thus the same object number, in every part.
    """
    order = {label: place for place, label in reversed(list(enumerate(labels)))}
    place = F.lit(None).cast("int")
    for label, at in order.items():
        place = F.when(F.col("label") == label, at).otherwise(place)
    listed = prompts.withColumn("_label_place", place).filter(F.col("_label_place").isNotNull())
    numbered = ranked(listed, ["participant_id"], ["seq"], frame_chunk(F.col("seq"), _SEQ_CHUNK), "_rank")
    click = F.struct("x", "y", "positive", "label", "frame")
    parts = (
        numbered.withColumn("part", F.floor((F.col("_rank") - 1) / F.lit(clicks_per_document)))
        .groupBy("participant_id", "part", "label")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", click.alias("click")))), lambda c: c["click"]).alias("clicks"))
        .groupBy("participant_id", "part").agg(F.map_from_entries(F.collect_list(F.struct("label", "clicks"))).alias("_clicks"))
    )
    none = F.array().cast(parts.schema["_clicks"].dataType.valueType)
    present = listed.groupBy("participant_id").agg(
        F.sort_array(F.collect_set(F.struct("_label_place", "label"))).alias("_present"))
    return parts.join(present, "participant_id").select("participant_id", "part", F.to_json(F.map_from_entries(F.transform(
        "_present", lambda e: F.struct(e["label"], F.coalesce(F.try_element_at("_clicks", e["label"]), none))))).alias("json"))


def parse_prompt_json(documents: DataFrame, column: str = "json") -> DataFrame:
    """Rows of prompt documents: other columns, label_ord (order of labels in the document), click_ord, click.

    A document that can't be parsed is an error.
    """
    parsed = documents.withColumn("_labels", F.map_entries(F.from_json(column, PROMPT_DOCUMENT, {"mode": "FAILFAST"}))).drop(column)
    entries = parsed.select("*", F.posexplode("_labels").alias("label_ord", "_entry")).drop("_labels")
    clicks = entries.select("*", F.posexplode("_entry.value").alias("click_ord", "_click"))
    return clicks.select(
        *[c for c in documents.columns if c != column], "label_ord", F.col("_entry.key").alias("label"), "click_ord",
        "_click.x", "_click.y", "_click.positive", "_click.frame")


def label_ids(documents: DataFrame, column: str = "json") -> DataFrame:
    """Object numbers of the labels of a document, in document order."""
    keys = F.map_keys(F.from_json(column, PROMPT_DOCUMENT, {"mode": "FAILFAST"}))
    return documents.select(
        *[c for c in documents.columns if c != column], F.posexplode(keys).alias("object_id", "label"))


def effective_prompts(prompts: DataFrame) -> DataFrame:
    """The last click of each label and frame; earlier ones are replaced by it."""
    return prompts.groupBy("participant_id", "label", "frame").agg(
        F.max_by(F.struct("seq", "x", "y", "positive"), "seq").alias("last")
    ).select("participant_id", "label", "frame", "last.seq", "last.x", "last.y", "last.positive")


def undo_last_click(prompts: DataFrame, frames: DataFrame) -> DataFrame:
    """Drops the latest click on each of the given frames (participant_id, frame)."""
    last = prompts.groupBy("participant_id", "frame").agg(F.max("seq").alias("seq")).join(
        frames.select("participant_id", "frame").distinct(), ["participant_id", "frame"], "left_semi")
    return prompts.join(last, ["participant_id", "frame", "seq"], "left_anti")


def click_counts(prompts: DataFrame) -> DataFrame:
    """Clicks per frame, and in total per participant."""
    per_frame = prompts.groupBy("participant_id", "frame").agg(F.count(F.lit(1)).alias("frame_clicks"))
    total = prompts.groupBy("participant_id").agg(F.count(F.lit(1)).alias("total_clicks"))
    return per_frame.join(total, "participant_id")


def dense_object_ids(prompts: DataFrame) -> DataFrame:
    """Numbers the labels of each participant from 0 in order of first appearance."""
    first = prompts.groupBy("participant_id", "label").agg(F.min("seq").alias("first_seq"))
    numbered = ranked(first, ["participant_id"], ["first_seq"], frame_chunk(F.col("first_seq"), _SEQ_CHUNK), "_rank")
    return numbered.select("participant_id", "label", (F.col("_rank") - 1).alias("object_id"))


def remove_objects(objects: DataFrame, removed: DataFrame) -> DataFrame:
    """Drops objects (participant_id, label) and closes the gaps in the numbering."""
    left = objects.join(removed.select("participant_id", "label"), ["participant_id", "label"], "left_anti")
    numbered = ranked(left, ["participant_id"], ["object_id"], frame_chunk(F.col("object_id")), "_rank")
    return numbered.select("participant_id", "label", F.col("object_id").alias("old_object_id"),
                           (F.col("_rank") - 1).alias("object_id"))


def clear_prompts(prompts: DataFrame, keys: DataFrame) -> DataFrame:
    """Drops all clicks of the given (participant_id, label, frame)."""
    return prompts.join(keys.select("participant_id", "label", "frame"), ["participant_id", "label", "frame"], "left_anti")


def append_points(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds point rows after the existing ones of each key; batch and seq give the order within it."""
    both = old.withColumn("batch", F.lit(0)).unionByName(new.withColumn("batch", F.lit(1)))
    chunk = F.struct(F.col("batch"), frame_chunk(F.col("seq"), _SEQ_CHUNK))
    numbered = ranked(both, keys, ["batch", "seq"], chunk, "_rank")
    return numbered.withColumn("point", F.col("_rank") - 1).drop("_rank")


def tracked_frames(prompts: DataFrame, sizes: DataFrame, start: Column | None = None, limit: int | None = None,
                   reverse: bool = False) -> DataFrame:
    """Frames that tracking visits, numbered in visiting order.

    It starts at the earliest prompted frame unless ``start`` is given. ``sizes`` has participant_id and
    num_frames. Backwards from frame 0 there is nothing to visit.
    """
    first = prompts.groupBy("participant_id").agg(F.min("frame").alias("first_frame"))
    known = first.join(sizes, "participant_id").withColumn("_start", F.col("first_frame") if start is None else start)
    reach = F.col("num_frames") if limit is None else F.lit(limit)
    if reverse:
        visits = known.filter(F.col("_start") > 0).withColumn("_end", F.greatest(F.col("_start") - reach, F.lit(0)))
        path = F.sequence(F.col("_start"), F.col("_end"), F.lit(-1))
    else:
        visits = known.withColumn("_end", F.least(F.col("_start") + reach, F.col("num_frames") - 1)).filter(
            F.col("_end") >= F.col("_start"))
        path = F.sequence("_start", "_end")
    return visits.select("participant_id", F.posexplode(path).alias("step", "frame"))


def _carried_marks(marks: DataFrame, spots: DataFrame, k: int) -> DataFrame:
    """The k prompted frames next before and next after each chunk (participant_id, chunk) of ``spots``, one row each.

    A chunk that has prompts tells its first and last k; only these short lists go along the chunks of a participant."""
    key = ["participant_id", "chunk"]
    ends = marks.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("frame", "seq"))).alias("all")).select(
        *key, F.slice("all", 1, k).alias("first"), F.slice("all", F.greatest(F.size("all") - k + 1, F.lit(1)), F.lit(k)).alias("last"))
    along = Window.partitionBy("participant_id").orderBy("chunk")
    behind = F.flatten(F.collect_list("last").over(along.rowsBetween(1 - k, 0)))
    ahead = F.flatten(F.collect_list("first").over(along.rowsBetween(0, k - 1)))
    known = ends.select(*key, F.slice(behind, F.greatest(F.size(behind) - k + 1, F.lit(1)), F.lit(k)).alias("behind"), F.slice(ahead, 1, k).alias("ahead"))
    every = spots.join(known, key, "full")
    none = F.array().cast("array<struct<frame:int,seq:bigint>>")
    before = F.last("behind", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("ahead", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    lists = every.select(*key, F.concat(F.coalesce(before, none), F.coalesce(after, none)).alias("list"))
    return lists.select(*key, F.explode("list").alias("m")).select(*key, "m.frame", "m.seq")


def _nearest_of(frames: np.ndarray, marks: np.ndarray, seq: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``frames``, prompted frame): up to k for each; ``marks`` are sorted and different."""
    before = np.searchsorted(marks, frames)
    near = before[:, None] + np.arange(-k, k)
    row, slot = np.nonzero((near >= 0) & (near < len(marks)))
    near = near[row, slot]
    order = np.lexsort((seq[near], np.abs(marks[near] - frames[row]), ~np.isin(slot, (k - 1, k)), row))
    row, near = row[order], near[order]
    first = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1])
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row)))) if len(row) else row
    return row[place < k], marks[near[place < k]]


def nearest_prompts(frames: DataFrame, prompts: DataFrame, k: int, chunk_frames: int = FRAMES_PER_CHUNK) -> DataFrame:
    """Up to ``k`` prompted frames for each frame: the closest before, the closest at or after, then the nearest others.

    Frames and prompted frames meet in chunks of frames, to which the k prompted frames next before and after are carried; a
    chunk holds at most ``chunk_frames`` frames, so one participant may have any number of them. Equal distances go to the
    prompt given first; ``seq`` is a whole number.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    chunk = frame_chunk(F.col("frame"), chunk_frames).alias("chunk")
    key = ["participant_id", "chunk"]
    marks = cut_lineage(prompts.groupBy("participant_id", F.col("frame").cast("int").alias("frame")).agg(F.min("seq").cast("long").alias("seq")).select(
        "participant_id", chunk, "frame", "seq"))
    wanted = cut_lineage(frames.select("participant_id", F.col("frame").cast("int").alias("frame")).distinct().select("participant_id", chunk, "frame"))
    carried = _carried_marks(marks, wanted.select(*key).distinct(), k)
    rows = wanted.withColumn("seq", F.lit(None).cast("long")).unionByName(marks).unionByName(carried.select(*key, "frame", "seq"))
    dealt = rows.repartition(*key).sortWithinPartitions(*key, "frame")

    def work(table: pa.Table, groups: np.ndarray) -> pa.Table:
        frame, is_mark = table.column("frame").to_numpy(), ~table.column("seq").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        seq = table.column("seq").fill_null(0).to_numpy()
        of, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ends = np.append(np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])), len(groups))
        for a, b in zip(ends[:-1], ends[1:]):
            asked, told = a + np.flatnonzero(~is_mark[a:b]), a + np.flatnonzero(is_mark[a:b])
            if len(asked) and len(told):
                row, near = _nearest_of(frame[asked].astype(np.int64), frame[told].astype(np.int64), seq[told], k)
                of.append(asked[row])
                found.append(near)
        of = pa.array(np.concatenate(of))
        return pa.table({"participant_id": table.column("participant_id").take(of), "frame": table.column("frame").take(of),
                         "prompt_frame": pa.array(np.concatenate(found).astype(np.int32))})

    kind = rows.schema["participant_id"].dataType.simpleString()
    return dealt.mapInArrow(whole_groups(key, work), f"participant_id {kind}, frame int, prompt_frame int")


def context_frames(frames: DataFrame, slots: int, stride: int = 1, reverse: bool = False) -> DataFrame:
    """Earlier frames that accompany each frame: the one next to it, then every ``stride``-th one.

    Out: participant_id, frame, slot (1 is the farthest), context_frame; only frames that exist.
    """
    if slots < 2 or stride < 1:
        raise ValueError("slots must be at least 2 and stride at least 1")
    sign = -1 if reverse else 1
    frame, back = F.col("frame"), F.col("back")
    if reverse:
        anchor = F.ceil((frame + 2) / F.lit(stride)) * stride
    else:
        anchor = F.floor((frame - 2) / F.lit(stride)) * stride
    context = F.when(back == 1, frame - sign).otherwise(anchor - (back - 2) * stride * sign)
    wanted = frames.select("participant_id", "frame", F.explode(F.sequence(F.lit(1), F.lit(slots - 1))).alias("back")).select(
        "participant_id", "frame", (F.lit(slots) - back).alias("slot"), context.cast("int").alias("context_frame"))
    there = frames.select("participant_id", F.col("frame").alias("context_frame"))
    return wanted.join(there, ["participant_id", "context_frame"], "left_semi").select(
        "participant_id", "frame", "slot", "context_frame")


def fill_missing_objects(frames: DataFrame, objects: DataFrame, layers: Sequence[DataFrame], default: float) -> DataFrame:
    """A score for every object of a participant in every frame.

    ``layers`` (participant_id, frame, object_id, score) are looked up in turn; the first that has the object
    wins, ``default`` stands where none has. One aggregate over all layers replaces a chain of joins.
    """
    stacked = layers[0].withColumn("layer", F.lit(0))
    for place, layer in enumerate(layers[1:], 1):
        stacked = stacked.unionByName(layer.withColumn("layer", F.lit(place)))
    key = ["participant_id", "frame", "object_id"]
    chosen = stacked.groupBy(*key).agg(F.min_by("score", "layer").alias("score"))
    # A participant's few objects go to each share of its frames, so that many frames of one participant are spread.
    salts = F.explode(F.sequence(F.lit(0), F.lit(FILL_SHARES - 1)))
    listed = objects.select("participant_id", "object_id", salts.alias("_share"))
    spread = frames.withColumn("_share", F.pmod(F.xxhash64("frame"), F.lit(FILL_SHARES)).cast("int"))
    grid = spread.join(listed, ["participant_id", "_share"]).drop("_share")
    return grid.join(chosen, key, "left").select(*key, F.coalesce("score", F.lit(default)).alias("score"))


def batch_ids(df: DataFrame, size: int, order: Sequence[str], chunk: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Numbers batches of ``size`` rows along ``order``."""
    if size < 1:
        raise ValueError("size must be at least 1")
    placed = ranked(df, list(keys), list(order), chunk, "_rank") if keys else numbered(df, list(order), "_rank")
    return placed.withColumn("batch", F.floor((F.col("_rank") - 1) / F.lit(size))).drop("_rank")
